"""Sum-of-squares online packing (operator 2).

Windows of fixed capacity fill up online: a document goes, as one piece, where the sum over fill levels of the squared number of windows at
that level grows least. Only the counts by level decide, so the state is one array of counts and, by level, a stack of open windows.
Documents longer than a window give whole windows first, and their rest is placed. When a task has read its rows, or open windows hold more
tokens than a fixed budget, the open windows are drained: the fullest are topped up by cuts from the emptiest, and the last rest leaves in
sequences of powers of two, which need no padding.

Each partition of the input packs its own documents, so nothing is shuffled and a lost task is simply run again; sequence ids hold the
partition's number. A null text counts as empty and has the end token alone. Repeated rows are packed each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from touchline.llm.bpe import Known, Words, packed
from touchline.llm.common import spark_schema

CAPACITY = 4096
END_ID = 2
#: Sequences of a task at most; its number is above in the ids.
PER_TASK = 1 << 36
#: Tokens that open windows hold before they are drained.
OPEN_TOKENS = 1 << 22


@dataclass(frozen=True)
class Piece:
    doc: tuple[int | None, int]  # id and length of the document
    start: int
    ids: np.ndarray


class Packer:
    """Documents in, pairs of (pieces of a sequence, its number) out."""

    def __init__(self, capacity: int = CAPACITY, open_tokens: int = OPEN_TOKENS):
        self.capacity, self.most = capacity, open_tokens
        self.levels = np.zeros(capacity + 1, np.int64)  # open windows at each fill; none at 0, and full ones are gone
        self.windows: list[list[list[Piece]]] = [[] for _ in range(capacity)]
        self.open_tokens = 0

    def level_for(self, size: int) -> int:
        """The fill to put a piece on (0: a new window) so that the sum of squares grows least; ties: the fullest."""
        top = self.capacity - size
        here = self.levels[: top + 1]
        after = self.levels[size:]
        growth = 2 * (after - here) + 2
        growth[top] = 1 - 2 * here[top]  # it is full and leaves
        growth[0] = 2 * self.levels[size] + 1 if size < self.capacity else 0
        growth[1:][here[1:] == 0] = np.iinfo(np.int64).max
        return int(top - np.argmin(growth[::-1]))

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[Piece]]:
        doc, whole = (doc_id, len(ids)), len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            yield [Piece(doc, start, ids[start : start + self.capacity])]
        size = len(ids) - whole
        if not size:
            return
        level = self.level_for(size)
        window = self.windows[level].pop() if level else []
        if level:
            self.levels[level] -= 1
        window.append(Piece(doc, whole, ids[whole:].copy()))
        if level + size == self.capacity:
            self.open_tokens -= level
            yield window
            return
        self.levels[level + size] += 1
        self.windows[level + size].append(window)
        self.open_tokens += size
        if self.open_tokens > self.most:
            yield from self.drain()

    def drain(self) -> Iterator[list[Piece]]:
        """All open windows: full ones by cutting the emptiest, then powers of two."""
        queue = [(level, w) for level in range(self.capacity) for w in self.windows[level]]  # emptiest first
        pieces = [p for _, w in queue for p in w]
        at = 0  # pieces before it have gone from the emptiest windows
        rest: list[Piece] = []
        while queue and at < len(pieces):
            level, window = queue.pop()
            if len(pieces) - at <= len(window):
                break
            del pieces[len(pieces) - len(window) :]
            need = self.capacity - level
            while need and at < len(pieces):
                cut, left = self._cut(pieces[at], need)
                window.append(cut)
                need -= len(cut.ids)
                if left:
                    pieces[at] = left
                else:
                    at += 1
            if need:
                rest = window
                break
            yield window
        yield from self._powers([*rest, *pieces[at:]])
        self.levels[:] = 0
        self.windows = [[] for _ in range(self.capacity)]
        self.open_tokens = 0

    def _cut(self, piece: Piece, size: int) -> tuple[Piece, Piece | None]:
        if len(piece.ids) <= size:
            return piece, None
        return Piece(piece.doc, piece.start, piece.ids[:size]), Piece(piece.doc, piece.start + size, piece.ids[size:])

    def _powers(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        total = sum(len(p.ids) for p in pieces)
        pieces = pieces[::-1]
        while total:
            size = min(self.capacity, 1 << total.bit_length() - 1)
            total -= size
            sequence = []
            while size:
                cut, left = self._cut(pieces.pop(), size)
                sequence.append(cut)
                size -= len(cut.ids)
                if left:
                    pieces.append(left)
            yield sequence


#: Bytes of the cache of words, in a Python worker.
CACHED = 48 << 20


class LibraryEncoder:
    """Ids of the tokenizers library: its BPE model is asked for each word, and words that come again are taken from a bounded cache. How text is
    cut into words is the tokenizer file's pattern."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.v = Words(path)
        model = Tokenizer.from_file(path).model
        self.word = Known(lambda w: packed(t.id for t in model.tokenize(self.v.symbols(w))), CACHED)

    def encode(self, text: str) -> np.ndarray:
        found = (packed([self.v.special[p]]) if special else b"".join(map(self.word.__getitem__, self.v.words(p))) for special, p in self.v.pieces(text))
        return np.frombuffer(b"".join(found), "<u4")


@cache
def library_encoder(path: str) -> LibraryEncoder:
    """One a Python worker, whose later tasks find its cache warm."""
    return LibraryEncoder(path)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of docs(doc_id, text, ...): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. No shuffle."""

    def run(batches):
        encoder, packer = library_encoder(path), Packer(capacity)
        number = TaskContext.get().partitionId() * PER_TASK
        rows: list[tuple] = []

        def put(sequence):
            nonlocal number
            offset = 0
            for p in sequence:
                rows.append((p.doc[0], p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.doc[1], number, offset))
                offset += len(p.ids)
            number += 1

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)
            rows.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(encoder.encode(text.as_py() or ""), np.uint32(END_ID))
                for sequence in packer.add(doc_id, ids):
                    put(sequence)
                if len(rows) > 10_000:
                    yield batch()
        for sequence in packer.drain():
            put(sequence)
        if rows:
            yield batch()

    return docs.select("doc_id", "text").mapInArrow(run, spark_schema(SCHEMA))
