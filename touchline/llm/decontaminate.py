"""Benchmark decontamination (operator 11): windows of test items, found in documents word by word.

Letters A-Z are lower-cased; words are runs of digits, letters and whatever isn't ASCII. A window is ten consecutive words of an item; an item
of fewer words, but not none, is one window. The windows, each once, are a hash set that every executor gets: sorted 64-bit hashes, a bitmap
before them, the windows' bytes for verifying a hit, and the items of each window. A task tokenises a batch of documents on their UTF-8 bytes in
numpy (a character that isn't ASCII is bytes of 128 and more, so classes of bytes decide), hashes all windows of the batch at once, looks them up
and compares bytes where a hash is met. Documents pass through in pieces of PIECE_BYTES; nine words are carried from one piece to the next.

The set is broadcast only up to MOST_WINDOWS pairs of window and item and MOST_BYTES. A larger benchmark is split by hashes of windows into blocks
under that bound; each block is broadcast and scanned on its own, and what the blocks find of a document is united by a shuffle of hits alone.

Rows: a null text has no words. Each row of documents gives one row; rows with the same or a null id are scanned alone. A null item text has no
words; items with one id count once; an item with a null id marks words but is not counted as an item. An empty benchmark hits nothing. Empty
documents: empty result. Other columns may have any name: only doc_id, text, item_id and those named in keep are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import checkpointed, unused

WINDOW = 10
PIECE_BYTES = 1 << 19
#: Of one broadcast: pairs of window and item, and bytes of window texts.
MOST_WINDOWS, MOST_BYTES = 500_000, 64 << 20

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
# Fixed odd multipliers, from the digits of the golden ratio and of the square root of two.
STEP, SALT = 0x9E3779B97F4A7C15, 0x6A09E667F3BCC909


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(SALT)
    return x ^ (x >> np.uint64(29))


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), base, np.uint64), dtype=np.uint64)])[:n]


class Words:
    """The words of some UTF-8 bytes: begin and end as places of bytes, and a hash each. No word crosses a place in cuts."""

    powers, back = _powers(PIECE_BYTES + 1, STEP), _powers(PIECE_BYTES + 1, pow(STEP, -1, 1 << 64))

    def __init__(self, raw: bytes, cuts: np.ndarray):
        self.raw = raw.translate(LOWER)
        data = np.frombuffer(self.raw, np.uint8)
        mask = IN_WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[cuts] = True
        first, last = mask.copy(), mask.copy()
        first[1:] &= ~mask[:-1] | edge[1:-1]
        last[:-1] &= ~mask[1:] | edge[1:-1]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        n = len(data)
        if n >= len(Words.powers):  # a piece with a word longer than PIECE_BYTES
            Words.powers, Words.back = _powers(2 * n, STEP), _powers(2 * n, pow(STEP, -1, 1 << 64))
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Words.powers[:n], out=sums[1:])
            self.hash = _mix((sums[self.end] - sums[self.begin]) * Words.back[self.begin])

    def __getitem__(self, k: int) -> bytes:
        return self.raw[self.begin[k] : self.end[k]]


def window_hashes(words: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length, ascending: the hash of the window at every word from which there are so many."""
    total, done = np.zeros(len(words), np.uint64), 0
    with np.errstate(over="ignore"):
        for length in lengths:
            for k in range(done, length):
                n = max(len(words) - k, 0)
                total = total[:n] + _mix(words[k : k + n] + np.uint64((k + 1) * STEP & (1 << 64) - 1))
            done = length
            yield length, total


def pieces(texts: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Bytes of about PIECE_BYTES, and what they hold: (which text, where it begins here, where this begins in the text). Long texts are cut between
    words, so a piece is longer only where one word is."""
    held, spans, size = [], [], 0
    for number, text in enumerate(texts):
        at = 0
        while True:
            end = len(text) if len(text) - at <= PIECE_BYTES else _cut(text, at + PIECE_BYTES)
            if held and size + end - at > PIECE_BYTES:
                yield b"".join(held), spans
                held, spans, size = [], [], 0
            held.append(text[at:end])
            spans.append((number, size, at))
            size += end - at
            at = end
            if at >= len(text):
                break
    if held:
        yield b"".join(held), spans


def _cut(text: bytes, at: int) -> int:
    """The first place from at on before which there is no word."""
    while at < len(text) and IN_WORD[text[at - 1] if not 65 <= text[at - 1] <= 90 else 97]:
        at += 1
    return at


def item_windows(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(which text, words, the window's words joined by blanks) of every window, in order; of a long text as it goes."""
    carry: dict[int, list[bytes]] = {}
    slid = set()
    for raw, spans in pieces(texts):
        words = Words(raw, np.array([b for _, b, _ in spans]))
        bounds = np.searchsorted(words.begin, [b for _, b, _ in spans] + [len(raw)])
        for (number, _, _), lo, hi in zip(spans, bounds[:-1], bounds[1:], strict=True):
            for k in range(lo, hi):
                line = carry.setdefault(number, [])
                line.append(words[k])
                if len(line) == WINDOW:
                    slid.add(number)
                    yield number, WINDOW, b" ".join(line)
                    line.pop(0)
    for number, line in carry.items():
        if line and number not in slid:
            yield number, len(line), b" ".join(line)


WINDOWS = pa.schema([("item", pa.string()), ("words", pa.int32()), ("window", pa.string()), ("part", pa.int64())])


def _item_rows(batches):
    for batch in batches:
        ids = batch.column(0).to_pylist()
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        rows = []
        for number, words, window in item_windows(texts):
            part = int.from_bytes(hashlib.blake2b(window, digest_size=7).digest(), "big")
            rows.append((ids[number], words, window.decode("utf-8", "surrogatepass"), part))
            if len(rows) == 4096:
                yield _record(rows, WINDOWS)
                rows = []
        if rows:
            yield _record(rows, WINDOWS)


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item (string), words, window, part (a hash of window): each window of an item once."""
    rows = benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(_item_rows, "item string, words int, window string, part long")
    return rows.dropDuplicates(["item", "window"])


@dataclass
class WindowSet:
    """Windows by hash. windows[k] is the k-th window's bytes in the order of hashes; its items are items[first[k] : first[k + 1]]."""

    lengths: list[int]
    hashes: np.ndarray
    bitmap: np.ndarray
    windows: list[bytes]
    first: np.ndarray
    items: list[str | None]

    @staticmethod
    def of(rows: list[tuple[str | None, int, str]]) -> WindowSet:
        """rows: (item, words, window), each pair of item and window once."""
        by: dict[tuple[int, bytes], list[str | None]] = {}
        for item, words, window in rows:
            by.setdefault((words, window.encode("utf-8", "surrogatepass")), []).append(item)
        keys = list(by)
        lengths = sorted({n for n, _ in keys})
        hashes = np.zeros(len(keys), np.uint64)
        for at in range(0, len(keys), 4096):
            some = keys[at : at + 4096]
            raw = b" ".join(w for _, w in some)
            starts = np.cumsum([0] + [n for n, _ in some])[:-1]
            found = dict(window_hashes(Words(raw, np.array([0])).hash, lengths)) if some else {}
            hashes[at : at + 4096] = [found[n][s] for (n, _), s in zip(some, starts, strict=True)]
        order = np.argsort(hashes, kind="stable")
        bits = max(16, int(len(keys) * 16).bit_length())
        bitmap = np.zeros(1 << bits, bool)
        bitmap[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
        groups = [by[keys[k]] for k in order]
        return WindowSet(lengths, hashes[order], bitmap, [keys[k][1] for k in order], np.cumsum([0] + [len(g) for g in groups]), [i for g in groups for i in g])

    def find(self, hashes: np.ndarray) -> tuple[list[int], list[int]]:
        """Places whose hash is in the set, and the place of the first window with that hash."""
        if not len(self.hashes):
            return [], []
        shift = np.uint64(64 - (len(self.bitmap).bit_length() - 1))
        near = np.flatnonzero(self.bitmap[(hashes >> shift).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[near]), len(self.hashes) - 1)
        met = self.hashes[at] == hashes[near]
        return near[met].tolist(), at[met].tolist()

    def verified(self, at: int, window: bytes) -> int:
        """The place of the window with these bytes among those with the hash of the one at `at`, or -1."""
        key = self.hashes[at]
        while at < len(self.hashes) and self.hashes[at] == key:
            if self.windows[at] == window:
                return at
            at += 1
        return -1


@dataclass
class Found:
    """What was met in one text: its words, spans of hit words as [first word, end, first byte, end], and windows by place in the set."""

    words: int = 0
    spans: list[list[int]] | None = None
    windows: set[int] | None = None


def scan(texts: list[bytes], known: WindowSet) -> list[Found]:
    found = [Found(0, [], set()) for _ in texts]
    tail: tuple[int, list[tuple[bytes, int, int]], np.ndarray] = (-1, [], np.zeros(0, np.uint64))  # of the text that a piece ends in
    most = max(known.lengths, default=1)
    for raw, spans in pieces(texts):
        words = Words(raw, np.array([b for _, b, _ in spans]))
        carried = tail if tail[0] == spans[0][0] else (spans[0][0], [], np.zeros(0, np.uint64))
        extra = len(carried[1])
        hashes = np.concatenate([carried[2], words.hash])
        bounds = np.searchsorted(words.begin, [b for _, b, _ in spans] + [len(raw)]) + extra
        bounds[0] = 0
        owner = np.repeat(np.arange(len(spans)), np.diff(bounds))

        met = [(length, *known.find(sums)) for length, sums in window_hashes(hashes, known.lengths)]
        # the bytes of all words and their places in this piece; carried ones lie before it
        shown, lay = [], []
        if any(places for _, places, _ in met):
            lay = [(b - spans[0][2], e - spans[0][2]) for _, b, e in carried[1]] + list(zip(words.begin.tolist(), words.end.tolist(), strict=True))
            shown = [w for w, _, _ in carried[1]] + [words.raw[b:e] for b, e in lay[extra:]]
        fresh: dict[int, list[list[int]]] = {}
        for length, places, ats in met:
            for k, at in zip(places, ats, strict=True):
                mine = owner[k]
                if mine != owner[k + length - 1]:
                    continue
                at = known.verified(at, b" ".join(shown[k : k + length]))
                if at >= 0:
                    number, begins, skipped = spans[mine]
                    of = found[number]
                    of.windows.add(at)
                    first = of.words - (extra if mine == 0 else 0) + k - int(bounds[mine])
                    fresh.setdefault(number, []).append([first, first + length, lay[k][0] - begins + skipped, lay[k + length - 1][1] - begins + skipped])
        for number, new in fresh.items():  # what was found before reaches into the carried words at most
            spans_so_far = found[number].spans
            found[number].spans = spans_so_far[:-WINDOW] + united(spans_so_far[-WINDOW:] + new)
        for j, (number, _, _) in enumerate(spans):
            found[number].words += int(bounds[j + 1] - bounds[j]) - (extra if j == 0 else 0)
        last, lo = spans[-1], max(int(bounds[-2]), len(hashes) - most + 1)
        held = [c for k, c in enumerate(carried[1]) if k >= lo] if len(spans) == 1 else []
        for k in range(max(lo - extra, 0), len(words.begin)):
            b, e = int(words.begin[k]), int(words.end[k])
            held.append((words.raw[b:e], b - last[1] + last[2], e - last[1] + last[2]))
        tail = (last[0], held, hashes[lo:])
    return found


def united(spans: list[list[int]]) -> list[list[int]]:
    """Spans of words that meet or touch, made one."""
    out: list[list[int]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1][1], out[-1][3] = s[1], s[3]
        else:
            out.append(list(s))
    return out


SPAN = "struct<first:long,end:long,begin_byte:long,end_byte:long>"
SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("begin_byte", pa.int64()), ("end_byte", pa.int64())]))


def _scanner(cast, hits_only: bool):
    """cast.value: a WindowSet. Adds n_words, spans and items to batches whose last column is the text; the text goes unless hits alone are asked for."""

    def run(batches):
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                n, size, column = 0, 0, batch.column(batch.num_columns - 1)
                texts = []
                while at + n < batch.num_rows and (n == 0 or size < 8 * PIECE_BYTES):
                    texts.append((column[at + n].as_py() or "").encode("utf-8", "surrogatepass"))
                    size += len(texts[-1])
                    n += 1
                known = cast.value
                found = scan(texts, known)
                rows = batch.slice(at, n)
                at += n
                items = [sorted({known.items[i] for k in f.windows for i in range(known.first[k], known.first[k + 1])} - {None}) for f in found]
                spans = [[dict(zip(("first", "end", "begin_byte", "end_byte"), s, strict=True)) for s in f.spans] for f in found]
                added = [pa.array([f.words for f in found], pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))]
                columns = [*(rows.column(k) for k in range(batch.num_columns - 1)), *added]
                fields = [*(batch.schema.field(k) for k in range(batch.num_columns - 1)), pa.field("n_words", pa.int64()), pa.field("spans", SPANS), pa.field("items", pa.list_(pa.string()))]
                out = pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))
                yield out.filter(pa.array([bool(f.spans) for f in found])) if hits_only else out

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), most_windows: int = MOST_WINDOWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """keep's columns, n_words, spans of hit words (numbers of words, and bytes of the text), items (ids as strings, sorted): a row for each row of docs."""
    spark = docs.sparkSession
    windows = checkpointed(benchmark_windows(benchmark))
    size = windows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size.n // most_windows), -(-size.b // most_bytes))
    broadcasts = []
    for k in range(blocks):
        # at most about most_windows rows: the bound was checked above, and hashes deal windows evenly
        rows = windows.where(F.pmod("part", F.lit(blocks)) == k).select("item", "words", "window").toArrow()
        broadcasts.append(spark.sparkContext.broadcast(WindowSet.of(list(zip(*(c.to_pylist() for c in rows.columns), strict=True)))))
    renamed = {c: f"d_keep_{i}" for i, c in enumerate(keep)}
    kinds = dict(docs.dtypes)
    own = ", ".join(f"{r} {kinds[c]}" for c, r in renamed.items())
    end = f"n_words long, spans array<{SPAN}>, items array<string>"
    back = [F.col(r).alias(c) for c, r in renamed.items()]
    rows = docs.select(*(F.col(c).alias(r) for c, r in renamed.items()), F.col("text").alias("d_text"))
    if blocks == 1:
        return rows.mapInArrow(_scanner(broadcasts[0], False), f"{own}, {end}").select(*back, "n_words", "spans", "items")
    # what a row is joined by: its id and a digest of its text; equal ones are hit alike
    keyed = docs.select(*(F.col(c).alias(r) for c, r in renamed.items()), F.sha2(F.concat_ws(":", F.col("doc_id").isNull().cast("string"), F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))), 256).alias("d_row"), F.col("text").alias("d_text"))
    hits = None
    for cast in broadcasts:
        found = keyed.select("d_row", "d_text").mapInArrow(_scanner(cast, True), f"d_row string, {end}").select("d_row", "spans", "items").dropDuplicates(["d_row"])
        hits = found if hits is None else hits.unionByName(found)
    # at most `blocks` rows of one document meet here
    hits = hits.groupBy("d_row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("d_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = "aggregate(d_spans, cast(array() as array<SPAN>), (out, s) -> if(size(out) > 0 and s.first <= element_at(out, -1).end, if(s.end > element_at(out, -1).end, concat(slice(out, 1, size(out) - 1), array(named_struct('first', element_at(out, -1).first, 'end', s.end, 'begin_byte', element_at(out, -1).begin_byte, 'end_byte', s.end_byte))), out), concat(out, array(s))))".replace("SPAN", SPAN)
    hits = hits.select("d_row", F.expr(joined).alias("spans"), "items")
    nothing = spark.sparkContext.broadcast(WindowSet.of([]))
    counted = keyed.mapInArrow(_scanner(nothing, False), f"{own}, d_row string, {end}").drop("spans", "items")
    out = counted.join(hits, "d_row", "left")
    return out.select(*back, "n_words", F.coalesce("spans", F.expr(f"cast(array() as array<{SPAN}>)")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, **bounds) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a row for each row of docs."""
    found = find_leaks(docs, benchmark, **bounds)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def drop_documents(docs: DataFrame, benchmark: DataFrame, most_percent: float = 0.0, **bounds) -> DataFrame:
    """The rows of docs with at most most_percent of their words hit, with docs' columns."""
    spans, items, words = (unused(c, docs) for c in ("d_spans", "d_items", "d_words"))
    found = find_leaks(docs, benchmark, keep=tuple(docs.columns), **bounds).toDF(*docs.columns, words, spans, items)
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.where(100 * n_hit <= F.lit(most_percent) * F.col(words)).select(*docs.columns)


def cut_spans(docs: DataFrame, benchmark: DataFrame, **bounds) -> DataFrame:
    """docs with every span of hit words cut out of the text, what lay between its words too; other columns stay. A null text stays null."""
    spans, items, words = (unused(c, docs) for c in ("d_spans", "d_items", "d_words"))
    found = find_leaks(docs, benchmark, keep=tuple(docs.columns), **bounds).toDF(*docs.columns, words, spans, items)
    raw = F.col("text").cast("binary")
    # what stands before each span and after the last one, as bytes; spans end at characters
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end_byte"]))
    ends = F.concat(F.transform(spans, lambda s: s["begin_byte"]), F.array(F.octet_length("text").cast("long")))
    left = F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda p: F.substring(raw, (p["b"] + 1).cast("int"), (p["e"] - p["b"]).cast("int")).cast("string"))
    text = F.when(F.size(spans) > 0, F.array_join(left, "")).otherwise(F.col("text"))
    return found.withColumn("text", F.when(F.col("text").isNotNull(), text)).select(*docs.columns)


SQL = r"""
with docs as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
  select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as win
  from (select item, w, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from items where len(w) > 0)),
places as (select r, w, unnest(range(1, len(w) + 1)) as i from docs),
met as (
  select distinct r, i, windows.n, item
  from (select r, i, n, array_to_string(w[i:i + n - 1], ' ') as win from places, (select distinct n from windows) where i + n - 1 <= len(w)) p
  join windows on windows.win = p.win and windows.n = p.n),
hit as (select r, count(distinct x) as n_hit from (select distinct r, unnest(range(i, i + n)) as x from met) group by r),
named as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as names from met group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (r) left join named using (r)
"""
