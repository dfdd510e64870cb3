"""BPE encoding and decoding as a streaming transducer (operator 7).

Encoding follows the merge list of a tokenizer file whose words end in a marked symbol. Two facts make it a transducer: a sequence of
tokens is what the merges give exactly if each token and each pair of neighbours is what the merges give for its own characters; and so the
encoding of a prefix is one more token after the encoding of a shorter prefix. For each character read, the transducer keeps only that last
token. From the merge list follows how far a character can change what stands before it (`lookahead`); once twice as many characters are
held, tokens that end before that bound leave, so memory stays constant however long a word is. All encodings to come grow from one of the
last few prefixes (as many as the longest token has characters); that these agree on what leaves is asserted each time.

Decoding is a state machine from ids to bytes to text: it holds a partial character between ids, and nothing else.

The registered query gives per document the ids and the decoded text of the tokenizers library, as digests. Null texts count as empty
(no tokens, digest of nothing). One row in, one row out; long texts go through in blocks.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache, cached_property
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import DataFrame

from touchline.llm.common import per_row, spark_schema

#: In place of the file's "</w>" while symbols are handled; no byte is written with this character.
END = "\n"
SUFFIX = "</w>"
#: Bytes of each of an encoder's caches, in a Python worker.
CACHED = 160 << 20


#: White space that can end a block, in any reading of \s.
BLANK = re.compile("[ \t\n\r]")


# Letters and numbers of Unicode 16, as ranges, which the tokenizers library knows and Python's tables don't yet.
YOUNG_NUMBERS = "\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa"
YOUNG_LETTERS = (
    "\u1c89-\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4\U00011380-\U00011389"
    "\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3\U00011bc0-\U00011be0\U00013460-\U000143fa\U00016100-\U0001611d"
    "\U00016d40-\U00016d6c\U00018cff\U0001e5d0-\U0001e5ed\U0001e5f0"
)
_ALL = "".join(map(chr, (*range(128, 0xD800), *range(0xE000, sys.maxunicode + 1))))
#: Numbers that aren't decimal digits, which re takes for letters.
NUMBERS = "".join(c for c in _ALL if unicodedata.category(c) in ("No", "Nl"))
RARE = frozenset(NUMBERS) | frozenset(re.findall(f"[{YOUNG_NUMBERS}{YOUNG_LETTERS}]", _ALL))


def word_pattern(pattern: str, rare: bool = False) -> re.Pattern:
    r"""The tokenizer file's pattern for re, which lacks \p{L} and \p{N}; slower if the text may have RARE characters. The four separators that
    Python's \s has beyond the tokenizer's count as other characters."""
    letter, number, other = r"[^\W\d_]+", r"\d", r"(?:[^\s\w]|[_\x1c-\x1f])+"
    if rare:
        young = YOUNG_LETTERS + YOUNG_NUMBERS
        letter, number, other = rf"(?:[^\W\d_{NUMBERS}{YOUNG_NUMBERS}]|[{YOUNG_LETTERS}])+", rf"[\d{NUMBERS}{YOUNG_NUMBERS}]", rf"(?:[^\s\w{young}]|[_\x1c-\x1f])+"
    known = {r"[\p{L}]+": letter, r"[\p{N}]": number, r"[^\s\p{L}\p{N}]+": other}
    parts = pattern.split("|")
    if any("\\" in p and p not in known for p in parts):
        raise ValueError(f"an unknown pattern of words: {pattern}")
    return re.compile("|".join(known.get(p, p) for p in parts))


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next one from 256 up."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Words:
    """How a tokenizer file cuts text: special tokens, blocks, words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pattern = next(p for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.word_pattern, self.rare_pattern = word_pattern(pattern), word_pattern(pattern, True)
        self.alphabet = byte_alphabet()
        self.learn(file["model"])

    def learn(self, model: dict) -> None:
        """Take what is wanted of the file's model."""

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # letter by letter: no final sigma
        return (self.word_pattern if text.isascii() or RARE.isdisjoint(set(text)) else self.rare_pattern).findall(text)

    def symbols(self, word: str) -> str:
        """A word's bytes, as characters of the byte alphabet."""
        return word if word.isascii() and word.isprintable() else "".join(self.alphabet[b] for b in word.encode("utf-8", "replace"))

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """Special tokens (True) and the text between them, the latter in blocks that end before white space: no word is cut."""
        if self.special_pattern is None or not self.special_pattern.search(text):
            yield from ((False, b) for b in blocks(text))
            return
        for piece in self.special_pattern.split(text):
            yield from [(True, piece)] if piece in self.special else ((False, b) for b in blocks(piece))


class Vocabulary(Words):
    """And the tokens and merges: ids of tokens, ranks of merges."""

    def learn(self, model: dict) -> None:
        own = lambda s: s.removesuffix(SUFFIX) + END if s.endswith(SUFFIX) else s
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.ids = {own(t): i for t, i in model["vocab"].items()}
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.ranks = {(own(a), own(b)): k for k, (a, b) in enumerate(merges)}
        self.longest = max(len(t.rstrip(END)) for t in self.ids)
        self.pairs = Known(lambda pair: self.fits(*pair))

    @cached_property
    def lookahead(self) -> int:
        """Characters after a position beyond which nothing changes the tokens that end before it.

        A change travels to the left only along merges of growing rank, each of which wants as its right part what the one before took
        as its left part. The heaviest such chain, in characters, bounds the way.
        """
        reach: dict[str, int] = {}
        most = 0
        for left, right in self.ranks:  # by rank
            own = len(left) + len(right) + reach.get(right, 0)
            most = max(most, own)
            if own > reach.get(left, 0):
                reach[left] = own
        return most + self.longest

    def merged(self, symbols: list[str]) -> list[str]:
        """What the merge list makes of symbols: the lowest rank first, from the left."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(pair, sys.maxsize), k) for k, pair in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == sys.maxsize:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def fits(self, before: str | None, token: str) -> bool:
        """Are these neighbours, or (before: None) this token alone, what the merges give for their characters?"""
        tokens = [token] if before is None else [before, token]
        symbols = [c for t in tokens for c in t.rstrip(END)]
        if token.endswith(END):
            symbols[-1] += END
        return self.merged(symbols) == tokens


class Transducer:
    """Reads one word's characters, gives tokens as soon as no further character can change them."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.chars = ""  # not yet given
        self.before: str | None = None  # the last token given
        self.last: list[tuple[int, str]] = []  # for each prefix of chars: where its last token starts, and the token

    def _grow(self, n: int, end: str) -> tuple[int, str]:
        """The last token of the first n characters, the word's end included or not."""
        v, chars, last = self.v, self.chars, self.last
        for start in range(max(0, n - v.longest), n):
            token = chars[start:n] + end
            if token in v.ids:
                if v.pairs[last[start - 1][1] if start else self.before, token]:
                    return start, token
        raise ValueError(f"no token for {self.chars[n - 1]!r}")

    def _path(self, n: int) -> list[str]:
        """Tokens of the first n characters."""
        tokens = []
        while n:
            n, token = self.last[n - 1]
            tokens.append(token)
        return tokens[::-1]

    def feed(self, chars: str) -> Iterator[str]:
        """Characters of the word, without its last one; tokens that are stable now."""
        most = 2 * self.v.lookahead
        for c in chars:
            self.chars += c
            self.last.append(self._grow(len(self.chars), ""))
            if len(self.chars) >= most:
                yield from self._leave(len(self.chars) - self.v.lookahead)

    def _leave(self, bound: int) -> list[str]:
        """The tokens that end at the bound or before it, which no further character reaches."""
        ends = set()
        for n in range(len(self.chars) + 1 - self.v.longest, len(self.chars) + 1):
            while n > bound:
                n = self.last[n - 1][0]
            ends.add(n)
        if len(ends) > 1:
            raise AssertionError("a token beyond the lookahead can still change")
        (end,) = ends
        if not end:
            return []
        tokens = self._path(end)
        self.chars, self.before = self.chars[end:], tokens[-1]
        self.last = [(start - end, token) for start, token in self.last[end:]]
        return tokens

    def finish(self, char: str) -> list[str]:
        """The word's last character; the rest of its tokens."""
        self.chars += char
        start, token = self._grow(len(self.chars), END)
        return [*self._path(start), token]


def word_tokens(vocabulary: Vocabulary, word: str) -> Iterator[str]:
    t = Transducer(vocabulary)
    yield from t.feed(word[:-1])
    yield from t.finish(word[-1])


class Known(dict):
    """Results by key, found by make(key) when first wanted.

    No more than `most` bytes are held (strings, bytes and an allowance for the table): in two generations, of which the older one is
    dropped when the younger one has half of that. What is asked for again moves to the younger one. Long keys aren't held.
    """

    def __init__(self, make: Callable, most: int | None = None, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.held, self.older = make, CACHED if most is None else most, longest, 0, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > self.longest:
                return found
        if 2 * self.held > self.most:
            self.older, self.held = dict(self), 0
            self.clear()
        self.held += getsizeof(key) + getsizeof(found) + 100
        self[key] = found
        return found


def packed(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def blocks(text: str, size: int = 1 << 18) -> Iterator[str]:
    """The text in blocks of about that many characters, cut before white space only."""
    begin, n = 0, len(text)
    while begin < n:
        end = min(n, begin + size)
        if end < n and (space := BLANK.search(text, end)):
            end = space.start()
        elif end < n:
            end = n
        yield text[begin:end]
        begin = end


class Encoder:
    """Ids of texts, by the transducer. Words that come again are taken from a bounded cache."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.word = Known(lambda w: packed(self.v.ids[t] for t in word_tokens(self.v, self.v.symbols(w))))

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed ids, some at a time."""
        for special, piece in self.v.pieces(text):
            yield packed([self.v.special[piece]]) if special else b"".join(map(self.word.__getitem__, self.v.words(piece)))


class Decoder:
    """Text from ids, some at a time. as_text: words instead of the library's own rendering, which shows tokens with blanks between."""

    def __init__(self, vocabulary: Vocabulary, as_text: bool = False):
        self.as_text = as_text
        if as_text:
            byte = {c: b for b, c in enumerate(vocabulary.alphabet)}
            special = set(vocabulary.special.values())
            plain = lambda t: bytes(byte[c] for c in t.removesuffix(SUFFIX)) + (b" " if t.endswith(SUFFIX) else b"")
            self.bytes_of = {i: t.encode() if i in special else plain(t) for i, t in vocabulary.names.items()}
        else:
            self.bytes_of = {i: t.encode() for i, t in vocabulary.names.items()}
        self.restart()

    def restart(self) -> None:
        self.begun = False
        self.partial = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        """The characters that are whole after these packed ids."""
        if not ids:
            return ""
        found = map(self.bytes_of.__getitem__, memoryview(ids).cast("I").tolist())
        out = (b"" if self.as_text else b" ").join(found)
        if self.begun and not self.as_text:
            out = b" " + out
        self.begun = True
        return self.partial.decode(out)

    def finish(self) -> str:
        out = self.partial.decode(b"", final=True)
        self.restart()
        return out


@cache
def codec(path: str) -> tuple[Encoder, Decoder]:
    """One encoder and decoder a Python worker, whose later tasks find the caches warm."""
    vocabulary = Vocabulary(path)
    return Encoder(vocabulary), Decoder(vocabulary)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs(doc_id, text, ...). No shuffle.

    path: the tokenizer file, there on every executor.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def make():
        encoder, decoder = codec(path)
        decoder.restart()  # a task before may have ended in the middle

        def row(doc_id, text):
            n, ids_digest, text_digest = 0, hashlib.sha256(), hashlib.sha256()
            for ids in encoder.encode(text or ""):
                n += len(ids) // 4
                ids_digest.update(ids)
                text_digest.update(decoder.feed(ids).encode())
            text_digest.update(decoder.finish().encode())
            return doc_id, n, ids_digest.hexdigest(), text_digest.hexdigest()

        return row

    return docs.select("doc_id", "text").mapInArrow(per_row(["doc_id", "text"], out, make), spark_schema(out))
