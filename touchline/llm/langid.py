"""Language by n-gram filters with a bit a language (operator 4).

Fit: the n-grams of a bounded sample of labelled training texts are counted by documents. A language keeps an n-gram if enough of
its documents have it, and not far fewer than of the language where it is most usual (so passages in another language don't count).
The kept n-grams fill bit-sliced Bloom filters: slot s of the table holds, as bits of one integer, the slot's bit of every language's
filter, so one read returns the bits of all languages, and the conjunction over the probes returns all languages that contain an n-gram.

Predict: look up every n-gram of the whole text, count the set bits by language, take away what the filter's fill makes appear by
chance (f = fill ** probes; (count - f * n) / (1 - f)), and choose the largest count (ties: the language with more training rows, then
the name).

Only text and lang of training rows are learnt from, where crc32(doc_id) mod 4 is not 2. Rows with a null id, lang or text aren't
learnt from. Null texts and those without a letter get "und" and score 0, as all do if there is nothing to learn from. One row in, one
row out, repeated rows too.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import per_row, spark_schema

UNDETERMINED = "und"
#: Languages in one integer of the table; more have several.
A_WORD = 62


@dataclass(frozen=True)
class Settings:
    sizes: tuple[int, ...] = (2, 3, 4)  # letters in an n-gram; words are bordered by one blank
    slots: int = 1 << 20  # of the filter table: 8 MB, whatever the corpus
    probes: int = 3
    sample_docs: int = 4000  # training documents a language, in expectation; chosen by a hash of the id
    min_docs: int = 2
    min_share: float = 0.004  # of a language's documents that have an n-gram it keeps
    min_ratio: float = 0.25  # of that share to the largest share among languages


@dataclass(frozen=True)
class Filters:
    languages: tuple[str, ...]  # more training rows first
    table: np.ndarray  # uint64, a row for each A_WORD languages and a column a slot: a bit a language
    settings: Settings

    @property
    def chance(self) -> np.ndarray:
        """By language: the probability that an n-gram it lacks appears to be there."""
        fill = [float(np.count_nonzero(self.table[k // A_WORD] >> np.uint64(k % A_WORD) & np.uint64(1))) / self.settings.slots for k in range(len(self.languages))]
        return np.array(fill) ** self.settings.probes


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def code_points(text: str) -> np.ndarray | None:
    """Lower-case letters, each other run as one blank, a blank at both ends; None without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[points]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.concatenate(([np.uint32(32)], np.where(letter, points, np.uint32(32))[keep], [np.uint32(32)] if letter[-1] else np.empty(0, np.uint32)))


def gram_hashes(points: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """A 63-bit hash of each n-gram, repeats included."""
    wide, out = points.astype(np.uint64), []
    h = wide.copy()
    for n in range(2, max(sizes) + 1):
        if len(wide) < n:
            break
        h = h[:-1] * np.uint64(0x100000001B3) + wide[n - 1 :]
        if n in sizes:
            mixed = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((mixed ^ mixed >> np.uint64(32)) >> np.uint64(1))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _grams(sizes: tuple[int, ...]):
    """mapInArrow: (lang, text) to lang, gram, n: the documents of the batch that have it."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            found: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (points := code_points(text.as_py())) is not None:
                    found.setdefault(lang, []).append(np.unique(gram_hashes(points, sizes)))
            for lang, parts in found.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n)], schema=schema)

    return run, spark_schema(schema)


def fit(docs: DataFrame, settings: Settings = Settings()) -> Filters:
    """Learn the filters from docs(doc_id, text, lang). To the driver come counts by language and one integer a slot at most."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()}
    languages = tuple(counts)
    table = np.zeros((max(1, -(-len(languages) // A_WORD)), settings.slots), np.uint64)
    if not languages:
        return Filters(languages, table, settings)
    parts = 1 << 20
    part = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(parts))
    chosen = rows.where(part < F.coalesce(*(F.when(F.col("lang") == x, F.lit(min(parts, -(-parts * settings.sample_docs // n)))) for x, n in counts.items())))
    sizes = {r.lang: r.n for r in chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    run, schema = _grams(settings.sizes)
    by_gram = chosen.select("lang", "text").mapInArrow(run, schema).groupBy("gram").agg(*(F.sum(F.when(F.col("lang") == x, F.col("n"))).alias(f"n{k}") for k, x in enumerate(languages)))
    shares = [F.coalesce(F.col(f"n{k}"), F.lit(0)) / F.lit(float(sizes.get(x, 1))) for k, x in enumerate(languages)]
    most = F.greatest(*shares, F.lit(0.0))
    masks = []
    for begin in range(0, len(languages), A_WORD):
        mask = F.lit(0).cast("long")
        for k, share in list(enumerate(shares))[begin : begin + A_WORD]:
            usual = (F.col(f"n{k}") >= settings.min_docs) & (share >= settings.min_share) & (share >= settings.min_ratio * most)
            mask = mask.bitwiseOR(F.when(usual, F.lit(1 << k - begin).cast("long")).otherwise(F.lit(0).cast("long")))
        masks.append(mask.alias(f"m{begin // A_WORD}"))
    words = [f"m{w}" for w in range(len(masks))]
    probes = F.array(*(F.shiftright("gram", 20 * k).bitwiseAND(F.lit(settings.slots - 1)) for k in range(settings.probes)))
    kept = by_gram.select(*masks, probes.alias("slots")).where(" or ".join(f"{w} <> 0" for w in words))
    slots = kept.select(*words, F.explode("slots").alias("slot")).groupBy("slot").agg(*(F.bit_or(w).alias(w) for w in words)).toArrow()
    for w, name in enumerate(words):
        table[w, slots.column("slot").to_numpy()] = slots.column(name).to_numpy().astype(np.uint64)
    return Filters(languages, table, settings)


def scored(text: str | None, filters: Filters, chance: np.ndarray) -> tuple[str, float, float]:
    """Language, its share of all languages' corrected counts, and the share of the text's n-grams that it has."""
    points = code_points(text) if text else None
    if points is None or not filters.languages:
        return UNDETERMINED, 0.0, 0.0
    grams = gram_hashes(points, filters.settings.sizes)
    last, k = np.uint64(filters.settings.slots - 1), len(filters.languages)
    slots = [(grams >> np.uint64(20 * probe) & last).astype(np.intp) for probe in range(filters.settings.probes)]
    counts = []
    for table, own in zip(filters.table, (min(A_WORD, k - b) for b in range(0, k, A_WORD)), strict=True):
        masks = table[slots[0]]
        for places in slots[1:]:
            masks = masks & table[places]
        if own <= 10:
            by_mask = np.bincount(masks.astype(np.int64), minlength=1 << own)
            counts.append(by_mask @ (np.arange(1 << own)[:, None] >> np.arange(own) & 1))
        else:
            counts.append(np.array([np.count_nonzero(masks >> np.uint64(b) & np.uint64(1)) for b in range(own)]))
    counts = np.concatenate(counts)
    sure = np.maximum(0.0, (counts - chance * len(grams)) / np.maximum(1e-9, 1 - chance))
    best = int(np.argmax(sure))
    total = float(sure.sum())
    return filters.languages[best], float(sure[best]) / total if total else 0.0, min(1.0, float(sure[best]) / max(1, len(grams)))


def _scorer(docs: DataFrame, filters: Filters):
    """make() for per_row: the filter table goes to each executor once."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def make():
        own = sent.value
        chance = own.chance
        return lambda text: scored(text, own, chance)

    return make


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score, coverage of every row of docs(doc_id, text, ...). No shuffle."""
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("coverage", pa.float64())])
    scorer = _scorer(docs, filters)

    def make():
        score = scorer()
        return lambda doc_id, held, text: (doc_id, held, *score(text))

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(per_row(["doc_id", "held_out", "text"], out, make), spark_schema(out))


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fit on docs' training rows, then predict every row."""
    return predict(docs, fit(docs, settings))


def keep_identified(docs: DataFrame, filters: Filters, min_coverage: float = 0.2) -> DataFrame:
    """The rows of docs whose language can be told: not "und", and at least that share of n-grams known to the language. docs' columns."""
    scorer = _scorer(docs, filters)

    def run(batches):
        score = scorer()
        for batch in batches:
            found = [score(x.as_py()) for x in batch.column(batch.schema.get_field_index("text"))]
            yield batch.filter(pa.array([lang != UNDETERMINED and coverage >= min_coverage for lang, _, coverage in found], pa.bool_()))

    types = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in docs.columns))
