"""Quality rules with hashed n-gram importance (operator 10). DataFrame operations only.

Base rules count words, their code points, symbols, repeated lines and words in repeated 3-word windows. The verdict on what passes
them is a log-likelihood ratio: the n-grams (one and two lower-cased words) are hashed into a fixed number of buckets; one multinomial
is counted over trusted documents, one over the whole corpus; a document's score is the mean over its n-grams of
log p_trusted - log p_corpus, and it is kept from a fixed threshold up. Bucket counts cover every document of the corpus; the trusted
documents are those labelled quality 1, of which a bounded sample by a hash of the id stands for all.

Rows: a null text has no words. A document without n-grams has a null score and fails the base rules. Repeated rows, rows with the same
or with a null id are each judged alone. A label with a null id or quality is ignored; of several labels for one document the lowest
quality counts. Without trusted documents every ratio is 0 and the base rules decide alone. Empty table: empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import checkpointed, unused

#: White space as the contract has it: blank, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Ratios are whole multiples of 1 / UNIT, so that a document's sum is the same in any order.
UNIT = 1e9


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    trusted_docs: int = 20000  # labelled documents that the target is counted over, in expectation
    smoothing: float = 1.0  # added to each bucket's count, in both multinomials scaled to the same mass
    threshold: float = -0.1  # lowest mean ratio that is kept
    min_words: int = 50
    max_repeat_percent: int = 50


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _neighbours(left: str, right: str, step: int, merge: str) -> str:
    """SQL: merge of (a, b), where a runs through the array left and b through right from `step` places on, while there are both."""
    n = f"greatest(size({left}) - {step}, 0)"
    return f"zip_with(slice({left}, 1, {n}), slice({right}, {step + 1}, {n}), (a, b) -> {merge})"


def _repeated_words(windows: str) -> Column:
    """Words inside windows that are there twice or more; windows are 64-bit hashes by place.

    Windows are sorted with their places, so equal ones are neighbours; the places that have an equal neighbour, in order, cover three words
    each, less what the next one covers again. Documents whose windows all differ skip that.
    """
    placed = f"sort_array(transform({windows}, (h, i) -> struct(h, i)))"
    equal = _neighbours("p", "p", 1, "a.h = b.h")
    either = "zip_with(concat(array(false), e), concat(e, array(false)), (a, b) -> a or b)"
    places = f"sort_array(array_compact(zip_with(p, {either}, (x, y) -> if(y, x.i, null))))"
    covered = f"aggregate({_neighbours('q', 'q', 1, 'least(b - a, 3)')}, 3, (sum, x) -> sum + x)"
    named = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    count = named(placed, "p", named(equal, "e", named(places, "q", covered)))
    return F.expr(f"if(size(array_distinct({windows})) = size({windows}), 0, {count})").cast("long")


def rule_columns(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns named in keep, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base counts of docs' text; words stay as q_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, text.alias("q_text"))
    rows = rows.select(*keep, "q_text", words_of(F.col("q_text")).alias("q_words"))
    windows = "slice(arrays_zip(q_words, slice(q_words, 2, size(q_words)), slice(q_words, 3, size(q_words))), 1, greatest(size(q_words) - 2, 0))"
    lines = F.filter(F.split("q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        *keep,
        "q_words",
        F.size("q_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("q_words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("q_text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        lines.alias("q_lines"),
        F.expr(f"transform({windows}, x -> xxhash64(x))").alias("q_windows"),
    )
    return rows.select(
        *keep,
        "q_words",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words("q_windows").alias("n_repeat_words"),
    )


def _with_buckets(rows: DataFrame, keep: list[str], settings: Settings) -> DataFrame:
    """A row for each word of the array q_words (one of nulls where it has none): keep, q_first (the word's bucket) and q_second (that of the word
    and the next one, or null)."""
    pairs = F.expr("arrays_zip(q_words, slice(q_words, 2, size(q_words)))")
    words = rows.select(*keep, F.inline_outer(pairs).alias("q_word", "q_next"))
    bucket = lambda *of: F.pmod(F.xxhash64(*(F.lower(c) for c in of)), F.lit(settings.buckets)).cast("int")
    first, second = F.when(F.col("q_word").isNotNull(), bucket("q_word")), F.when(F.col("q_next").isNotNull(), bucket("q_word", "q_next"))
    return words.select(*keep, first.alias("q_first"), second.alias("q_second"))


def trusted_ids(labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """q_id of the documents labelled good, at most settings.trusted_docs in expectation."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("q_id")).agg(F.min("quality").alias("q")).where("q = 1").select("q_id")
    n, parts = good.count(), 1 << 20
    share = parts if n <= settings.trusted_docs else -(-parts * settings.trusted_docs // n)
    return good.where(F.pmod(F.xxhash64("q_id", F.lit(29)), F.lit(parts)) < share)


def bucket_ratios(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """q_bucket, q_ratio (times UNIT): a row for each bucket that the corpus fills, settings.buckets at most."""
    trusted = F.broadcast(trusted_ids(labels, settings).withColumn("q_trusted", F.lit(True)))  # its size is bounded above
    rows = docs.select(F.col("doc_id").alias("q_id"), words_of(F.coalesce(F.col("text"), F.lit(""))).alias("q_words"))
    grams = _with_buckets(rows.join(trusted, "q_id", "left"), ["q_trusted"], settings)
    grams = grams.select("q_trusted", F.explode(F.array("q_first", "q_second")).alias("q_bucket")).where("q_bucket is not null")
    # read twice below, and counted once
    counts = checkpointed(grams.groupBy("q_bucket").agg(F.count(F.lit(1)).alias("q_all"), F.count("q_trusted").alias("q_good")))
    totals = counts.agg(F.sum("q_all").alias("q_all"), F.sum("q_good").alias("q_good")).first()
    every, good = float(totals.q_all or 0), float(totals.q_good or 0)
    if not good:
        return counts.select("q_bucket", F.lit(0).cast("long").alias("q_ratio"))
    # the corpus' counts are scaled to the target's mass, so one smoothing fits both and an even bucket gets 0
    ratio = F.log(F.col("q_good") + settings.smoothing) - F.log(F.col("q_all") * (good / every) + settings.smoothing)
    return counts.select("q_bucket", F.round(ratio * UNIT).cast("long").alias("q_ratio"))


def judge(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score: a row for each row of docs."""
    ratios = F.broadcast(bucket_ratios(docs, labels, settings))  # settings.buckets rows at most, read for both lengths
    renamed = {c: f"q_keep_{i}" for i, c in enumerate(keep)}
    rows = rule_columns(docs.select("text", *(F.col(c).alias(r) for c, r in renamed.items())), list(renamed.values()))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = rows.withColumn("q_row", F.monotonically_increasing_id())  # before the n-grams are rows of their own
    grams = _with_buckets(rows, ["q_row", *renamed.values(), *counts], settings)
    for at in ("q_first", "q_second"):
        grams = grams.join(ratios.select(F.col("q_bucket").alias(at), F.col("q_ratio").alias(at + "_ratio")), at, "left")
    # the rows of a document lie together, so the sums shrink to a row a document before they are shuffled
    both = F.coalesce("q_first_ratio", F.lit(0)) + F.coalesce("q_second_ratio", F.lit(0))
    seen = F.count("q_first_ratio") + F.count("q_second_ratio")
    scored = grams.groupBy("q_row").agg(*(F.first(c).alias(c) for c in [*renamed.values(), *counts]), (F.when(seen > 0, F.sum(both)) / seen / F.lit(UNIT)).alias("score"))
    failed = (F.col("n_words") < settings.min_words) | (100 * F.col("n_repeat_words") > settings.max_repeat_percent * F.col("n_words"))
    return scored.select(
        *(F.col(r).alias(c) for c, r in renamed.items()),
        *counts,
        failed.alias("base_failed"),
        (~failed & (F.coalesce(F.col("score"), F.lit(0.0)) >= settings.threshold)).alias("kept"),
        "score",
    )


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs that judge() keeps, with docs' columns. A verdict belongs to an id and a text, so repeated ids are no trouble."""
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    bad = judge(docs.select("doc_id", "text", text_hash.alias("q_hash")), labels, settings, ("doc_id", "q_hash")).where(~F.col("kept"))
    bad_id, bad_hash = unused("q_bad_id", docs), unused("q_bad_hash", docs)
    bad = bad.select(F.col("doc_id").alias(bad_id), F.col("q_hash").alias(bad_hash)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (text_hash == F.col(bad_hash)), "left_anti")
