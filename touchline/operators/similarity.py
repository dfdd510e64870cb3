"""Exact joins of word sets by likeness, over an inverted index of rare words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import text as X
from touchline.operators.lineage import settled

# Words that don't tell which goal a text is about; neither do those under four letters.
IDENTITY_STOP_WORDS = (
    "goal", "goals", "score", "scores", "scored", "replay", "goalcall", "crowd", "team", "match", "but", "marque", "marquer", "egalisation", "le", "la",
    "les", "des", "une", "the", "and", "for", "after", "from", "into", "dans", "pour", "avec", "sur", "qui", "que", "est",
)

#: Words are counted by hashes into so many buckets, so that the counts can be broadcast whatever the vocabulary.
BUCKETS = 1 << 16


def identity(words: Column) -> Column:
    """Of distinct normalised words, those that tell which action a text is about."""
    return F.filter(words, lambda x: (F.char_length(x) >= 4) & ~x.isin(*IDENTITY_STOP_WORDS))


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _need(size: str, share: float) -> str:
    """SQL: the least whole number of words that is a share of size; rounding errors make it too small rather than too large."""
    return f"cast(ceil({share} * {size} - 1e-9) as int)"


def classes(rows: DataFrame, text: str, kind: str = "all") -> DataFrame:
    """rows with l_class: a digest of the distinct words (of a kind of functions.text.token_set) of their text, and words: texts of equal words are one class."""
    words = F.array_sort(X.token_set(F.coalesce(F.col(text), F.lit("")), kind))
    return rows.withColumn("words", words).withColumn("l_class", F.sha2(F.array_join("words", " "), 256))


def similar_classes(left: DataFrame, right: DataFrame, keys: list[str], least: float = 0.7, tokens: int = 3, identity: Callable[[Column], Column] = identity) -> DataFrame:
    """keys, l_class, r_class, jaccard: pairs of word sets (keys, l_class, words, of left and of right) of the same keys with `tokens` identity words in common and a
    Jaccard similarity of all words, or a containment of identity words, of `least`.

    Each class once a side. Words are put in an order that all sets share, rare ones first. Two sets with an overlap of o words must meet in the
    first n - o + 1 words of one that has n, and o is known from the shares asked for: so only such prefixes of one side, rare words, meet the
    other side's words (for the Jaccard part, its prefixes, of sets whose sizes allow it). Pairs that meet are tested on the whole sets.
    """
    one, two = (settled(side.select(*keys, "l_class", "words").dropDuplicates([*keys, "l_class"]).where(F.size(identity(F.col("words"))) >= tokens)) for side in (left, right))
    said = one.select(F.explode("words").alias("word")).unionByName(two.select(F.explode("words").alias("word")))
    counts = F.broadcast(said.groupBy(_bucket(F.col("word")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")))  # BUCKETS rows at most

    def ranked(side: DataFrame) -> DataFrame:
        rows = side.select(*keys, "l_class", F.explode("words").alias("word")).withColumn("bucket", _bucket(F.col("word"))).join(counts, "bucket")
        rows = rows.groupBy(*keys, "l_class").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "word"))), lambda x: x.word).alias("words"))
        return rows.withColumn("names", identity(F.col("words")))

    a, b = settled(ranked(one)), settled(ranked(two).withColumnRenamed("l_class", "r_class"))
    near = f"slice(words, 1, size(words) - {_need('size(words)', least)} + 1)"
    part = f"slice(names, 1, greatest(size(names) - greatest({tokens}, {_need('size(names)', least)}) + 1, 0))"
    index = lambda side, id_, words, size: side.select(*keys, id_, F.size(size).alias(f"{id_}_n"), F.explode(F.expr(words)).alias("word"))
    meet = lambda x, y, test: x.join(y, [*keys, "word"]).where(test).select(*keys, "l_class", "r_class")
    pairs = meet(index(a, "l_class", near, "words"), index(b, "r_class", near, "words"), f"r_class_n >= {least} * l_class_n - 1e-9 and l_class_n >= {least} * r_class_n - 1e-9")
    pairs = pairs.unionByName(meet(index(a, "l_class", part, "names"), index(b, "r_class", "names", "names"), "l_class_n <= r_class_n"))
    pairs = pairs.unionByName(meet(index(a, "l_class", "names", "names"), index(b, "r_class", part, "names"), "r_class_n < l_class_n")).distinct()
    sides = pairs.join(a, [*keys, "l_class"]).join(b.select(*keys, "r_class", F.col("words").alias("r_words"), F.col("names").alias("r_names")), [*keys, "r_class"])
    same = F.greatest(X.jaccard(F.col("words"), F.col("r_words")), X.containment(F.col("names"), F.col("r_names"))) >= least
    return sides.where((F.size(F.array_intersect("names", "r_names")) >= tokens) & same).select(*keys, "l_class", "r_class", X.jaccard(F.col("words"), F.col("r_words")).alias("jaccard"))


def _fold(keys: int):
    def run(batches):
        """Rows by keys, time: (keys, ms, id, own class, may stand, classes that are like it). Gives ids that follow one they are like."""
        import pyarrow as pa

        group, standing, coming, now = None, set(), [], None
        for batch in batches:
            found = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(keys + 5)), strict=True):
                own, (ms, row_id, cls, stands, like) = row[:keys], row[keys:]
                if own != group:
                    group, standing, coming, now = own, set(), [], None
                if ms != now:  # what stands at a time counts for later ones alone
                    standing.update(coming)
                    coming, now = [], ms
                if any(c in standing for c in like or ()):
                    found.append(row_id)
                elif stands:
                    coming.append(cls)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["id"])

    return run


def follow_ups(rows: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """id of rows (keys, ms, id, l_class or null, r_class, stands) that come after a row of a class like theirs which stands and is no follow-up itself.

    pairs: keys, l_class, r_class. Only rows that are in a pair go on; those of the same keys pass through a task in order of time. State: classes that stand.
    """
    like = pairs.groupBy(*keys, "l_class").agg(F.collect_set("r_class").alias("like"))
    met = pairs.select(*keys, "r_class").distinct().withColumn("met", F.lit(True))
    chain = rows.join(like, [*keys, "l_class"], "left").join(met, [*keys, "r_class"], "left").where("like is not null or (met and stands)")
    chain = chain.repartition(*keys).sortWithinPartitions(*keys, "ms", "id").select(*keys, "ms", "id", "r_class", "stands", "like")
    return chain.mapInArrow(_fold(len(keys)), "id long")
