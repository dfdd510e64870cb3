"""Operator 10 against plain Python."""

import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from touchline.llm import quality
from touchline.llm.common import read_table


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    w = words_of(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def spark_hash(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def grams(text, buckets):
    w = [x.lower() for x in words_of(text)]
    return [spark_hash(x) % buckets for x in w] + [spark_hash(a, b) % buckets for a, b in zip(w, w[1:])]


ODD = [(7, " ".join(f"w{k % 9973}" if k % 3 else f"v{k}" for k in range(300_000)), "m"), (8, "one two three one two three one two", "o"), (1, "a b c a b c d", "x"), (1, "a b c a b c d", "x"), (2, None, "y"), (None, "", None), (3, "x\n\ny\nx\n \nx " * 40, "z"), (4, "w " * 30000, "z"), (5, " a b | <c>", "q"), (6, "a a a a", "q")]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 0, 1), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_base_counts_of_odd_rows(odd):
    got = quality.judge(*odd).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r.doc_id, *(r[n] for n in names)) for r in got), key=key) == sorted(((i, *base(t)) for i, t, _ in ODD), key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_empty_tables(odd):
    docs, labels = odd
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert {r.kept for r in quality.judge(docs, labels.limit(0)).collect()} <= {True, False}


def test_keep_good_keeps_columns(odd):
    docs, labels = odd
    out = quality.keep_good(docs, labels, quality.Settings(min_words=3, max_repeat_percent=100, threshold=-9))
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [1, 1, 3, 4, 5, 6, 7, 8]


def test_scores_equal_brute_force(spark, sf_dir):
    settings = quality.Settings(buckets=512)
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    got = {r.doc_id: r for r in quality.judge(docs, labels, settings).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    every, target = Counter(), Counter()
    for i, t in texts.items():
        every.update(g := grams(t, 512))
        if i in good:
            target.update(g)
    scale = sum(target.values()) / sum(every.values())
    ratio = {b: math.log(target[b] + 1) - math.log(n * scale + 1) for b, n in every.items()}
    for i, t in texts.items():
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == base(t)
        g = grams(t, 512)
        assert got[i].score == pytest.approx(sum(ratio[b] for b in g) / len(g), abs=1e-6)
        assert got[i].kept == (not got[i].base_failed and got[i].score >= settings.threshold)


def test_labelled_documents_are_told_apart(spark, sf_dir):
    docs, labels = read_table(spark, "/root/testdata/sf0.01", "documents"), read_table(spark, "/root/testdata/sf0.01", "labels")
    rows = quality.judge(docs, labels).join(labels, "doc_id").where(~F.col("base_failed")).groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.98 and kept[0] < 0.05


def test_clashing_names(odd):
    docs, labels = odd
    named = docs.withColumn("q_bad_id", F.lit("own")).withColumn("q_hash", F.lit(1)).withColumn("q_text", F.lit(2))
    out = quality.keep_good(named, labels, quality.Settings(min_words=3, max_repeat_percent=100, threshold=-9))
    assert out.columns == named.columns and {(r.q_bad_id, r.q_hash, r.q_text) for r in out.collect()} == {("own", 1, 2)}


def test_repeats_in_a_text_of_a_million_words(spark):
    """Words at multiples of 1000 begin a window that comes a thousand times; no other window comes twice."""
    words = [("x", "y", "z")[k % 1000] if k % 1000 < 3 else f"w{k}" for k in range(1_000_000)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    assert quality.rule_columns(docs, ["doc_id"]).first().n_repeat_words == 3000
