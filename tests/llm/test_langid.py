"""Operator 4: exact counts of set membership where nothing collides, and held-out accuracy."""

import zlib
from collections import Counter

import numpy as np
import pytest

from touchline.llm import langid

ROWS = [(i, f"the house and the garden {i} with water", "en") for i in range(30)] + [(100 + i, f"das haus und der garten {i} mit wasser", "de") for i in range(30)]


@pytest.fixture(scope="module")
def filters(spark):
    return langid.fit(spark.createDataFrame(ROWS, "doc_id long, text string, lang string"))


def test_code_points():
    text = lambda x: None if (p := langid.code_points(x)) is None else "".join(map(chr, p))
    assert text("Ab-1 cD") == " ab cd " and text("12 .") is None and text("É") == " é " and text("\U0001d400") is not None


def test_filters_hold_the_languages_grams(filters):
    """Every n-gram of a training language's text is found; counts follow plain sets."""
    assert set(filters.languages) == {"en", "de"}
    sets = {}
    for lang in filters.languages:
        words = [t for i, t, x in ROWS if x == lang and zlib.crc32(str(i).encode()) % 4 != 2]
        sets[lang] = set(np.concatenate([langid.gram_hashes(langid.code_points(t), (2, 3, 4)) for t in words]).tolist())
    for text in ("the water and the house", "mit wasser und haus", "the haus"):
        grams = langid.gram_hashes(langid.code_points(text), (2, 3, 4)).tolist()
        lang, score, _ = langid.scored(text, filters, np.zeros(2))
        counts = [sum(g in sets[x] for g in grams) for x in filters.languages]
        assert lang == filters.languages[int(np.argmax(counts))]
        assert score == pytest.approx(max(counts) / sum(counts), abs=0.05)


def test_odd_rows(spark, filters):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 ...", "en"), (None, "the garden", None), (4, "das wasser " * 50000, "x"), (4, "das wasser", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = langid.predict(docs, filters).collect()
    assert len(got) == len(rows)
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "de", "de"]
    assert all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id == 4] == [zlib.crc32(b"4") % 4 == 2] * 2
    assert langid.predict(docs.limit(0), filters).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(docs).collect()] == ["und"]


def test_keep_identified(spark, filters):
    docs = spark.createDataFrame([(1, "the garden", "en"), (2, None, "en"), (3, "qqq xxx zzz", "en")], "doc_id long, text string, lang string")
    out = langid.keep_identified(docs, filters)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [1]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def plain_filters(rows, settings):
    """Languages, and by language the n-grams it keeps, from documents' sets: what fit() states."""
    by_lang = {}
    for i, text, lang in rows:
        if i is not None and text is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            by_lang.setdefault(lang, []).append(text)
    languages = sorted(by_lang, key=lambda x: (-len(by_lang[x]), x))
    share = {}
    for lang, texts in by_lang.items():
        for t in texts:
            if (points := langid.code_points(t)) is not None:
                for g in set(langid.gram_hashes(points, settings.sizes).tolist()):
                    share.setdefault(g, Counter())[lang] += 1
    kept = {x: set() for x in languages}
    for g, n in share.items():
        most = max(n[x] / len(by_lang[x]) for x in languages)
        for x in languages:
            own = n[x] / len(by_lang[x])
            if n[x] >= settings.min_docs and own >= settings.min_share and own >= settings.min_ratio * most:
                kept[x].add(g)
    return languages, kept


def plain_prediction(text, languages, kept, settings):
    """Language and score by filters kept as sets of slots."""
    points = langid.code_points(text) if text else None
    if points is None:
        return "und", 0.0
    probes = lambda g: [g >> 20 * p & settings.slots - 1 for p in range(settings.probes)]
    filled = {x: {s for g in kept[x] for s in probes(g)} for x in languages}
    grams = langid.gram_hashes(points, settings.sizes).tolist()
    sure = []
    for x in languages:
        chance = (len(filled[x]) / settings.slots) ** settings.probes
        found = sum(all(s in filled[x] for s in probes(g)) for g in grams)
        sure.append(max(0.0, (found - chance * len(grams)) / (1 - chance)))
    best = max(range(len(languages)), key=lambda k: (sure[k], -k))
    return languages[best], sure[best] / sum(sure) if sum(sure) else 0.0


@pytest.mark.parametrize("slots", [1 << 20, 1 << 12])  # the smaller table is filled in part by chance
def test_whole_operator_equals_plain_sets(spark, slots):
    settings = langid.Settings(slots=slots)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    languages, kept = plain_filters(rows, settings)
    got = {r.doc_id: r for r in langid.identify(docs, settings).collect()}
    for i, text, _ in rows[:80]:
        lang, score = plain_prediction(text, languages, kept, settings)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-9)


def test_more_languages_than_an_integer_has_bits(spark):
    word = lambda k: "".join(chr(97 + (k * 7 + j * 5) % 26) + chr(97 + (k // 26 + j) % 26) for j in range(4))
    rows = [(100 * k + c, f"{word(k)} " * (3 + c % 3), f"l{k:02d}") for k in range(70) for c in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == len(rows) and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
