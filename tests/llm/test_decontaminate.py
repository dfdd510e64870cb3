"""Operator 11: equal to a plain search on random texts, whatever the pieces and blocks; the query equals SQL; hits are removed."""

import hashlib
import random
import re

import duckdb
import pytest

from touchline.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    """A row for each document, by looking at every window of every item at every place."""
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, met = words(text), set(), set()
        for i in range(len(w)):
            for n in range(1, 11):
                if i + n <= len(w) and tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    met |= windows[tuple(w[i : i + n])]
        names = sorted(str(i) for i in met if i is not None)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(seed, vocabulary):
    draw = random.Random(seed)
    text = lambda n: "".join(draw.choice(vocabulary) + draw.choice([" ", ", ", "\n", " - "]) for _ in range(n))
    items = [(i, text(draw.choice([0, 1, 3, 9, 10, 11, 30]))) for i in range(12)] + [(None, text(12)), (3, text(12)), (5, None), (20, "..."), (10, text(12))]
    docs = [(i, text(draw.choice([0, 1, 5, 60, 200])) + (draw.choice(items)[1] or "").upper() + text(3)) for i in range(40)]
    docs += [(100, None), (101, ""), (102, " .!"), (None, items[4][1]), (7, items[4][1]), (7, items[4][1]), (103, items[3][1] * 40), (104, "z" * 5000 + " " + (items[6][1] or ""))]
    return docs, items


@pytest.mark.parametrize("seed", range(6))
def test_scan_equals_plain(seed, monkeypatch):
    vocabulary = ["a", "B", "it", "Öl", "x1", "7", "straße", " "] if seed % 2 else [f"w{i}" for i in range(60)]
    docs, items = rows(seed, vocabulary)
    monkeypatch.setattr(D, "PIECE_BYTES", [64, 200, 1 << 17][seed % 3])
    texts = [(t or "").encode() for _, t in items]
    pairs = {(items[k][0] if items[k][0] is None else str(items[k][0]), n, w.decode()) for k, n, w in D.item_windows(texts)}
    known = D.WindowSet.of(sorted(pairs, key=str))
    raw = [(t or "").encode() for _, t in docs]
    found = D.scan(raw, known)
    got = []
    for (doc_id, _), of, text in zip(docs, found, raw, strict=True):
        names = sorted({known.items[i] for k in of.windows for i in range(known.first[k], known.first[k + 1])} - {None})
        got.append((doc_id, of.words, sum(e - b for b, e, _, _ in of.spans), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(of.spans)))
        for first, end, b, e in of.spans:  # the bytes of a span hold its words
            assert words(text.decode())[first:end] == words(text[b:e].decode())
    assert sorted(got, key=str) == plain(docs, items)


def frames(spark, seed=1):
    docs, items = rows(seed, [f"w{i}" for i in range(40)])
    return docs, items, spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, spans int"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("most", [10**6, 20])
def test_query_equals_plain(spark, most):
    """In one block, and in several whose hits are united."""
    docs, items, d, b = frames(spark)
    got = sorted(map(tuple, D.contamination(d, b, most_windows=most).collect()), key=str)
    assert got == plain(docs, items)


def test_hits_are_removed(spark):
    docs, items, d, b = frames(spark)
    hit = {r[0] for r in plain(docs, items) if r[5]}
    kept = D.drop_documents(d, b)
    assert kept.columns == d.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _ in docs if i not in hit), key=str)
    assert D.drop_documents(d, b, most_percent=100).count() == len(docs)
    cut = D.cut_spans(d, b)
    assert cut.columns == d.columns and cut.count() == len(docs)
    before = dict(docs)
    for r in cut.where("doc_id is not null").collect():
        assert (r.text is None) == (before[r.doc_id] is None)
        if r.doc_id not in hit:
            assert r.text == before[r.doc_id]
    one = spark.createDataFrame([(1, "Ä before; Alpha BETA, gamma! after")], "doc_id long, text string")
    assert D.cut_spans(one, spark.createDataFrame([(1, "alpha beta. gamma")], "item_id long, text string")).first().text == "Ä before; ! after"


def test_empty_tables(spark):
    _, _, d, b = frames(spark)
    assert D.contamination(d.limit(0), b).count() == 0
    none = D.contamination(d, b.limit(0))
    assert none.where("contaminated or n_hit > 0 or n_items > 0").count() == 0 and none.count() == d.count()


def test_equal_hashes_are_told_apart():
    known = D.WindowSet.of([("1", 2, "a b"), ("2", 2, "c d")])
    known.hashes[:] = known.hashes[0]
    known.bitmap[:] = True
    at = known.windows.index(b"c d")
    assert known.verified(0, b"c d") == at and known.verified(0, b"e f") == -1


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    got = D.contamination(*(spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark")))
    assert any(r.contaminated for r in got.collect())
    cursor = con.execute(D.SQL)
    assert sorted(got.columns) == sorted(c[0] for c in cursor.description)
    assert sorted(map(tuple, got.collect())) == sorted(cursor.fetchall())
