"""The pipeline against a plain version: each stage's input is what the one before kept."""

import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from touchline.llm import pii, simhash
from touchline.llm.common import DOCUMENT_COLUMNS, read_table
from touchline.llm.queries import TOKENIZER


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = read_table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, sf_dir)
        df.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if name != "packing":
            assert docs.columns == DOCUMENT_COLUMNS
        out[name] = [r.asDict() for r in docs.collect()]
    return [r.asDict() for r in read_table(spark, sf_dir, "documents").collect()], out


def test_language_and_quality_keep_clean_documents(spark, sf_dir, stages):
    raw, out = stages
    assert {r["doc_id"] for r in out["language"]} == {r["doc_id"] for r in raw if re.search(r"[^\W\d_]", r["text"])}
    labels = {r.doc_id: r.quality for r in read_table(spark, sf_dir, "labels").collect()}
    kept = {r["doc_id"] for r in out["quality"]}
    words = {r["doc_id"]: len(r["text"].split()) for r in raw}
    clean = [i for i, q in labels.items() if q == 1 and words[i] >= 50]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)
    assert not any(labels.get(i) == 0 for i in kept)


def test_near_copies(stages):
    _, out = stages
    texts = {r["doc_id"]: r["text"] for r in out["quality"]}
    sets = {i: set(simhash.shingle_hashes(t, 5, 42).tolist()) for i, t in texts.items()}
    near = {(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    kept = {r["doc_id"] for r in out["near_copies"]}
    assert not [p for p in near if p[0] in kept and p[1] in kept]
    touched = {i for p in near for i in p}
    assert all(i in kept for i in texts if i not in touched)


def test_personal_data_is_gone(stages):
    _, out = stages
    anchors = pii.automaton()
    before = {r["doc_id"]: r for r in out["near_copies"]}
    for r in out["personal"]:
        assert not any(pii.find_spans(r["text"], anchors)[k] for k in pii.BASE_KINDS)
        assert r["n_chars"] == len(r["text"]) and (r["text"] == before[r["doc_id"]]["text"] or "[" in r["text"])


def test_packing_holds_every_id(stages):
    _, out = stages
    library = Tokenizer.from_file(TOKENIZER)
    want = {r["doc_id"]: [*library.encode(r["text"], add_special_tokens=False).ids, 2] for r in out["personal"]}
    got = {i: 0 for i in want}
    for p in out["packing"]:
        ids = np.array(want[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4")
        assert zlib.crc32(ids.tobytes()) == p["ids_crc32"]
        got[p["doc_id"]] += p["length"]
    assert got == {i: len(x) for i, x in want.items()}


def test_run_gives_the_same_rows(spark, sf_dir, stages):
    _, out = stages
    total = lambda rows: sorted((r["doc_id"], r["doc_tokens"]) for r in rows)
    got = {(r.doc_id, r.doc_tokens) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert sorted(got) == sorted(set(total(out["packing"])))


def test_odd_rows_go_through(spark, sf_dir, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows, other columns; and an empty table."""
    some = read_table(spark, sf_dir, "documents").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "x", 1) for r in some] + [(some[3].doc_id, some[3].text, some[3].lang, some[3].source, some[3].n_chars, "x", 1)] * 2
    rows += [(None, some[5].text, None, None, None, None, None), (9001, None, None, None, None, None, None), (9002, "", "en", "s", 0, "x", 1), (9003, " \n ", None, "s", 3, "x", 1)]
    rows += [(9004, (some[7].text + " ") * 400, "en", "s", None, "x", 1), (9005, "word" * 60_000, "en", "s", None, "x", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, score int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    read_table(spark, sf_dir, "labels").unionByName(spark.createDataFrame([(None, 1, 0), (some[0].doc_id, None, None)], "doc_id long, quality long, toxic long"), allowMissingColumns=True).write.parquet(f"{tmp_path}/labels.parquet")
    packed = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    whole = {}
    for p in packed:
        whole.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], p["length"]))
    for (_, tokens), pieces in whole.items():
        at = 0
        for start, length in sorted(set(pieces)):
            assert start == at
            at += length
        assert at == tokens
    ids = [p["doc_id"] for p in packed if p["start"] == 0]
    assert len(ids) == len(set(ids)) and not {9001, 9002, 9003} & set(ids)
    empty = tmp_path / "empty"
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    read_table(spark, sf_dir, "labels").limit(0).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
