"""Operator 2: every id in one piece, no gap, little padding, and the placement rule against its plain form."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from touchline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(pieces, ids_of):
    """pieces: rows of the operator; ids_of: ids by document."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
        ids = np.array(ids_of[p["doc_id"]], "<u4")[p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(ids.tobytes()) and p["doc_tokens"] == len(ids_of[p["doc_id"]]) and p["length"] > 0
    assert set(by_doc) == set(ids_of)
    for doc, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
        assert at == len(ids_of[doc])
    padding = total = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.CAPACITY
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
        total += at
    return padding / max(1, total), len(pieces) - sum(-(-len(x) // packing.CAPACITY) for x in ids_of.values())


def test_level_rule_equals_plain_sum_of_squares():
    rng = random.Random(1)
    for _ in range(300):
        p = packing.Packer(capacity=24)
        p.levels[1:24] = [rng.randrange(4) for _ in range(23)]
        size = rng.randrange(1, 24)

        def cost(level):
            n = p.levels.copy()
            if level:
                n[level] -= 1
            if level + size < 24:
                n[level + size] += 1
            return int((n[1:24] ** 2).sum())

        fits = [h for h in range(0, 24 - size + 1) if h == 0 or p.levels[h]]
        assert p.level_for(size) == min(fits, key=lambda h: (cost(h), -h))


def test_random_documents_fill_windows():
    rng, packer, out, ids_of = np.random.default_rng(2), packing.Packer(open_tokens=200_000), [], {}
    sequences = []
    for doc in range(3000):
        ids_of[doc] = rng.integers(0, 49000, int(rng.lognormal(6, 1.2)) + 1).astype(np.uint32)
        sequences += packer.add(doc, ids_of[doc])
    sequences += packer.drain()
    for number, s in enumerate(sequences):
        at = 0
        for p in s:
            out.append({"doc_id": p.doc[0], "start": p.start, "length": len(p.ids), "ids_crc32": zlib.crc32(p.ids.tobytes()), "doc_tokens": p.doc[1], "sequence_id": number, "offset": at})
            at += len(p.ids)
    padding, cuts = check(out, ids_of)
    assert padding == 0 and cuts < 1500
    assert Counter(len(s) > 0 for s in sequences) == {True: len(sequences)}


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    library = Tokenizer.from_file(PATH)
    ids_of = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 2] for r in docs.collect()}
    rows = [r.asDict() for r in packing.pack_documents(docs.repartition(3), PATH).collect()]
    padding, _ = check(rows, ids_of)
    assert padding == 0


@pytest.mark.parametrize("copies", [0, 1, 3])
def test_odd_rows(spark, copies):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "word " * 20_000, "x")] * copies or [(0, "", "")], "doc_id long, text string, start string")
    got = packing.pack_documents(docs if copies else docs.limit(0), PATH).collect()
    assert sum(r.length for r in got) == copies * (1 + 1 + 20_001)
    assert sum(r.length for r in got if r.doc_id is None) == copies * 20_001
