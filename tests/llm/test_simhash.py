"""Operator 8 against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from touchline.llm import simhash


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, radius=2):
    fps = [fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                comp[root(i)] = root(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    least = {r: min((d for d in g if d is not None), default=None) for r, g in groups.items()}
    return sorted(((doc, f"{fps[i]:016x}", least[root(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def test_fingerprint():
    for text in ("", None, "One", "one TWO", "É A b c d", "a b c\td\x0be", " x\x1cy z "):
        assert simhash.majority(simhash.shingle_hashes(text, 3, 42)).hex() == f"{fingerprint(text):016x}"


def test_rows_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(40)]
    rows = [(None, "null id here now"), (7, None), (8, ""), (9, "  \n"), (10, "one"), (11, "ONE"), (11, "ONE")]
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 200]))]
        rows.append((100 - k, " ".join(words)))
        for c in range(rng.choice([0, 0, 3])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((1000 + 10 * k + c, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    got = sorted((tuple(r) for r in simhash.near_copies(docs).collect()), key=str)
    assert got == brute(rows)
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_documents_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in simhash.near_copies(docs).collect()), key=str)
    assert got == brute(rows)


def test_links_join_what_all_pairs_join(spark):
    """Random fingerprints with dense and sparse neighbourhoods, small chunks."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = {int(x) for x in base}
    for x in base[:20]:
        for _ in range(30):
            fps.add(int(x) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    fps = sorted(fps)
    rows = [(int(np.uint64(f).astype(np.int64)), f.to_bytes(8, "big"), [(f >> (48 - 16 * k) & 0xFFFF).bit_count() for k in range(4)]) for f in fps]
    nodes = spark.createDataFrame(rows, "node long, fp binary, tile array<int>")
    edges = [tuple(r) for r in simhash.links(nodes, 2, simhash.within(4, 2), chunk=16).collect()]
    parent = {r[0]: r[0] for r in rows}

    def root(p, x):
        while p[x] != x:
            x = p[x]
        return x

    other = dict(parent)
    for a, b in edges:
        parent[root(parent, a)] = root(parent, b)
    signed = [r[0] for r in rows]
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                other[root(other, signed[i])] = root(other, signed[j])
    groups = lambda p: sorted(sorted(x for x in signed if root(p, x) == r) for r in {root(p, x) for x in signed})
    assert groups(parent) == groups(other)
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for g in groups(other):
        assert len(g) == 1 or {found[x] for x in g} == {g[0]}


def test_forest_of_dense_links_in_small_steps(monkeypatch):
    rng = np.random.default_rng(8)
    fps = np.array([0, 0xFF, 0xFF00, 0xFF0000], np.uint64)[rng.integers(0, 4, (300, 1))]
    joined = []
    for most in (40, 1 << 18):
        monkeypatch.setattr(simhash, "MOST_LINKS", most)
        i, j = simhash.forest_of(300, simhash.near_pairs(fps, fps, 3, True))
        assert len(i) == 300 - len(np.unique(fps))
        joined.append((fps[i] == fps[j]).all())
    assert all(joined)


def test_components_of_a_path_and_of_nothing(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 500)], "a long, b long")
    found = simhash.components(edges).collect()
    assert len(found) == 201 and {r.root for r in found} == {0}
    assert simhash.components(edges.limit(0)).count() == 0


@pytest.fixture(scope="module")
def near(spark):
    rng = random.Random(4)
    rows, groups = [], []
    for k in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 150, 400]))]
        own = [(1000 - k, " ".join(words))]
        for c in range(3):
            edited = list(words)
            edited[rng.randrange(len(edited))] = "edit"
            own.append((2000 + 10 * k + c, " ".join(edited)))
        rows += own
        groups.append([i for i, _ in own])
    rows += [(1, "short"), (2, "short"), (2, "short"), (3, None), (4, ""), (None, "any"), (None, "any")]
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), groups


def test_one_of_each_group_stays(near):
    docs, groups = near
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns
    kept = sorted(r.doc_id or -1 for r in out.collect())
    assert kept == sorted([-1, -1, 1, 3, *(min(g) for g in groups)])
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


def test_thinned_documents(spark, sf_dir):
    """No two that stay are that similar; what goes is similar to some other document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    sets = {i: set(simhash.shingle_hashes(t, 5, 42).tolist()) for i, t in texts.items()}
    near = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) >= 0.8
    missed = [(a, b) for a in kept for b in kept if a < b and near(a, b)]
    assert not missed
    assert all(any(near(a, b) for b in texts if b != a) for a in texts if a not in kept)


def test_similar_pairs_that_the_nearest_links_leave_out(spark):
    """Families whose pairs lie on both sides of 0.8, by brute force over all pairs."""
    rng = random.Random(6)
    texts = {}
    for family in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(100)]
        for member in range(14):
            words = list(base)
            for at in rng.sample(range(100), rng.choice([1, 2, 2, 3])):
                words[at] = f"edit{rng.randrange(3)}"
            texts[100 * family + member] = " ".join(words)
    sketch = simhash._sketches(5)()
    fps = {i: int.from_bytes(sketch(i, t)[2], "big") for i, t in texts.items()}
    sets = {i: set(simhash.shingle_hashes(t, 5, 42).astype(np.uint32).tolist()) for i, t in texts.items()}
    similar = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and (sets[a] == sets[b] or (fps[a] ^ fps[b]).bit_count() <= 28 and similar(a, b)):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = sorted(i for i in texts if find(i) == i)
    assert 30 < len(expected) < 300
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == expected
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs, chunk=4).collect()) == expected


def test_repeats_of_a_line_move_no_fingerprint(spark):
    rng = random.Random(9)
    rows = []
    for k in range(20):
        body, line = (" ".join(f"w{rng.randrange(3000)}" for _ in range(n)) for n in (100, 10))
        rows += [(2 * k, f"{body}\n{line}"), (2 * k + 1, body + f"\n{line}" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == [2 * k for k in range(20)]
    sketch = simhash._sketches(5)()
    assert sketch(0, "a b c d e f " * 3)[2:] == sketch(0, "a b c d e f " * 9)[2:]


def test_ids_on_several_texts_and_clashing_names(spark):
    rng = random.Random(11)
    one, two, three = (" ".join(f"w{rng.randrange(3000)}" for _ in range(80)) for _ in range(3))
    rows = [(1, one, "a", "b"), (1, two, "c", "d"), (1, two, "c", "d"), (2, two + " end", "e", "f"), (3, one, "g", "h"), (4, three, "user value", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, q_hash string, q_stays string")
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == sorted({rows[0], rows[1], rows[5]})


def test_a_hot_fingerprint_and_a_star(spark):
    docs = spark.createDataFrame([(k, "same words here now") for k in range(500)] + [(1000, "other words of its own")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_copies(docs).collect()} == {*((k, 0) for k in range(500)), (1000, 1000)}
    star = spark.createDataFrame([(5, 100 + k) for k in range(400)], "a long, b long")
    assert {r.root for r in simhash.components(star).collect()} == {5}
