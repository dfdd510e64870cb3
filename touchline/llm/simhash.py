"""Near copies by SimHash, compared exactly in tiles (operator 8).

A fingerprint has a bit for each bit of the shingles' hashes: 1 if over half of the shingles have it set. Fingerprints are dealt into
tiles by the population counts of their parts: two fingerprints within the radius have counts that differ by the radius at most, summed
over the parts, so only tiles that near meet and all other pairs of tiles are skipped. Tiles over a fixed size are split into chunks. Each
pair of chunks is one row of a join; a task compares it with numpy's exclusive-or and bit counts, skipping what the whole counts rule
out, and returns a minimum spanning forest of the links it found: at most one edge fewer than members, which joins what all links join.
Components are then found over those edges by alternating star contractions, each round checkpointed.

Exact copies meet before any comparison: fingerprints are compared once each, however many documents have them. No step sends pairs,
components or fingerprints to the driver, and no group of copies is expanded into its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import checkpointed, per_row, spark_schema, spread_join, unused

#: Fingerprints in a chunk, in expectation. A pair of chunks is what one comparison holds in memory.
CHUNK = 2048


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included: words of lower-cased A-Z, joined by blanks; a shorter text is one shingle."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: only ASCII counts as case or white space
    if not found:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(itertools.islice(found, k, None) for k in range(words)), strict=False)) if len(found) >= words else iter([b" ".join(found)])
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, max(1, len(found) - words + 1))


def majority(hashes: np.ndarray) -> bytes:
    """The fingerprint of hashes, most significant byte first; zero without hashes."""
    counts = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), 1 << 16):
        part = hashes[begin : begin + (1 << 16)].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def population(fingerprint: bytes) -> int:
    return int.from_bytes(fingerprint, "big").bit_count()


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, node (the fingerprint as a signed integer), fp (its bytes), tile (population counts of its quarters) of every row. No shuffle."""
    out = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("fp", pa.binary()), ("tile", pa.string())])

    def make():
        def row(doc_id, text):
            fp = majority(shingle_hashes(text, words, 42))
            return doc_id, int.from_bytes(fp, "big", signed=True), fp, " ".join(str(population(fp[k : k + 2])) for k in range(0, 8, 2))

        return row

    return docs.select("doc_id", "text").mapInArrow(per_row(["doc_id", "text"], out, make), spark_schema(out)).withColumn("tile", F.split("tile", " ").cast("array<int>"))


def half(offsets) -> list[tuple[int, ...]]:
    """Of each pair of opposite offsets one, and the zero offset: every two tiles meet once."""
    return [v for v in offsets if v >= tuple(0 for _ in v)]


def within(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Offsets between tiles whose population counts differ by the radius at most."""
    return half(v for v in itertools.product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, v)) <= radius)


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a, rows of b and distances of what is within the radius, some at a time; a and b: uint64, a column a word. same: b is a, each pair once."""
    count_a, count_b = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    order_a, order_b = np.argsort(count_a, kind="stable"), np.argsort(count_b, kind="stable")
    sorted_a, sorted_b, counts = a[order_a], b[order_b], count_b[order_b]
    for begin in range(0, len(a), 128):
        rows, own = sorted_a[begin : begin + 128], count_a[order_a[begin : begin + 128]]
        lo, hi = np.searchsorted(counts, own[0] - radius, "left"), np.searchsorted(counts, own[-1] + radius, "right")
        if lo >= hi:
            continue
        distance = np.bitwise_count(rows[:, None, 0] ^ sorted_b[None, lo:hi, 0])
        for w in range(1, a.shape[1]):
            distance = distance + np.bitwise_count(rows[:, None, w] ^ sorted_b[None, lo:hi, w])
        i, j = np.nonzero(distance <= radius)
        d, i, j = distance[i, j], order_a[i + begin], order_b[j + lo]
        keep = i < j if same else slice(None)
        if len(i[keep]):
            yield i[keep], j[keep], d[keep]


def spanning_forest(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which edges make a forest of least distances over nodes 0..n-1 (ties: the smaller nodes), by rounds that each take every part's nearest edge."""
    order = np.lexsort((j, i, d))
    i, j = i[order], j[order]
    rank = np.arange(len(i))
    label, taken = np.arange(n), []
    while len(rank):
        a, b = label[i[rank]], label[j[rank]]
        rank, a, b = rank[a != b], a[a != b], b[a != b]
        if not len(rank):
            break
        best = np.full(n, len(i))
        np.minimum.at(best, a, rank)
        np.minimum.at(best, b, rank)
        chosen = np.unique(best[best < len(i)])
        taken.append(chosen)
        parent = list(range(n))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for x, y in zip(label[i[chosen]].tolist(), label[j[chosen]].tolist(), strict=True):
            parent[root(x)] = root(y)
        label = np.fromiter((root(x) for x in label.tolist()), np.int64, n)
    return order[np.concatenate(taken)] if taken else np.empty(0, np.int64)


#: Links that a comparison holds before it reduces them to a forest.
MOST_LINKS = 1 << 18


def forest_of(n: int, links: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], shift: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a spanning forest of links, whose second ends are shifted. A forest of a forest and more links is a forest of all links, so no more
    than MOST_LINKS and one step's are held, however dense they are."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def reduced() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, d = (np.concatenate(x) for x in zip(*held, strict=True))
        keep = spanning_forest(n, i, j, d)
        return i[keep], j[keep], d[keep]

    for i, j, d in links:
        held.append((i, j + shift, d))
        if sum(len(x[0]) for x in held) > MOST_LINKS:
            held = [reduced()]
    return reduced()[:2] if held else (np.empty(0, np.int64), np.empty(0, np.int64))


def _compare(radius: int):
    """mapInArrow: pairs of chunks to the edges of their forests."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def unpack(cell) -> tuple[np.ndarray, np.ndarray]:
        nodes = np.array(cell.values.field("node").to_numpy(zero_copy_only=False), np.int64)
        fps = cell.values.field("fp").to_pylist()
        return nodes, np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(len(nodes), -1)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                same = batch.column(2)[r].as_py()
                left, fps = unpack(batch.column(0)[r])
                right, others = (left, fps) if same else unpack(batch.column(1)[r])
                shift = 0 if same else len(left)
                i, j = forest_of(len(left) + (0 if same else len(right)), near_pairs(fps, others, radius, same), shift)
                if not len(i):
                    continue
                a, b = left[i], right[j - shift]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

    return run, spark_schema(schema)


def links(nodes: DataFrame, radius: int, offsets: list[tuple[int, ...]], chunk: int = CHUNK) -> DataFrame:
    """Edges a < b that join what fingerprints within the radius join.

    nodes: node (long, one row each), fp (binary), tile (array of ints); fingerprints of tiles whose difference is none of the offsets
    or their opposites are taken to be farther apart.
    """
    sizes = nodes.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(chunk))).cast("int").alias("chunks"))
    sizes = F.broadcast(sizes)  # as many rows as there are vectors of population counts at most, whatever the corpus
    packed = (
        nodes.join(sizes, "tile")
        .groupBy("tile", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"))
        .agg(F.collect_list(F.struct("node", "fp")).alias("members"))
    )
    steps = "array(" + ", ".join(f"array({', '.join(map(str, v))})" for v in offsets) + ")"
    left = packed.select(F.col("tile").alias("l_tile"), F.col("chunk").alias("l_chunk"), F.col("members").alias("l_members"), F.explode(F.expr(steps)).alias("step"))
    left = left.select("l_tile", "l_chunk", "l_members", F.zip_with("l_tile", "step", lambda x, y: x + y).alias("tile")).join(sizes, "tile")
    left = left.select("l_tile", "l_chunk", "l_members", "tile", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    own = F.col("l_tile") == F.col("tile")
    left = left.where(~own | (F.col("l_chunk") <= F.col("chunk")))
    run, schema = _compare(radius)
    pairs = left.join(packed, ["tile", "chunk"]).select("l_members", "members", (own & (F.col("l_chunk") == F.col("chunk"))).alias("same"))
    return pairs.mapInArrow(run, schema).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it reaches) of every node of edges(a, b), by alternating star contractions.

    An edge is (u, v), u > v. A round first points u at the least neighbour of v, or v itself; then u and all it points at to the least of those.
    Nothing moves only once every v is a root and every u points at one.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), F.lit(True).alias("moved")).distinct())
    while not now.where("moved").isEmpty():
        ends = now.select(F.inline(F.array(F.struct(F.col("v").alias("x"), F.col("u").alias("y")), F.struct(F.col("u").alias("x"), F.col("v").alias("y")))))
        least = ends.groupBy(F.col("x").alias("v")).agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = now.select("u", "v").join(least, "v").select("u", F.col("m").alias("v"), (F.col("m") < F.col("v")).alias("moved"))
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        other = F.col("v") > F.col("m")
        own = F.struct("u", F.col("m").alias("v"), (F.col("moved") | other).alias("moved"))
        stars = F.array_compact(F.array(own, F.when(other, F.struct(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(True).alias("moved")))))
        now = checkpointed(small.select(F.inline(stars)).groupBy("u", "v").agg(F.bool_or("moved").alias("moved")))
    named = now.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root")))))
    return named.groupBy("node").agg(F.min("root").alias("root"))


def near_copies(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (the smallest doc_id that links reach) of every row of docs(doc_id, text, ...).

    Null texts and texts without words have fingerprint zero and link like any other. Repeated rows give a row each. A null doc_id takes
    part, but names no component: component_id is null only where all ids of the component are.
    """
    rows = checkpointed(fingerprints(docs, words))
    nodes = rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("tile").alias("tile"), F.min("doc_id").alias("first_id"))
    found = components(links(nodes.select("node", "fp", "tile"), radius, within(4, radius)))
    rooted = nodes.select("node", "first_id").join(found, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = spread_join(rooted.select("node", "root"), smallest, "root", "node").select("node", "component_id")
    named = spread_join(rows.select("doc_id", "node", F.lower(F.hex("fp")).alias("fingerprint")), named, "node", "doc_id")
    return named.select("doc_id", "fingerprint", "component_id")


@dataclass(frozen=True)
class Thinning:
    """How drop_near_copies compares: longer shingles, two hashes for 128 bits, and Jaccard similarity of the shingles to confirm a link."""

    words: int = 5
    similarity: float = 0.8
    radius: int = 28  # of 128: pairs at the similarity differ in about 19 bits (4 a standard deviation), unrelated ones in 64


def _sketches(words: int):
    """make() for per_row: doc_id, a hash of the text, fp of 128 bits, number of different shingles, digest of their set and number. All but the first
    two are of the set, without repeats."""

    def make():
        def row(doc_id, text):
            own, other = (np.unique(shingle_hashes(text, words, seed)) for seed in (42, 43))
            digest = xxhash.xxh64_intdigest(own.tobytes(), len(own)) - (1 << 63)
            return doc_id, _text_hash(text), majority(own) + majority(other), len(own), digest

        return row

    return make


def _text_hash(text: str | None) -> int:
    """What Spark's xxhash64 gives for the text."""
    return int.from_bytes(xxhash.xxh64_digest((text or "").encode("utf-8", "surrogatepass"), 42), "big", signed=True)


#: Shingles of a chunk whose pairs are all confirmed, in expectation: what two such chunks hold bounds a task's memory.
MOST_SHINGLES = 1 << 20


def joining_pairs(part: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], left: int, radius: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs of rows within the radius and of the similarity that join what such pairs join, besides what part (a number a row) joins already.

    Pairs are of the first left rows with the others, or of all rows if left is their number. A pair whose ends are joined is skipped.
    """
    label, same = np.unique(part, return_inverse=True)[1], left == len(part)
    ends = np.cumsum([len(x) for x in sets])
    ids = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], ends[:-1])
    mark = np.zeros(ends[-1], bool)
    for i, j, _ in near_pairs(fps[:left], fps if same else fps[left:], radius, same):
        j = j if same else j + left
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        for others in np.split(j, np.flatnonzero(np.diff(i)) + 1):
            row, i = int(i[0]), i[len(others) :]
            others = others[label[others] != label[row]]
            if not len(others):
                continue
            sizes = np.array([len(ids[k]) for k in others])
            mark[ids[row]] = True
            common = np.concatenate([[0], np.cumsum(mark[np.concatenate([ids[k] for k in others])])])
            common = np.diff(common[np.concatenate([[0], np.cumsum(sizes)])])
            mark[ids[row]] = False
            for k in others[common / np.maximum(1, len(ids[row]) + sizes - common) >= similarity].tolist():
                if label[k] != label[row]:
                    label[label == label[k]] = label[row]
                    yield row, k


def _join_parts(radius: int, similarity: float):
    """mapInArrow: pairs of chunks (lo, hi, members) of a group to confirmed links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                lo, hi = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                cells = batch.column(2)[r].values
                node, part, chunk = (cells.field(x).to_numpy(zero_copy_only=False) for x in ("node", "part", "chunk"))
                order = np.argsort(chunk, kind="stable")
                left = int((chunk == lo).sum())
                if not left or (lo < hi and left == len(node)):
                    continue
                fps = np.frombuffer(b"".join(cells.field("fp").to_pylist()), ">u8").astype(np.uint64).reshape(len(node), -1)
                raw = cells.field("shingles")
                sets = [np.frombuffer(raw[int(k)].as_buffer(), np.uint32) for k in order]
                found = [(node[order[x]], node[order[y]]) for x, y in joining_pairs(part[order], fps[order], sets, left, radius, similarity)]
                if found:
                    a, b = np.array(found, np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

    return run, spark_schema(schema)


def drop_near_copies(docs: DataFrame, how: Thinning = Thinning(), chunk: int = CHUNK) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id; docs' columns.

    Documents whose sets of shingles are equal (by a digest of 64 bits) are copies and one node. Others are linked by fingerprints within the
    radius and sizes that allow the similarity, and by a Jaccard similarity of the shingles themselves (as 32-bit hashes) that reaches it;
    groups are what those links join. First the nearest links by fingerprints that hold a group together are confirmed. Where all are, all
    other pairs are joined, too; where one isn't, all pairs of that group whose ends aren't joined yet are confirmed, chunk by chunk. Texts
    without words are copies of each other. A row is known by its id and its text, so ids that stand on several texts lose nothing; where rows
    of one id are in a group, the text with the smallest hash stays. Repeated rows count as copies. Rows with a null doc_id can't be named
    and stay.
    """
    out = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.binary()), ("size", pa.int64()), ("node", pa.int64())])
    named = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    rows = checkpointed(named.mapInArrow(per_row(["doc_id", "text"], out, _sketches(how.words)), spark_schema(out)))
    # sizes that allow the similarity are in the same or in neighbouring buckets
    bucket = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / F.log(F.lit(1 / how.similarity)) + F.lit(1e-9)).cast("int")
    bits = F.length(F.translate(F.conv(F.hex(F.substring("fp", 1, 8)), 16, 2), "0", "")) + F.length(F.translate(F.conv(F.hex(F.substring("fp", 9, 8)), 16, 2), "0", ""))
    classes = checkpointed(rows.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("fp").alias("fp"), F.first("size").alias("size")))
    tile = F.array(bucket, F.floor(bits / F.lit(how.radius + 1)).cast("int"))
    nodes = classes.where("size > 0").select("node", "fp", "size", tile.alias("tile"))
    edges = checkpointed(links(nodes, how.radius, half(itertools.product((-1, 0, 1), repeat=2)), chunk))
    sets = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def shingles():
        def row(node, text):
            return node, np.unique(shingle_hashes(text, how.words, 42).astype(np.uint32)).tobytes()

        return row

    # from the text of a class' first row, once, and read three times below
    linked = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = classes.join(linked, "node", "left_semi").select("node", "first.doc_id", "first.text_hash")
    have = named.join(wanted, "doc_id").where(F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("text_hash"))
    have = checkpointed(have.select("node", "text").mapInArrow(per_row(["node", "text"], sets, shingles), spark_schema(sets)).dropDuplicates(["node"]))
    both = edges.join(have.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a").join(have.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    pair = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def jaccard():
        def row(a, b, of_a, of_b):
            x, y = np.frombuffer(of_a, np.uint32), np.frombuffer(of_b, np.uint32)
            common = len(np.intersect1d(x, y, assume_unique=True))
            return a, b, common / max(1, len(x) + len(y) - common)

        return row

    checked = checkpointed(both.mapInArrow(per_row(["a", "b", "of_a", "of_b"], pair, jaccard), spark_schema(pair)))
    confirmed, failed = (checked.where(t).select("a", "b") for t in (F.col("similarity") >= how.similarity, F.col("similarity") < how.similarity))
    parts = components(confirmed).withColumnRenamed("root", "part")
    joined = parts.select(F.col("node").alias("a"), F.col("part").alias("b"))  # joins what the confirmed links join, and in fewer rounds
    groups = components(joined.unionByName(failed))
    broken = groups.join(failed.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("root").distinct()
    members = groups.join(broken, "root", "left_semi").join(parts, "node", "left").join(nodes.select("node", "fp", "size"), "node")
    members = checkpointed(members.select("node", "root", F.coalesce("part", "node").alias("part"), "fp", "size"))
    chunks = members.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(float(chunk)), F.sum("size") / F.lit(float(MOST_SHINGLES)))).cast("int").alias("chunks"))
    dealt = members.join(chunks, "root").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.join(have, "node")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = dealt.groupBy("root", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi")).agg(F.collect_list(F.struct("node", "part", "chunk", "fp", "shingles")).alias("members"))
    run, schema = _join_parts(how.radius, how.similarity)
    roots = components(joined.unionByName(met.select("lo", "hi", "members").mapInArrow(run, schema)))
    grouped = classes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first"))
    stays, hashed = unused("q_stays", docs), unused("q_hash", docs)
    stay = grouped.select(F.col("first.doc_id").alias(stays), F.col("first.text_hash").alias(hashed))
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    kept = docs.join(stay, (F.col("doc_id") == F.col(stays)) & (text_hash == F.col(hashed)), "left_semi").withColumn(hashed, text_hash)
    return kept.dropDuplicates(["doc_id", hashed]).select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
