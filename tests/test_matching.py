"""Greedy matching, clustering and thinning against plain folds, and hand-written cases of time joins."""

import random

import pytest
from pyspark.sql import functions as F

from touchline.functions import text as X
from touchline.operators import matching as M
from touchline.operators import sequence as S
from touchline.operators import timejoin as T


def candidates(spark, rows):
    return spark.createDataFrame(rows, "candidate_id long, asset_id long, run_id long, trigger_ms long, start_ms long, end_ms long, event_type string, score double, status string, context string")


def random_candidates(rng, n, run):
    types = ["GOAL", "SHOT", "FOUL"]
    words = ["late strike", "free kick wide", "saved low", ""]
    return [(i, i % 3, run, t := rng.randrange(0, 400_000, 500), max(0, t - 5000), t + 8000, rng.choice(types), rng.random(), rng.choice(["DETECTED", "REJECTED", "DETECTED"]), rng.choice(words)) for i in range(run * 1000, run * 1000 + n)]


def alike(a, b):
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y) if x and y else 0.0


def test_match_runs_equals_plain_greed(spark):
    rng = random.Random(3)
    left, right = random_candidates(rng, 120, 0), random_candidates(rng, 120, 1)
    want = {}
    for asset in range(3):
        taken = set()
        for a in sorted((x for x in left if x[1] == asset), key=lambda x: (x[3], x[0])):
            free = [b for b in right if b[1] == asset and b[0] not in taken and abs(b[3] - a[3]) <= 15_000 and (b[6] == a[6] or alike(a[9], b[9]) >= 0.35)]
            if free:
                b = min(free, key=lambda b: (abs(b[3] - a[3]), -alike(a[9], b[9]), b[3], b[0]))
                taken.add(b[0])
                want[a[0]] = b[0]
    got = {r.l_id: r.r_id for r in M.match_runs(candidates(spark, left), candidates(spark, right)).collect()}
    assert got == want
    outcomes = M.compare_runs(candidates(spark, left), candidates(spark, right)).groupBy("outcome").count().collect()
    assert {r.outcome: r["count"] for r in outcomes} == {"MATCHED": len(want), "ONLY_LEFT": 120 - len(want), "ONLY_RIGHT": 120 - len(want)}


def test_clusters_equal_plain_fold(spark):
    rows = random_candidates(random.Random(4), 300, 0)
    want = {}
    window = {"GOAL": 15_000, "SHOT": 3000, "FOUL": 10_000}
    for asset in range(3):
        for kind in window:
            clusters = []
            for c in sorted((x for x in rows if x[1] == asset and x[6] == kind and x[8] == "DETECTED"), key=lambda x: (x[3], x[0])):
                words = lambda x: " ".join(w for w in x[9].split() if len(w) > 2)
                ok = lambda g: c[3] - g[0][3] <= window[kind] and all(M.same_event(c[3] - m[3], alike(words(m), words(c)), kind == "GOAL", 0.48) for m in g)  # noqa: E731, B023
                home = next((g for g in reversed(clusters) if ok(g)), None)
                if home is None:
                    clusters.append(home := [])
                home.append(c)
                want[c[0]] = home[0][0]
    got = {r.candidate_id: r.cluster_id for r in M.cluster_candidates(candidates(spark, rows)).collect()}
    assert got == want
    members = M.canonicalize(candidates(spark, rows), M.cluster_candidates(candidates(spark, rows))).collect()
    assert sorted(int(i) for r in members for i in r.members.split(",")) == sorted(want)


def test_ground_truth(spark):
    found = candidates(spark, [(1, 7, 0, 30_500, 20_000, 40_000, "GOAL", 0.9, "DETECTED", "")])
    truth = lambda n: spark.createDataFrame([(k, 7, "GOAL", 30_000 * (k + 1)) for k in range(n)], "gt_id long, asset_id long, event_type string, ts_ms long")
    reviews = spark.createDataFrame([(7, "COMPLETED")], "asset_id long, review_status string")
    five, four = M.evaluate(truth(5), reviews, found).first(), M.evaluate(truth(4), reviews, found).first()
    assert (five.true_positives, five.false_negatives, five.false_positives, five.sufficient) == (1, 4, 0, True) and not four.sufficient


@pytest.mark.parametrize("inclusive", [True, False])
def test_thinning_equals_plain_fold(spark, inclusive):
    rng = random.Random(5)
    rows = sorted({(a, rng.randrange(0, 60_000, 250)) for a in range(4) for _ in range(80)})
    want = []
    for a in range(4):
        last = None
        for asset, ts in rows:
            if asset == a and (last is None or (ts - last >= 4000 if inclusive else ts - last > 4000)):
                last = ts
                want.append((a, ts))
    got = S.thin_by_last_kept(spark.createDataFrame(rows, "asset_id long, ts_ms long"), ["asset_id"], "ts_ms", 4000, inclusive)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_range_join_kinds_and_overlap(spark):
    rng = random.Random(6)
    left = [(i, i % 2, rng.randrange(1000)) for i in range(60)]
    right = [(100 + i, i % 2, rng.randrange(1000)) for i in range(60)]
    a = spark.createDataFrame(left, "l long, k long, at long")
    b = spark.createDataFrame(right, "r long, k long, ts long")
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] - 30 <= y[2] <= x[2] + 20)
    join = lambda how: T.range_join(a, b, ["k"], F.col("at") - 30, F.col("at") + 20, "ts", 25, how)
    assert sorted((r.l, r.r) for r in join("inner").collect()) == want
    hit = {x for x, _ in want}
    assert {r.l for r in join("left_semi").collect()} == hit and {r.l for r in join("left_anti").collect()} == {x[0] for x in left} - hit
    assert join("left").count() == len(want) + len(left) - len(hit)
    c = spark.createDataFrame([(i, k, t, t + 40) for i, k, t in left], "l long, k long, s1 long, e1 long")
    d = spark.createDataFrame([(i, k, t, t + 90) for i, k, t in right], "r long, k long, s2 long, e2 long")
    both = sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] < y[2] + 90 and y[2] < x[2] + 40)
    assert sorted((r.l, r.r) for r in T.overlap_join(c, d, ["k"], ("s1", "e1"), ("s2", "e2"), 25).collect()) == both


def test_texts(spark):
    df = spark.createDataFrame([("É GOLAÇO!!!",), ("GOOOOL",), ("naïve  ß—œ",)], "text string")
    assert [r[0] for r in df.select(X.normalize_text(F.col("text"))).collect()] == ["e golaco", "goooool".replace("ooooo", "oooo"), "naive ß œ"]
    broken = "É golaço".encode().decode("cp1252", "replace")
    one = spark.createDataFrame([(broken,), ("plain",), (None,)], "text string")
    assert [r[0] for r in one.select(X.repair_mojibake(F.col("text"))).collect()][1:] == ["plain", None]
    scores = spark.createDataFrame([("HOME 2-O AWAY",), ("l:1",), ("99-1",), ("x",), (None,)], "t string").select(X.parse_score_ocr(F.col("t")).alias("s")).collect()
    assert [None if r.s is None else (r.s.home, r.s.away) for r in scores] == [(2, 0), (1, 1), None, None, None]
    told = spark.createDataFrame([("2-1 and again 2 - 1",), ("2-1 or 1-1",), ("none",)], "t string").select(X.parse_score_text(F.col("t")).alias("s")).collect()
    assert [None if r.s is None else (r.s.home, r.s.away) for r in told] == [(2, 1), None, None]
    said = spark.createDataFrame([("the goal was disallowed",), ("he had already scored",), ("what a goal",)], "t string").select(X.goal_context(F.col("t")).alias("c")).collect()
    assert [[x.type for x in r.c] for r in said] == [["NEGATION_CONTEXT"], ["RETROSPECTIVE_CONTEXT", "HISTORICAL_REFERENCE"], []]


def test_replays_of_goals_equal_brute_force(spark):
    """Which goals are replays follows from their words, whatever their ids and however long ago; a replay is no goal to be replayed."""
    import random

    from touchline.operators import assemble as E

    rng = random.Random(5)
    names = [f"name{c}" for c in "abcdefgh"]
    rows = [(rng.randrange(3), rng.randrange(2), k, rng.randrange(60) * 50_000, rng.choice(["DETECTED", "DETECTED", "REJECTED"]), " ".join(["goal", "the", "from", *rng.sample(names, rng.choice([2, 3, 4, 5]))])) for k in range(150)]
    skip, expected = {"goal", "the", "from"}, {}
    for a, r, k, ms, _, text in sorted(rows, key=lambda x: (x[3], x[2])):
        w = set(text.split())
        expected[k] = False
        for a2, r2, k2, ms2, status, text2 in rows:
            w2 = set(text2.split())
            both = (w & w2) - skip
            same = max(len(w & w2) / len(w | w2), len(both) / min(len(w - skip), len(w2 - skip))) >= 0.7 and len(both) >= 3
            if (a, r) == (a2, r2) and ms2 < ms and status == "DETECTED" and same and not expected[k2]:
                expected[k] = True
    assert 10 < sum(expected.values()) < 140
    goals = spark.createDataFrame(rows, "asset_id long, run_id long, goal_id long, goal_ms long, status string, context string")
    got = {r.goal_id: r.replay for r in E.resolve_replays(goals, E.replay_pairs(goals)).collect()}
    assert got == expected


def test_thinning_keeps_no_island_as_an_array(spark):
    """One island of 100,000 rows, of which the fold keeps every fourth or fifth."""
    from pyspark.sql import functions as F

    from touchline.operators import sequence as S

    dense = spark.range(100_000).select(F.lit(1).alias("asset_id"), (F.col("id") * 5).alias("ts_ms"), F.col("id").alias("row"))
    for inclusive, step in ((True, 4), (False, 5)):
        thin = S.thin_by_last_kept(dense, ["asset_id"], "ts_ms", 20, inclusive)
        assert thin.columns == dense.columns
        assert sorted(r.row for r in thin.collect()) == list(range(0, 100_000, step))
        assert "collect_list" not in thin._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti"])
def test_range_join_of_rows_in_no_fixed_order(spark, how):
    def shuffled(batches):
        import pyarrow as pa

        for batch in batches:
            order = list(range(batch.num_rows))
            random.SystemRandom().shuffle(order)
            yield batch.take(pa.array(order))

    left = spark.range(0, 200, 1, 1).selectExpr("id % 2 as k", "id * 10 as t").union(spark.sql("select 0L as k, 40L as t union all select null, 5L union all select 1L, null")).coalesce(1).mapInArrow(shuffled, "k long, t long")
    right = spark.createDataFrame([(0, 45), (0, 45), (1, 1000), (1, 1333)], "k long, o long")
    found = T.range_join(left, right, ["k"], F.col("t"), F.col("t") + 20, "o", 15, how)
    rows = [(i % 2, i * 10) for i in range(200)] + [(0, 40), (None, 5), (1, None)]
    of = lambda k, t: [o for j, o in [(0, 45), (0, 45), (1, 1000), (1, 1333)] if k == j and t is not None and t <= o <= t + 20]
    want = {"left": [(k, t, o) for k, t in rows for o in of(k, t) or [None]], "left_semi": [r for r in rows if of(*r)], "left_anti": [r for r in rows if not of(*r)]}[how]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
