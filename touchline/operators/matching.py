"""Greedy matching of two runs, of events to ground truth, and clustering. Pairs are scored set-wise; what depends on earlier choices is folded in
islands of time that no choice reaches across."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.text import jaccard, token_set
from touchline.operators import timejoin as T
from touchline.settings import DEFAULTS, Settings


MATCH = pa.schema([("l_id", pa.int64()), ("r_id", pa.int64()), ("gap_ms", pa.int64())])
CLUSTER = pa.schema([("candidate_id", pa.int64()), ("cluster_id", pa.int64())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows island, l_id, r_id, gap in the order in which left items choose, each the best first: the first one that is free is taken."""
    found = []
    for _, own in groupby(_rows(batches), key=itemgetter(0)):
        taken, done = set(), None
        for _, left, right, gap in own:
            if left != done and right not in taken:
                taken.add(right)
                done = left
                found.append((left, right, gap))
        if len(found) > 5000:
            yield _out(found, MATCH)
            found = []
    if found:
        yield _out(found, MATCH)


def greedy_match(pairs: DataFrame, keys: list[str], reach_ms: int) -> DataFrame:
    """l_id, r_id, gap_ms from eligible pairs (keys, l_id, l_ms, r_id, r_ms, similarity): left items in order of time and id each take the free right
    item that is nearest, then most similar, then earliest. Islands are cut where no pair reaches across, sorted, and passed through one after the other.
    """
    times = pairs.select(*keys, F.explode(F.array("l_ms", "r_ms")).alias("at_ms")).distinct()
    w = Window.partitionBy(*keys).orderBy("at_ms")
    cut = times.withColumn("new", F.coalesce((F.col("at_ms") - F.lag("at_ms").over(w) > reach_ms).cast("int"), F.lit(0)))
    numbered = cut.select(*keys, F.col("at_ms").alias("l_ms"), F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))
    rows = pairs.join(numbered, [*keys, "l_ms"]).select(F.struct(*keys, "island").cast("string").alias("island"), "l_id", "l_ms", "r_id", "r_ms", "similarity", F.abs(F.col("r_ms") - F.col("l_ms")).alias("gap_ms"))
    rows = rows.repartition("island").sortWithinPartitions("island", "l_ms", "l_id", "gap_ms", F.desc("similarity"), "r_ms", "r_id")
    return rows.select("island", "l_id", "r_id", "gap_ms").mapInArrow(_greedy, "l_id long, r_id long, gap_ms long")


def match_runs(left: DataFrame, right: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """l_id, r_id, gap_ms of candidates of two runs that are the same event: the same type or similar words, within the tolerance."""
    side = lambda df, p: df.select("asset_id", F.col("candidate_id").alias(f"{p}_id"), F.col("trigger_ms").alias(f"{p}_ms"), F.col("event_type").alias(f"{p}_type"), token_set(F.coalesce("context", F.lit("")), "raw").alias(f"{p}_words"))
    tol = cfg.match_tolerance_ms
    pairs = T.range_join(side(left, "l"), side(right, "r"), ["asset_id"], F.col("l_ms") - tol, F.col("l_ms") + tol, "r_ms", 2 * tol)
    pairs = pairs.withColumn("similarity", jaccard(F.col("l_words"), F.col("r_words"))).where("l_type = r_type or similarity >= 0.35")
    return greedy_match(pairs, ["asset_id"], tol)


def compare_runs(left: DataFrame, right: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """l_id, r_id, outcome, score_changed, type_changed, status_changed: matched pairs, and what only one run has."""
    matched = match_runs(left, right, cfg)
    side = lambda df, p: df.select(F.col("candidate_id").alias(f"{p}_id"), F.col("score").alias(f"{p}_score"), F.col("event_type").alias(f"{p}_type"), F.col("status").alias(f"{p}_status"))
    rows = side(left, "l").join(matched, "l_id", "left").join(side(right, "r"), "r_id", "full")
    outcome = F.when(F.col("l_id").isNull(), "ONLY_RIGHT").when(F.col("r_id").isNull(), "ONLY_LEFT").otherwise("MATCHED")
    both = F.col("l_id").isNotNull() & F.col("r_id").isNotNull()
    changed: dict[str, Column] = {"score_changed": F.abs(F.col("l_score") - F.col("r_score")) > 5e-5, "type_changed": F.col("l_type") != F.col("r_type"), "status_changed": F.col("l_status") != F.col("r_status")}
    return rows.select("l_id", "r_id", outcome.alias("outcome"), *((both & F.coalesce(t, F.lit(False))).alias(n) for n, t in changed.items()))


def evaluate(gt_events: DataFrame, gt_reviews: DataFrame, candidates: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """By asset: true positives, false negatives, false positives, and whether the ground truth suffices."""
    tol = cfg.match_tolerance_ms
    truth = gt_events.select("asset_id", "event_type", F.col("gt_id").alias("l_id"), F.col("ts_ms").alias("l_ms"))
    found = candidates.where("status = 'DETECTED'").select("asset_id", "event_type", F.col("candidate_id").alias("r_id"), F.col("trigger_ms").alias("r_ms"))
    pairs = T.range_join(truth, found, ["asset_id", "event_type"], F.col("l_ms") - tol, F.col("l_ms") + tol, "r_ms", 2 * tol).withColumn("similarity", F.lit(0.0))
    hits = greedy_match(pairs, ["asset_id", "event_type"], tol).join(truth.select("l_id", "asset_id"), "l_id").groupBy("asset_id").agg(F.count(F.lit(1)).alias("true_positives"))
    count = lambda df, name: df.groupBy("asset_id").agg(F.count(F.lit(1)).alias(name))
    rows = gt_reviews.join(count(truth, "truths"), "asset_id", "left").join(count(found, "detected"), "asset_id", "left").join(hits, "asset_id", "left").fillna(0, ["truths", "detected", "true_positives"])
    enough = (F.col("review_status") == "COMPLETED") & (F.col("truths") >= 5)
    return rows.select("asset_id", "true_positives", (F.col("truths") - F.col("true_positives")).alias("false_negatives"), (F.col("detected") - F.col("true_positives")).alias("false_positives"), enough.alias("sufficient"))


def type_window() -> Column:
    """How far apart triggers of one cluster can be."""
    kind = F.col("event_type")
    return F.when(kind == "GOAL", 15_000).when(kind.contains("CARD"), 20_000).when(kind.isin("SHOT", "NEAR_MISS"), 3000).otherwise(10_000)


def same_event(gap: int, similarity: float, goal: bool, least: float) -> bool:
    """Are two candidates of one type one event?"""
    return gap == 0 or gap <= 3000 and similarity >= (0.65 if goal else least)


def cluster_candidates(candidates: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """candidate_id, cluster_id (the first member): detected candidates of one run and type, each with the latest cluster whose every member is the same event.

    Groups are cut at gaps wider than the type's window, which no cluster spans.
    """
    w = Window.partitionBy("asset_id", "run_id", "event_type").orderBy("trigger_ms", "candidate_id")
    rows = candidates.where("status = 'DETECTED'").select("asset_id", "run_id", "event_type", "candidate_id", "trigger_ms", token_set(F.coalesce("context", F.lit("")), "content").alias("words"), type_window().alias("window_ms"))
    rows = rows.withColumn("new", F.coalesce((F.col("trigger_ms") - F.lag("trigger_ms").over(w) > F.col("window_ms")).cast("int"), F.lit(0)))
    rows = rows.withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
    keys = ["asset_id", "run_id", "event_type", "part"]
    rows = rows.select(F.struct(*keys).cast("string").alias("group"), "event_type", "window_ms", "candidate_id", "trigger_ms", "words")
    rows = rows.repartition("group").sortWithinPartitions("group", "trigger_ms", "candidate_id")
    return rows.mapInArrow(_fold(cfg.context_similarity), "candidate_id long, cluster_id long")


def _fold(least: float):
    """Rows group, type, window, id, time, words in order to their clusters."""

    def run(batches):
        found = []
        for (_, kind), own in groupby(_rows(batches), key=itemgetter(0, 1)):
            clusters: list[list[tuple]] = []
            for _, _, window, number, at, words in own:
                me = (number, at, frozenset(words))

                def fits(c, me=me, window=window, goal=kind == "GOAL"):
                    alike = lambda m: len(m[2] & me[2]) / len(m[2] | me[2]) if m[2] and me[2] else 0.0
                    return me[1] - c[0][1] <= window and all(same_event(me[1] - m[1], alike(m), goal, least) for m in c)

                home = next((c for c in reversed(clusters) if fits(c)), None)
                if home is None:
                    clusters.append(home := [])
                home.append(me)
                found.append((number, home[0][0]))
            if len(found) > 5000:
                yield _out(found, CLUSTER)
                found = []
        if found:
            yield _out(found, CLUSTER)

    return run


def canonicalize(candidates: DataFrame, clusters: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """One event a cluster: the best member, the union of windows (at most so long, around the trigger), all members."""
    rows = candidates.join(clusters, "candidate_id")
    best = F.max_by(F.struct("candidate_id", "trigger_ms", "score", "event_type"), F.struct("score", -F.col("trigger_ms"), -F.col("candidate_id")))
    one = rows.groupBy("cluster_id").agg(best.alias("b"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_join(F.sort_array(F.collect_set("candidate_id")), ",").alias("members"))
    over = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms") - cfg.maximum_event_ms)
    return one.select("cluster_id", F.col("b.candidate_id").alias("candidate_id"), F.col("b.event_type").alias("event_type"), F.col("b.trigger_ms").alias("trigger_ms"), F.col("b.score").alias("score"), F.least(F.col("start_ms") + over, "b.trigger_ms").alias("start_ms"), "end_ms", "members")
