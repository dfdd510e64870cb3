"""Counts over runs, assets and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.review import is_detected, needs_review


def counts_by(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """tile, value, n: the rows of each table by a column."""
    parts = [df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(tile).alias("tile"), "value", "n") for tile, (df, c) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def workload(reviewed: DataFrame) -> DataFrame:
    """Events that await a review (manual ones count), and rejected ones whose rejection nobody confirmed."""
    return reviewed.agg(
        F.count_if((F.col("status") != "REJECTED") & (F.col("review_status") == "UNREVIEWED")).alias("awaiting_review"),
        F.count_if((F.col("status") == "REJECTED") & (F.col("review_status") != "REJECTED")).alias("rejected_awaiting"),
    )


def evaluation_ready(gt_reviews: DataFrame, gt_events: DataFrame, minimum: int = 5) -> DataFrame:
    """Assets whose ground truth is complete and has enough events."""
    enough = gt_events.groupBy("asset_id").agg(F.count(F.lit(1)).alias("truths")).where(F.col("truths") >= minimum)
    return gt_reviews.where("review_status = 'COMPLETED'").join(enough, "asset_id").select("asset_id", "truths")


def totals(assets: DataFrame, reviewed: DataFrame, gt_events: DataFrame, gt_reviews: DataFrame) -> DataFrame:
    """name, n: the dashboard's single figures."""
    one = lambda name, df, n: df.agg(n.cast("long").alias("n")).select(F.lit(name).alias("name"), "n")
    every = F.count(F.lit(1))
    parts = [
        one("assets", assets, every),
        one("events", reviewed, every),
        one("reviewed", reviewed, F.count_if(F.col("review_status") != "UNREVIEWED")),
        one("completed", assets, F.count_if(F.col("status") == "COMPLETED")),
        one("truths", gt_events, every),
        one("evaluation_ready", evaluation_ready(gt_reviews, gt_events), every),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of each asset."""
    return runs.groupBy("asset_id").agg(F.max_by(F.struct("detection_run_id", "status"), F.struct("created_order", "detection_run_id")).alias("r")).select("asset_id", F.col("r.detection_run_id").alias("latest_run_id"), F.col("r.status").alias("latest_status"))


def asset_summary(assets: DataFrame, reviewed: DataFrame, clips: DataFrame, runs: DataFrame) -> DataFrame:
    """One row an asset: counts of its events by what became of them, of its clips, and its latest run. Clips and events are counted apart and
    joined as counts."""
    events = reviewed.groupBy("asset_id").agg(
        F.count_if(F.col("status") != "MANUAL").alias("candidates"),
        F.count_if(is_detected()).alias("detected"),
        F.count_if(F.col("status") == "REJECTED").alias("rejected"),
        F.count_if(needs_review()).alias("needs_review"),
        F.count_if(is_detected() & (F.col("review_status") == "CONFIRMED")).alias("approved"),
    )
    files = clips.groupBy("asset_id").agg(F.count(F.lit(1)).alias("clips"))
    names = ["candidates", "detected", "rejected", "needs_review", "approved", "clips"]
    return assets.join(events, "asset_id", "left").join(files, "asset_id", "left").join(latest_run(runs), "asset_id", "left").fillna(0, names).select("asset_id", "status", *names, "latest_run_id", "latest_status")


def match_key(asset: DataFrame) -> Column:
    """One name for the recordings of a match: competition, day, teams; else the asset alone."""
    part = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    known = (part("home_team") != "") & (part("away_team") != "")
    return F.when(known, F.concat(F.lit("match:"), F.concat_ws("|", part("competition"), part("home_team"), part("away_team")))).otherwise(F.concat(F.lit("asset:"), F.col("asset_id").cast("string")))


def match_part(name: Column) -> Column:
    """Which half a file name says it is. An underscore counts as part of a word."""
    low = F.lower(name)
    return F.when(low.rlike(r"\b(first|1st)[\s._-]*half\b"), "FIRST_HALF").when(low.rlike(r"\b(second|2nd)[\s._-]*half\b"), "SECOND_HALF").otherwise("OTHER")


def match_summary(assets: DataFrame, summary: DataFrame) -> DataFrame:
    """Sums and flags by match."""
    keyed = assets.select("asset_id", match_key(assets).alias("match_key")).join(summary, "asset_id")
    names = ["candidates", "detected", "rejected", "needs_review", "approved", "clips"]
    return keyed.groupBy("match_key").agg(
        F.count(F.lit(1)).alias("assets"),
        *(F.sum(n).alias(n) for n in names),
        F.bool_or((F.col("status") == "PROCESSING") | F.coalesce(F.col("latest_status").isin("PENDING", "RUNNING"), F.lit(False))).alias("processing"),
        F.bool_or(F.coalesce(F.col("latest_status") == "COMPLETED", F.lit(False))).alias("completed"),
    )


def match_buckets(matches: DataFrame) -> DataFrame:
    """How many matches each filter of the list has."""
    return matches.agg(
        F.count(F.lit(1)).alias("all_matches"),
        F.count_if(F.col("needs_review") > 0).alias("needs_review"),
        F.count_if((F.col("detected") > 0) & (F.col("needs_review") == 0)).alias("reviewed"),
        F.count_if(F.col("approved") > 0).alias("approved"),
        F.count_if("processing").alias("processing"),
        F.count_if("completed").alias("completed"),
    )


def run_breakdown(candidates: DataFrame) -> DataFrame:
    """Detected and rejected events by run and type."""
    return candidates.groupBy("run_id", "event_type").agg(F.count_if(is_detected()).alias("detected"), F.count_if(F.col("status") == "REJECTED").alias("rejected"))


def run_summary(candidates: DataFrame, signals: DataFrame) -> DataFrame:
    """Counters of each run: candidates, distinct observations, detected, rejected."""
    events = candidates.groupBy("asset_id", "run_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("status") == "DETECTED").alias("detected"), F.count_if(F.col("status") == "REJECTED").alias("rejected"))
    seen = distinct_signals(signals).groupBy("asset_id", "run_id").agg(F.count(F.lit(1)).alias("observations"))
    return events.join(seen, ["asset_id", "run_id"], "full").fillna(0, ["candidates", "detected", "rejected", "observations"])


def distinct_signals(signals: DataFrame) -> DataFrame:
    """Each signal once: all five fields and where it belongs."""
    return signals.select("asset_id", "run_id", "signal_type", "event_type", "confidence", "ts_ms", "evidence").distinct()


def batch_outcome(items: DataFrame, key: str, status: str) -> DataFrame:
    """By batch: done items, failures, and how it ended."""
    return items.groupBy(key).agg(
        F.count_if(F.col(status) != "PENDING").alias("finished"),
        F.count_if(F.col(status) == "FAILED").alias("failed"),
        F.when(F.bool_or(F.col(status) == "FAILED"), "COMPLETED_WITH_FAILURES").otherwise("COMPLETED").alias("outcome"),
    )


def timeline_length(assets: DataFrame, layers: DataFrame) -> DataFrame:
    """By asset its duration, else the latest time on any layer, 1 at least."""
    latest = layers.groupBy("asset_id").agg(F.max("ts_ms").alias("latest_ms"))
    return assets.join(latest, "asset_id", "left").select("asset_id", F.greatest(F.coalesce("duration_ms", "latest_ms", F.lit(1)), F.lit(1)).alias("length_ms"))


def timeline_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """layer, asset_id, item_id, ts_ms: all layers of a timeline in one table."""
    parts = [df.select(F.lit(name).alias("layer"), "asset_id", F.col("item_id").cast("long").alias("item_id"), F.col("ts_ms").cast("long").alias("ts_ms")) for name, df in layers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rank_candidates(candidates: DataFrame, most: int = 100) -> DataFrame:
    """By asset and run the best candidates: detected ones first, then by score, start and type."""
    w = Window.partitionBy("asset_id", "run_id").orderBy((F.col("status") != "DETECTED").cast("int"), F.desc("score"), "start_ms", "event_type", "candidate_id")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
