"""Stable scores, transitions and reversals from scoreboard readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.text import parse_score_ocr

KEY = ["asset_id"]


def parsed_readings(readings: DataFrame) -> DataFrame:
    """Readings with a score, and as run the number of the stretch of equal scores they are in."""
    w = Window.partitionBy(*KEY).orderBy("ts_ms")
    before = F.last("score", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = readings.withColumn("score", parse_score_ocr(F.col("raw_text")))
    # readings without a score go after the windows: a filter before them would read every text twice
    rows = rows.withColumn("new", F.coalesce((before != F.col("score")).cast("int"), F.lit(0)))
    return rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("score is not null").drop("new")


def scoreboard_states(readings: DataFrame, window_ms: int = 12_000) -> DataFrame:
    """asset_id, ts_ms, home, away, previous_home, previous_away, confidence: scores read twice within the window, each when it replaces another."""
    # a run's readings follow each other, so the order that runs were numbered in serves for all that is asked of neighbours, and readings are sorted once
    w = Window.partitionBy(*KEY).orderBy("ts_ms")
    rows = parsed_readings(readings).withColumn("before", F.lag(F.struct("run", "ts_ms", "confidence")).over(w))
    stable = rows.where((F.col("before.run") == F.col("run")) & (F.col("ts_ms") - F.col("before.ts_ms") <= window_ms))
    first = stable.withColumn("last_run", F.lag("run").over(w)).where("last_run is null or last_run <> run")
    states = first.withColumn("previous", F.lag("score").over(w)).where("previous is null or previous <> score")
    sure = (F.col("confidence") + F.col("before.confidence")) / 2
    return states.select(*KEY, F.col("before.ts_ms").alias("ts_ms"), F.col("score.home").alias("home"), F.col("score.away").alias("away"), F.col("previous.home").alias("previous_home"), F.col("previous.away").alias("previous_away"), sure.alias("confidence"))


def score_reversals(readings: DataFrame) -> DataFrame:
    """asset_id, ts_ms, confidence of scores read once between two stretches of one other score."""
    runs = parsed_readings(readings).groupBy(*KEY, "run").agg(
        F.count(F.lit(1)).alias("n"), F.first("score").alias("score"), F.min("ts_ms").alias("ts_ms"), F.min("confidence").alias("least"), F.max_by("confidence", "ts_ms").alias("last"), F.min_by("confidence", "ts_ms").alias("first")
    )
    w = Window.partitionBy(*KEY).orderBy("run")
    near = runs.withColumns({"before": F.lag(F.struct("score", "last")).over(w), "after": F.lead(F.struct("score", "first")).over(w)})
    return near.where("n < 2 and before.score = after.score").select(*KEY, "ts_ms", F.least("before.last", "least", "after.first").alias("confidence"))


def scoreboard_counters(readings: DataFrame) -> DataFrame:
    """By asset: readings, those with a score, states, transitions, reversals, mean confidence."""
    base = readings.groupBy(*KEY).agg(F.count(F.lit(1)).alias("sampled"), F.count(parse_score_ocr(F.col("raw_text"))).alias("parsed"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("mean_confidence"))
    states = scoreboard_states(readings).groupBy(*KEY).agg(F.count(F.lit(1)).alias("states"), F.count("previous_home").alias("transitions"))
    back = score_reversals(readings).groupBy(*KEY).agg(F.count(F.lit(1)).alias("reversals"))
    return base.join(states, KEY, "left").join(back, KEY, "left").fillna(0, ["states", "transitions", "reversals"])
