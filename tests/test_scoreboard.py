"""Scoreboard readings: states by hand, and how often they are sorted."""

from pyspark.sql import functions as F

from touchline.operators import scoreboard as B
from touchline.operators import views as V


def test_states_need_one_sort(spark):
    rows = [(1, k * 5000, text, 0.5 + k / 100) for k, text in enumerate(["HOME 0-0 AWAY", "HOME 0-0 AWAY", "no score", "HOME 1-0 AWAY", "HOME 0-0 AWAY", "HOME 0-0 AWAY", "HOME 1-0 AWAY", "HOME 1-0 AWAY", "HOME 1-0 AWAY"])]
    rows += [(2, 0, "HOME 1-0 AWAY", 0.5), (2, 20_000, "HOME 1-0 AWAY", 0.5), (2, 25_000, "HOME 1-0 AWAY", 0.7)]
    states = B.scoreboard_states(spark.createDataFrame(rows, "asset_id long, ts_ms long, raw_text string, confidence double"))
    found = [(r.asset_id, r.ts_ms, r.home, r.away, r.previous_home, round(r.confidence, 6)) for r in states.orderBy("asset_id", "ts_ms").collect()]
    # 0-0 comes back without having been replaced; the first two readings of 2 are too far apart
    assert found == [(1, 0, 0, 0, None, 0.505), (1, 30_000, 1, 0, 0, 0.565), (2, 20_000, 1, 0, None, 0.6)]
    plan = states._jdf.queryExecution().sparkPlan().toString() + states._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Sort [") == 1 and "Aggregate" not in plan


def test_timeline_sorts_no_items(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    assets = make([(1, 100), (2, None)], "asset_id long, duration_ms long")
    reviewed = make([(1, 5, 10, 20, "DETECTED", "CONFIRMED")], "asset_id long, candidate_id long, trigger_ms long, end_ms long, status string, review_status string")
    points = lambda item, rows: make(rows, f"asset_id long, {item} string, ts_ms long")
    rows = V.timeline(assets, reviewed, points("marker_type", [(2, "HALF", 50)]), points("id", [(2, "7", 200)]), points("transition_id", []), points("gt_id", []), points("kind", []))
    found = {(r.asset_id, r.layer, r.percent) for r in rows.collect()}
    assert found == {(1, "detected", 10.0), (1, "confirmed", 10.0), (2, "structure", 25.0), (2, "observations", 100.0)}
    assert "ShuffledHashJoin [asset_id" in rows._jdf.queryExecution().sparkPlan().toString()
