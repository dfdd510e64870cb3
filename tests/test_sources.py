"""Writing runs, JSON columns, stamps; features of audio from made tones."""

import math

import pytest
from pyspark.sql import functions as F

from touchline.functions import evidence as V
from touchline.operators import audio as D
from touchline.sources import tables as IO


def test_runs_are_appended_and_pruned(spark, tmp_path):
    path = str(tmp_path / "candidates")
    rows = lambda run: spark.createDataFrame([(k, k % 3, run, 0.5) for k in range(10)], "candidate_id long, asset_id long, run_id long, score double")
    for run in (1, 2):
        IO.write_run(rows(run), path, run)
    IO.write_run(rows(2), path, 2)
    assert IO.read_candidates(spark, path).count() == 30
    two = IO.read_candidates(spark, path, run_id=2, asset_ids=[0, 1])
    assert two.count() == 14 and "PartitionFilters: [isnotnull(run_id" in two._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="not of run 3"):
        IO.write_run(rows(2), path, 3)
    assert IO.read_candidates(spark, path, legacy=True).count() == 0


def test_upsert_and_delete(spark):
    base = spark.createDataFrame([(1, "a", 10, 10), (2, "b", 11, 11)], "k long, v string, created long, updated long")
    changes = spark.createDataFrame([(2, "c", 20, 20), (3, "d", 21, 21)], "k long, v string, created long, updated long")
    out = IO.upsert(base, changes, ["k"], "updated", "created")
    assert sorted(map(tuple, out.collect())) == [(1, "a", 10, 10), (2, "c", 11, 20), (3, "d", 21, 21)]
    assert sorted(r.k for r in IO.delete_keys(out, changes, ["k"]).collect()) == [1]


def test_segments(spark):
    raw = spark.createDataFrame([(1, 1.0005, 1.0005, " b "), (1, 0.0, 2.0, "a"), (1, 3.0, 4.0, "  ")], "asset_id long, start_s double, end_s double, text string")
    got = IO.ingest_segments(raw).orderBy("sequence").collect()
    assert [(r.text, r.start_ms, r.end_ms, r.sequence) for r in got] == [("a", 0, 2000, 0), ("b", 1000, 1001, 1)]


def test_stamp_depends_on_values_only(spark):
    one, two = (spark.range(1).select(IO.config_hash(c)).first()[0] for c in ({"a": 1, "b": "x"}, {"b": "x", "a": 1}))
    assert one == two and len(one) == 64


def test_windows_of_tones(spark):
    wave = lambda level, hz: [level * math.sin(2 * math.pi * hz * i / 16_000) for i in range(16_000)]
    samples = spark.createDataFrame([(1, 0, 16_000, wave(0.03, 150)), (1, 1, 16_000, wave(0.5, 150)), (1, 2, 16_000, [0.0] * 16_000)], "asset_id long, window long, rate int, samples array<double>")
    levels = {r.ts_ms: r for r in D.audio_windows(samples).collect()}
    assert set(levels) == {500, 1500, 2500} and levels[1500].dbfs - levels[500].dbfs > 20 and levels[2500].dbfs == -100
    assert levels[1500].zero_crossing_rate == pytest.approx(300 / 16_000, abs=0.002)
    pitch = {r.ts_ms: r for r in D.pitch_features(samples).collect()}
    assert abs(pitch[1500].median_pitch_hz - 150) < 10 and pitch[1500].voiced_frame_ratio >= 0.5 and pitch[2500].voiced_frame_ratio == 0


def test_names(spark):
    df = spark.createDataFrame([("C:\\a\\match.MP4",), ("/x/..",), ("noext",), (" .mp4",), (None,)], "n string").select(V.safe_name(F.col("n")).alias("s"), V.extension_of(F.col("n")).alias("e"))
    assert [tuple(r) for r in df.collect()] == [("match.MP4", "mp4"), (None, None), ("noext", None), (".mp4", None), (None, None)]
    text = spark.createDataFrame([("OUTCOME=SAVE; phrase",), ("none",)], "t string").select(V.outcome_of(F.col("t")).alias("o"))
    assert [r.o for r in text.collect()] == ["SAVE", None]


def test_a_run_is_committed_once(spark, tmp_path):
    from touchline.sources import runs as RUNS

    path = str(tmp_path / "runs")
    rows = lambda run, n=4: spark.createDataFrame([(k, run) for k in range(n)], "k long, run_id long")
    assert RUNS.read_runs(spark, path) is None
    assert RUNS.append_run(rows(1), path, 1) and RUNS.append_run(rows(2, 3), path, 2)
    assert not RUNS.append_run(rows(1, 9), path, 1, again="skip")
    with pytest.raises(RUNS.AlreadyCommitted):
        RUNS.append_run(rows(1, 9), path, 1)
    assert RUNS.read_runs(spark, path).count() == 7 and RUNS.read_runs(spark, path, [2]).count() == 3
    with pytest.raises(Exception, match="not of run 3"):
        RUNS.append_run(rows(2), path, 3)  # fails midway: nothing of it is seen, and it can be tried again
    assert set(RUNS.committed(spark, path)) == {1, 2}
    assert RUNS.append_run(rows(3, 2), path, 3) and RUNS.read_runs(spark, path).count() == 9


def test_the_first_of_two_writers_wins(spark, tmp_path, monkeypatch):
    from touchline.sources import runs as RUNS

    path, seen = str(tmp_path / "runs"), RUNS.committed
    rows = spark.createDataFrame([(1, 5)], "k long, run_id long")
    assert RUNS.append_run(rows, path, 5)
    calls = iter([{}])
    monkeypatch.setattr(RUNS, "committed", lambda *a: next(calls))  # the second writer looked before the first one was done
    assert not RUNS.append_run(rows.withColumn("k", F.lit(2).cast("long")), path, 5, again="skip")
    monkeypatch.setattr(RUNS, "committed", seen)
    assert [r.k for r in RUNS.read_runs(spark, path).collect()] == [1]
    assert len([p for p in (tmp_path / "runs/data/run_id=5").iterdir() if p.is_dir()]) == 1


def test_json_that_comes_back(spark):
    df = spark.createDataFrame([(1, [(1, "a")], {"x": 1}), (2, [], None), (3, None, {})], "k int, s array<struct<n:int,t:string>>, m map<string,int>")
    text = IO.to_json_columns(df)
    kinds = {"s": "array<struct<n:int,t:string>>", "m": "map<string,int>"}
    back = IO.from_json_columns(text, kinds)
    assert back.select("k", "s", "m").collect() == df.collect() and back.where("size(corrupt) > 0").count() == 0
    broken = IO.from_json_columns(text.withColumn("s", F.when(F.col("k") == 1, "[{").otherwise(F.col("s"))), kinds).orderBy("k").collect()
    assert [(r.s, len(r.corrupt)) for r in broken] == [(None, 1), ([], 0), (None, 0)] and broken[0].corrupt[0].text == "[{" and broken[0].m == {"x": 1}


def test_windows_of_other_rates_and_lengths_and_without_samples(spark):
    wave = lambda n, rate, hz: [0.4 * math.sin(2 * math.pi * hz * i / rate) for i in range(n)]
    rows = [(1, 0, 16_000, wave(16_000, 16_000, 200)), (1, 1, 8000, wave(8000, 8000, 200)), (1, 2, 8000, wave(700, 8000, 200)), (1, 3, 8000, None), (1, 4, 8000, []), (1, 5, 8000, wave(2750, 8000, 160))]
    samples = spark.createDataFrame(rows, "asset_id long, window long, rate int, samples array<double>")
    pitch = {r.ts_ms // 1000: r for r in D.pitch_features(samples, block=2).collect()}
    assert [pitch[k].median_pitch_hz for k in (0, 1, 2, 4, 5)] == [200, 200, 0, 0, 160]
    assert [pitch[k].voiced_frame_ratio for k in (0, 1, 2, 3, 4, 5)] == [1, 1, 0, None, 0, 1]
    levels = {r.ts_ms // 1000: r for r in D.audio_windows(samples).collect()}
    assert levels[2].dbfs == pytest.approx(20 * math.log10(math.sqrt(sum(x * x for x in rows[2][3]) / 700))) and levels[4].dbfs == -100 and levels[3].zero_crossing_rate is None


def test_scores_are_read_once_and_separators_are_told(spark):
    from touchline.functions.text import parse_score_ocr
    from touchline.operators import scoreboard as B

    texts = ["HOME 1-O AWAY", "2 : l", "3\t−\n4", "I – 0", "16-1", "1-16", "no score", None, "12 — 15", "123-4"]
    df = spark.createDataFrame([(1, k * 5000, t, 0.5) for k, t in enumerate(texts)], "asset_id long, ts_ms long, raw_text string, confidence double")
    found = [r.s and tuple(r.s) for r in df.orderBy("ts_ms").select(parse_score_ocr(F.col("raw_text")).alias("s")).collect()]
    assert found == [(1, 0), (2, 1), (3, 4), (1, 0), None, None, None, None, (12, 15), None]
    rows = B.parsed_readings(df)
    assert [(r.ts_ms // 5000, r.run) for r in rows.orderBy("ts_ms").collect()] == [(0, 0), (1, 1), (2, 2), (3, 3), (8, 4)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1
