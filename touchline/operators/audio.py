"""Signals from audio windows, and features of the windows from samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators import sequence as S
from touchline.settings import DEFAULTS, Settings

KEY = ["asset_id"]


def with_baselines(windows: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """baseline_db and pitch_baseline_hz of each window's surroundings, excess_db over the former, rise_db over three windows, and spike."""
    half = cfg.audio_baseline_ms // 2
    out = S.centered_median(windows, KEY, "ts_ms", "dbfs", half, cfg.audio_window_ms, "baseline_db")
    voiced = (F.col("voiced_frame_ratio") >= cfg.voiced_ratio) & (F.col("median_pitch_hz") > 0)
    out = S.trailing_upper_median(out.withColumn("voiced", voiced), KEY, "ts_ms", "median_pitch_hz", F.col("voiced"), half, 15, "pitch_baseline_hz")
    excess = F.col("dbfs") - F.col("baseline_db")
    rise = F.col("dbfs") - F.lag("dbfs", 3).over(Window.partitionBy(*KEY).orderBy("ts_ms"))
    spike = F.coalesce((F.col("dbfs") >= cfg.minimum_db) & (excess >= cfg.spike_db), F.lit(False))
    return out.withColumns({"excess_db": excess, "rise_db": rise, "spike": spike})


def spike_islands(based: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Runs of loud windows: peak_ms (first of the loudest), peak_db over the baseline, active_ms."""
    runs = S.islands(based, KEY, ["ts_ms"], F.col("spike"))
    peak = F.max_by("ts_ms", F.struct("excess_db", -F.col("ts_ms")))
    return runs.groupBy(*KEY, "island").agg(peak.alias("peak_ms"), F.max("excess_db").alias("peak_db"), (F.max("ts_ms") - F.min("ts_ms") + cfg.audio_window_ms).alias("active_ms")).drop("island")


def detect_audio(windows: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """asset_id, ts_ms, signal_type, confidence of all signals that windows give."""
    based = with_baselines(windows, cfg)
    sure = lambda most, value: F.least(F.lit(most), value)
    pitch_ratio = F.col("median_pitch_hz") / F.col("pitch_baseline_hz")
    pitch_rise = F.col("voiced") & F.coalesce(pitch_ratio >= cfg.pitch_rise, F.lit(False))
    varies = F.col("pitch_variance_hz") / F.col("median_pitch_hz")
    variance = F.col("voiced") & (varies >= cfg.pitch_variance)
    above = F.coalesce(F.col("peak_dbfs") - F.col("baseline_db"), F.lit(float("-inf")))
    one = lambda test, name, value: F.when(test, F.struct(F.lit(name).alias("signal_type"), value.alias("confidence")))
    rise = (F.col("rise_db") >= cfg.spike_db) & (F.col("excess_db") >= cfg.spike_db / 2) & (F.col("dbfs") >= cfg.minimum_db)
    voice = pitch_rise | variance | (F.col("voiced") & F.col("spike") & (above >= cfg.spike_db))
    found = F.array_compact(
        F.array(
            one(rise, "AUDIO_ENERGY_RISE", sure(0.88, 0.58 + (F.col("rise_db") - cfg.spike_db) / 35)),
            one(pitch_rise, "PITCH_RISE", sure(0.94, 0.62 + (pitch_ratio - cfg.pitch_rise) * 0.35)),
            one(variance, "PITCH_VARIANCE", sure(0.90, 0.58 + varies * 0.35)),
            one(voice, "VOICE_EXCITEMENT", sure(0.95, 0.55 + F.greatest(F.lit(0.0), above) / 45 + F.when(pitch_rise, 0.12).otherwise(0.0))),
            one(F.col("spike") & (F.col("zero_crossing_rate") >= cfg.crowd_zcr), "CROWD_REACTION_PROXY", sure(0.86, 0.55 + F.col("excess_db") / 50)),
        )
    )
    own = based.select(*KEY, "ts_ms", F.inline(found))
    runs = spike_islands(based, cfg)
    spikes = runs.select(*KEY, F.col("peak_ms").alias("ts_ms"), F.lit("AUDIO_SPIKE").alias("signal_type"), sure(0.99, 0.55 + F.greatest(F.lit(0.0), F.col("peak_db") - cfg.spike_db) / 25).alias("confidence"))
    long = runs.where(F.col("active_ms") >= cfg.sustained_ms)
    long = long.select(*KEY, F.col("peak_ms").alias("ts_ms"), F.lit("AUDIO_SUSTAINED").alias("signal_type"), sure(0.97, 0.55 + F.col("active_ms") / 40_000).alias("confidence"))
    return own.unionByName(spikes).unionByName(long).unionByName(high_excitement(own, cfg))


def high_excitement(signals: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Long enough stretches of excited voice, at their starts."""
    voice = S.gap_clusters(signals.where("signal_type = 'VOICE_EXCITEMENT'"), KEY, "ts_ms", 2 * cfg.audio_window_ms)
    spans = voice.groupBy(*KEY, "cluster").agg(F.min("ts_ms").alias("ts_ms"), (F.max("ts_ms") - F.min("ts_ms") + cfg.audio_window_ms).alias("span_ms"), F.max("confidence").alias("confidence"))
    return spans.where((F.col("span_ms") >= max(3000, cfg.sustained_ms)) & (F.col("confidence") >= 0.72)).select(*KEY, "ts_ms", F.lit("HIGH_EXCITEMENT").alias("signal_type"), "confidence")


def audio_windows(samples: DataFrame, floor: float = 1e-5) -> DataFrame:
    """Level, peak and zero crossings of windows. samples: asset_id, window, rate, samples (array of doubles in -1..1, one window)."""

    @F.pandas_udf("rms double, peak double, turns double")
    def of(windows: pd.Series, rates: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([level_of(w, rate) for w, rate in zip(windows, rates, strict=True)], columns=["rms", "peak", "turns"])

    db = lambda rms: F.greatest(F.lit(-100.0), F.least(F.lit(0.0), 20 * F.log10(F.greatest(rms, F.lit(floor)))))
    out = samples.select("asset_id", (F.col("window") * 1000 + 500).alias("ts_ms"), of("samples", "rate").alias("p"))
    return out.select("asset_id", "ts_ms", db(F.col("p.rms")).alias("dbfs"), db(F.col("p.peak")).alias("peak_dbfs"), F.col("p.turns").alias("zero_crossing_rate"))


def level_of(samples: np.ndarray | None, rate: int) -> tuple[float | None, float | None, float | None]:
    """Root of the mean square of a window, the greatest of its tenths of a second, and the share of neighbours that differ in sign. Squares are added in order."""
    if samples is None:
        return None, None, None
    x, step = np.asarray(samples, float), max(int(rate / 10), 1)
    if not len(x):
        return 0.0, 0.0, 0.0
    square, over = x * x, -len(x) % step
    parts = np.cumsum(np.pad(square, (0, over)).reshape(-1, step), axis=1)[:, -1]
    sizes = np.full(len(parts), step)
    sizes[-1] -= over
    turns = np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0))
    return float(np.sqrt(np.cumsum(square)[-1] / len(x))), float(np.sqrt(parts / sizes).max()), turns / max(len(x) - 1, 1)


def pitches_of(frames: np.ndarray, rate: float) -> np.ndarray:
    """Pitch of each frame (a row) by normalised autocorrelation: its first peak of .65 or more between 70 and 400 Hz; 0 without one."""
    stride = max(1, round(rate / 8000))
    x = np.ascontiguousarray(frames[:, ::stride])
    x = x - x.mean(axis=1, keepdims=True)
    rate, n = rate / stride, x.shape[1]
    least, most = max(1, int(rate / 400)), min(n - 2, int(rate / 70))
    if most < least or not len(x):
        return np.zeros(len(x))
    head = np.cumsum(x * x, axis=1)
    tail = np.cumsum((x * x)[:, ::-1], axis=1)
    r = np.full((len(x), most - least + 3), -1.0)  # lags from least - 1 to most + 1
    for k in range(max(1, least - 1), most + 2):
        size = np.sqrt(head[:, n - k - 1] * tail[:, n - k - 1])
        r[:, k - least + 1] = np.einsum("fi,fi->f", x[:, k:], x[:, :-k]) / np.where(size == 0, 1.0, size)
    peak = (r[:, 1:-1] >= 0.65) & (r[:, 1:-1] >= r[:, :-2]) & (r[:, 1:-1] >= r[:, 2:]) & (head[:, -1:] > 1e-9)
    return np.where(peak.any(axis=1), rate / (least + peak.argmax(axis=1)), 0.0)


def pitch_features(samples: DataFrame, block: int = 2048) -> DataFrame:
    """asset_id, ts_ms, median_pitch_hz, pitch_variance_hz (standard deviation), voiced_frame_ratio of windows. Spark cuts the frames out; Python gets these
    alone, and looks at up to block of them at a time."""

    @F.pandas_udf("median double, spread double, voiced double")
    def of(windows: pd.Series, rates: pd.Series) -> pd.DataFrame:
        rows: list = [(None, None, None)] * len(windows)
        alike: dict[tuple, list[int]] = {}
        for i, (w, rate) in enumerate(zip(windows, rates, strict=True)):
            if w is not None:
                alike.setdefault((rate, len(w)), []).append(i)
        for (rate, length), places in alike.items():
            size = int(rate * 0.04)
            each = length // size if size else 0
            step = max(1, block // max(1, each))
            for at in range(0, len(places), step):
                some = places[at : at + step]
                found = pitches_of(np.stack([windows.iloc[i] for i in some]).reshape(-1, size), rate).reshape(len(some), each) if each else np.zeros((len(some), 0))
                for i, own in zip(some, found, strict=True):
                    voiced = own[own > 0]
                    rows[i] = (float(np.median(voiced)), float(np.std(voiced)), len(voiced) / each) if len(voiced) else (0.0, 0.0, 0.0)
        return pd.DataFrame(rows, columns=["median", "spread", "voiced"])

    size, first, last = (F.col("rate") * 0.04).cast("int"), (F.col("rate") * 0.08).cast("int"), F.size("samples") - (F.col("rate") * 0.04).cast("int")
    starts = F.when(last >= first, F.sequence(first, last, (F.col("rate") * 0.3).cast("int"))).otherwise(F.array().cast("array<int>"))
    frames = F.when(F.col("samples").isNotNull(), F.flatten(F.transform(starts, lambda a: F.slice("samples", a + 1, size))))
    out = samples.select("asset_id", (F.col("window") * 1000 + 500).alias("ts_ms"), of(frames, "rate").alias("p"))
    return out.select("asset_id", "ts_ms", F.col("p.median").alias("median_pitch_hz"), F.col("p.spread").alias("pitch_variance_hz"), F.col("p.voiced").alias("voiced_frame_ratio"))
