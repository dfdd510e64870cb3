"""Goals that nobody called: from a shot and what came of it, and from voices that rise around an action or a new score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators import timejoin as T
from touchline.operators.lineage import settled
from touchline.settings import DEFAULTS, Settings

KEY = ["asset_id", "run_id"]
VOICED = ("HIGH_EXCITEMENT", "VOICE_EXCITEMENT")
PITCHED = ("PITCH_VARIANCE", "PITCH_RISE")
LOUD = ("AUDIO_SPIKE", "AUDIO_SUSTAINED", "CROWD_REACTION_PROXY")
# Outcomes by which a shot was no goal, and how sure each kind of reaction must be.
NO_GOAL = ("SAVE", "BLOCK", "CLEARANCE", "WIDE", "POST", "CONTINUED_PLAY")
VOICE_SURE, PITCH_SURE, RATE_SURE, RISE_SURE, STRONG_VOICE, ACTION_SURE = 0.60, 0.60, 0.58, 0.65, 0.72, 0.55
ACTION_MS, SCORE_MS = 20_000, 30_000


def no_goal() -> Column:
    """Does a signal (signal_type, s_event, evidence) say that a shot was no goal?"""
    told = (F.col("signal_type") == "SHOT_OUTCOME_CONTEXT") & F.col("evidence").rlike("|".join(f"OUTCOME={o}" for o in NO_GOAL))
    return F.coalesce(F.col("s_event").isin("SAVE", "NEAR_MISS", "MISSED_PENALTY"), F.lit(False)) | told


def is_action() -> Column:
    kind, event = F.col("signal_type"), F.col("s_event")
    spoken = (kind == "TRANSCRIPT_EVENT") & event.isin("ATTACK", "COUNTER_ATTACK", "BIG_CHANCE", "SHOT", "PENALTY")
    return kind.isin("ATTACK_BUILDUP", "TRANSCRIPT_SHOT") | F.coalesce(spoken | ((kind == "OWN_GOAL") & (event == "GOAL")), F.lit(False))


def _with(rows: DataFrame, signals: DataFrame, at: str, before_ms: int, after_ms: int) -> DataFrame:
    """rows with each signal (event_type as s_event) so long before and after their time."""
    near = signals.select(*KEY, "ts_ms", "signal_type", F.col("event_type").alias("s_event"), "confidence", "evidence")
    return T.range_join(rows, near, KEY, F.greatest(F.lit(0), F.col(at) - before_ms), F.col(at) + after_ms, "ts_ms", 60_000)


def from_shots(signals: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """KEY, id, ts_ms, confidence, action_ms, led (by what): a shot, audio after it, and a build-up before it or words or faster speech after it; neither a goal kick nor
    another outcome follows."""
    shots = signals.where("signal_type = 'TRANSCRIPT_SHOT' and event_type = 'SHOT'").select(*KEY, "id", F.col("ts_ms").alias("shot_ms"))
    near = _with(shots, signals, "shot_ms", cfg.buildup_lead_ms, cfg.attach_ms)
    kind, after = F.col("signal_type"), F.col("ts_ms") >= F.col("shot_ms")
    top = lambda test: F.max(F.when(test & after, F.col("confidence")))
    one = near.groupBy(*KEY, "id", "shot_ms").agg(
        F.max(F.when((kind == "ATTACK_BUILDUP") & ~after, F.struct("ts_ms", "confidence"))).alias("built"),
        top(kind.isin(*VOICED, *PITCHED, *LOUD)).alias("audio"),
        top(kind.isin("TRANSCRIPT_EMPHASIS", "TRANSCRIPT_REPETITION") | ((kind == "TRANSCRIPT_KEYWORD") & (F.col("s_event") == "CELEBRATION"))).alias("said"),
        F.coalesce(top(kind == "SPEECH_RATE_SPIKE"), F.lit(0.0)).alias("rate"),
        F.bool_or(((kind == "GOAL_KICK_CONTEXT") & (F.col("ts_ms") >= F.col("shot_ms") - 3000)) | (no_goal() & after)).alias("veto"),
    )
    good = one.where((F.col("audio") >= cfg.minimum_reaction) & ~F.col("veto") & (F.col("built").isNotNull() | F.col("said").isNotNull() | (F.col("rate") >= RATE_SURE)))
    both = F.least("audio", F.greatest(F.coalesce("built.confidence", F.lit(0.0)), F.coalesce("said", F.lit(0.0)), F.col("rate")))
    led = F.when(F.col("built").isNotNull(), "attack buildup").when(F.col("said").isNotNull(), "post-action commentary").otherwise("speech-rate increase")
    return good.select(*KEY, "id", F.col("shot_ms").alias("ts_ms"), F.least(F.lit(0.88), 0.76 + 0.12 * both).alias("confidence"), F.col("shot_ms").alias("action_ms"), led.alias("led"))


def from_voices(signals: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """As above, for each voice or pitch signal with others around it and an action near by, or with a new score after it."""
    marks = signals.where(F.col("signal_type").isin(*VOICED, *PITCHED)).select(*KEY, "id", F.col("ts_ms").alias("mark_ms"))
    near = _with(marks, signals, "mark_ms", ACTION_MS, SCORE_MS)
    kind, gap = F.col("signal_type"), F.col("ts_ms") - F.col("mark_ms")
    around = F.abs(gap) <= ACTION_MS
    top = lambda test: F.coalesce(F.max(F.when(test & around, F.col("confidence"))), F.lit(0.0))
    action = is_action() & (F.col("confidence") >= ACTION_SURE) & around
    close = F.abs(gap) <= cfg.attach_ms
    one = near.groupBy(*KEY, "id", "mark_ms").agg(
        top(kind.isin(*VOICED)).alias("voice"), top(kind.isin(*PITCHED)).alias("pitch"), top(kind == "SPEECH_RATE_SPIKE").alias("rate"), top(kind == "AUDIO_ENERGY_RISE").alias("rise"),
        F.min(F.when(action, F.struct(F.abs(gap).alias("far"), (-F.col("confidence")).alias("c"), "ts_ms"))).alias("action"),
        F.coalesce(F.bool_or((kind == "SCORE_STATE_TRANSITION") & gap.between(0, SCORE_MS)), F.lit(False)).alias("scored"),
        F.coalesce(F.bool_or(close & ((kind == "GOAL_KICK_CONTEXT") | no_goal())), F.lit(False)).alias("veto"),
    )
    moderate = (F.col("voice") >= VOICE_SURE) & ((F.col("pitch") >= PITCH_SURE) | (F.col("rate") >= RATE_SURE) | (F.col("rise") >= RISE_SURE))
    acted = F.col("action").isNotNull()
    confirmed = F.col("scored") & ((F.col("voice") >= VOICE_SURE) | (F.col("pitch") >= PITCH_SURE)) & (moderate | ((F.col("voice") >= STRONG_VOICE) & acted))
    good = one.where(((moderate & acted) | confirmed) & ~F.col("veto"))
    at = F.when(F.col("scored") | ~acted, F.col("mark_ms")).otherwise(F.col("action.ts_ms"))
    sure = F.least(F.lit(0.92), 0.76 + 0.12 * F.greatest("voice", "pitch", "rate", "rise"))
    return good.select(*KEY, "id", F.col("mark_ms").alias("ts_ms"), sure.alias("confidence"), at.alias("action_ms"), F.when(acted, "typed football-action evidence").otherwise("a later score-state transition").alias("led"))


def discover(signals: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """KEY, source (SHOT, AUDIO), id, ts_ms, confidence, action_ms, led: goals from shots, and those from voices with none of a shot within 20 s."""
    shots = settled(from_shots(signals, cfg))
    voices = T.range_join(from_voices(signals, cfg), shots.select(*KEY, F.col("ts_ms").alias("s_ms")), KEY, F.col("ts_ms") - ACTION_MS, F.col("ts_ms") + ACTION_MS, "s_ms", 40_000, "left_anti")
    names = [*KEY, "source", "id", "ts_ms", "confidence", "action_ms", "led"]
    return shots.withColumn("source", F.lit("SHOT")).select(*names).unionByName(voices.withColumn("source", F.lit("AUDIO")).select(*names))


def as_signals(found: DataFrame) -> DataFrame:
    """obs_id, KEY, ts_ms, signal_type, event_type, confidence, evidence: what discovered goals add to the signals, emitted together with each other."""
    shot = F.concat(F.lit("Inferred goal hypothesis from a shot, independent audio reaction, and "), F.col("led"))
    audio = F.concat(F.lit("Audio-backed GOAL hypothesis with "), F.col("led"))
    action = F.when(F.col("led").startswith("typed"), F.concat(F.lit("Goal action is anchored to typed football-action evidence at "), F.col("action_ms").cast("string"), F.lit(" ms"))).otherwise("Event action is anchored to audio and a later score transition")
    one = lambda kind, at, text: F.struct(F.lit(kind).alias("signal_type"), at.alias("at_ms"), text.alias("evidence"))
    rows = F.when(F.col("source") == "SHOT", F.array(one("TRANSCRIPT_KEYWORD", F.col("ts_ms"), shot), one("TRANSCRIPT_GOAL", F.col("ts_ms"), shot)))
    rows = rows.otherwise(F.array(one("AUDIO_GOAL_HYPOTHESIS", F.col("ts_ms"), audio), one("EVENT_RECONSTRUCTION", F.col("action_ms"), action)))
    out = found.select(F.col("id").alias("obs_id"), *KEY, "confidence", F.inline(rows))
    return out.select("obs_id", *KEY, F.col("at_ms").alias("ts_ms"), "signal_type", F.lit("GOAL").alias("event_type"), "confidence", "evidence")
