"""From when to when an event goes: its start by what led to it, its end by what came of it, trimmed to a length and to the media.

Signals (asset_id, run_id, id, ts_ms, signal_type, event_type, confidence, evidence) of a recording's run meet each event by a range join around its
reference time (that of the action, or of the trigger); what decides is then maxima, minima and chains over the signals near one event.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import text as X
from touchline.operators import timejoin as T
from touchline.operators import transcript as P
from touchline.operators.lineage import settled
from touchline.operators.sequence import gap_clusters
from touchline.settings import DEFAULTS, Settings

KEY = ["asset_id", "run_id"]
#: The type of rows that stand for anchors among signals.
ANCHOR = "#ANCHOR"
REPLAYS = ("REPLAY_CONTEXT", "RETROSPECTIVE_CONTEXT", "POST_EVENT_COMMENTARY")
GOAL_FENCES = (*REPLAYS, "INJURY_CONTEXT", "RESTART_CONTEXT", "UNRELATED_ACTION_CONTEXT", "GOAL_KICK_CONTEXT")
ATTACKS = ("ATTACK", "COUNTER_ATTACK", "BIG_CHANCE")
AFTERGLOW = (
    "AUDIO_SPIKE", "AUDIO_SUSTAINED", "HIGH_EXCITEMENT", "VOICE_EXCITEMENT", "PITCH_RISE", "PITCH_VARIANCE", "SCORE_STATE_TRANSITION", "CROWD_REACTION_PROXY",
    "TRANSCRIPT_EMPHASIS", "TRANSCRIPT_REPETITION",
)
#: How the evidence of a rise begins that is a buildup of its own.
RISING = "Independent audio buildup features"
#: Types of signals that windows depend on; others only if they are a celebration, or name a penalty.
BOUNDS = (*GOAL_FENCES, "POST_EVENT_COMMENTARY", *AFTERGLOW, "ATTACK_BUILDUP", "AUDIO_ENERGY_RISE", "SPEECH_RATE_SPIKE", "TRANSCRIPT_SHOT", "TRANSCRIPT_EVENT")
# Words of a penalty being prepared; the second list by itself, the first beside a signal of one.
PENALTY_WORDS = ("penalty", "penalti", "penalte", "penalty spot", "penalty kick", "tir au but", "punto de penalti", "point de penalty", "penalty pour")
PENALTY_SETUP = (
    "penalty awarded", "penalty kick", "takes the penalty", "taking the penalty", "the penalty is taken", "lanzamiento de penalti", "lanzamiento de penante", "lanza el penalti",
    "penalti señalado", "penalty spot", "point de penalty", "frappe le penalty",
)


@dataclass(frozen=True)
class Limits:
    padding_ms: int = 5000  # before a cue
    after_ms: int = 8000  # after the last reaction
    fallback_ms: int = 30_000  # before an action without a cue
    glow_ms: int = 20_000  # reactions to a goal
    restart_ms: int = 30_000


def marks_of(anchors: DataFrame) -> DataFrame:
    """Anchors (KEY, anchor_id, event_type, trigger_ms) as rows beside signals."""
    return anchors.select(
        *KEY, F.col("anchor_id").alias("id"), F.col("trigger_ms").alias("ts_ms"), F.lit(ANCHOR).alias("signal_type"), "event_type", F.lit(0.0).alias("confidence"), F.lit("").alias("evidence")
    )


def contexts(windows: DataFrame, segments: DataFrame, keys: list[str], most: int = 6000) -> DataFrame:
    """keys and context: texts of segments that touch each window (asset_id, from_ms, to_ms; both ends count), in order, cut at most characters."""
    closed = windows.select(*keys, "asset_id", F.col("from_ms").alias("start_ms"), (F.col("to_ms") + 1).alias("end_ms"))
    return P.window_context(closed, segments.select("asset_id", "seq", "start_ms", (F.col("end_ms") + 1).alias("end_ms"), "text"), keys, most)


def _near(events: DataFrame, signals: DataFrame, anchors: DataFrame, cfg: Settings, limits: Limits) -> DataFrame:
    """Events with each signal near them that may decide, and what is known of all of these: fences, decisive action, what ends the event. What a signal can be to an event is
    found once a signal; of the pairs those that no rule asks for are dropped where they arise."""
    lead, glow_ms = min(cfg.buildup_lead_ms, cfg.search_back_ms), max(cfg.attach_ms, limits.glow_ms)
    told = F.col("evidence").startswith(RISING).alias("rising")
    rows = signals.select(*KEY, "id", "ts_ms", "signal_type", "event_type", "confidence", told).withColumnRenamed("event_type", "s_event")
    kind, event, strong = F.col("signal_type"), F.col("s_event"), F.col("confidence") >= 0.55
    spot = (event == "PENALTY") & kind.isin("TRANSCRIPT_PENALTY", "TRANSCRIPT_EVENT", "TRANSCRIPT_KEYWORD")
    taken = ((kind == "TRANSCRIPT_SHOT") & (event == "SHOT")) | ((kind == "TRANSCRIPT_PENALTY") & (event == "PENALTY")) | ((kind == "TRANSCRIPT_EVENT") & event.isin("SHOT", "PENALTY"))
    audio = kind.isin("AUDIO_ENERGY_RISE", "AUDIO_SPIKE", "AUDIO_SUSTAINED", "SPEECH_RATE_SPIKE", "PITCH_RISE")
    rows = rows.where(kind.isin(*BOUNDS) | (event == "CELEBRATION") | spot)
    rows = rows.unionByName(marks_of(anchors).where("event_type = 'GOAL'").withColumnRenamed("event_type", "s_event").withColumn("rising", F.lit(False)).select(rows.columns))
    signal = kind != ANCHOR
    flags = {
        "mark": ~signal, "fence": kind.isin(*GOAL_FENCES), "replay": kind.isin(*REPLAYS), "restart": kind == "RESTART_CONTEXT", "taken": strong & taken,
        "leads_goal": signal & strong & (builds() | taken | spot | audio), "leads_other": signal & strong & (builds() | penalty_cue()),
        "first": strong & ((builds() & (kind == "TRANSCRIPT_SHOT")) | penalty_cue()), "second": strong & (kind == "AUDIO_ENERGY_RISE"), "glows": signal & glow(),
    }
    rows = rows.withColumns({name: F.coalesce(test, F.lit(False)) for name, test in flags.items()})
    goal, ts, ref, is_ = F.col("a_event") == "GOAL", F.col("ts_ms"), F.col("ref_ms"), F.col
    latest = F.greatest("ref_ms", "trigger_ms")
    left = events.select(*KEY, "anchor_id", "a_event", "trigger_ms", "ref_ms", "duration_ms").withColumns({
        "search_ms": F.greatest(F.lit(0), ref - lead), "until_ms": latest + F.when(goal, glow_ms).otherwise(cfg.attach_ms),
    })
    far = ref + cfg.replay_window_ms
    near = T.range_join(left, rows, KEY, F.col("search_ms"), F.when(goal, far).otherwise(F.least("until_ms", far)), "ts_ms", 60_000)
    restarts = is_("restart") & (ts > ref) & (ts - ref <= max(limits.glow_ms, limits.restart_ms))
    asked = F.when(goal, is_("fence") & (ts < ref) | is_("leads_goal") & (ts <= ref) | is_("replay") & (ts > ref) | restarts).otherwise(is_("replay") & (ts < ref) | is_("leads_other") & (ts <= ref))
    glows = is_("glows") & ts.between(ref, F.col("until_ms"))
    near = near.where(asked | glows | (is_("mark") & (ts < ref)))
    w = Window.partitionBy("anchor_id")
    top = lambda test, value=ts: F.max(F.when(test, value)).over(w)
    near = near.withColumns({
        "fence_ms": top(is_("fence") & (ts < ref)),
        "past_ms": top(is_("replay") & (ts > F.col("search_ms")) & (ts < ref)),
        "mark_ms": top(is_("mark") & (F.col("id") != F.col("anchor_id")) & (ts < ref)),
        "replay_ms": F.min(F.when(goal & is_("replay") & (ts > ref), ts)).over(w),
        "restart_ms": F.min(F.when(goal & restarts, ts)).over(w),
    }).withColumn("from_ms", F.when(goal, F.greatest("search_ms", F.coalesce("fence_ms", "search_ms"))).otherwise(F.col("search_ms")))
    seen = F.when(goal, is_("leads_goal")).otherwise(is_("leads_other")) & ts.between(F.col("from_ms"), ref) & (ts >= F.coalesce("mark_ms", F.lit(0))) & (goal | (ts > F.coalesce("past_ms", F.lit(-1))))
    near = near.withColumn("seen", seen)
    pick = lambda test: top(F.col("seen") & test, F.struct("ts_ms", (-F.col("id")).alias("o"), "confidence"))
    near = near.withColumn("decisive", F.when(goal, pick(is_("taken"))).otherwise(F.coalesce(pick(is_("first")), pick(is_("second")))))
    # what decides, and rows that stand for what is known of all of them
    knows = (ts == F.col("fence_ms")) | (ts == F.col("replay_ms")) | (ts == F.col("restart_ms"))
    columns = ["asset_id", "anchor_id", "a_event", "trigger_ms", "ref_ms", "duration_ms", "id", "ts_ms", "signal_type", "s_event", "confidence", "rising", "from_ms", "replay_ms", "restart_ms", "seen", "decisive"]
    return near.where(F.col("seen") | glows | F.coalesce(knows, F.lit(False))).select(*columns)


def glow() -> Column:
    """Is a signal a reaction?"""
    return F.col("signal_type").isin(*AFTERGLOW) | F.coalesce(F.col("s_event") == "CELEBRATION", F.lit(False))


def builds() -> Column:
    """Does a signal lead to an event that is no goal?"""
    kind, event = F.col("signal_type"), F.col("s_event")
    return kind.isin("ATTACK_BUILDUP", "AUDIO_ENERGY_RISE") | ((kind == "TRANSCRIPT_SHOT") & (event == "SHOT")) | ((kind == "TRANSCRIPT_EVENT") & event.isin(*ATTACKS))


def penalty_cue() -> Column:
    return F.col("signal_type").isin("TRANSCRIPT_PENALTY", "TRANSCRIPT_KEYWORD") & (F.col("s_event") == "PENALTY")


def connected_attack(near: DataFrame, segments: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """anchor_id, attack_ms, attack_sure of goals: the earliest cue of an attack that chains up to the decisive action (else to the last cue) by steps that are
    short enough and through which somebody speaks."""
    kind = F.col("signal_type")
    cue = F.col("seen") & (F.col("a_event") == "GOAL") & ((kind == "ATTACK_BUILDUP") | ((kind == "TRANSCRIPT_EVENT") & F.col("s_event").isin(*ATTACKS)))
    rows = near.where(cue & (F.col("decisive").isNull() | (F.col("ts_ms") < F.col("decisive.ts_ms"))))
    # of cues at one time, the last
    rows = rows.groupBy("asset_id", "anchor_id", "ref_ms", F.col("decisive.ts_ms").alias("action_ms"), "ts_ms").agg(F.max_by(F.struct("confidence", "signal_type"), "id").alias("cue"))
    w = Window.partitionBy("anchor_id").orderBy(F.desc("ts_ms"))
    rows = rows.withColumn("later_ms", F.coalesce(F.lag("ts_ms").over(w), "action_ms"))
    steps = rows.where("later_ms is not null").select(F.struct("anchor_id", "ts_ms").alias("pair_id"), "asset_id", F.col("ts_ms").alias("a_ms"), F.col("later_ms").alias("b_ms"))
    told = bridged(steps, segments, cfg.attach_ms).select("pair_id.anchor_id", "pair_id.ts_ms", "bridged")
    rows = rows.join(told, ["anchor_id", "ts_ms"], "left")
    far = F.col("later_ms").isNotNull() & ((F.col("later_ms") - F.col("ts_ms") > max(4 * cfg.attach_ms, 20_000)) | ~F.coalesce("bridged", F.lit(False)))
    rows = rows.withColumn("broken", F.max(far.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("broken = 0")
    found = rows.groupBy("anchor_id", "ref_ms").agg(F.min_by(F.struct("ts_ms", "cue"), "ts_ms").alias("first"), F.count(F.lit(1)).alias("n"), F.first("action_ms").alias("action_ms"))
    back = F.col("ref_ms") - F.col("first.ts_ms")
    good = F.col("action_ms").isNotNull() | (F.col("n") > 1) | (back <= cfg.attach_ms) | (F.col("first.cue.signal_type") == "ATTACK_BUILDUP")
    return found.where(good).select("anchor_id", F.col("first.ts_ms").alias("attack_ms"), F.col("first.cue.confidence").alias("attack_sure"))


def bridged(steps: DataFrame, segments: DataFrame, gap_ms: int) -> DataFrame:
    """steps (pair_id, asset_id, a_ms, b_ms) with bridged: do segments that touch the time between leave holes of gap_ms at most, before its end too?"""
    closed = segments.select("asset_id", F.col("start_ms").alias("s_ms"), (F.col("end_ms") + 1).alias("e_ms"))
    pairs = T.overlap_join(steps.withColumn("c_ms", F.col("b_ms") + 1), closed, ["asset_id"], ("a_ms", "c_ms"), ("s_ms", "e_ms"), 30_000)
    w = Window.partitionBy("pair_id").orderBy("s_ms", "e_ms").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col("a_ms"), F.coalesce(F.max(F.col("e_ms") - 1).over(w), F.col("a_ms")))
    holes = pairs.withColumn("hole", F.when(reached < F.col("b_ms"), F.col("s_ms") - reached).otherwise(F.lit(0)))
    ends = holes.groupBy("pair_id").agg(F.max("hole").alias("hole"), F.max(F.col("e_ms") - 1).alias("end"))
    tail = F.col("b_ms") - F.greatest("a_ms", F.coalesce("end", "a_ms"))
    return steps.join(ends, "pair_id", "left").withColumn("bridged", (F.coalesce("hole", F.lit(0)) <= gap_ms) & (tail <= gap_ms)).drop("hole", "end")


def rising_audio(near: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """anchor_id, loud_ms, loud_sure of goals: the latest stretch of audio cues of two families at least (loudness, speech rate, pitch) not long before."""
    kind = F.col("signal_type")
    family = F.when(kind.isin("AUDIO_ENERGY_RISE", "AUDIO_SPIKE", "AUDIO_SUSTAINED"), "ENERGY").when(kind == "SPEECH_RATE_SPIKE", "SPEECH_RATE").when(kind == "PITCH_RISE", "PITCH")
    cues = near.where(F.col("seen") & (F.col("a_event") == "GOAL") & (F.col("ts_ms") < F.col("ref_ms")) & (F.col("confidence") >= 0.60) & (F.col("ref_ms") - F.col("ts_ms") <= 6 * cfg.attach_ms))
    cues = cues.withColumn("family", family).where("family is not null").select("anchor_id", "ref_ms", "ts_ms", "family", "confidence")
    gap = max(1, cfg.attach_ms // 2)
    parts = gap_clusters(cues, ["anchor_id"], "ts_ms", gap).groupBy("anchor_id", "ref_ms", "cluster")
    parts = parts.agg(F.min("ts_ms").alias("loud_ms"), F.max("ts_ms").alias("to_ms"), F.max("confidence").alias("loud_sure"), F.count_distinct("family").alias("families"))
    good = parts.where((F.col("families") >= 2) & (F.col("ref_ms") - F.col("to_ms") <= 6 * gap))
    return T.nearest(good, ["anchor_id"], -F.col("to_ms"), ["loud_ms", "loud_sure"])


def event_windows(events: DataFrame, signals: DataFrame, anchors: DataFrame, segments: DataFrame, cfg: Settings = DEFAULTS, limits: Limits = Limits()) -> DataFrame:
    """anchor_id, start_ms, end_ms, start_sure, end_sure, start_reason, end_reason.

    events: KEY, anchor_id, a_event, trigger_ms, ref_ms (the action's time, or the trigger's), rebuilt (is it an action's?), duration_ms.
    A goal starts before the setup of a penalty, else before a connected attack, rising audio, a decisive action, or at a fixed time; other events
    before the first cue, the action, or the trigger. It ends after the last reaction, at a restart, or before a replay. Windows over
    cfg.maximum_event_ms lose their oldest part first, but never the trigger; all are clamped to the media.
    """
    near = settled(_near(events, signals, anchors, cfg, limits))
    goal, kind, ts, ref = F.col("a_event") == "GOAL", F.col("signal_type"), F.col("ts_ms"), F.col("ref_ms")
    cue = F.struct("ts_ms", "id", "confidence", "signal_type")
    limit = F.least(F.col("duration_ms"), F.greatest("ref_ms", "trigger_ms") + F.when(goal, max(cfg.attach_ms, limits.glow_ms)).otherwise(cfg.attach_ms), "replay_ms", "restart_ms")
    one = near.withColumn("limit_ms", limit).groupBy("anchor_id").agg(
        *(F.first(c).alias(c) for c in ("from_ms", "decisive", "replay_ms", "restart_ms")),
        F.max(F.when((kind != ANCHOR) & glow() & ts.between(ref, F.col("limit_ms")), ts)).alias("glow_at"),
        F.min(F.when(F.col("seen") & goal & (F.col("s_event") == "PENALTY") & kind.isin("TRANSCRIPT_PENALTY", "TRANSCRIPT_EVENT", "TRANSCRIPT_KEYWORD"), cue)).alias("spot"),
        F.min(F.when(F.col("seen") & ~goal & builds(), cue)).alias("built"),
        F.max(F.when(F.col("seen") & goal & (kind == "AUDIO_ENERGY_RISE") & (F.col("confidence") >= 0.65) & (ts < ref), F.struct("ts_ms", (-F.col("id")).alias("o"), "confidence", "rising"))).alias("rise"),
    )
    rows = events.join(one, "anchor_id", "left").join(connected_attack(near, segments, cfg), "anchor_id", "left").join(rising_audio(near, cfg), "anchor_id", "left")
    rows = settled(rows.withColumn("from_ms", F.coalesce("from_ms", F.greatest(F.lit(0), F.col("ref_ms") - min(cfg.buildup_lead_ms, cfg.search_back_ms)))))

    # what is said before a goal of a penalty
    said = contexts(rows.where(goal & F.col("spot").isNotNull()).select("anchor_id", "asset_id", "from_ms", F.col("ref_ms").alias("to_ms")), segments, ["anchor_id"])
    said = said.where(X.says_any(F.col("context"), PENALTY_WORDS)).select("anchor_id", F.lit(True).alias("named"))
    setup = segments.where(X.says_any(F.col("text"), PENALTY_SETUP)).select("asset_id", F.col("start_ms").alias("setup_ms"))
    setup = T.range_join(rows.where(goal).select("anchor_id", "asset_id", "from_ms", "ref_ms"), setup, ["asset_id"], F.col("from_ms"), F.col("ref_ms") - 1, "setup_ms", 60_000)
    rows = rows.join(said, "anchor_id", "left").join(setup.groupBy("anchor_id").agg(F.min("setup_ms").alias("setup_ms")), "anchor_id", "left")

    spot = F.coalesce(F.when(F.col("named"), F.struct(F.col("spot.ts_ms").alias("at"), F.col("spot.confidence").alias("sure"))), F.when(F.col("setup_ms").isNotNull(), F.struct(F.col("setup_ms").alias("at"), F.lit(0.64).alias("sure"))))
    start = lambda at, sure, reason: F.struct(at.cast("long").alias("at"), sure.alias("sure"), reason.alias("reason"))
    padded = lambda at: F.greatest(F.lit(0), at - min(5000, limits.padding_ms))
    action = start(padded(F.col("decisive.ts_ms")), F.col("decisive.confidence"), F.lit("START=DECISIVE_ACTION"))
    fallback = start(F.greatest(F.lit(0), ref - limits.fallback_ms), F.lit(0.55), F.lit("START=FALLBACK_PRE_ROLL"))
    rise = F.when(F.col("rise.rising"), "START=AUDIO_BUILDUP").otherwise("START=ATTACK_INTENSITY_RISE")
    of_goal = (
        F.when(spot.isNotNull(), start(padded(spot.at), spot.sure, F.lit("START=PENALTY_SETUP")))
        .when(F.col("attack_ms").isNotNull(), start(padded(F.col("attack_ms")), F.col("attack_sure"), F.lit("START=CONNECTED_ATTACK")))
        .when(F.col("loud_ms").isNotNull(), start(padded(F.col("loud_ms")), F.col("loud_sure"), F.lit("START=AUDIO_BUILDUP")))
        .when(F.col("rise").isNotNull(), start(padded(F.col("rise.ts_ms")), F.col("rise.confidence"), rise))
        .when(F.col("decisive").isNotNull(), action)
        .otherwise(fallback)
    )
    built = F.when(F.col("built.signal_type") == "AUDIO_ENERGY_RISE", "START=ATTACK_INTENSITY_RISE").otherwise("START=BUILDUP_SIGNAL")
    of_other = (
        F.when(F.col("built").isNotNull(), start(padded(F.col("built.ts_ms")), F.col("built.confidence"), built))
        .when(F.col("decisive").isNotNull(), action)
        .when(F.col("rebuilt"), fallback)
        .otherwise(start(F.greatest(F.lit(0), F.col("trigger_ms") - limits.padding_ms), F.lit(0.55), F.lit("START=PADDING")))
    )
    rows = rows.withColumn("start", F.when(goal, of_goal).otherwise(of_other))
    rows = rows.withColumns({"start_ms": F.col("start.at"), "start_sure": F.col("start.sure"), "start_reason": F.col("start.reason")})
    window = goal.cast("int") * (max(cfg.attach_ms, limits.glow_ms) - cfg.attach_ms) + cfg.attach_ms
    latest = F.greatest("ref_ms", "trigger_ms")
    rows = rows.withColumn("glow_at", F.coalesce("glow_at", F.least(latest, F.col("duration_ms"), latest + window, "replay_ms", "restart_ms")))
    return _trimmed(rows, cfg, limits).select("anchor_id", "start_ms", "end_ms", "start_sure", F.when(F.col("glow_at") > F.col("trigger_ms"), 0.78).otherwise(0.55).alias("end_sure"), "start_reason", "end_reason")


def _trimmed(rows: DataFrame, cfg: Settings, limits: Limits) -> DataFrame:
    """rows (start_ms, start_reason, glow_at, replay_ms, restart_ms, trigger_ms, ref_ms, duration_ms) with their end, in order of the rules."""
    end = F.least(F.col("duration_ms"), F.coalesce("restart_ms", F.col("glow_at") + limits.after_ms))
    reason = F.when(F.col("restart_ms").isNotNull(), "END=IMMEDIATE_RESTART").when(F.col("replay_ms") <= F.col("glow_at"), "END=REPLAY_BOUNDARY")
    reason = reason.when(F.col("glow_at") > F.col("ref_ms"), "END=GOAL_REACTION").otherwise("END=FALLBACK_POST_WINDOW")
    rows = rows.withColumns({"end_ms": end, "end_reason": reason})
    rows = rows.withColumn("cut", F.coalesce(F.col("replay_ms") <= F.col("end_ms"), F.lit(False)))
    rows = rows.withColumns({"end_ms": F.when(F.col("cut"), F.col("replay_ms")).otherwise(F.col("end_ms")), "end_reason": F.when(F.col("cut"), "END=REPLAY_BOUNDARY").otherwise(F.col("end_reason"))})
    # an end that isn't after the start
    empty = F.col("end_ms") <= F.col("start_ms")
    after = F.least(F.col("duration_ms"), F.greatest("start_ms", "ref_ms") + max(1, limits.after_ms))
    rows = rows.withColumns({"end_ms": F.when(empty, after).otherwise(F.col("end_ms")), "start_ms": F.when(empty, F.least("start_ms", F.greatest(F.lit(0), F.col("ref_ms") - 1))).otherwise(F.col("start_ms"))})
    # the trigger lies inside
    late, early = F.col("start_ms") > F.col("trigger_ms"), F.col("end_ms") < F.col("trigger_ms")
    told = lambda test, column, more: F.when(test, F.concat(column, F.lit(more))).otherwise(F.col(column))
    rows = rows.withColumns({
        "start_ms": F.least("start_ms", "trigger_ms"), "end_ms": F.greatest("end_ms", "trigger_ms"),
        "start_reason": told(late, "start_reason", "; WINDOW=EXTENDED_TO_INCLUDE_TRIGGER"), "end_reason": told(early, "end_reason", "; WINDOW=EXTENDED_TO_INCLUDE_TRIGGER"),
    })
    # too long: the oldest part goes first, never the trigger
    most = cfg.maximum_event_ms
    over, capped = F.col("end_ms") - F.col("start_ms") > most, F.greatest(F.lit(0), F.col("end_ms") - most)
    rows = rows.withColumns({
        "start_ms": F.when(over, F.least(capped, "trigger_ms")).otherwise(F.col("start_ms")), "end_ms": F.when(over & (capped > F.col("trigger_ms")), F.least(F.col("end_ms"), F.col("trigger_ms") + most)).otherwise(F.col("end_ms")),
        "start_reason": told(over, "start_reason", "; START=MAXIMUM_DURATION_TRIM"),
    })
    # the media's ends
    some = F.col("duration_ms") > 0
    rows = rows.withColumn("start_ms", F.when(some, F.greatest(F.lit(0), F.least("start_ms", F.col("duration_ms") - 1))).otherwise(F.lit(0)))
    rows = rows.withColumn("end_ms", F.when(some, F.greatest(F.col("start_ms") + 1, F.least("end_ms", "duration_ms"))).otherwise(F.lit(0)))
    rows = rows.withColumn("end_reason", told(F.col("restart_ms").isNotNull(), "end_reason", "; POST_RESTART"))
    return rows.withColumn("end_reason", told(F.coalesce(F.col("replay_ms") <= F.col("end_ms"), F.lit(False)), "end_reason", "; REPLAY_CONTEXT"))
