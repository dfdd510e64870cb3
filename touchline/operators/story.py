"""A candidate as a story: its stored signals as typed atoms in order, and relations between them.

candidates: candidate_id, event_type, trigger_ms, score, status. signals: candidate_id, signal_type, event_type, confidence, ts_ms, evidence. All relations are windows
over the atoms of one candidate in order of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The atom of a signal type, where nothing more special holds.
ATOM_OF = {
    "SCORE_STATE": "SCORE_STATE", "SCORE_STATE_TRANSITION": "SCORE_TRANSITION", "REPLAY_CONTEXT": "REPLAY_INTRODUCTION", "RETROSPECTIVE_CONTEXT": "REPLAY_EVENT", "RESTART_CONTEXT": "RESTART",
    "GOAL_KICK_CONTEXT": "GOAL_KICK", "INJURY_CONTEXT": "INJURY", "UNRELATED_ACTION_CONTEXT": "PHASE_BOUNDARY", "TRANSCRIPT_SHOT": "SHOT", "ATTACK_BUILDUP": "ATTACK",
    "TRANSCRIPT_EMPHASIS": "COMMENTATOR_REACTION", "TRANSCRIPT_REPETITION": "COMMENTATOR_REACTION", "POST_EVENT_COMMENTARY": "COMMENTATOR_REACTION", "AUDIO_ENERGY_RISE": "AUDIO_INTENSITY_RISE",
    "AUDIO_SPIKE": "AUDIO_INTENSITY_RISE", "CROWD_REACTION_PROXY": "AUDIO_INTENSITY_RISE", "AUDIO_SUSTAINED": "AUDIO_SUSTAINED", "HIGH_EXCITEMENT": "AUDIO_SUSTAINED", "VOICE_EXCITEMENT": "AUDIO_SUSTAINED",
    "SPEECH_RATE_SPIKE": "SPEECH_RATE_RISE", "PITCH_RISE": "PITCH_RISE", "PITCH_VARIANCE": "PITCH_RISE", "REJECTION_REASON": "REJECTION", "EVENT_BOUNDARY": "CLIP_BOUNDARY", "EVENT_AFTERGLOW": "CLIP_BOUNDARY",
    "TRANSCRIPT_CARD": "CARD", "LIVE_EVENT_CONTEXT": "OTHER", "EVENT_ASSOCIATION": "ASSOCIATION", "EVENT_MERGE": "ASSOCIATION",
}
OUTCOMES = ("SAVE", "BLOCK", "CLEARANCE", "CORNER", "WIDE", "POST", "CONTINUED_PLAY", "PENALTY_AWARDED", "PENALTY_ATTEMPT")
NEGATIVE = ("SAVE", "BLOCK", "CLEARANCE", "CORNER", "WIDE", "POST", "CONTINUED_PLAY", "MISSED_PENALTY")
FENCES = ("RESTART", "GOAL_KICK", "INJURY", "PHASE_BOUNDARY", "REPLAY_INTRODUCTION", "REPLAY_EVENT", "RETROSPECTIVE_REFERENCE")
REPLAYS = ("REPLAY_INTRODUCTION", "REPLAY_EVENT", "RETROSPECTIVE_REFERENCE")
#: The family of a signal type, where it isn't TRANSCRIPT.
FAMILY_OF = {
    "SCORE_STATE": "SCORE_STATE", "SCORE_STATE_TRANSITION": "SCORE_STATE", "REPLAY_CONTEXT": "REPLAY_CONTEXT", "RETROSPECTIVE_CONTEXT": "REPLAY_CONTEXT", "RESTART_CONTEXT": "RESTART_CONTEXT",
    "INJURY_CONTEXT": "INJURY_CONTEXT", "EVENT_RECONSTRUCTION": "RECONSTRUCTION", "EVENT_ASSOCIATION": "ASSOCIATION", "EVENT_MERGE": "ASSOCIATION", "AUDIO_SPIKE": "AUDIO", "AUDIO_SUSTAINED": "AUDIO",
    "AUDIO_ENERGY_RISE": "AUDIO", "VOICE_EXCITEMENT": "AUDIO", "HIGH_EXCITEMENT": "AUDIO", "PITCH_RISE": "AUDIO", "PITCH_VARIANCE": "AUDIO", "SPEECH_RATE_SPIKE": "AUDIO", "CROWD_REACTION_PROXY": "AUDIO",
    "REJECTION_REASON": "CLASSIFICATION",
}
ASSOCIATED = ("REPLAY_OF_EXISTING_GOAL; DUPLICATE_EVENT;", "REPLAY_EVIDENCE_FOR_LIVE_EVENT;")


def _of(codes: dict[str, str], column: str) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in codes.items() for x in pair)), F.col(column))


def associates(kind: Column, evidence: Column) -> Column:
    """Does a signal tie a replay to its goal?"""
    return (kind == "EVENT_ASSOCIATION") & (evidence.startswith(ASSOCIATED[0]) | evidence.startswith(ASSOCIATED[1]))


def atom_of(detected: Column, replayed: Column) -> Column:
    """The atom of a signal (signal_type, event_type, evidence); null if it is none. The first rule that holds decides."""
    kind, event, told = F.col("signal_type"), F.col("event_type"), F.col("evidence")
    outcome = F.upper(F.trim(F.regexp_extract(told, "OUTCOME=([^;]*)", 1)))
    spoken, goal = kind == "TRANSCRIPT_EVENT", (event == "GOAL") & kind.isin("TRANSCRIPT_GOAL", "TRANSCRIPT_EVENT", "TRANSCRIPT_KEYWORD", "AUDIO_GOAL_HYPOTHESIS")
    return (
        F.when(associates(kind, told), "REPLAY_EVENT")
        .when(kind == "SHOT_OUTCOME_CONTEXT", F.when(outcome.isin(*OUTCOMES), outcome).otherwise("OTHER"))
        .when(event == "MISSED_PENALTY", "MISSED_PENALTY")
        .when(event == "FOUL", "FOUL")
        .when(event.isin("YELLOW_CARD", "RED_CARD"), "CARD")
        .when(event == "CELEBRATION", "CELEBRATION")
        .when(spoken & event.isin("ATTACK", "COUNTER_ATTACK"), "ATTACK")
        .when(spoken & (event == "BIG_CHANCE"), "DANGEROUS_ATTACK")
        .when(spoken & (event == "SHOT"), "SHOT")
        .when(spoken & (event == "SAVE"), "SAVE")
        .when(spoken & (event == "NEAR_MISS"), F.when(outcome == "POST", "POST").otherwise("WIDE"))
        .when(goal, F.when(detected, "GOAL").when(replayed, "REPLAY_EVENT").otherwise("GOAL_HYPOTHESIS"))
        .when(kind == "EVENT_RECONSTRUCTION", "RECONSTRUCTED_ACTION")
        .when((event == "PENALTY") & (kind == "TRANSCRIPT_PENALTY"), "PENALTY_ATTEMPT")
        .when((event == "PENALTY") & spoken, "PENALTY_AWARDED")
        .otherwise(_of(ATOM_OF, "signal_type"))
    )


def atoms(candidates: DataFrame, signals: DataFrame) -> DataFrame:
    """candidate_id, ordinal, ts_ms, atom, confidence, sources and families (in order, comma-joined), negative: signals of one meaning and time are one atom.

    A goal stands at its candidate's trigger, a replay where its evidence says; a detected goal has its atom even if no signal makes it.
    """
    own = Window.partitionBy("candidate_id")
    rows = signals.join(candidates.select("candidate_id", F.col("event_type").alias("c_event"), F.col("trigger_ms").alias("c_ms"), (F.col("status") == "DETECTED").alias("detected")), "candidate_id")
    sure = F.max(F.when(F.col("signal_type").isin("REPLAY_CONTEXT", "RETROSPECTIVE_CONTEXT"), F.col("confidence"))).over(own)
    rows = rows.withColumn("replayed", F.coalesce(sure > 0, F.lit(False)))
    rows = rows.withColumn("atom", atom_of(F.col("detected"), F.col("replayed"))).where("atom is not null")
    told = F.regexp_extract("evidence", r" at (\d+) ms", 1)
    at = F.when((F.col("atom") == "GOAL") & (F.col("c_event") == "GOAL"), F.col("c_ms")).when((F.col("atom") == "REPLAY_EVENT") & (told != ""), told.try_cast("long")).otherwise(F.col("ts_ms"))
    two = associates(F.col("signal_type"), F.col("evidence"))
    family = F.when(two, F.array(F.lit("ASSOCIATION"), F.lit("REPLAY_CONTEXT"))).otherwise(F.array(F.coalesce(_of(FAMILY_OF, "signal_type"), F.lit("TRANSCRIPT"))))
    rows = rows.select("candidate_id", at.alias("ts_ms"), "atom", "confidence", F.col("signal_type").alias("source"), family.alias("family"))
    stands = candidates.where("status = 'DETECTED' and event_type = 'GOAL'").select("candidate_id", F.col("trigger_ms").alias("ts_ms"), F.lit("GOAL").alias("atom"), F.col("score").alias("c_score"))
    joined = lambda column: F.array_join(F.array_sort(column), ",")
    rows = rows.unionByName(stands, allowMissingColumns=True).groupBy("candidate_id", "ts_ms", "atom").agg(
        F.coalesce(F.max("confidence"), F.max("c_score")).alias("confidence"), F.collect_set("source").alias("sources"), F.array_distinct(F.flatten(F.collect_set("family"))).alias("families")
    )
    bare = F.size("sources") == 0
    order = Window.partitionBy("candidate_id").orderBy("ts_ms", "atom")
    return rows.select(
        "candidate_id", (F.row_number().over(order) - 1).alias("ordinal"), "ts_ms", "atom", "confidence", F.when(bare, "CANONICAL_CANDIDATE").otherwise(joined("sources")).alias("sources"),
        F.when(bare, "CLASSIFICATION").otherwise(joined("families")).alias("families"), F.col("atom").isin(*NEGATIVE).alias("negative"),
    )


def relations(atom: DataFrame, candidates: DataFrame, signals: DataFrame, attach_ms: int = 8000, lead_ms: int = 45_000) -> DataFrame:
    """candidate_id, from_ordinal, to_ordinal, relation.

    Neighbours PRECEDE. What came of a shot is OUTCOME_OF the nearest one before, play that goes on of the nearest attack. An award SUPPORTS the penalty
    after it; the nearest shot and attack support the first goal; all unless the phase changes between. An associated replay is REPLAY_OF the
    goal, and the nearest atom on either side of a rejection CONTRADICTS it.
    """
    w = Window.partitionBy("candidate_id")
    line = w.orderBy("ordinal")
    so_far, earlier = w.orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, 0), w.orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, -1)
    kind, own = F.col("atom"), F.col("ordinal")
    here = F.struct("ts_ms", (-own).alias("o"))
    last = lambda *names: F.max(F.when(kind.isin(*names), here)).over(so_far)
    linked = signals.where(((F.col("signal_type") == "REJECTION_REASON") & F.col("evidence").rlike("REPLAY_OF_EXISTING_GOAL|DUPLICATE_EVENT")) | associates(F.col("signal_type"), F.col("evidence"))).select("candidate_id").distinct()
    rows = atom.join(candidates.select("candidate_id", F.col("status").alias("c_status")), "candidate_id").join(linked.withColumn("linked", F.lit(True)), "candidate_id", "left")
    rows = rows.withColumns({
        "shot": last("SHOT"), "attack": last("ATTACK"), "award": last("PENALTY_AWARDED"), "any_attack": last("ATTACK", "DANGEROUS_ATTACK"), "fence_ms": F.max(F.when(kind.isin(*FENCES), F.col("ts_ms"))).over(earlier),
        "low": F.min("ordinal").over(Window.partitionBy("candidate_id", "ts_ms")), "first_goal": F.min(F.when(kind == "GOAL", own)).over(w), "first_replay": F.min(F.when(kind.isin(*REPLAYS), own)).over(w),
    }).withColumns({"before": F.lag(F.struct("ts_ms", "low")).over(line), "after": F.lead(F.struct("ts_ms", "ordinal")).over(line)})
    open_ = lambda c, reach: F.coalesce((F.col("ts_ms") - F.col(f"{c}.ts_ms") <= reach) & (F.col("fence_ms").isNull() | (F.col("fence_ms") <= F.col(f"{c}.ts_ms"))), F.lit(False))
    one = lambda test, a, b, name: F.when(test, F.struct(a.cast("int").alias("from_ordinal"), b.cast("int").alias("to_ordinal"), F.lit(name).alias("relation")))
    goal = F.coalesce(own == F.col("first_goal"), F.lit(False))
    near = F.when(F.col("before").isNull(), F.col("after.ordinal")).when(F.col("after").isNull() | (F.col("ts_ms") - F.col("before.ts_ms") <= F.col("after.ts_ms") - F.col("ts_ms")), F.col("before.low")).otherwise(F.col("after.ordinal"))
    found = F.array_compact(F.array(
        one(F.col("after").isNotNull(), own, F.col("after.ordinal"), "PRECEDES"),
        one(F.col("negative") & open_("shot", attach_ms), -F.col("shot.o"), own, "OUTCOME_OF"),
        one((kind == "CONTINUED_PLAY") & open_("attack", attach_ms), -F.col("attack.o"), own, "OUTCOME_OF"),
        one((kind == "PENALTY_ATTEMPT") & open_("award", attach_ms), -F.col("award.o"), own, "SUPPORTS"),
        one(goal & open_("shot", attach_ms), -F.col("shot.o"), own, "SUPPORTS"),
        one(goal & open_("any_attack", lead_ms), -F.col("any_attack.o"), own, "SUPPORTS"),
        one(goal & F.col("first_replay").isNotNull() & F.coalesce("linked", F.lit(False)), F.col("first_replay"), own, "REPLAY_OF"),
        one((kind == "REJECTION") & (F.col("c_status") == "REJECTED") & near.isNotNull(), near, own, "CONTRADICTS"),
    ))
    return rows.select("candidate_id", F.inline(found))


def assessments(candidates: DataFrame, signals: DataFrame) -> DataFrame:
    """candidate_id, label: what a story amounts to, by status and the reasons against it."""
    why = signals.where("signal_type = 'REJECTION_REASON'").groupBy("candidate_id").agg(F.bool_or(F.col("evidence").rlike("REPLAY_OF_EXISTING_GOAL|DUPLICATE_EVENT")).alias("again"))
    rows = candidates.join(why, "candidate_id", "left")
    label = F.when(F.col("status") == "DETECTED", F.when(F.col("event_type") == "GOAL", "CANONICAL_GOAL").otherwise("DETECTED_EVENT"))
    return rows.select("candidate_id", label.when(F.col("again"), "REPLAY_OR_DUPLICATE").when(F.col("again").isNotNull(), "REJECTED_HYPOTHESIS").otherwise("UNRESOLVED_HYPOTHESIS").alias("label"))
