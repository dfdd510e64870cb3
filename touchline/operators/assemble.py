"""From signals to candidates: anchors, support, family confidences, scores, reasons; discovery of goals; sequences of atoms.

signals: asset_id, run_id, id, ts_ms, signal_type, event_type, confidence, evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators import timejoin as T
from touchline.settings import DEFAULTS, Settings

KEY = ["asset_id", "run_id"]
VOICE = ("HIGH_EXCITEMENT", "VOICE_EXCITEMENT", "PITCH_RISE", "PITCH_VARIANCE")
LOUD = ("AUDIO_SPIKE", "AUDIO_SUSTAINED", "CROWD_REACTION_PROXY")
SAID = ("TRANSCRIPT_EMPHASIS", "TRANSCRIPT_REPETITION")
PAST = ("REPLAY_CONTEXT", "RETROSPECTIVE_CONTEXT")
NEGATIVE = ("NEGATION_CONTEXT", "CORRECTION_CONTEXT", "HISTORICAL_REFERENCE")
LED = ("ATTACK_BUILDUP", "AUDIO_ENERGY_RISE")


def anchors(signals: DataFrame) -> DataFrame:
    """One row for each event type and time that has an event-specific signal: anchor_id (the smallest signal), trigger_ms, direct confidence, that of a
    keyword (0 without one)."""
    own = signals.where("event_type is not null and signal_type like 'TRANSCRIPT%'")
    keyword = F.coalesce(F.max(F.when(F.col("signal_type") == "TRANSCRIPT_KEYWORD", F.col("confidence"))), F.lit(0.0))
    return own.groupBy(*KEY, "event_type", F.col("ts_ms").alias("trigger_ms")).agg(F.min("id").alias("anchor_id"), F.max("confidence").alias("direct"), keyword.alias("keyword"))


def support_rule(cfg: Settings = DEFAULTS) -> Column:
    """Does a signal (signal_type, ts_ms) belong to the anchor (event_type, trigger_ms)? The first rule that its type falls under decides. A signal at the
    anchor's own time has the anchor among fences_to, so nothing lies between if these are no fewer than fences_before."""
    kind, gap = F.col("signal_type"), F.col("ts_ms") - F.col("trigger_ms")
    goal = F.col("event_type") == "GOAL"
    reaction = kind.isin(*VOICE, *LOUD, *SAID, "SPEECH_RATE_SPIKE")
    return (
        F.when(kind.isin(*PAST), gap.between(-cfg.replay_window_ms, 0))
        .when(kind.isin(*NEGATIVE), gap.between(-max(cfg.attach_ms, 3000), 0))
        .when(kind == "INJURY_CONTEXT", gap.between(-cfg.replay_window_ms, 0))
        .when(kind == "RESTART_CONTEXT", gap.between(-cfg.replay_window_ms, 30_000))
        .when(kind.isin(*LED), gap.between(-min(cfg.buildup_lead_ms, cfg.search_back_ms), 0) & (F.col("fences_to") >= F.col("fences_before")))
        .when(goal & (kind == "SCORE_STATE_TRANSITION"), gap.between(0, 30_000))
        .when(goal & (kind == "SHOT_OUTCOME_CONTEXT"), gap.between(-cfg.attach_ms, cfg.attach_ms))
        .otherwise(reaction & gap.between(-cfg.attach_ms, cfg.attach_ms))
    )


def attach_support(anchor: DataFrame, signals: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Pairs of an anchor and a signal that supports it. What leads to an event counts only if no other anchor lies strictly between."""
    marks = anchor.select(*KEY, F.col("trigger_ms").alias("a_ms")).distinct()
    left = T.fence_counts(anchor, marks, KEY, "trigger_ms", "a_ms", True, "fences_before")
    right = T.fence_counts(signals.where("event_type is null").select(*KEY, "id", "ts_ms", "signal_type", "confidence"), marks, KEY, "ts_ms", "a_ms", False, "fences_to")
    pairs = T.range_join(left, right, KEY, F.col("trigger_ms") - cfg.replay_window_ms, F.col("trigger_ms") + 30_000, "ts_ms", 60_000)
    return pairs.where(support_rule(cfg))


def family_confidences(anchor: DataFrame, support: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Anchors with the surest signal of each family: audio, textual, speech_rate, buildup, replay, negative."""
    top = lambda test, share=1.0: F.coalesce(F.max(F.when(test, F.col("confidence"))), F.lit(0.0)) * share
    kind = F.col("signal_type")
    near = F.col("trigger_ms") - F.col("ts_ms") <= max(cfg.attach_ms, 3000)
    found = support.groupBy("anchor_id", "event_type").agg(
        F.greatest(top(kind.isin(*VOICE)), top(kind.isin(*LOUD), 0.60)).alias("audio"),
        top(kind.isin(*SAID)).alias("textual"),
        top(kind == "SPEECH_RATE_SPIKE").alias("speech_rate"),
        F.greatest(top(kind == "ATTACK_BUILDUP"), top(kind == "AUDIO_ENERGY_RISE", 0.25)).alias("buildup"),
        top(kind.isin(*PAST)).alias("replay"),
        top(kind.isin(*PAST, *NEGATIVE) & near & (F.col("ts_ms") <= F.col("trigger_ms")) & (F.col("confidence") >= cfg.replay_probability)).alias("negative"),
        F.count(F.lit(1)).alias("supporting"),
        *(F.bool_or(test).alias(name) for name, test in goal_flags(cfg).items()),
    )
    names = ["audio", "textual", "speech_rate", "buildup", "replay", "negative", "supporting"]
    out = anchor.join(found, ["anchor_id", "event_type"], "left").fillna(0, names).fillna(False, list(goal_flags(cfg)))
    return out.withColumn("negative", F.when(F.col("event_type") == "GOAL", F.col("negative")).otherwise(F.lit(0.0)))


def goal_flags(cfg: Settings = DEFAULTS) -> dict[str, Column]:
    """What single signals around a goal (signal_type, confidence, ts_ms, trigger_ms) say against it, or for it, by name."""
    kind, before = F.col("signal_type"), F.col("trigger_ms") - F.col("ts_ms")
    sure = (F.col("confidence") >= cfg.replay_probability) & (before >= 0)
    near = sure & (before <= max(cfg.attach_ms, 3000))
    return {
        "replay_told": near & (kind == "REPLAY_CONTEXT"),
        "negated": near & (kind == "NEGATION_CONTEXT"),
        "corrected": near & (kind == "CORRECTION_CONTEXT"),
        "historical": near & (kind == "HISTORICAL_REFERENCE"),
        "looked_back": near & kind.isin("RETROSPECTIVE_CONTEXT", "HISTORICAL_REFERENCE"),
        "replayed": sure & kind.isin(*PAST),
        "injured": (kind == "INJURY_CONTEXT") & before.between(0, 90_000),
        "restarted": (kind == "RESTART_CONTEXT") & before.between(1, 30_000),
        "score_moved": (kind == "SCORE_STATE_TRANSITION") & (before <= 0),
    }


def score_candidates(df: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """With live (probability), score and reaction. Doubles are rounded to the four places in which scores are kept."""
    replay = F.when((F.col("event_type") == "GOAL") & (F.col("replay") >= cfg.replay_probability), F.col("replay")).otherwise(F.lit(0.0))
    clamp = lambda x, most=1.0: F.greatest(F.lit(0.0), F.least(F.lit(most), x))
    live = 0.20 + 0.45 * F.col("direct") + 0.25 * F.col("audio") + 0.08 * F.col("textual") + 0.07 * F.col("buildup") - cfg.replay_penalty * replay - cfg.negative_penalty * F.col("negative")
    score = (cfg.transcript_weight * F.col("direct") + cfg.audio_weight * F.col("audio")) / (cfg.transcript_weight + cfg.audio_weight)
    score += F.when((F.col("direct") > 0) & (F.col("audio") > 0), cfg.agreement_bonus * 0.25).otherwise(0.0) + 0.05 * F.col("buildup") - 0.5 * cfg.replay_penalty * replay - cfg.negative_penalty * F.col("negative")
    four = lambda x: F.floor(x * 10_000 + 0.500001) / 10_000  # noqa: E731  a tie counts as one however its double came about
    reaction = F.greatest("audio", "textual", F.col("speech_rate") * 0.25)
    return df.withColumns({"live": four(clamp(live)), "score": four(clamp(score, 0.98)), "reaction": reaction, "replay_used": replay})


def score_components(scored: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """anchor_id, event_type, component, contribution: rows that add up to the score; the last is what the clamp takes or gives."""
    total = cfg.transcript_weight + cfg.audio_weight
    parts = {
        "EVENT_EVIDENCE": F.col("direct") * cfg.transcript_weight / total,
        "AUDIO_REACTION": F.col("audio") * cfg.audio_weight / total,
        "SIGNAL_AGREEMENT": F.when((F.col("direct") > 0) & (F.col("audio") > 0), cfg.agreement_bonus * 0.25).otherwise(0.0),
        "ATTACK_BUILDUP": 0.05 * F.col("buildup"),
        "REPLAY_PENALTY": -0.5 * cfg.replay_penalty * F.col("replay_used"),
        "NEGATIVE_CONTEXT": -cfg.negative_penalty * F.col("negative"),
    }
    rest = F.col("score") - sum(parts.values(), F.lit(0.0))
    rows = F.array(*(F.struct(F.lit(n).alias("component"), F.round(v, 6).alias("contribution")) for n, v in {**parts, "CLAMP": rest}.items()))
    return scored.select("anchor_id", "event_type", F.inline(rows))


def rejection_reasons(scored: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """With reasons (an array) and status: DETECTED if there is none. A goal that a keyword names, with nothing said against it, needs no reaction and may be
    looked back on."""
    goal, again = F.col("event_type") == "GOAL", F.col("replay_used") > 0
    named = goal & (F.col("negative") == 0) & (F.col("keyword") >= cfg.single_signal)
    late = goal & again & F.col("restarted") & ~F.col("score_moved")
    needed = F.when(F.col("event_type") == "ATTACK", 0.62).otherwise(cfg.single_signal)
    tests = {
        "REPLAY_OF_EXISTING_GOAL": again,
        "REPLAY_COMMENTARY_REFERENCE": goal & F.col("replay_told"),
        "NEGATED_GOAL_REFERENCE": goal & F.col("negated"),
        "CORRECTED_GOAL_REFERENCE": goal & F.col("corrected"),
        "HISTORICAL_GOAL_REFERENCE": goal & F.col("historical"),
        "INJURY_THEN_REPLAY": again & F.col("replayed") & F.col("injured"),
        "POST_RESTART": late,
        "NO_NEW_SCORE_TRANSITION": late,
        "RETROSPECTIVE_GOAL_REFERENCE": goal & F.col("looked_back") & ~named & ~F.col("score_moved"),
        "INSUFFICIENT_EVENT_SPECIFIC_EVIDENCE": F.col("direct") < needed,
        "GOAL_WITHOUT_REACTION_CORROBORATION": goal & (F.col("reaction") < cfg.minimum_reaction) & ~named,
        "ATTACK_WITHOUT_LOCAL_BUILDUP_AND_REACTION": (F.col("event_type") == "ATTACK") & ((F.col("buildup") < 0.70) | (F.col("audio") < 0.55)),
        "LOW_LIVE_EVENT_PROBABILITY": F.col("live") < cfg.minimum_live,
        "LOW_CANDIDATE_SCORE": F.col("score") < cfg.minimum_score,
    }
    reasons = F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())))
    return scored.withColumn("reasons", reasons).withColumn("status", F.when(F.size("reasons") == 0, "DETECTED").otherwise("REJECTED"))


def choose_trigger(signals: DataFrame, keys: list[str]) -> DataFrame:
    """keys and trigger_ms: the time of a candidate's surest event-specific signal (ts_ms, signal_type, event_type, confidence), of equals the earliest; that of
    the first retrospective confirmation of its goal (confirms) goes before."""
    own = signals.where("confirms or (event_type is not null and signal_type like 'TRANSCRIPT%')")
    order = F.struct((~F.col("confirms")).cast("int"), F.when(F.col("confirms"), F.lit(0.0)).otherwise(-F.col("confidence")), "ts_ms")
    return own.groupBy(*keys).agg(F.min_by("ts_ms", order).alias("trigger_ms"))


def assemble(signals: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Candidates: anchors with their support, scored and judged, at most cfg.maximum_candidates an asset and run."""
    a = anchors(signals)
    judged = rejection_reasons(score_candidates(family_confidences(a, attach_support(a, signals, cfg), cfg), cfg), cfg)
    order = Window.partitionBy(*KEY).orderBy((F.col("status") != "DETECTED").cast("int"), F.desc("score"), "trigger_ms", "event_type")
    return judged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.maximum_candidates)


def event_end(candidates: DataFrame, signals: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """candidate_id, end_ms: after the last reaction within reach, before a restart, not longer than allowed."""
    goal = F.col("event_type") == "GOAL"
    rows = candidates.select("candidate_id", *KEY, "event_type", "start_ms", "trigger_ms").withColumn("reach_ms", F.when(goal, 20_000).otherwise(cfg.attach_ms))
    near = T.range_join(rows, signals.select(*KEY, "ts_ms", "signal_type"), KEY, F.col("trigger_ms"), F.col("trigger_ms") + 30_000, "ts_ms", 30_000)
    stop = near.where("signal_type = 'REPLAY_CONTEXT' and ts_ms > trigger_ms").groupBy("candidate_id").agg(F.min("ts_ms").alias("stop_ms"))
    after = near.where("signal_type = 'AUDIO_SPIKE'").join(stop, "candidate_id", "left").where("ts_ms <= trigger_ms + reach_ms and (stop_ms is null or ts_ms < stop_ms)").groupBy("candidate_id").agg(F.max("ts_ms").alias("glow_ms"))
    out = rows.join(after, "candidate_id", "left").join(stop, "candidate_id", "left")
    end = F.coalesce("glow_ms", "trigger_ms") + 8000
    end = F.greatest(F.col("trigger_ms"), F.least(end, F.coalesce("stop_ms", end), F.col("start_ms") + cfg.maximum_event_ms))
    return out.select("candidate_id", end.alias("end_ms"))


def discover_goals(signals: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """asset_id, run_id, id (of the shot), ts_ms, confidence: goals that nobody called, from a shot, a reaction to it and what led to it."""
    shots = signals.where("signal_type = 'TRANSCRIPT_SHOT' and event_type = 'SHOT'").select(*KEY, "id", F.col("ts_ms").alias("shot_ms"))
    around = signals.select(*KEY, "ts_ms", "signal_type", "confidence")
    pairs = T.range_join(shots, around, KEY, F.greatest(F.lit(0), F.col("shot_ms") - cfg.buildup_lead_ms), F.col("shot_ms") + cfg.attach_ms, "ts_ms", 60_000)
    kind, after = F.col("signal_type"), F.col("ts_ms") >= F.col("shot_ms")
    top = lambda test: F.max(F.when(test, F.col("confidence")))
    led = F.max_by("confidence", F.when((kind == "ATTACK_BUILDUP") & ~after, F.struct("ts_ms", "confidence")))
    one = pairs.groupBy(*KEY, "id", "shot_ms").agg(
        led.alias("led"),
        top(kind.isin(*VOICE, *LOUD) & after).alias("audio"),
        top(kind.isin(*SAID) & after).alias("said"),
        F.coalesce(top((kind == "SPEECH_RATE_SPIKE") & after), F.lit(0.0)).alias("rate"),
        F.bool_or(((kind == "GOAL_KICK_CONTEXT") & (F.col("ts_ms") >= F.col("shot_ms") - 3000)) | ((kind == "SHOT_OUTCOME_CONTEXT") & after)).alias("veto"),
    )
    good = one.where((F.col("audio") >= cfg.minimum_reaction) & ~F.col("veto") & (F.col("led").isNotNull() | F.col("said").isNotNull() | (F.col("rate") >= 0.58)))
    both = F.least("audio", F.greatest(F.coalesce("led", F.lit(0.0)), F.coalesce("said", F.lit(0.0)), F.col("rate")))
    return good.select(*KEY, "id", F.col("shot_ms").alias("ts_ms"), F.least(F.lit(0.88), 0.76 + 0.12 * both).alias("confidence"))


# What a signal type means in a sequence, and the family it is evidence of.
ATOMS = {"ATTACK_BUILDUP": "ATTACK_BUILDUP", "TRANSCRIPT_SHOT": "SHOT", "TRANSCRIPT_GOAL": "GOAL", "AUDIO_SPIKE": "AUDIO_REACTION", "REPLAY_CONTEXT": "REPLAY_EVENT", "SCORE_STATE_TRANSITION": "SCORE_CHANGE", "RESTART_CONTEXT": "RESTART", "SHOT_OUTCOME_CONTEXT": "OUTCOME"}
FAMILIES = {"ATTACK_BUILDUP": "TRANSCRIPT", "SHOT": "TRANSCRIPT", "GOAL": "TRANSCRIPT", "AUDIO_REACTION": "AUDIO", "REPLAY_EVENT": "CONTEXT", "SCORE_CHANGE": "SCORE", "RESTART": "CONTEXT", "OUTCOME": "CONTEXT"}


def _named(codes: dict[str, str], column: str) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in codes.items() for x in pair)), F.col(column))


def atoms(attached: DataFrame) -> DataFrame:
    """candidate_id, ordinal, ts_ms, atom, family, confidence, sources: signals of a candidate (candidate_id, ts_ms, signal_type, confidence) as typed atoms,
    those of one type and time as one. Types that mean nothing are dropped."""
    rows = attached.withColumn("atom", _named(ATOMS, "signal_type")).where("atom is not null")
    one = rows.groupBy("candidate_id", "ts_ms", "atom").agg(F.max("confidence").alias("confidence"), F.count_distinct("signal_type").alias("sources"))
    order = Window.partitionBy("candidate_id").orderBy("ts_ms", "atom")
    return one.select("candidate_id", (F.row_number().over(order) - 1).alias("ordinal"), "ts_ms", "atom", _named(FAMILIES, "atom").alias("family"), "confidence", "sources")


def edges(atom: DataFrame, support_ms: int = 45_000, outcome_ms: int = 8000) -> DataFrame:
    """candidate_id, from_ordinal, to_ordinal, relation: neighbours PRECEDE; the nearest shot or goal before a reaction is what it SUPPORTS; a replay is
    REPLAY_OF the goal before it; what came of a shot is OUTCOME_OF the nearest one before."""
    order = Window.partitionBy("candidate_id").orderBy("ordinal")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda *names: F.last(F.when(F.col("atom").isin(*names), F.struct("ordinal", "ts_ms")), ignorenulls=True).over(so_far)
    rows = atom.withColumns({"next": F.lead("ordinal").over(order), "action": last("SHOT", "GOAL"), "goal": last("GOAL"), "shot": last("SHOT")})
    one = lambda test, a, b, name: F.when(test, F.struct(a.alias("from_ordinal"), b.alias("to_ordinal"), F.lit(name).alias("relation")))
    own = F.col("ordinal")
    found = F.array_compact(
        F.array(
            one(F.col("next").isNotNull(), own, F.col("next"), "PRECEDES"),
            one((F.col("atom") == "AUDIO_REACTION") & (F.col("ts_ms") - F.col("action.ts_ms") <= support_ms), own, F.col("action.ordinal"), "SUPPORTS"),
            one((F.col("atom") == "OUTCOME") & (F.col("ts_ms") - F.col("shot.ts_ms") <= outcome_ms), F.col("shot.ordinal"), own, "OUTCOME_OF"),
            one((F.col("atom") == "REPLAY_EVENT") & F.col("goal").isNotNull(), own, F.col("goal.ordinal"), "REPLAY_OF"),
        )
    )
    return rows.select("candidate_id", F.inline(found))


def assessment(candidates: DataFrame, atom: DataFrame) -> DataFrame:
    """candidate_id, label: what the sequence of a candidate amounts to."""
    has = atom.groupBy("candidate_id").agg(F.bool_or(F.col("atom") == "REPLAY_EVENT").alias("replayed"))
    rows = candidates.join(has, "candidate_id", "left")
    label = F.when(F.col("status") == "REJECTED", F.when(F.coalesce("replayed", F.lit(False)), "REPLAY_OR_DUPLICATE").otherwise("REJECTED_HYPOTHESIS"))
    label = label.when(F.col("status") != "DETECTED", "UNRESOLVED_HYPOTHESIS").when(F.col("event_type") == "GOAL", "CANONICAL_GOAL").otherwise("DETECTED_EVENT")
    return rows.select("candidate_id", label.alias("label"))


def goal_action(goals: DataFrame, shots: DataFrame, lead_ms: int = 45_000) -> DataFrame:
    """goal_id, shot_id, shot_ms: the latest shot before each goal (asset_id, run_id, goal_id, goal_ms), with no other goal between; ties: the surest."""
    marks = goals.select(*KEY, F.col("goal_ms").alias("a_ms")).distinct()
    left = T.fence_counts(goals, marks, KEY, "goal_ms", "a_ms", True, "before")
    right = T.fence_counts(shots, marks, KEY, "shot_ms", "a_ms", False, "up_to")
    pairs = T.range_join(left, right, KEY, F.greatest(F.lit(0), F.col("goal_ms") - lead_ms), F.col("goal_ms") - 1, "shot_ms", 45_000).where(F.col("before") == F.col("up_to"))
    return T.nearest(pairs, ["goal_id"], F.struct(-F.col("shot_ms"), -F.col("confidence"), "shot_id"), ["shot_id", "shot_ms"])


def audio_buildup(goals: DataFrame, signals: DataFrame, gap_ms: int = 4000, lead_ms: int = 45_000) -> DataFrame:
    """goal_id, from_ms, to_ms: of the stretches of rising audio before a goal, of two families at least and no farther than six gaps, the latest."""
    near = T.range_join(goals, signals.select("asset_id", "ts_ms", "signal_type"), ["asset_id"], F.greatest(F.lit(0), F.col("goal_ms") - lead_ms), F.col("goal_ms"), "ts_ms", 45_000)
    from touchline.operators.sequence import gap_clusters

    parts = gap_clusters(near, ["goal_id", "goal_ms"], "ts_ms", gap_ms).groupBy("goal_id", "goal_ms", "cluster").agg(F.min("ts_ms").alias("from_ms"), F.max("ts_ms").alias("to_ms"), F.count_distinct("signal_type").alias("families"))
    good = parts.where((F.col("families") >= 2) & (F.col("goal_ms") - F.col("to_ms") <= 6 * gap_ms))
    return T.nearest(good, ["goal_id"], -F.col("to_ms"), ["from_ms", "to_ms"])


def exclude_near(rows: DataFrame, others: DataFrame, ts: str, other_ts: str, reach_ms: int) -> DataFrame:
    """Rows with no row of others of their asset within reach."""
    return T.range_join(rows, others.select("asset_id", other_ts), ["asset_id"], F.col(ts) - reach_ms, F.col(ts) + reach_ms, other_ts, 2 * reach_ms, "left_anti")


def observations_by_family(signals: DataFrame, center_ms: int, window_ms: int = 60_000) -> DataFrame:
    """asset_id, run_id, family, n, top: signals around a time by the family they are evidence of."""
    from touchline.functions.evidence import family

    near = signals.where(F.col("ts_ms").between(max(0, center_ms - window_ms), center_ms + window_ms))
    return near.groupBy(*KEY, family(F.col("signal_type")).alias("family")).agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("top"))


#: Words that don't tell which goal a text is about, besides those under four letters.
REPLAY_STOP_WORDS = ("goal", "goals", "score", "scores", "scored", "replay", "goalcall", "crowd", "team", "match", "marque", "marquer", "egalisation", "after", "from", "into", "dans", "pour", "avec")


def replay_pairs(goals: DataFrame, least: float = 0.7, tokens: int = 3) -> DataFrame:
    """goal_id, earlier_id: goals (asset_id, run_id, goal_id, goal_ms, status, context) that say the same as an earlier detected one of their run.

    All goals of a run are compared, however far apart: quadratic in the goals of one recording's run.
    """
    from touchline.functions import text as X

    rows = goals.select(*KEY, "goal_id", "goal_ms", "status", X.token_set(F.col("context"), "all").alias("words"))
    rows = rows.withColumn("names", F.filter("words", lambda x: (F.char_length(x) >= 4) & ~x.isin(*REPLAY_STOP_WORDS)))
    earlier = rows.where("status = 'DETECTED'").select(*KEY, *(F.col(c).alias(n) for c, n in (("goal_id", "earlier_id"), ("goal_ms", "earlier_ms"), ("words", "e_words"), ("names", "e_names"))))
    pairs = rows.where(F.size("names") >= tokens).join(earlier.where(F.size("e_names") >= tokens), KEY).where("earlier_ms < goal_ms")
    same = F.greatest(X.jaccard(F.col("words"), F.col("e_words")), X.containment(F.col("names"), F.col("e_names"))) >= least
    return pairs.where((F.size(F.array_intersect("names", "e_names")) >= tokens) & same).select("goal_id", "earlier_id")


def _fold_replays(batches):
    """mapInArrow: goals with likenesses (asset_id, run_id, goal_id, earlier), sorted, to those that are replays. State: the replays of one run."""
    import pyarrow as pa

    run, replays = None, set()
    for batch in batches:
        found = []
        for asset_id, run_id, goal_id, earlier in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if run != (asset_id, run_id):
                run, replays = (asset_id, run_id), set()
            if any(e not in replays for e in earlier):
                replays.add(goal_id)
                found.append(goal_id)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["goal_id"])


def resolve_replays(goals: DataFrame, pairs: DataFrame) -> DataFrame:
    """goal_id, replay: is a goal a replay of an earlier goal that is none itself? pairs: goal_id, earlier_id of goals that say the same.

    Goals (asset_id, run_id, goal_id, goal_ms) without an earlier likeness are none. The rest of a run passes through a task in order of time.
    """
    chains = pairs.join(goals.select(*KEY, "goal_id", "goal_ms"), "goal_id").groupBy(*KEY, "goal_ms", "goal_id").agg(F.collect_set("earlier_id").alias("earlier"))
    chains = chains.repartition(*KEY).sortWithinPartitions(*KEY, "goal_ms", "goal_id").select(*KEY, "goal_id", "earlier")
    found = chains.mapInArrow(_fold_replays, "goal_id long").withColumn("is_replay", F.lit(True))
    return goals.join(found, "goal_id", "left").select("goal_id", F.coalesce("is_replay", F.lit(False)).alias("replay"))


#: Signals after which a goal's story can't have begun earlier.
FENCES = ("REPLAY_CONTEXT", "RETROSPECTIVE_CONTEXT", "POST_EVENT_COMMENTARY", "INJURY_CONTEXT", "RESTART_CONTEXT", "UNRELATED_ACTION_CONTEXT", "GOAL_KICK_CONTEXT")


def goal_start(goals: DataFrame, signals: DataFrame, cfg: Settings = DEFAULTS, gap_ms: int = 4000, fallback_ms: int = 30_000, padding_ms: int = 5000) -> DataFrame:
    """goal_id, start_ms, reason for goals (asset_id, run_id, goal_id, goal_ms): from the attack whose cues chain up to the goal, else rising audio, else the
    shot before it, else a fixed time; never before the last fence."""
    from touchline.operators.sequence import back_chain

    lead = min(cfg.buildup_lead_ms, cfg.search_back_ms)
    seen = signals.select(*KEY, "ts_ms", "signal_type", "confidence", "id")
    near = T.range_join(goals, seen, KEY, F.greatest(F.lit(0), F.col("goal_ms") - cfg.search_back_ms), F.col("goal_ms"), "ts_ms", 45_000)
    fence = near.where(F.col("signal_type").isin(*FENCES) & (F.col("ts_ms") < F.col("goal_ms"))).groupBy("goal_id").agg(F.max("ts_ms").alias("fence_ms"))
    after = near.join(fence, "goal_id", "left").where("fence_ms is null or ts_ms > fence_ms").where(F.col("goal_ms") - F.col("ts_ms") <= lead)
    attack = back_chain(after.where("signal_type = 'ATTACK_BUILDUP'").select("goal_id", "goal_ms", "ts_ms"), ["goal_id"], "goal_ms", "ts_ms", 2 * gap_ms).select("goal_id", F.col("earliest").alias("attack_ms"))
    loud = audio_buildup(goals, signals.where("signal_type in ('AUDIO_SPIKE', 'AUDIO_ENERGY_RISE', 'PITCH_RISE', 'VOICE_EXCITEMENT', 'ATTACK_BUILDUP')"), gap_ms, lead).select("goal_id", F.col("from_ms").alias("loud_ms"))
    shot = after.where("signal_type = 'TRANSCRIPT_SHOT' and ts_ms < goal_ms").groupBy("goal_id").agg(F.max("ts_ms").alias("action_ms"))
    rows = goals.join(fence, "goal_id", "left").join(attack, "goal_id", "left").join(loud, "goal_id", "left").join(shot, "goal_id", "left")
    open_ms = F.coalesce(F.col("fence_ms"), F.lit(0))
    loud_ms = F.when(F.col("loud_ms") > F.coalesce("fence_ms", F.lit(-1)), F.col("loud_ms"))
    reason = F.when(F.col("attack_ms").isNotNull(), "CONNECTED_ATTACK").when(loud_ms.isNotNull(), "AUDIO_BUILDUP").when(F.col("action_ms").isNotNull(), "DECISIVE_ACTION").otherwise("FALLBACK_PRE_ROLL")
    begin = F.coalesce(F.coalesce("attack_ms", loud_ms, "action_ms") - padding_ms, F.col("goal_ms") - fallback_ms)
    return rows.select("goal_id", F.greatest(open_ms, begin, F.lit(0)).alias("start_ms"), reason.alias("reason"))


def preceding_foul(events: DataFrame, fouls: DataFrame, reach_ms: int = 15_000, least: float = 0.25) -> DataFrame:
    """event_id, foul_id: the nearest foul before a penalty or card whose words overlap enough. events: asset_id, run_id, event_id, event_ms, event_words (array);
    fouls: asset_id, run_id, foul_id, foul_ms, foul_words."""
    pairs = T.range_join(events, fouls, KEY, F.greatest(F.lit(0), F.col("event_ms") - reach_ms), F.col("event_ms"), "foul_ms", 2 * reach_ms)
    common = F.size(F.array_intersect("event_words", "foul_words")) / F.greatest(F.lit(1), F.least(F.size("event_words"), F.size("foul_words")))
    return T.nearest(pairs.where(common >= least), ["event_id"], F.struct(F.col("event_ms") - F.col("foul_ms"), "foul_id"), ["foul_id"])


def final_signals(judged: DataFrame, support: DataFrame) -> DataFrame:
    """anchor_id, event_type, signal_type, confidence: what a candidate is stored with: its support, its probabilities and a row for each reason against it."""
    own = support.select("anchor_id", "event_type", "signal_type", "confidence").distinct()
    live = judged.select("anchor_id", "event_type", F.lit("LIVE_EVENT_CONTEXT").alias("signal_type"), F.col("live").alias("confidence"))
    replay = judged.where("replay_used > 0").select("anchor_id", "event_type", F.lit("EVENT_ASSOCIATION").alias("signal_type"), F.col("replay_used").alias("confidence"))
    why = judged.select("anchor_id", "event_type", F.explode("reasons").alias("reason")).select("anchor_id", "event_type", F.concat(F.lit("REJECTION_REASON:"), "reason").alias("signal_type"), F.lit(1.0).alias("confidence"))
    return own.unionByName(live).unionByName(replay).unionByName(why)


def emission_groups(signals: DataFrame, group: str) -> DataFrame:
    """Signals of a type and time that were emitted together: asset_id, run_id, event_type, ts_ms, members (ids in order), top. A keyword signal joins the typed
    signals of its own emission only."""
    typed = signals.where("event_type is not null")
    keyed = typed.groupBy(*KEY, "event_type", "ts_ms").agg(F.collect_set(group).alias("groups"), F.max("confidence").alias("top"))
    members = typed.join(keyed.select(*KEY, "event_type", "ts_ms", "groups", "top"), [*KEY, "event_type", "ts_ms"]).where(F.array_contains("groups", F.col(group)))
    return members.groupBy(*KEY, "event_type", "ts_ms").agg(F.array_join(F.sort_array(F.collect_set("id")), ",").alias("members"), F.max("top").alias("top"))


def event_start(events: DataFrame, signals: DataFrame, gap_ms: int = 8000, lead_ms: int = 45_000, padding_ms: int = 5000) -> DataFrame:
    """candidate_id, start_ms, reason of other events than goals (asset_id, run_id, candidate_id, trigger_ms): from the earliest cue of an attack that chains up
    to the trigger, else from a fixed padding before it."""
    from touchline.operators.sequence import back_chain

    cues = signals.where("signal_type = 'ATTACK_BUILDUP'").select(*KEY, "ts_ms")
    near = T.range_join(events, cues, KEY, F.greatest(F.lit(0), F.col("trigger_ms") - lead_ms), F.col("trigger_ms"), "ts_ms", 45_000)
    chain = back_chain(near.select("candidate_id", "trigger_ms", "ts_ms"), ["candidate_id"], "trigger_ms", "ts_ms", gap_ms)
    rows = events.join(chain.select("candidate_id", "earliest"), "candidate_id", "left")
    reason = F.when(F.col("earliest").isNotNull(), "CONNECTED_BUILDUP").otherwise("PADDING")
    return rows.select("candidate_id", F.greatest(F.lit(0), F.coalesce("earliest", F.col("trigger_ms") - padding_ms)).alias("start_ms"), reason.alias("reason"))


def replay_support(rejected: DataFrame, live: DataFrame, reach_ms: int = 120_000) -> DataFrame:
    """candidate_id, supports: the earlier live goal that each rejected goal with a replay cue is a replay of: the most alike, then the latest.

    rejected: asset_id, run_id, candidate_id, trigger_ms, words; live: asset_id, run_id, live_id, live_ms, live_words.
    """
    pairs = T.range_join(rejected, live, KEY, F.greatest(F.lit(0), F.col("trigger_ms") - reach_ms), F.col("trigger_ms") - 1, "live_ms", reach_ms)
    union = F.greatest(F.lit(1), F.size(F.array_union("words", "live_words")))
    alike = F.size(F.array_intersect("words", "live_words")) / union
    return T.nearest(pairs, ["candidate_id"], F.struct(-alike, -F.col("live_ms"), "live_id"), ["live_id"]).withColumnRenamed("live_id", "supports")


def confirm_replayed_goals(cues: DataFrame, attacks: DataFrame, fences: DataFrame, reach_ms: int = 120_000) -> DataFrame:
    """cue_id, attack_id: the attack that a replay with scoring words (asset_id, run_id, cue_id, cue_ms) shows: the latest before it, with no fence (asset_id, run_id, ts_ms: a
    score, an injury, another goal) between. attacks: asset_id, run_id, attack_id, attack_ms. Each attack confirms one goal, that of its first cue."""
    marks = fences.select(*KEY, F.col("ts_ms").alias("f_ms")).distinct()
    left = T.fence_counts(cues, marks, KEY, "cue_ms", "f_ms", True, "before")
    right = T.fence_counts(attacks, marks, KEY, "attack_ms", "f_ms", False, "up_to")
    pairs = T.range_join(left, right, KEY, F.greatest(F.lit(0), F.col("cue_ms") - reach_ms), F.col("cue_ms") - 1, "attack_ms", reach_ms).where(F.col("before") == F.col("up_to"))
    best = T.nearest(pairs, ["cue_id", "cue_ms"], F.struct(-F.col("attack_ms"), "attack_id"), ["attack_id"])
    return best.groupBy("attack_id").agg(F.min_by("cue_id", F.struct("cue_ms", "cue_id")).alias("cue_id"))
