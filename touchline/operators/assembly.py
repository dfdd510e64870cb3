"""Candidates from signals, transcript and media lengths, as one plan: pool, anchors, replay-confirmed goals, support, judgement, windows, stored signals.

signals: asset_id, run_id, id, obs_id (what was emitted together), ts_ms, signal_type, event_type, confidence, evidence. segments: asset_id, seq, start_ms,
end_ms, text. media: asset_id, duration_ms. Everything is keyed by recording and run; what a candidate needs of the signals around it are sums,
maxima and flags over a range join. Only the question which goal is a replay of another one depends on earlier answers; it is a fold over
the goals that are alike (operators.similarity).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import text as X
from touchline.operators import boundaries as B
from touchline.operators import similarity as L
from touchline.operators import timejoin as T
from touchline.operators.lineage import settled
from touchline.settings import DEFAULTS, EVENT_CONFIDENCE, Settings

KEY = ["asset_id", "run_id"]
VALUE = ["ts_ms", "signal_type", "event_type", "confidence", "evidence"]
#: Event types that no candidate is made of.
NO_EVENTS = ("UNKNOWN", "COMMENTATOR_REACTION", "CROWD_REACTION", "CELEBRATION", "DRAMATIC_MOMENT")
PAST = ("REPLAY_CONTEXT", "RETROSPECTIVE_CONTEXT")
NEGATIVE = ("NEGATION_CONTEXT", "CORRECTION_CONTEXT", "HISTORICAL_REFERENCE")
VOICE = ("HIGH_EXCITEMENT", "VOICE_EXCITEMENT", "PITCH_RISE", "PITCH_VARIANCE")
LOUD = ("AUDIO_SPIKE", "AUDIO_SUSTAINED", "CROWD_REACTION_PROXY")
SAID = ("TRANSCRIPT_EMPHASIS", "TRANSCRIPT_REPETITION")
SPOKEN = ("TRANSCRIPT_KEYWORD", "TRANSCRIPT_GOAL", "TRANSCRIPT_SHOT", "TRANSCRIPT_PENALTY", "TRANSCRIPT_CARD", "TRANSCRIPT_EVENT")
# How evidence texts begin that rules ask for, and words that rules look for in the transcript.
SCORING_PHRASE = "Football phrase match: "
CUE_PHRASE = "Context phrase or structure match:"
CONFIRMED = "RETROSPECTIVE_GOAL_CONFIRMATION:"
INFERRED = "Inferred goal hypothesis from a shot"
PENALTIES = ("penalty", "penalti", "penalte", "penalty kick", "tir au but", "penalty spot", "punto de penalti")
MISSED = ("penalty miss", "missed the penalty", "rate le penalty", "gardien arrete le penalty")
CORNERS = ("corner", "corners", "coup de corner", "corner kick", "saque de esquina", "tiro de esquina", "corner flag")


@dataclass(frozen=True)
class Reach:
    score_ms: int = 30_000  # a new score after a goal
    action_ms: int = 20_000  # an action around a goal
    shot_ms: int = 10_000
    play_on_ms: int = 15_000
    injury_ms: int = 90_000
    foul_ms: int = 2500  # of a foul's and a card's words
    rate: float = 0.58  # of speech around an attack that a replay confirms


def specific(kind: Column, event: Column) -> Column:
    """Is a signal of this type evidence of that event itself?"""
    own = (
        F.when(event == "GOAL", kind.isin("TRANSCRIPT_GOAL", "AUDIO_GOAL_HYPOTHESIS", "OWN_GOAL"))
        .when(event.isin("SHOT", "NEAR_MISS"), kind == "TRANSCRIPT_SHOT")
        .when(event.isin("PENALTY", "MISSED_PENALTY", "PENALTY_MISSED"), kind == "TRANSCRIPT_PENALTY")
        .when(event.isin("YELLOW_CARD", "RED_CARD"), kind == "TRANSCRIPT_CARD")
        .otherwise(kind == "TRANSCRIPT_EVENT")
    )
    return event.isNotNull() & ~event.isin(*NO_EVENTS) & own


def pool(signals: DataFrame, media: DataFrame) -> DataFrame:
    """Signals up to the end of their recording, with duration_ms."""
    return signals.join(media.select("asset_id", "duration_ms"), "asset_id").where("ts_ms <= duration_ms")


def distinct_signals(rows: DataFrame) -> DataFrame:
    """Of equal signals the one with the smallest id."""
    return rows.groupBy(*KEY, *VALUE).agg(F.min("id").alias("id"))


def anchors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(anchors, members) of the pool. An anchor is an event type and a time with evidence of the event itself: KEY, anchor_id (its smallest signal), event_type,
    trigger_ms. Its members are that evidence and keywords of the same event and time that were emitted together with some of it: anchor_id and VALUE."""
    own = rows.where(specific(F.col("signal_type"), F.col("event_type")))
    at = [*KEY, "event_type", "ts_ms"]
    found = own.groupBy(*at).agg(F.min("id").alias("anchor_id"))
    words = rows.where("signal_type = 'TRANSCRIPT_KEYWORD'").join(own.select(*at, "obs_id").distinct(), [*at, "obs_id"], "left_semi")
    members = own.unionByName(words).join(found, at).select("anchor_id", *KEY, *VALUE).distinct()
    return found.withColumnRenamed("ts_ms", "trigger_ms"), members


#: Types of signals that support an anchor or are its action; others only if they are a celebration.
ASKED = (*PAST, *NEGATIVE, *VOICE, *LOUD, *SAID, "INJURY_CONTEXT", "RESTART_CONTEXT", "ATTACK_BUILDUP", "SCORE_STATE_TRANSITION", "TRANSCRIPT_SHOT", "EVENT_RECONSTRUCTION", "TRANSCRIPT_EVENT", "SHOT_OUTCOME_CONTEXT", "AUDIO_ENERGY_RISE", "SPEECH_RATE_SPIKE")


def spans(cfg: Settings, reach: Reach, goal: bool) -> Column:
    """How long before (from, negative) and after (to) the trigger of a goal, or of another event, a signal (signal_type, s_event) supports it; null if it never does. The first
    rule that its type falls under decides. It depends on the signal alone, so it is looked up once a signal and not once a pair."""
    kind, event, lead = F.col("signal_type"), F.col("s_event"), min(cfg.buildup_lead_ms, cfg.search_back_ms)
    span = lambda lo, hi: F.struct(F.lit(lo).alias("from"), F.lit(hi).alias("to"))
    action = (kind == "TRANSCRIPT_SHOT") | ((kind == "EVENT_RECONSTRUCTION") & (event == "GOAL")) | ((kind == "TRANSCRIPT_EVENT") & event.isin("ATTACK", "COUNTER_ATTACK", "BIG_CHANCE", "SHOT", "PENALTY"))
    reaction = kind.isin(*SAID, "SPEECH_RATE_SPIKE", *VOICE, *LOUD) | ((event == "CELEBRATION") & kind.isin(*SPOKEN))
    rule = F.when(kind.isin(*PAST, "INJURY_CONTEXT"), span(-cfg.replay_window_ms, 0)).when(kind.isin(*NEGATIVE), span(-max(cfg.attach_ms, 3000), 0))
    rule = rule.when(kind == "RESTART_CONTEXT", span(-cfg.replay_window_ms, 30_000)).when(kind == "ATTACK_BUILDUP", span(-lead, 0))
    if goal:
        rule = rule.when(kind == "SCORE_STATE_TRANSITION", span(0, reach.score_ms)).when(F.coalesce(action, F.lit(False)), span(-reach.action_ms, reach.action_ms))
        rule = rule.when(kind == "SHOT_OUTCOME_CONTEXT", span(-cfg.attach_ms, cfg.attach_ms))
    return rule.when(kind == "AUDIO_ENERGY_RISE", span(-lead, 0)).when(F.coalesce(reaction, F.lit(False)), span(-cfg.attach_ms, cfg.attach_ms))


def around(anchor: DataFrame, signals: DataFrame, cfg: Settings, reach: Reach) -> DataFrame:
    """Anchors (a_event) with each signal (s_event, roles) that supports them (backs) or may be the shot that made the goal, and the latest anchor and goal before the trigger.

    Those two come of the anchors alone; pairs of an anchor and a signal that no rule asks for are dropped where they arise, before any shuffle.
    """
    # rows of one time are a frame's peers, so the anchor itself and others of its time are outside
    w = Window.partitionBy(*KEY).orderBy("trigger_ms").rangeBetween(-cfg.replay_window_ms, -1)
    left = anchor.withColumnRenamed("event_type", "a_event").withColumns({"anchor_ms": F.max("trigger_ms").over(w), "goal_ms": F.max(F.when(F.col("a_event") == "GOAL", F.col("trigger_ms"))).over(w)})
    rows = signals.select(*KEY, "id", *VALUE).withColumnRenamed("event_type", "s_event").where(F.col("signal_type").isin(*ASKED) | (F.coalesce(F.col("s_event") == "CELEBRATION", F.lit(False)) & F.col("signal_type").isin(*SPOKEN)))
    rows = rows.withColumns({
        "of_goal": spans(cfg, reach, True), "of_other": spans(cfg, reach, False), "fenced": F.col("signal_type").isin("ATTACK_BUILDUP", "AUDIO_ENERGY_RISE"),
        "is_shot": F.coalesce((F.col("signal_type") == "TRANSCRIPT_SHOT") & (F.col("s_event") == "SHOT"), F.lit(False)), "roles": roles(),
    })
    near = T.range_join(left, rows, KEY, F.col("trigger_ms") - cfg.replay_window_ms, F.col("trigger_ms") + max(reach.score_ms, reach.action_ms), "ts_ms", 60_000)
    goal, gap = F.col("a_event") == "GOAL", F.col("ts_ms") - F.col("trigger_ms")
    inside = F.when(goal, gap.between(F.col("of_goal.from"), F.col("of_goal.to"))).otherwise(gap.between(F.col("of_other.from"), F.col("of_other.to")))
    backs = F.coalesce(inside, F.lit(False)) & (~F.col("fenced") | F.col("anchor_ms").isNull() | (F.col("ts_ms") >= F.col("anchor_ms")))
    shot = goal & F.col("is_shot") & gap.between(-min(cfg.buildup_lead_ms, cfg.search_back_ms), -1)
    return near.where(backs | shot).withColumn("backs", backs).drop("of_goal", "of_other", "fenced", "is_shot")


def goal_actions(near: DataFrame, cfg: Settings = DEFAULTS, reach: Reach = Reach()) -> DataFrame:
    """anchor_id, action_ms, action_sure of goals: the last shot before with no other goal between, else the nearest action that a goal was anchored to."""
    kind, goal, gap = F.col("signal_type"), F.col("a_event") == "GOAL", F.col("trigger_ms") - F.col("ts_ms")
    shot = goal & (kind == "TRANSCRIPT_SHOT") & (F.col("s_event") == "SHOT") & gap.between(1, min(cfg.buildup_lead_ms, cfg.search_back_ms)) & (F.col("goal_ms").isNull() | (F.col("ts_ms") >= F.col("goal_ms")))
    anchored = F.col("evidence").startswith("Event action is anchored") | F.col("evidence").startswith("Goal action is anchored")
    built = goal & (kind == "EVENT_RECONSTRUCTION") & (F.col("s_event") == "GOAL") & anchored & (F.abs(gap) <= reach.action_ms)
    found = near.groupBy("anchor_id").agg(
        F.max(F.when(shot, F.struct(F.col("ts_ms").alias("at"), F.col("confidence").alias("sure")))).alias("shot"),
        F.min(F.when(built, F.struct(F.abs(gap).alias("far"), "id", F.col("ts_ms").alias("at"), F.col("confidence").alias("sure")))).alias("built"),
    )
    found = found.select("anchor_id", F.coalesce("shot.at", "built.at").alias("action_ms"), F.coalesce("shot.sure", "built.sure").alias("action_sure"))
    return found.where("action_ms is not null")


def fouls_before(anchor: DataFrame, signals: DataFrame, segments: DataFrame, cfg: Settings = DEFAULTS, reach: Reach = Reach()) -> DataFrame:
    """anchor_id, foul_ms, foul_sure of penalties and cards: the nearest foul before whose words overlap with theirs by a quarter of the shorter text."""
    hit = anchor.where("event_type in ('PENALTY', 'YELLOW_CARD', 'RED_CARD')").select(*KEY, "anchor_id", "trigger_ms")
    fouls = signals.where("signal_type = 'TRANSCRIPT_EVENT' and event_type = 'FOUL'").select(*KEY, F.col("id").alias("foul_id"), F.col("ts_ms").alias("foul_ms"))
    pairs = T.range_join(hit, fouls, KEY, F.greatest(F.lit(0), F.col("trigger_ms") - min(2 * cfg.attach_ms, 15_000)), F.col("trigger_ms"), "foul_ms", 15_000)
    side = lambda name, at: pairs.select("asset_id", F.struct("anchor_id", "foul_id", F.lit(name).alias("side")).alias("pair"), F.greatest(F.lit(0), F.col(at) - reach.foul_ms).alias("from_ms"), (F.col(at) + reach.foul_ms).alias("to_ms"))
    said = B.contexts(side("foul", "foul_ms").unionByName(side("event", "trigger_ms")), segments, ["pair"])
    words = X.tokens(X.normalize_text(F.col("context")))
    said = said.select("pair.*", words.alias("words")).groupBy("anchor_id", "foul_id").agg(F.first(F.when(F.col("side") == "foul", F.col("words")), True).alias("a"), F.first(F.when(F.col("side") == "event", F.col("words")), True).alias("b"))
    share = F.size(F.array_intersect("a", "b")) / F.least(F.size("a"), F.size("b"))
    said = said.where((F.size("a") > 0) & (F.size("b") > 0)).select("anchor_id", "foul_id", share.alias("foul_sure")).where("foul_sure >= 0.25")
    return T.nearest(pairs.join(said, ["anchor_id", "foul_id"]), ["anchor_id"], F.struct(F.col("trigger_ms") - F.col("foul_ms"), "foul_id"), ["foul_ms", "foul_sure"])


def heard(segments: DataFrame, anchor: DataFrame) -> DataFrame:
    """Segments of recordings that have an anchor, settled: all that is asked of the transcript is asked around anchors, several times."""
    return settled(segments.select("asset_id", "seq", "start_ms", "end_ms", "text").join(anchor.select("asset_id").distinct(), "asset_id", "left_semi"))


def review_contexts(anchor: DataFrame, segments: DataFrame, cfg: Settings) -> DataFrame:
    """anchor_id, context: what is said in half the longest event around each anchor."""
    half = cfg.maximum_event_ms // 2
    windows = anchor.select("asset_id", "anchor_id", F.greatest(F.lit(0), F.col("trigger_ms") - half).alias("from_ms"), (F.col("trigger_ms") + half).alias("to_ms"))
    return B.contexts(windows, segments, ["anchor_id"])


def confirmed_goals(anchor: DataFrame, members: DataFrame, signals: DataFrame, segments: DataFrame, cfg: Settings = DEFAULTS, reach: Reach = Reach()) -> DataFrame:
    """goal_id, attack_id, phrase_sure, cue_ms, cue_sure: goals that are told in a replay, and the attack before that they show.

    A goal with a strong scoring phrase and a replay cue shortly before, of which no earlier goal tells the same, shows the latest attack before it that had
    speech speeding up, if no score, injury or other goal lies between and their words have something in common. As no goal lies between, an attack
    is shown by the first goal after it alone, so nothing is used twice.
    """
    goals = anchor.where("event_type = 'GOAL'").select(*KEY, F.col("anchor_id").alias("goal_id"), F.col("trigger_ms").alias("goal_ms"))
    strong = members.where((F.col("signal_type") == "TRANSCRIPT_KEYWORD") & (F.col("event_type") == "GOAL") & (F.col("confidence") >= cfg.single_signal) & F.col("evidence").startswith(SCORING_PHRASE))
    told = goals.join(strong.groupBy(F.col("anchor_id").alias("goal_id")).agg(F.max("confidence").alias("phrase_sure")), "goal_id")
    cues = signals.where(F.col("signal_type").isin(*PAST) & (F.col("confidence") >= cfg.replay_probability) & F.col("evidence").startswith(CUE_PHRASE)).select(*KEY, F.col("ts_ms").alias("cue_ms"), F.col("confidence").alias("cue_sure"))
    told = T.range_join(told, cues, KEY, F.col("goal_ms") - cfg.attach_ms, F.col("goal_ms"), "cue_ms", 60_000)
    told = settled(T.nearest(told, [*KEY, "goal_id", "goal_ms", "phrase_sure"], F.struct(-F.col("cue_sure"), F.col("cue_ms")), ["cue_ms", "cue_sure"]))

    sure = members.where((F.col("signal_type") == "TRANSCRIPT_EVENT") & (F.col("event_type") == "ATTACK") & (F.col("confidence") >= EVENT_CONFIDENCE["ATTACK"])).select("anchor_id").distinct()
    attacks = anchor.where("event_type = 'ATTACK'").join(sure, "anchor_id").select(*KEY, F.col("anchor_id").alias("attack_id"), F.col("trigger_ms").alias("attack_ms"))
    fast = signals.where((F.col("signal_type") == "SPEECH_RATE_SPIKE") & (F.col("confidence") >= reach.rate)).select(*KEY, F.col("ts_ms").alias("fast_ms"))
    attacks = settled(T.range_join(attacks, fast, KEY, F.col("attack_ms") - cfg.attach_ms, F.col("attack_ms") + cfg.attach_ms, "fast_ms", 60_000, "left_semi"))

    # nothing between: running counts of goals (strictly between) and of scores and injuries (ends count)
    stops = signals.where("signal_type in ('SCORE_STATE_TRANSITION', 'INJURY_CONTEXT')").select(*KEY, F.col("ts_ms").alias("stop_ms"))
    marks = goals.select(*KEY, F.col("goal_ms").alias("mark_ms"))
    counted = lambda rows, at, strict, stop: T.fence_counts(T.fence_counts(rows, marks, KEY, at, "mark_ms", strict, f"goals_{at}"), stops, KEY, at, "stop_ms", stop, f"stops_{at}")
    pairs = T.range_join(counted(told, "goal_ms", True, False), counted(attacks, "attack_ms", False, True), KEY, F.col("goal_ms") - cfg.replay_window_ms, F.col("goal_ms") - 1, "attack_ms", 60_000)
    pairs = settled(pairs.where("goals_goal_ms = goals_attack_ms and stops_goal_ms = stops_attack_ms"))

    # words are looked at of goals and attacks in such pairs alone
    def told_by(ids: DataFrame) -> DataFrame:
        said = review_contexts(anchor.join(ids.distinct(), "anchor_id", "left_semi"), segments, cfg)
        return settled(L.classes(said.join(anchor.select(*KEY, "anchor_id", "trigger_ms"), "anchor_id"), "context").drop("context"))

    words = told_by(pairs.select(F.col("goal_id").alias("anchor_id")).unionByName(pairs.select(F.col("attack_id").alias("anchor_id"))))
    of = lambda prefix: words.select(F.col("anchor_id").alias(f"{prefix}_id"), F.col("words").alias(f"{prefix}_words"), L.identity(F.col("words")).alias(f"{prefix}_names"))
    pairs = pairs.join(of("goal"), "goal_id").join(of("attack"), "attack_id")
    common = (X.jaccard(F.col("goal_words"), F.col("attack_words")) >= 0.10) | (F.size(F.array_intersect("goal_names", "attack_names")) >= 2)
    best = settled(T.nearest(pairs.where(common), [*KEY, "goal_id", "phrase_sure", "cue_ms", "cue_sure"], F.struct(-F.col("attack_ms"), "attack_id"), ["attack_id"]))

    # goals of which an earlier one of their recording's run tells the same: the class has one before
    all_goals = told_by(goals.join(best.select(*KEY).distinct(), KEY, "left_semi").select(F.col("goal_id").alias("anchor_id")))
    alike = L.similar_classes(all_goals.join(best.select(F.col("goal_id").alias("anchor_id")), "anchor_id"), all_goals, KEY)
    first = all_goals.groupBy(*KEY, F.col("l_class").alias("r_class")).agg(F.min("trigger_ms").alias("first_ms"))
    first = alike.join(first, [*KEY, "r_class"]).groupBy(*KEY, "l_class").agg(F.min("first_ms").alias("first_ms"))
    known = all_goals.join(first, [*KEY, "l_class"]).where("first_ms < trigger_ms").select(F.col("anchor_id").alias("goal_id"))
    return settled(best.drop(*KEY).join(known, "goal_id", "left_anti"))


def with_confirmed(anchor: DataFrame, members: DataFrame, confirmed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(anchors, members) in which goals told in a replay and the attacks they show are one goal, at the attack."""
    used = confirmed.select(F.col("goal_id").alias("anchor_id")).unionByName(confirmed.select(F.col("attack_id").alias("anchor_id")))
    made = anchor.join(confirmed.select(F.col("attack_id").alias("anchor_id")), "anchor_id").withColumn("event_type", F.lit("GOAL"))
    shown = confirmed.join(anchor.select(F.col("anchor_id").alias("attack_id"), *KEY, F.col("trigger_ms").alias("ts_ms")), "attack_id")
    row = lambda kind, sure, evidence: shown.select(F.col("attack_id").alias("anchor_id"), *KEY, "ts_ms", F.lit(kind).alias("signal_type"), F.lit("GOAL").alias("event_type"), F.col(sure).alias("confidence"), evidence.alias("evidence"))
    extra = row("EVENT_RECONSTRUCTION", "phrase_sure", F.lit(CONFIRMED)).unionByName(row("EVENT_ASSOCIATION", "cue_sure", F.concat(F.lit("REPLAY_EVIDENCE_FOR_LIVE_EVENT; cue at "), F.col("cue_ms").cast("string"), F.lit(" ms"))))
    kept = members.join(confirmed.select(F.col("goal_id").alias("anchor_id")), "anchor_id", "left_anti")
    return anchor.join(used, "anchor_id", "left_anti").unionByName(made), kept.unionByName(extra)


def listed(near: DataFrame, members: DataFrame, anchor: DataFrame) -> DataFrame:
    """anchor_id, a_event, trigger_ms, VALUE (s_event) and roles: what speaks for or against each anchor, each signal once.

    Signals around an anchor come once each, and members lie at its trigger: so only there one can be met twice.
    """
    columns = ["anchor_id", "a_event", "trigger_ms", *(c if c != "event_type" else "s_event" for c in VALUE)]
    own = members.withColumnRenamed("event_type", "s_event").join(anchor.select("anchor_id", F.col("event_type").alias("a_event"), "trigger_ms"), "anchor_id")
    met, at = near.where("backs").select(*columns, "roles"), F.col("ts_ms") == F.col("trigger_ms")
    return met.where(~at).unionByName(met.where(at).select(*columns).unionByName(own.select(*columns)).distinct().withColumn("roles", roles()))


#: What a signal can be to an event, by its type, the event it names and its evidence: a bit each, found once a signal, so that a pair of signal and event tests numbers.
ROLES = {
    "goal": lambda kind, event, told: kind.isin("TRANSCRIPT_GOAL", "AUDIO_GOAL_HYPOTHESIS", "OWN_GOAL"),
    "shot": lambda kind, event, told: kind == "TRANSCRIPT_SHOT",
    "penalty": lambda kind, event, told: kind == "TRANSCRIPT_PENALTY",
    "card": lambda kind, event, told: kind == "TRANSCRIPT_CARD",
    "event": lambda kind, event, told: kind == "TRANSCRIPT_EVENT",
    "voice": lambda kind, event, told: kind.isin(*VOICE),
    "loud": lambda kind, event, told: kind.isin(*LOUD),
    "said": lambda kind, event, told: kind.isin(*SAID),
    "rate": lambda kind, event, told: kind == "SPEECH_RATE_SPIKE",
    "celebration": lambda kind, event, told: (event == "CELEBRATION") & kind.isin(*SPOKEN),
    "buildup": lambda kind, event, told: kind == "ATTACK_BUILDUP",
    "attack": lambda kind, event, told: (kind == "TRANSCRIPT_EVENT") & event.isin("ATTACK", "COUNTER_ATTACK"),
    "attacks": lambda kind, event, told: (kind == "TRANSCRIPT_EVENT") & (event == "ATTACK"),
    "rise": lambda kind, event, told: kind == "AUDIO_ENERGY_RISE",
    "replay": lambda kind, event, told: kind == "REPLAY_CONTEXT",
    "past": lambda kind, event, told: kind == "RETROSPECTIVE_CONTEXT",
    "negation": lambda kind, event, told: kind == "NEGATION_CONTEXT",
    "correction": lambda kind, event, told: kind == "CORRECTION_CONTEXT",
    "history": lambda kind, event, told: kind == "HISTORICAL_REFERENCE",
    "confirmed": lambda kind, event, told: (kind == "EVENT_RECONSTRUCTION") & (event == "GOAL") & told.startswith(CONFIRMED),
    "phrase": lambda kind, event, told: (kind == "TRANSCRIPT_KEYWORD") & (event == "GOAL") & told.startswith(SCORING_PHRASE),
    "inferred": lambda kind, event, told: (event == "GOAL") & ((kind == "AUDIO_GOAL_HYPOTHESIS") | ((kind == "TRANSCRIPT_GOAL") & told.startswith(INFERRED))),
    "injury": lambda kind, event, told: kind == "INJURY_CONTEXT",
    "restart": lambda kind, event, told: kind == "RESTART_CONTEXT",
    "score": lambda kind, event, told: kind == "SCORE_STATE_TRANSITION",
    "saved": lambda kind, event, told: event.isin("SAVE", "MISSED_PENALTY"),
}


def roles() -> Column:
    """The bits of ROLES that hold for a signal (signal_type, s_event, evidence)."""
    return bits([test(F.col("signal_type"), F.col("s_event"), F.col("evidence")) for test in ROLES.values()])


def bits(tests: list[Column]) -> Column:
    """A number whose bit k says whether test k holds; there are at most 31."""
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(test, F.lit(1 << k)).otherwise(F.lit(0)) for k, test in enumerate(tests)))


def is_a(*names: str) -> Column:
    """Has a signal (roles) one of these roles?"""
    return F.col("roles").bitwiseAND(F.lit(sum(1 << list(ROLES).index(n) for n in names))) != 0


def evidence(rows: DataFrame, cfg: Settings = DEFAULTS, reach: Reach = Reach()) -> DataFrame:
    """A row for each anchor: what its listed signals amount to."""
    event, gap = F.col("a_event"), F.col("ts_ms") - F.col("trigger_ms")
    goal, sure = event == "GOAL", F.col("confidence")
    top = lambda test, share=1.0: F.coalesce(F.max(F.when(test, sure)), F.lit(0.0)) * share
    own = F.when(goal, is_a("goal", "confirmed")).when(event.isin("SHOT", "NEAR_MISS"), is_a("shot")).when(event.isin("PENALTY", "MISSED_PENALTY", "PENALTY_MISSED"), is_a("penalty"))
    own = own.when(event.isin("YELLOW_CARD", "RED_CARD"), is_a("card")).otherwise(is_a("event")) & ~event.isin(*NO_EVENTS)
    certain = sure >= cfg.replay_probability
    against = goal & certain & gap.between(-max(cfg.attach_ms, 3000), 0)
    shot = lambda far: is_a("shot") & (F.abs(gap) <= far)
    flags = {
        "confirmed": is_a("confirmed"),
        "phrase": is_a("phrase") & (sure >= cfg.single_signal),
        "inferred": is_a("inferred"),
        "negated": against & is_a("negation"),
        "corrected": against & is_a("correction"),
        "historical": against & is_a("history"),
        "replay_told": against & is_a("replay"),
        "past_told": against & is_a("past"),
        "replayed": is_a("replay", "past") & (gap <= 0) & certain,
        "injured": is_a("injury") & gap.between(-reach.injury_ms, 0),
        "restarted": goal & is_a("restart") & gap.between(-30_000, -1),
        "score_moved": is_a("score"),
        "shot_near": shot(reach.shot_ms),
        "shot_around": shot(reach.action_ms),
        "saved": is_a("saved") & (F.abs(gap) <= reach.action_ms),
        "led": is_a("buildup") & gap.between(-min(cfg.buildup_lead_ms, cfg.search_back_ms), -1),
        "play_on": is_a("attacks") & gap.between(1, reach.play_on_ms),
    }
    one = rows.groupBy("anchor_id", "a_event", "trigger_ms").agg(
        top(own).alias("direct"),
        F.greatest(top(is_a("voice")), top(is_a("loud"), 0.60)).alias("audio"),
        top(is_a("said")).alias("textual"),
        top(is_a("rate")).alias("rate"),
        top(is_a("celebration")).alias("celebration"),
        F.greatest(top(is_a("buildup", "attack")), top(is_a("rise"), 0.25)).alias("buildup"),
        top(is_a("replay", "past")).alias("replay"),
        top(against & is_a("replay", "past", "negation", "correction", "history")).alias("negative"),
        top(is_a("past") & (F.abs(gap) <= cfg.maximum_event_ms // 2) & certain).alias("looking_back"),
        F.bit_or(bits(list(flags.values()))).alias("flags"),
    )
    return one.select(*(c for c in one.columns if c != "flags"), *((F.col("flags").bitwiseAND(F.lit(1 << k)) != 0).alias(name) for k, name in enumerate(flags)))


def spoken_flags(goals: DataFrame, segments: DataFrame, cfg: Settings, reach: Reach) -> DataFrame:
    """anchor_id, penalty (one is spoken of, and not as missed), corner, local (what is said right around the trigger), for goals (asset_id, anchor_id, trigger_ms, duration_ms)."""
    spans = {"penalty": reach.action_ms, "corner": cfg.maximum_event_ms // 2, "local": cfg.attach_ms}
    window = F.inline(F.array(*(F.struct(F.lit(n).alias("which"), F.greatest(F.lit(0), F.col("trigger_ms") - s).alias("from_ms"), (F.col("trigger_ms") + s).alias("to_ms")) for n, s in spans.items())))
    windows = goals.select("asset_id", "anchor_id", "duration_ms", window)
    windows = windows.withColumn("to_ms", F.when(F.col("which") == "local", F.least("to_ms", "duration_ms")).otherwise(F.col("to_ms")))
    is_ = lambda name: F.col("which") == name
    penalty = X.says(F.col("context"), lambda norm: X.contains_any(norm, PENALTIES) & ~X.contains_any(norm, MISSED))
    said = B.contexts(windows, segments, ["anchor_id", "which"])
    said = said.withColumn("said", F.when(is_("penalty"), penalty).when(is_("corner"), X.says_any(F.col("context"), CORNERS)))
    return said.groupBy("anchor_id").agg(
        F.coalesce(F.bool_or(is_("penalty") & F.col("said")), F.lit(False)).alias("penalty"),
        F.coalesce(F.bool_or(is_("corner") & F.col("said")), F.lit(False)).alias("corner"),
        F.max(F.when(is_("local"), F.col("context"))).alias("local"),
    )


def weigh(rows: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """With reaction and what speaks for a goal."""
    rows = rows.withColumn("reaction", F.greatest("audio", "textual", F.col("rate") * 0.25, F.col("celebration") * 0.75))
    goal, moved = F.col("a_event") == "GOAL", F.col("reaction") >= cfg.minimum_reaction
    rows = rows.withColumns({
        "explicit": goal & (F.col("negative") == 0) & (F.col("phrase") | F.col("confirmed")),
        "retold": goal & (F.col("past_told") | F.col("historical") | (F.col("looking_back") > 0)),
        "penalty_scored": goal & F.coalesce("penalty", F.lit(False)) & F.col("shot_near") & moved & ~F.col("saved"),
        "in_order": goal & moved & (F.col("textual") >= 0.68) & F.col("led") & F.col("shot_around"),
        "set_piece": goal & F.coalesce("corner", F.lit(False)) & F.col("shot_around"),
        "told_again": goal & (F.col("replay") >= cfg.replay_probability),
    })
    hypothesis = goal & F.col("inferred") & ~F.col("explicit") & ~F.col("score_moved") & ~F.col("confirmed") & ~F.col("penalty_scored") & ~F.col("in_order")
    return rows.withColumn("hypothesis", hypothesis)


def judge(rows: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """With live (probability), score, reasons and status. is_replay says whether a goal is a replay of an earlier one; the rest comes from weigh()."""
    goal, again = F.col("a_event") == "GOAL", F.col("is_replay")
    weight = F.when(again, F.col("replay")).otherwise(F.lit(0.0))
    clamp = lambda x, most=1.0: F.greatest(F.lit(0.0), F.least(F.lit(most), x))
    live = 0.20 + 0.45 * F.col("direct") + 0.25 * F.col("audio") + 0.08 * F.col("textual") + 0.07 * F.col("buildup") - cfg.replay_penalty * weight - cfg.negative_penalty * F.col("negative")
    score = (F.col("direct") * cfg.transcript_weight + F.col("audio") * cfg.audio_weight) / (cfg.transcript_weight + cfg.audio_weight)
    score = score + F.when((F.col("direct") > 0) & (F.col("audio") > 0), cfg.agreement_bonus * 0.25).otherwise(0.0) + 0.05 * F.col("buildup") - 0.5 * cfg.replay_penalty * weight - cfg.negative_penalty * F.col("negative")
    rows = rows.withColumns({"live": F.round(clamp(live), 9), "score": F.round(clamp(score, 0.98), 9)})
    late = F.col("restarted") & ~F.col("score_moved") & again
    open_goal = goal & ~F.col("explicit") & ~F.col("score_moved")
    needed = F.when(F.col("a_event") == "ATTACK", EVENT_CONFIDENCE["ATTACK"]).otherwise(cfg.single_signal)
    tests = {
        "REPLAY_OF_EXISTING_GOAL": again,
        "REPLAY_COMMENTARY_REFERENCE": F.col("replay_told"),
        "NEGATED_GOAL_REFERENCE": F.col("negated"),
        "CORRECTED_GOAL_REFERENCE": F.col("corrected"),
        "HISTORICAL_GOAL_REFERENCE": F.col("historical"),
        "INJURY_THEN_REPLAY": again & F.col("replayed") & F.col("injured"),
        "POST_RESTART": late,
        "NO_NEW_SCORE_TRANSITION": late,
        "RETROSPECTIVE_GOAL_REFERENCE": open_goal & F.col("retold"),
        "GOAL_HYPOTHESIS_UNCONFIRMED": F.col("hypothesis"),
        "SET_PIECE_SHOT_WITHOUT_SCORING_CONFIRMATION": F.col("hypothesis") & F.col("set_piece"),
        "NON_SCORING_SHOT_CONTINUED_PLAY": open_goal & ~F.col("penalty_scored") & F.col("shot_near") & F.col("play_on"),
        "INSUFFICIENT_EVENT_SPECIFIC_EVIDENCE": F.col("direct") < needed,
        "GOAL_WITHOUT_REACTION_CORROBORATION": goal & (F.round("reaction", 9) < cfg.minimum_reaction) & ~F.col("explicit"),
        "ATTACK_WITHOUT_LOCAL_BUILDUP_AND_REACTION": (F.col("a_event") == "ATTACK") & ((F.col("buildup") < 0.70) | (F.round("audio", 9) < 0.55)),
        "LOW_LIVE_EVENT_PROBABILITY": F.col("live") < cfg.minimum_live,
        "LOW_CANDIDATE_SCORE": F.col("score") < cfg.minimum_score,
    }
    reasons = F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())))
    return rows.withColumn("reasons", reasons).withColumn("status", F.when(F.size("reasons") == 0, "DETECTED").otherwise("REJECTED"))


@dataclass
class Assembled:
    """candidates: KEY, anchor_id, a_event, trigger_ms, action_ms, foul_ms, live, score, reasons, status, start_ms, end_ms, start_reason, end_reason and what was
    weighed, before any limit. listed: the signals of each. confirmed: goals told in a replay, with the attack they show. contexts: anchor_id, context of those in whose
    window something is said; a table of its own, since texts are far longer than all else and few ask for them (None if nobody does)."""

    candidates: DataFrame
    listed: DataFrame
    confirmed: DataFrame
    contexts: DataFrame | None = None


def assemble(signals: DataFrame, segments: DataFrame, media: DataFrame, cfg: Settings = DEFAULTS, reach: Reach = Reach(), limits: B.Limits = B.Limits(), told: bool = True) -> Assembled:
    """told: are contexts of candidates wanted? If not, only goals are given theirs, since replays are found by them."""
    rows = settled(pool(signals, media))
    known = settled(distinct_signals(rows))
    anchor, members = map(settled, anchors(rows))
    segments = heard(segments, anchor)
    confirmed = confirmed_goals(anchor, members, known, segments, cfg, reach)
    anchor, members = map(settled, with_confirmed(anchor, members, confirmed))
    near = settled(around(anchor, known, cfg, reach))
    support = listed(near, members, anchor)
    weighed = evidence(support, cfg, reach)
    base = anchor.select(*KEY, "anchor_id").join(weighed, "anchor_id").join(media.select("asset_id", "duration_ms"), "asset_id")
    goals = anchor.where("event_type = 'GOAL'").join(media.select("asset_id", "duration_ms"), "asset_id")
    base = base.join(spoken_flags(goals.select("asset_id", "anchor_id", "trigger_ms", "duration_ms"), segments, cfg, reach), "anchor_id", "left")
    base = base.join(goal_actions(near, cfg, reach), "anchor_id", "left").join(fouls_before(anchor, known, segments, cfg, reach), "anchor_id", "left")
    # a goal that a replay confirmed is its own action
    own = F.when(F.col("confirmed"), F.col("trigger_ms"))
    base = settled(weigh(base.withColumn("action_ms", F.coalesce(own, "action_ms")), cfg))

    at = F.coalesce("action_ms", "foul_ms")
    events = base.select(*KEY, "anchor_id", "a_event", "trigger_ms", F.coalesce(at, "trigger_ms").alias("ref_ms"), at.isNotNull().alias("rebuilt"), "duration_ms")
    windows = settled(B.event_windows(events, known, anchor, segments, cfg, limits))
    spans_ = base.select("asset_id", "anchor_id", "a_event").join(windows.select("anchor_id", F.col("start_ms").alias("from_ms"), F.col("end_ms").alias("to_ms")), "anchor_id")
    said = settled(B.contexts(spans_ if told else spans_.where("a_event = 'GOAL'"), segments, ["anchor_id"]))
    base = settled(base.join(windows, "anchor_id"))
    found = settled(judge(base.join(replays(base, said, cfg), "anchor_id"), cfg).drop("local"))
    return Assembled(found, support, confirmed, said if told else None)


def replays(base: DataFrame, said: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """anchor_id, is_replay of weighed candidates, with what is said in their windows (anchor_id, context): a goal with a replay cue and no new score, whose words are those of an earlier goal that stands."""
    free = judge(base.withColumn("is_replay", F.lit(False)), cfg).where("a_event = 'GOAL'").join(said, "anchor_id", "left").select(*KEY, "anchor_id", "trigger_ms", "local", "context", (F.col("status") == "DETECTED").alias("stands"), (F.col("told_again") & ~F.col("score_moved")).alias("asks"))
    free = settled(free)
    one = L.classes(free.where("asks and local is not null"), "local")
    two = L.classes(free.where("stands and context is not null"), "context")
    pairs = L.similar_classes(one, two, KEY)
    rows = free.select(*KEY, F.col("trigger_ms").alias("ms"), F.col("anchor_id").alias("id"), "stands")
    rows = rows.join(one.select(F.col("anchor_id").alias("id"), "l_class"), "id", "left").join(two.select(F.col("anchor_id").alias("id"), F.col("l_class").alias("r_class")), "id", "left")
    again = L.follow_ups(rows, pairs, KEY).select(F.col("id").alias("anchor_id"), F.lit(True).alias("is_replay"))
    return base.select("anchor_id").join(again, "anchor_id", "left").select("anchor_id", F.coalesce("is_replay", F.lit(False)).alias("is_replay"))


def ranked(candidates: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """At most cfg.maximum_candidates of a recording's run: detected ones first, then by score, start and event type."""
    order = Window.partitionBy(*KEY).orderBy((F.col("status") != "DETECTED").cast("int"), F.desc("score"), "start_ms", "a_event", "anchor_id")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.maximum_candidates)


def stored_signals(made: Assembled) -> DataFrame:
    """anchor_id, signal_type, event_type, confidence, ts_ms, evidence: what each candidate is stored with: its signals inside the window, then what was concluded."""
    c = made.candidates
    sure = lambda column: column.cast("double").alias("confidence")
    own = made.listed.join(c.select("anchor_id", "start_ms", "end_ms"), "anchor_id").where("ts_ms between start_ms and end_ms")
    own = own.select("anchor_id", "signal_type", F.col("s_event").alias("event_type"), "confidence", "ts_ms", "evidence")

    def row(test, kind, confidence, at, text):
        return F.when(test, F.struct(F.lit(kind).alias("signal_type"), F.col("a_event").alias("event_type"), sure(confidence), at.cast("long").alias("ts_ms"), text.alias("evidence")))

    t, lit, col = F.col("trigger_ms"), F.lit, F.col
    again, late = col("is_replay"), col("is_replay") & col("restarted") & ~col("score_moved")
    retold = col("retold") & ~col("explicit") & ~col("score_moved")
    inside = lambda at: at.between(col("start_ms"), col("end_ms"))
    parts = [
        row(~col("confirmed") & col("action_ms").isNotNull() & inside(col("action_ms")), "EVENT_RECONSTRUCTION", col("action_sure"), col("action_ms"), lit("Goal action reconstructed")),
        row(col("foul_ms").isNotNull() & inside(col("foul_ms")), "EVENT_RECONSTRUCTION", col("foul_sure"), col("foul_ms"), lit("Sequence anchored to the preceding foul")),
        row(lit(True), "LIVE_EVENT_CONTEXT", col("live"), t, F.when(col("negative") > 0, "CLASSIFICATION=SUPPRESSED_GOAL").otherwise("CLASSIFICATION=LIVE_EVENT")),
        row(col("told_again"), "REPLAY_CONTEXT", col("replay"), t, F.when(again, "CLASSIFICATION=REPLAY_OF_EXISTING_GOAL").otherwise("REPLAY/RETROSPECTIVE_CONTEXT")),
        row(late, "POST_EVENT_COMMENTARY", col("replay"), t, lit("CLASSIFICATION=POST_EVENT_COMMENTARY")),
        row(late, "UNRELATED_ACTION_CONTEXT", col("replay"), t, lit("POST_RESTART_NO_NEW_SCORE_TRANSITION")),
        row(again & col("replayed") & col("injured"), "INJURY_CONTEXT", lit(0.90), t, lit("INJURY_THEN_REPLAY")),
        row(col("penalty_scored"), "EVENT_ASSOCIATION", lit(0.82), t, lit("PENALTY_ATTEMPT_WITH_INDEPENDENT_REACTION")),
        row(col("hypothesis") & col("set_piece"), "UNRELATED_ACTION_CONTEXT", lit(0.82), t, lit("SET_PIECE_SHOT_WITHOUT_SCORING_CONFIRMATION")),
        row(retold, "RETROSPECTIVE_CONTEXT", col("looking_back"), t, lit("RETROSPECTIVE_GOAL_REFERENCE")),
        row(lit(True), "EVENT_BOUNDARY", col("start_sure"), col("start_ms"), col("start_reason")),
        row(lit(True), "EVENT_AFTERGLOW", col("end_sure"), col("end_ms"), col("end_reason")),
        row(col("foul_ms").isNotNull(), "EVENT_ASSOCIATION", col("foul_sure"), t, lit("Associated with the preceding foul")),
    ]
    why = F.transform("reasons", lambda x: F.struct(lit("REJECTION_REASON").alias("signal_type"), col("a_event").alias("event_type"), sure(F.greatest(lit(0.5), 1 - col("live"))), t.cast("long").alias("ts_ms"), x.alias("evidence")))
    # all that was concluded in one pass over the candidates
    return own.unionByName(c.select("anchor_id", F.inline(F.concat(F.array_compact(F.array(*parts)), why))))
