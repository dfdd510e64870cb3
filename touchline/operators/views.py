"""What a reviewer sees beside an event: scores, marks and other events in its window, clips of rejected ones, two runs side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators import timejoin as T
from touchline.operators.sequence import even_sample

# The family that a signal type is shown in.
FAMILIES = {
    "TRANSCRIPT": ("TRANSCRIPT_KEYWORD", "TRANSCRIPT_EMPHASIS", "TRANSCRIPT_REPETITION", "TRANSCRIPT_GOAL", "TRANSCRIPT_SHOT", "TRANSCRIPT_PENALTY", "TRANSCRIPT_CARD", "TRANSCRIPT_EVENT"),
    "ATTACK_BUILDUP": ("ATTACK_BUILDUP", "LIVE_EVENT_CONTEXT"), "SPEECH_RATE": ("SPEECH_RATE_SPIKE",), "PITCH": ("PITCH_RISE", "PITCH_VARIANCE", "VOICE_EXCITEMENT", "HIGH_EXCITEMENT"),
    "AUDIO_ENERGY": ("AUDIO_SPIKE", "AUDIO_SUSTAINED", "AUDIO_ENERGY_RISE", "WHISTLE_LIKE_AUDIO"), "CROWD_REACTION": ("CROWD_REACTION_PROXY",), "REPLAY": ("REPLAY_CONTEXT", "EVENT_ASSOCIATION"),
    "RETROSPECTIVE": ("RETROSPECTIVE_CONTEXT", "POST_EVENT_COMMENTARY", "UNRELATED_ACTION_CONTEXT"), "RESTART": ("RESTART_CONTEXT", "GOAL_KICK_CONTEXT"), "SHOT_ACTION": ("SHOT_OUTCOME_CONTEXT",),
}


def family(kind: Column) -> Column:
    out = F.lit("OTHER")
    for name, kinds in FAMILIES.items():
        out = F.when(kind.isin(*kinds), F.lit(name)).otherwise(out)
    return out


def around_events(candidates: DataFrame, transitions: DataFrame, markers: DataFrame) -> DataFrame:
    """candidate_id, kind (SCORE, MARKER, EVENT), what, at_ms: new scores, marks of the match and other candidates of the run inside each candidate's window."""
    window = candidates.select("candidate_id", "asset_id", "run_id", "start_ms", "end_ms")
    scores = transitions.select("asset_id", F.lit("SCORE").alias("kind"), F.concat(F.col("home").cast("string"), F.lit("-"), F.col("away").cast("string")).alias("what"), F.col("ts_ms").alias("at_ms"))
    marks = markers.select("asset_id", F.lit("MARKER").alias("kind"), F.col("marker_type").alias("what"), F.col("ts_ms").alias("at_ms"))
    names = ["candidate_id", "kind", "what", "at_ms"]
    inside = lambda left, right, keys: T.range_join(left, right, keys, F.col("start_ms"), F.col("end_ms"), "at_ms", 30_000)
    out = inside(window, scores.unionByName(marks), ["asset_id"]).select(*names)
    others = candidates.select("asset_id", "run_id", F.col("candidate_id").alias("other_id"), F.lit("EVENT").alias("kind"), F.concat(F.col("event_type"), F.lit(" "), F.col("candidate_id").cast("string")).alias("what"), F.col("trigger_ms").alias("at_ms"))
    return out.unionByName(inside(window, others, ["asset_id", "run_id"]).where("other_id <> candidate_id").select(*names))


def rejected_clips(reviewed: DataFrame, files: DataFrame, span_ms: int = 30_000) -> DataFrame:
    """candidate_id, from_ms, to_ms, state of rejected candidates (with review_status, manual window, trigger, duration_ms or null).

    The window is the effective one if it is short enough, inside the media; else, or if the trigger isn't in it, one around the trigger; null where
    the trigger lies outside the media. The clip is READY if its file is there, DELETED once a person rejects it (FAILED if the file is still there), else ABSENT.
    """
    rows = reviewed.where("status = 'REJECTED'").join(files.select("candidate_id", F.lit(True).alias("there")).distinct(), "candidate_id", "left")
    manual = F.col("manual_start_ms").isNotNull() & F.col("manual_end_ms").isNotNull()
    rows = rows.withColumns({"s": F.when(manual, F.col("manual_start_ms")).otherwise(F.col("start_ms")), "e": F.when(manual, F.col("manual_end_ms")).otherwise(F.col("end_ms"))})
    length, at = F.when(F.col("duration_ms") > 0, F.col("duration_ms")), F.col("trigger_ms")
    long_ = F.col("e") - F.col("s") > span_ms
    begin = F.greatest(F.lit(0), at - span_ms // 2)
    over = F.coalesce(begin + span_ms > length, F.lit(False))
    first_s = F.when(long_, F.when(over, F.greatest(F.lit(0), length - span_ms)).otherwise(begin)).otherwise(F.least("s", length))
    first_e = F.when(long_, F.least(begin + span_ms, length)).otherwise(F.least("e", length))
    rows = rows.withColumns({"a": first_s, "b": first_e})
    off = (F.col("b") <= F.col("a")) | ~at.between(F.col("a"), F.col("b"))
    late = F.coalesce(at + span_ms // 2 > length, F.lit(False))
    rows = rows.withColumns({
        "from_ms": F.when(off, F.when(late, F.greatest(F.lit(0), length - span_ms)).otherwise(begin)).otherwise(F.col("a")),
        "to_ms": F.when(off, F.least(at + span_ms // 2, length)).otherwise(F.col("b")),
    })
    out = (F.col("to_ms") <= F.col("from_ms")) | (at > F.col("to_ms"))
    there, gone = F.coalesce("there", F.lit(False)), F.coalesce(F.col("review_status") == "REJECTED", F.lit(False))
    state = F.when(gone, F.when(there, "FAILED").otherwise("DELETED")).when(there, "READY").otherwise("ABSENT")
    return rows.select("candidate_id", F.when(~out, F.col("from_ms")).alias("from_ms"), F.when(~out, F.col("to_ms")).alias("to_ms"), state.alias("state"))


def compare_observations(signals: DataFrame, media: DataFrame, left: int, right: int, center_ms: int, window_ms: int = 60_000, limit: int = 1000) -> DataFrame:
    """asset_id, side (LEFT, RIGHT), family, n, top: what two runs saw around a time, at most limit rows a run, evenly over the window."""
    sides = F.when(F.col("run_id") == left, "LEFT").when(F.col("run_id") == right, "RIGHT")
    near = signals.join(media.select("asset_id", "duration_ms"), "asset_id", "left").where(F.col("ts_ms").between(max(0, center_ms - window_ms), F.least(F.lit(center_ms + window_ms), F.col("duration_ms"))))
    near = near.withColumn("side", sides).where("side is not null")
    return even_sample(near, ["asset_id", "side"], ["ts_ms", "id"], limit).groupBy("asset_id", "side", family(F.col("signal_type")).alias("family")).agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("top"))


def match_key(assets: DataFrame) -> Column:
    """One name for the recordings of a match: competition, day (match_date), teams; else, if a team or the day is missing, the asset alone."""
    part = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    known = (part("home_team") != "") & (part("away_team") != "") & F.col("match_date").isNotNull()
    return F.when(known, F.concat(F.lit("match:"), F.concat_ws("|", *map(part, ("competition", "match_date", "home_team", "away_team"))))).otherwise(F.concat(F.lit("asset:"), F.col("asset_id").cast("string")))


# The event types there are, and what lists of recordings can be sorted by.
EVENT_TYPES = (
    "GOAL", "GOAL_DISALLOWED", "BIG_CHANCE", "SHOT", "SAVE", "PENALTY", "MISSED_PENALTY", "PENALTY_MISSED", "CORNER", "FREE_KICK", "OFFSIDE", "SUBSTITUTION", "RED_CARD", "YELLOW_CARD", "VAR", "VAR_REVIEW",
    "VAR_DECISION", "REFEREE_WHISTLE", "FOUL", "COUNTER_ATTACK", "ATTACK", "NEAR_MISS", "CELEBRATION", "CROWD_REACTION", "COMMENTATOR_REACTION", "CONTROVERSIAL_DECISION", "DRAMATIC_MOMENT", "UNKNOWN",
)
SORTS = {"createdAt": "created_at", "updatedAt": "updated_at", "title": "title", "durationMs": "duration_ms", "matchDate": "match_date"}


def event_rules(events: DataFrame, signals: DataFrame) -> DataFrame:
    """candidate_id, rule of events (sources: array of ids, merge_reason) and their signals (candidate_id, ts_ms): every rule that an event breaks, once."""
    sources, reason = F.col("sources"), F.coalesce("merge_reason", F.lit(""))
    rules = {
        "WINDOW_ORDER": (F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms")),
        "TRIGGER_OUTSIDE": ~F.col("trigger_ms").between(F.col("start_ms"), F.col("end_ms")),
        "SCORE_RANGE": F.isnan("score") | ~F.col("score").between(0, 1),
        "CONTEXT_TOO_LONG": F.char_length("context") > 6000,
        "SOURCES_NOT_UNIQUE": (F.size(F.array_distinct(sources)) < F.size(sources)) | F.exists(sources, lambda x: x.isNull()),
        "SOURCES_WITHOUT_ITSELF": ~F.coalesce(F.array_contains(sources, F.col("candidate_id")), F.lit(False)),
        "MERGED_WITHOUT_REASON": (F.size(sources) > 1) & (F.trim(reason) == ""),
        "REASON_TOO_LONG": F.char_length(reason) > 500,
    }
    own = signals.join(events.select("candidate_id", "start_ms", "end_ms"), "candidate_id")
    inside = own.groupBy("candidate_id").agg(F.bool_or(~F.col("ts_ms").between(F.col("start_ms"), F.col("end_ms"))).alias("outside"))
    rows = events.join(inside, "candidate_id", "left")
    rules |= {"NO_SIGNALS": F.col("outside").isNull(), "SIGNAL_OUTSIDE": F.col("outside")}
    broken = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items())))
    return rows.select("candidate_id", F.explode(broken).alias("rule"))


def inventory(candidates: DataFrame, signals: DataFrame, term: str = "", status: str = "", event_type: str = "", sort: str = "timestamp") -> DataFrame:
    """Candidates of a status (REJECTED, or anything else as DETECTED) and type whose type, context, evidence or reasons have the term; in order of time,
    of confidence, or of status and time."""
    said = signals.groupBy("candidate_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("ts_ms", "evidence"))), lambda x: x["evidence"])).alias("v_said"))
    rows = candidates.join(said, "candidate_id", "left")
    text = F.lower(F.concat_ws(" ", "event_type", F.coalesce("context", F.lit("")), "v_said"))
    rows = rows.where(text.contains(term.strip().lower())) if term.strip() else rows
    rows = rows.where((F.when(F.col("status") == "REJECTED", "REJECTED").otherwise("DETECTED")) == status) if status else rows
    rows = rows.where(F.col("event_type") == event_type) if event_type else rows
    order = {"timestamp": ["trigger_ms"], "confidence": [F.desc("score")], "status": ["status", "trigger_ms"]}[sort]
    return rows.drop("v_said").orderBy(*order, "candidate_id")


def clip_targets(reviewed: DataFrame, assets: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """candidate_id, start_ms, end_ms, manual of events that clips can be made of: of complete recordings, detected or confirmed by a person and not rejected by one, or
    picked by hand (selected: candidate_id)."""
    rows = reviewed.join(assets.where("status = 'COMPLETED'").select("asset_id"), "asset_id", "left_semi")
    picked = F.lit(False)
    if selected is not None:
        rows = rows.join(selected.select("candidate_id", F.lit(True).alias("v_picked")).distinct(), "candidate_id", "left")
        picked = F.coalesce("v_picked", F.lit(False))
    said = F.coalesce("review_status", F.lit("UNREVIEWED"))
    manual = F.col("manual_start_ms").isNotNull() & F.col("manual_end_ms").isNotNull()
    good = ((F.col("status") == "DETECTED") | (said == "CONFIRMED")) & (said != "REJECTED")
    at = lambda c: F.when(manual, F.col(f"manual_{c}")).otherwise(F.col(c)).alias(c)
    return rows.where(picked | good).select("candidate_id", at("start_ms"), at("end_ms"), manual.alias("manual"))


def asset_page(assets: DataFrame, sort: str, descending: bool, number: int, size: int) -> DataFrame:
    """A page of recordings by one of SORTS (another one is an error), ties by id, with the total and the number of pages in each row."""
    from touchline.operators.review import page

    if sort not in SORTS:
        raise ValueError(f"recordings can be sorted by {', '.join(SORTS)}")
    column = F.col(SORTS[sort])
    return page(assets, [column.desc() if descending else column.asc(), F.col("asset_id")], number, size)


def taxonomy(candidates: DataFrame) -> DataFrame:
    """event_type, label, n: every type there is, how it reads, and how many candidates have it."""
    kinds = candidates.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, EVENT_TYPES))).alias("event_type"))
    counts = candidates.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(counts, "event_type", "left").select("event_type", F.replace("event_type", F.lit("_"), F.lit(" ")).alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def timeline(assets: DataFrame, reviewed: DataFrame, markers: DataFrame, observations: DataFrame, scores: DataFrame, truths: DataFrame, readings: DataFrame) -> DataFrame:
    """asset_id, layer, item, at_ms, percent: the ten layers of a recording's timeline, and where an item stands along it.

    An event is in several layers: by its status, and by what a person said of it. The timeline is as long as the recording, else as the last
    thing known of it, and at least 1 ms.
    """
    events = reviewed.withColumn("layers", F.array_compact(F.array(
        F.when(F.col("status") == "REJECTED", "rejected").when(F.col("status") == "MANUAL", "manual").otherwise("detected"),
        F.when(~F.col("status").isin("REJECTED", "MANUAL") & (F.col("review_status") == "CONFIRMED"), "confirmed"),
        F.when(F.col("review_status") == "REJECTED", "human_rejected"),
    )))
    name = lambda df, layer, item, at="ts_ms": df.select("asset_id", F.lit(layer).alias("layer"), F.col(item).cast("string").alias("item"), F.col(at).alias("at_ms"))
    rows = events.select("asset_id", F.explode("layers").alias("layer"), F.col("candidate_id").cast("string").alias("item"), F.col("trigger_ms").alias("at_ms"))
    for part in (name(markers, "structure", "marker_type"), name(observations, "observations", "id"), name(scores, "score", "transition_id"), name(truths, "ground_truth", "gt_id"), name(readings, "ocr", "kind")):
        rows = rows.unionByName(part)
    known = rows.where("layer in ('structure', 'score', 'observations', 'ocr')").select("asset_id", "at_ms").unionByName(reviewed.select("asset_id", F.col("end_ms").alias("at_ms")))
    latest = known.groupBy("asset_id").agg(F.max("at_ms").alias("latest_ms"))
    length = assets.select("asset_id", "duration_ms").join(latest, "asset_id", "left")
    length = length.select("asset_id", F.coalesce(F.when(F.col("duration_ms") > 0, F.col("duration_ms")), F.greatest(F.lit(1), "latest_ms"), F.lit(1)).alias("length_ms"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("at_ms") * 100.0 / F.col("length_ms")))
    # one number a recording is looked up: a hash join leaves the items, which are far more, unsorted
    return rows.join(length.hint("shuffle_hash"), "asset_id").select("asset_id", "layer", "item", "at_ms", share.alias("percent"))


def reading_rules(observations: DataFrame) -> DataFrame:
    """asset_id, ts_ms, rule of stored scoreboard readings (kind, confidence, home, away, previous_home, previous_away, details as JSON text)."""
    from touchline.operators.review import violations

    known = ("OCR_OBSERVATION", "SCORE_STATE", "SCORE_TRANSITION", "SCORE_REVERSAL")
    out = lambda c: ~F.col(c).between(0, 15)
    rules = {
        "NEGATIVE_TIME": F.col("ts_ms") < 0,
        "UNKNOWN_KIND": F.col("kind").isNull() | ~F.col("kind").isin(*known),
        "CONFIDENCE_RANGE": F.isnan("confidence") | ~F.col("confidence").between(0, 1),
        "SCORE_RANGE": F.greatest(*(F.coalesce(out(c), F.lit(False)) for c in ("home", "away", "previous_home", "previous_away"))),
        "DETAILS_NO_OBJECT": ~F.coalesce(F.trim("details").rlike(r"(?s)^\{.*\}$") & F.try_parse_json("details").isNotNull(), F.lit(False)),
    }
    return violations(observations, ["asset_id", "ts_ms"], rules)


def component_rules(components: DataFrame) -> DataFrame:
    """candidate_id, component, rule of parts of a score (evidence_confidence, weight, contribution, explanation)."""
    from touchline.operators.review import violations

    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rules = {
        "UNKNOWN_COMPONENT": F.col("component").isNull(),
        "CONFIDENCE_RANGE": ~finite("evidence_confidence") | ~F.col("evidence_confidence").between(0, 1),
        "NOT_FINITE": ~finite("weight") | ~finite("contribution"),
        "NO_EXPLANATION": F.trim(F.coalesce("explanation", F.lit(""))) == "",
    }
    return violations(components, ["candidate_id", "component"], rules)


def goal_manifest(goals: DataFrame, cues: DataFrame, frames: int = 5, spacing_ms: int = 1000) -> DataFrame:
    """goal_id, kind (FRAME, REPLAY), number (from 1), from_ms, to_ms (null for frames) of goals (goal_id, goal_ms) and their replay cues (goal_id, cue_ms, from_ms, to_ms).

    Frames lie at equal steps before the goal; where it is too near the start for that, they divide the time there is. A goal at 0 has none.
    """
    from pyspark.sql import Window

    oldest = F.greatest(F.lit(0), F.col("goal_ms") - frames * spacing_ms)
    whole = F.col("goal_ms") - oldest >= frames * spacing_ms
    k = F.col("number") - 1
    at = F.when(whole, oldest + k * spacing_ms).otherwise(oldest + F.floor((F.col("goal_ms") - oldest) * (k + 1) / F.lit(frames + 1)))
    shots = goals.where("goal_ms > 0").withColumn("number", F.explode(F.sequence(F.lit(1), F.lit(frames))))
    shots = shots.select("goal_id", F.lit("FRAME").alias("kind"), "number", at.cast("long").alias("from_ms"), F.lit(None).cast("long").alias("to_ms"))
    order = Window.partitionBy("goal_id").orderBy("cue_ms")
    return shots.unionByName(cues.select("goal_id", F.lit("REPLAY").alias("kind"), F.row_number().over(order).alias("number"), "from_ms", "to_ms"))
