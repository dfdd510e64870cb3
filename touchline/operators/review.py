"""Reviews of candidates: joins, effective values, filters, queues, counts, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
MAX_CLIP_MS = 60_000
UNREVIEWED = "UNREVIEWED"


def contains_text(term: str, *columns: str) -> Column:
    """Case-blind: is the term in the columns, joined by blanks? Nulls count as empty."""
    return F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns))).contains(term.strip().lower())


def with_review(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Candidates and what a person said of them; review_status is UNREVIEWED where nobody did."""
    return candidates.join(reviews, "candidate_id", "left").withColumn("review_status", F.coalesce("review_status", F.lit(UNREVIEWED)))


def effective_window(reviewed: DataFrame) -> DataFrame:
    """The window and type that count: a person's, else the detected ones; the trigger clamped into the window."""
    start, end = F.coalesce("manual_start_ms", "start_ms"), F.coalesce("manual_end_ms", "end_ms")
    return reviewed.withColumns({"effective_start_ms": start, "effective_end_ms": end, "effective_type": F.coalesce("event_type_override", "event_type")}).withColumn(
        "effective_trigger_ms", F.greatest("effective_start_ms", F.least("effective_end_ms", "trigger_ms"))
    )


def is_detected() -> Column:
    return ~F.col("status").isin("REJECTED", "MANUAL")


def needs_review() -> Column:
    return is_detected() & (F.col("review_status") == UNREVIEWED)


def search_assets(assets: DataFrame, term: str, status: str | None = None) -> DataFrame:
    found = assets.where(contains_text(term, "title", "original_filename", "competition", "home_team", "away_team", "source"))
    return found if status is None else found.where(F.col("status") == status)


def filter_candidates(df: DataFrame, status: str | None = None, event_type: str | None = None, text: str = "") -> DataFrame:
    """An inventory: REJECTED or all else as DETECTED; a type; a text in type, context."""
    shown = F.when(F.col("status") == "REJECTED", "REJECTED").otherwise("DETECTED")
    keep = F.lit(True)
    if status:
        keep &= shown == status
    if event_type:
        keep &= F.col("event_type") == event_type
    if text:
        keep &= contains_text(text, "event_type", "context")
    return df.where(keep)


def filter_approved(reviewed: DataFrame, event_type: str | None = None, text: str = "") -> DataFrame:
    """What a person confirmed and no rule rejected."""
    return filter_candidates(reviewed.where("status <> 'REJECTED' and review_status = 'CONFIRMED'"), None, event_type, text)


def search_all(assets: DataFrame, reviewed: DataFrame, clips: DataFrame, term: str) -> DataFrame:
    """bucket, asset_id, item_id: matches, approved, detected (not confirmed), rejected and clips that have the term."""
    match = assets.where(contains_text(term, "title", "home_team", "away_team", "competition")).select(F.lit("match").alias("bucket"), "asset_id", F.col("asset_id").alias("item_id"))
    titled = reviewed.join(assets.select("asset_id", "title"), "asset_id").where(contains_text(term, "event_type", "title", "context"))
    bucket = F.when(F.col("status") == "REJECTED", F.when(F.col("review_status") == "CONFIRMED", "approved_rejected").otherwise("rejected")).otherwise(F.when(F.col("review_status") == "CONFIRMED", "approved").otherwise("detected"))
    events = titled.select(F.when(bucket == "approved_rejected", "rejected").otherwise(bucket).alias("bucket"), "asset_id", F.col("candidate_id").alias("item_id"))
    clip = clips.join(reviewed.select("candidate_id", "event_type"), "candidate_id").join(assets.select("asset_id", "title"), "asset_id")
    clip = clip.where(contains_text(term, "event_type", "title")).select(F.lit("clip").alias("bucket"), "asset_id", F.col("candidate_id").alias("item_id"))
    return match.unionByName(events).unionByName(clip)


def clip_eligible(reviewed: DataFrame, assets: DataFrame) -> DataFrame:
    """With eligible: the asset is complete, the event detected or confirmed by a person, and no person rejected it."""
    ok = (F.col("asset_status") == "COMPLETED") & ((F.col("status") == "DETECTED") | (F.col("review_status") == "CONFIRMED")) & (F.col("review_status") != "REJECTED")
    return reviewed.join(assets.select("asset_id", F.col("status").alias("asset_status")), "asset_id", "left").withColumn("eligible", F.coalesce(ok, F.lit(False)))


def clip_category(event_type: Column) -> Column:
    return F.when(event_type == "GOAL", "goals").when(event_type.contains("CARD"), "cards").when(event_type == "SHOT", "shots").otherwise("other")


def clip_manifest(reviewed: DataFrame, assets: DataFrame, clips: DataFrame) -> DataFrame:
    """A row for each clip to cut: its window, category, length, and whether an existing file will do (no manual boundary)."""
    rows = effective_window(clip_eligible(reviewed, assets).where("eligible"))
    rows = rows.join(clips.select("candidate_id", F.lit(True).alias("has_file")), "candidate_id", "left")
    reuse = F.col("has_file").isNotNull() & F.col("manual_start_ms").isNull() & F.col("manual_end_ms").isNull()
    return rows.select("candidate_id", "asset_id", "effective_start_ms", "effective_end_ms", (F.col("effective_end_ms") - F.col("effective_start_ms")).alias("length_ms"), clip_category(F.col("effective_type")).alias("category"), reuse.alias("reuse"))


def clip_library(assets: DataFrame, reviewed: DataFrame, clips: DataFrame, search: str = "", event_type: str | None = None) -> DataFrame:
    """Events with a clip file, by title and start: what a page of the library shows."""
    rows = effective_window(reviewed.join(clips.select("candidate_id"), "candidate_id", "left_semi")).join(assets.select("asset_id", "title"), "asset_id")
    if search:
        rows = rows.where(contains_text(search, "title"))
    if event_type:
        rows = rows.where(F.col("effective_type") == event_type)
    return rows.select("title", "candidate_id", "run_id", "effective_start_ms", "effective_end_ms", "effective_type", "review_status")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of rows, with the total and the number of pages in each. size: 1 to 100. Only the page is sorted out of the rest."""
    if not 1 <= size <= 100 or number < 0:
        raise ValueError("a page has 1 to 100 rows, and pages count from 0")
    totals = df.agg(F.count(F.lit(1)).alias("total")).withColumns({"pages": F.ceil(F.col("total") / F.lit(size)), "p_key": F.lit(1)})
    return df.orderBy(*order).offset(number * size).limit(size).withColumn("p_key", F.lit(1)).join(totals, "p_key").drop("p_key")


def ready_assets(assets: DataFrame, transcripts: DataFrame, runs: DataFrame) -> DataFrame:
    """Complete assets with a complete transcript and no run under way."""
    return assets.where("status = 'COMPLETED'").join(transcripts, "asset_id", "left_semi").join(runs.where("status in ('PENDING', 'RUNNING')"), "asset_id", "left_anti")


def review_rules(reviewed: DataFrame, assets: DataFrame, max_ms: int = MAX_CLIP_MS) -> DataFrame:
    """candidate_id, rule: what is wrong with manual boundaries and decisions."""
    rows = reviewed.join(assets.select("asset_id", "duration_ms"), "asset_id", "left")
    reason = F.col("human_rejection_reason") if "human_rejection_reason" in reviewed.columns else F.lit(None)
    both = F.col("manual_start_ms").isNotNull() & F.col("manual_end_ms").isNotNull()
    rules = {
        "BOUNDARY_HALF_SET": F.col("manual_start_ms").isNull() != F.col("manual_end_ms").isNull(),
        "BOUNDARY_ORDER": both & (F.col("manual_end_ms") <= F.col("manual_start_ms")),
        "BOUNDARY_TOO_LONG": both & (F.col("manual_end_ms") - F.col("manual_start_ms") > max_ms),
        "BOUNDARY_OUTSIDE_ASSET": both & (F.col("manual_end_ms") > F.col("duration_ms")),
        "DURATION_UNKNOWN": both & F.col("duration_ms").isNull(),
        "REJECTED_TWICE_NEEDS_REASON": (F.col("status") == "REJECTED") & (F.col("review_status") == "REJECTED") & (F.trim(F.coalesce(reason, F.lit(""))) == ""),
    }
    return violations(rows, ["candidate_id"], rules)


def violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """keys and rule: a row for each rule that a row breaks."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items())))
    return df.select(*keys, F.explode(broken).alias("rule"))


def candidate_rules() -> dict[str, Column]:
    return {
        "WINDOW_ORDER": F.col("end_ms") <= F.col("start_ms"),
        "NEGATIVE_START": F.col("start_ms") < 0,
        "TRIGGER_OUTSIDE": ~F.col("trigger_ms").between(F.col("start_ms"), F.col("end_ms")),
        "SCORE_RANGE": ~F.col("score").between(0, 1),
        "CONTEXT_TOO_LONG": F.char_length("context") > 6000,
    }


def audio_rules(windows: DataFrame) -> DataFrame:
    """asset_id, ts_ms, rule of windows out of range or out of order."""
    before = F.lag("ts_ms").over(Window.partitionBy("asset_id").orderBy("ts_ms"))
    rules = {
        "NOT_INCREASING": F.col("before_ms") >= F.col("ts_ms"),
        "ABOVE_FULL_SCALE": (F.col("dbfs") > 0) | (F.col("peak_dbfs") > 0),
        "PEAK_BELOW_MEAN": F.col("peak_dbfs") < F.col("dbfs"),
        "RATIO_RANGE": ~F.col("voiced_frame_ratio").between(0, 1) | ~F.col("zero_crossing_rate").between(0, 1),
        "NEGATIVE_PITCH": (F.col("median_pitch_hz") < 0) | (F.col("pitch_variance_hz") < 0),
    }
    return violations(windows.withColumn("before_ms", before), ["asset_id", "ts_ms"], rules)


def _blank(column: str) -> Column:
    return ~F.coalesce(F.col(column), F.lit("")).rlike(r"\S")


def _not_a_share(column: str) -> Column:
    return F.isnan(column) | ~F.col(column).between(0, 1)


def segment_rules() -> dict[str, Column]:
    """For rows with seq, start_ms, end_ms, text."""
    return {
        "NEGATIVE_SEQUENCE": F.col("seq") < 0,
        "SEGMENT_WINDOW": (F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms")),
        "BLANK_TEXT": _blank("text"),
    }


def signal_rules() -> dict[str, Column]:
    """For rows with signal_type, ts_ms, confidence, evidence."""
    return {
        "TYPE_MISSING": F.col("signal_type").isNull(),
        "CONFIDENCE_RANGE": F.col("confidence").isNull() | _not_a_share("confidence"),
        "NEGATIVE_TIME": F.col("ts_ms") < 0,
        "BLANK_EVIDENCE": _blank("evidence"),
    }


def run_rules() -> dict[str, Column]:
    """For rows with status, the four counters, created_ms, started_ms, completed_ms, failure_reason, configuration_hash."""
    status, counters = F.col("status"), [F.col(f"{c}_count") for c in ("candidate", "observation", "detected", "rejected")]
    started, ended, failed = (F.col(c).isNotNull() for c in ("started_ms", "completed_ms", "failure_reason"))
    life = F.when(status == "PENDING", started | ended | failed).when(status == "RUNNING", ~started | ended | failed)
    life = life.when(status == "COMPLETED", ~started | ~ended | failed).when(status == "FAILED", ~ended | _blank("failure_reason"))
    return {
        "CONFIGURATION_BLANK": _blank("configuration_hash"),
        "COUNTERS_INVALID": (F.least(*counters) < 0) | (F.col("detected_count") + F.col("rejected_count") > F.col("candidate_count")),
        "LIFECYCLE_INVALID": life,
        "TIMES_OUT_OF_ORDER": (F.col("started_ms") < F.col("created_ms")) | (F.col("completed_ms") < F.greatest("created_ms", "started_ms")),
    }


def truth_rules() -> dict[str, Column]:
    """For rows with ts_ms, start_ms, end_ms, note, and the asset's duration_ms (null: unknown)."""
    return {
        "TIME_OUTSIDE_WINDOW": (F.col("ts_ms") < F.col("start_ms")) | (F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms")),
        "BEYOND_ASSET": F.col("end_ms") > F.col("duration_ms"),
        "NOTE_TOO_LONG": F.char_length("note") > 2000,
    }


def marker_rules() -> dict[str, Column]:
    """For rows with ts_ms and the asset's duration_ms (null: unknown)."""
    return {"TIME_OUTSIDE_ASSET": (F.col("ts_ms") < 0) | (F.col("ts_ms") > F.col("duration_ms"))}


def transition_rules() -> dict[str, Column]:
    """For rows with home, away, source, confidence (null: none), ts_ms, duration_ms."""
    return marker_rules() | {
        "NEGATIVE_SCORE": (F.col("home") < 0) | (F.col("away") < 0),
        "SOURCE_MISSING": F.col("source").isNull(),
        "CONFIDENCE_RANGE": _not_a_share("confidence"),
    }


def review_queue(reviewed: DataFrame) -> DataFrame:
    """By asset: detected events that nobody has reviewed, and rejected ones whose rejection nobody has confirmed."""
    return reviewed.groupBy("asset_id").agg(
        F.count_if(needs_review()).alias("pending"),
        F.count_if((F.col("status") == "REJECTED") & (F.col("review_status") != "REJECTED")).alias("rejected_pending"),
    )


def queue_neighbours(reviewed: DataFrame) -> DataFrame:
    """Detected events in order of their triggers: the ones before and after, the place in the queue and its length."""
    w = Window.partitionBy("asset_id").orderBy("trigger_ms", "candidate_id")
    return reviewed.where(is_detected()).select(
        "asset_id",
        "candidate_id",
        F.lag("candidate_id").over(w).alias("previous_id"),
        F.lead("candidate_id").over(w).alias("next_id"),
        F.row_number().over(w).alias("position"),
        F.count(F.lit(1)).over(Window.partitionBy("asset_id")).alias("queue_length"),
    )


def next_to_review(reviewed: DataFrame) -> DataFrame:
    """By asset the first event not reviewed, else the first one; rejected ones don't count."""
    order = F.struct((F.col("review_status") != UNREVIEWED).cast("int"), "trigger_ms", "candidate_id")
    return reviewed.where("status <> 'REJECTED'").groupBy("asset_id").agg(F.min_by("candidate_id", order).alias("candidate_id"))


def rejection_progress(reviewed: DataFrame) -> DataFrame:
    """By asset: rejected events, those still open, those a person confirmed as rejected, and the share of the latter."""
    confirmed = F.count_if(F.col("review_status") == "REJECTED")
    return reviewed.where("status = 'REJECTED'").groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("review_status") != "REJECTED").alias("pending"), confirmed.alias("confirmed"), F.round(confirmed / F.count(F.lit(1)), 6).alias("ratio")
    )


def rejected_window(df: DataFrame, span_ms: int = 30_000) -> DataFrame:
    """The window in which to look at a rejected event: its own if short enough, else one around its trigger, inside the asset."""
    start, end = F.col("effective_start_ms"), F.col("effective_end_ms")
    from_ms = F.greatest(F.lit(0), F.least(F.col("trigger_ms") - span_ms // 2, F.col("duration_ms") - span_ms))
    own = end - start <= span_ms
    return df.withColumns({"review_start_ms": F.when(own, start).otherwise(from_ms), "review_end_ms": F.when(own, F.least(end, F.col("duration_ms"))).otherwise(F.least(from_ms + span_ms, F.col("duration_ms")))})


def frame_times(df: DataFrame, frames: int = 5, spacing_ms: int = 1000) -> DataFrame:
    """candidate_id, frame, ts_ms: stills before a trigger, spaced evenly; closer where the trigger is near the start; none at 0."""
    step = F.least(F.lit(spacing_ms), F.floor(F.col("trigger_ms") / F.lit(frames)))
    rows = df.where("trigger_ms > 0").withColumns({"step_ms": step, "frame": F.explode(F.sequence(F.lit(0), F.lit(frames - 1)))})
    return rows.select("candidate_id", "frame", (F.col("trigger_ms") - (frames - F.col("frame")) * F.col("step_ms")).alias("ts_ms"))


def confirm_as_truth(reviewed: DataFrame, gt_events: DataFrame) -> DataFrame:
    """Ground truth from events that a person confirmed and no rule rejected, once each."""
    rows = effective_window(reviewed.where("status <> 'REJECTED' and review_status = 'CONFIRMED'"))
    known = gt_events.select(F.col("gt_id").alias("candidate_id"))
    return rows.join(known, "candidate_id", "left_anti").select("candidate_id", "asset_id", F.col("effective_type").alias("event_type"), F.col("effective_trigger_ms").alias("ts_ms"))


def manifest_violations(files: DataFrame, name: str, size: str, most_bytes: int, extensions: tuple[str, ...]) -> DataFrame:
    """file_id, rule: what is wrong with files to take in."""
    from touchline.functions.evidence import extension_of, safe_name

    rules = {
        "EMPTY_FILE": F.col(size) < 1,
        "TOO_LARGE": F.col(size) > most_bytes,
        "NO_NAME": safe_name(F.col(name)).isNull(),
        "UNSUPPORTED_TYPE": safe_name(F.col(name)).isNotNull() & ~F.coalesce(extension_of(F.col(name)).isin(*extensions), F.lit(False)),
    }
    return violations(files, ["file_id"], rules)


def manual_events(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """Events that a person put down: certain, of status MANUAL, inside the asset."""
    rows = requests.join(assets.select("asset_id", "duration_ms"), "asset_id").where("start_ms >= 0 and end_ms > start_ms and end_ms <= duration_ms")
    return rows.select("asset_id", "event_type", "start_ms", "end_ms", F.floor((F.col("start_ms") + F.col("end_ms")) / 2).alias("trigger_ms"), F.lit(1.0).alias("score"), F.lit("MANUAL").alias("status"))
