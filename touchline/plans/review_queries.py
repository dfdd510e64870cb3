"""Queries of reviews, analytics and sources, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import analytics as A
from touchline.operators import review as R
from touchline.operators import sequence as S
from touchline.operators import timejoin as T
from touchline.plans.registry import Tables, query
from touchline.sources import tables as IO

RV = """, rv as (select c.*, coalesce(r.review_status, 'UNREVIEWED') as review_status, r.manual_start_ms, r.manual_end_ms, r.event_type_override
  from candidates c left join reviews r using (candidate_id)),
ew as (select *, coalesce(manual_start_ms, start_ms) as effective_start_ms, coalesce(manual_end_ms, end_ms) as effective_end_ms,
  coalesce(event_type_override, event_type) as effective_type from rv)
"""
BOTH = ("candidates", "reviews")


def reviewed(t: Tables):
    return R.with_review(t("candidates"), t("reviews"))


@query("w1_even_sample", needs=("signals",), sql="""
select asset_id, run_id, id, ts_ms, signal_type from (select *, row_number() over (partition by asset_id, run_id order by ts_ms, id) - 1 as rn,
  count(*) over (partition by asset_id, run_id) as n from signals where ts_ms between 100000 and 600000)
where rn = 0 or (rn * 10) // n <> ((rn - 1) * 10) // n""")  # fmt: skip
def w1(t: Tables):
    inside = t("signals").where(F.col("ts_ms").between(100_000, 600_000))
    return S.even_sample(inside, ["asset_id", "run_id"], ["ts_ms", "id"], 10).select("asset_id", "run_id", "id", "ts_ms", "signal_type")


@query("s1_candidates_of_run", needs=("candidates",), sql="select candidate_id, score from candidates join (select asset_id, max(run_id) as run_id from candidates group by asset_id) using (asset_id, run_id)")
def s1(t: Tables):
    latest = t("candidates").groupBy("asset_id").agg(F.max("run_id").alias("run_id"))
    return t("candidates").join(latest, ["asset_id", "run_id"], "left_semi").select("candidate_id", "score")


@query("s3_upsert_reviews", needs=BOTH, sql=""", base as (select candidate_id, review_status, candidate_id as created_at, candidate_id as updated_at from reviews),
changes as (select candidate_id, 'CONFIRMED' as review_status, candidate_id + 500 as created_at, candidate_id + 500 as updated_at from candidates where candidate_id % 5 = 0),
every as (select * from base union all select * from changes)
select candidate_id, review_status, created_at, updated_at from (select candidate_id, review_status, updated_at, min(created_at) over (partition by candidate_id) as created_at,
  row_number() over (partition by candidate_id order by updated_at desc) as rn from every) where rn = 1""")  # fmt: skip
def s3(t: Tables):
    at = lambda plus: [(F.col("candidate_id") + plus).alias(c) for c in ("created_at", "updated_at")]
    base = t("reviews").select("candidate_id", "review_status", *at(0))
    changes = t("candidates").where("candidate_id % 5 = 0").select("candidate_id", F.lit("CONFIRMED").alias("review_status"), *at(500))
    return IO.upsert(base, changes, ["candidate_id"], "updated_at", "created_at")


@query("s4_delete_reviews", needs=BOTH, sql="select candidate_id, review_status from reviews r where not exists (select 1 from candidates c where c.candidate_id = r.candidate_id and c.status = 'REJECTED')")
def s4(t: Tables):
    return IO.delete_keys(t("reviews").select("candidate_id", "review_status"), t("candidates").where("status = 'REJECTED'"), ["candidate_id"])


@query("s5_ingest_segments", needs=("segments",), sql="""
, raw as (select asset_id, case when seq % 11 = 0 then '  ' else text end as text, start_ms / 1000e0 + seq % 7 / 1000e0 as start_s,
    case when seq % 13 = 0 then start_ms / 1000e0 else end_ms / 1000e0 end as end_s from segments),
ms as (select asset_id, trim(text) as text, round_even(start_s * 1000, 0)::bigint as start_ms,
    greatest(round_even(start_s * 1000, 0)::bigint + 1, round_even(end_s * 1000, 0)::bigint) as end_ms from raw where trim(text) <> '')
select *, row_number() over (partition by asset_id order by start_ms, end_ms, text) - 1 as sequence from ms""")  # fmt: skip
def s5(t: Tables):
    raw = t("segments").selectExpr("asset_id", "if(seq % 11 = 0, '  ', text) as text", "start_ms / 1000e0 + seq % 7 / 1000e0 as start_s", "if(seq % 13 = 0, start_ms / 1000e0, end_ms / 1000e0) as end_s")
    return IO.ingest_segments(raw)


@query("s6_signals_as_json", needs=("signals",), sql="""
select asset_id, run_id, '[' || string_agg('{"id":' || id || ',"signal_type":"' || signal_type || '"}', ',' order by id) || ']' as signals
from signals group by asset_id, run_id""")  # fmt: skip
def s6(t: Tables):
    nested = t("signals").groupBy("asset_id", "run_id").agg(F.sort_array(F.collect_list(F.struct("id", "signal_type"))).alias("signals"))
    return IO.to_json_columns(nested)


@query("s7_config_stamp", needs=("runs",), sql="""select detection_run_id, sha256('{"baseline_ms":30000,"maximum":100,"version":"v1"}') as configuration_hash from runs""")
def s7(t: Tables):
    return t("runs").select("detection_run_id", IO.config_hash({"version": "v1", "maximum": 100, "baseline_ms": 30000}).alias("configuration_hash"))


@query("f1_time_range", needs=("signals", "assets"), sql="select s.id from signals s join assets a using (asset_id) where ts_ms between 60000 and 120000 and duration_ms >= 120000")
def f1(t: Tables):
    known = t("assets").where("duration_ms >= 120000").select("asset_id")
    return t("signals").where(F.col("ts_ms").between(60_000, 120_000)).join(known, "asset_id").select("id")


@query("f2_search_assets", needs=("assets",), sql="""
select asset_id from assets where status = 'COMPLETED' and contains(lower(concat_ws(' ', coalesce(title, ''), coalesce(original_filename, ''), coalesce(competition, ''), coalesce(home_team, ''), coalesce(away_team, ''), coalesce(source, ''))), 'home 3')""")
def f2(t: Tables):
    return R.search_assets(t("assets"), "Home 3", "COMPLETED").select("asset_id")


@query("f3_filter_candidates", needs=("candidates",), sql="select candidate_id, trigger_ms, score from candidates where status <> 'REJECTED' and event_type = 'GOAL' and contains(lower(event_type || ' ' || coalesce(context, '')), '\"k\": 4')")
def f3(t: Tables):
    return R.filter_candidates(t("candidates"), "DETECTED", "GOAL", '"k": 4').select("candidate_id", "trigger_ms", "score")


@query("f4_search_all", needs=("assets", "candidates", "reviews", "clips"), sql=RV + """
, ev as (select rv.*, title from rv join assets using (asset_id)),
hit as (select * from ev where contains(lower(concat_ws(' ', event_type, title, coalesce(context, ''))), '07'))
select 'match' as bucket, asset_id, asset_id as item_id from assets where contains(lower(concat_ws(' ', title, coalesce(home_team, ''), coalesce(away_team, ''), competition)), '07')
union all select case when status = 'REJECTED' then 'rejected' when review_status = 'CONFIRMED' then 'approved' else 'detected' end, asset_id, candidate_id from hit
union all select 'clip', c.asset_id, c.candidate_id from clips c join ev using (candidate_id) where contains(lower(concat_ws(' ', ev.event_type, ev.title)), '07')""")  # fmt: skip
def f4(t: Tables):
    return R.search_all(t("assets"), reviewed(t), t("clips"), "07")


LIBRARY = """, lib as (select a.title, e.candidate_id, e.run_id, effective_start_ms, effective_end_ms, effective_type, review_status from ew e join assets a using (asset_id)
  where e.candidate_id in (select candidate_id from clips) and contains(lower(title), '1') and effective_type = 'GOAL')
"""


@query("j9_clip_library", needs=("assets", "candidates", "reviews", "clips"), sql=RV + LIBRARY + "select * from lib")
def j9(t: Tables):
    return R.clip_library(t("assets"), reviewed(t), t("clips"), "1", "GOAL")


@query("k4_page_of_library", needs=("assets", "candidates", "reviews", "clips"), sql=RV + LIBRARY + """
select *, (select count(*) from lib) as total, (select ceil(count(*) / 20.0)::bigint from lib) as pages from lib order by title, effective_start_ms, candidate_id limit 20 offset 20""")  # fmt: skip
def k4(t: Tables):
    lib = R.clip_library(t("assets"), reviewed(t), t("clips"), "1", "GOAL")
    return R.page(lib, [F.col("title"), F.col("effective_start_ms"), F.col("candidate_id")], 1, 20)


@query("f8_candidate_violations", needs=("candidates",), sql=""", c as (select candidate_id, start_ms, case when candidate_id % 9 = 0 then start_ms - 1 else end_ms end as end_ms, trigger_ms,
  case when candidate_id % 17 = 0 then score + 1 else score end as score from candidates)
select candidate_id, 'WINDOW_ORDER' as rule from c where end_ms <= start_ms union all select candidate_id, 'NEGATIVE_START' from c where start_ms < 0
union all select candidate_id, 'TRIGGER_OUTSIDE' from c where not trigger_ms between start_ms and end_ms union all select candidate_id, 'SCORE_RANGE' from c where not score between 0 and 1""")  # fmt: skip
def f8(t: Tables):
    bad = t("candidates").withColumns({"end_ms": F.expr("if(candidate_id % 9 = 0, start_ms - 1, end_ms)"), "score": F.expr("if(candidate_id % 17 = 0, score + 1, score)")})
    return R.violations(bad, ["candidate_id"], R.candidate_rules())


@query("f9_audio_violations", needs=("audio_windows",), sql="""
, w as (select *, lag(ts_ms) over (partition by asset_id order by ts_ms) as b from audio_windows)
select asset_id, ts_ms, 'NOT_INCREASING' as rule from w where b >= ts_ms union all select asset_id, ts_ms, 'ABOVE_FULL_SCALE' from w where dbfs > 0 or peak_dbfs > 0
union all select asset_id, ts_ms, 'PEAK_BELOW_MEAN' from w where peak_dbfs < dbfs
union all select asset_id, ts_ms, 'RATIO_RANGE' from w where not voiced_frame_ratio * 1.5e0 between 0 and 1 or not zero_crossing_rate between 0 and 1
union all select asset_id, ts_ms, 'NEGATIVE_PITCH' from w where median_pitch_hz < 0 or pitch_variance_hz < 0""")  # fmt: skip
def f9(t: Tables):
    return R.audio_rules(t("audio_windows").withColumn("voiced_frame_ratio", F.col("voiced_frame_ratio") * 1.5))


# Rows with faults put in, by expressions that both engines read.
BAD_SEGMENTS = ("asset_id", "seq - 1 as seq", "start_ms", "case when seq % 11 = 3 then start_ms else end_ms end as end_ms", "case when seq % 7 = 2 then ' ' else text end as text")


@query("f9_segment_violations", needs=("segments",), sql=f", b as (select {', '.join(BAD_SEGMENTS)} from segments)" + r"""
select asset_id, seq, 'NEGATIVE_SEQUENCE' as rule from b where seq < 0
union all select asset_id, seq, 'SEGMENT_WINDOW' from b where start_ms < 0 or end_ms <= start_ms
union all select asset_id, seq, 'BLANK_TEXT' from b where text is null or not regexp_matches(text, '\S')""")  # fmt: skip
def f9_segments(t: Tables):
    return R.violations(t("segments").selectExpr(*BAD_SEGMENTS), ["asset_id", "seq"], R.segment_rules())


BAD_SIGNALS = (
    "id", "ts_ms - 500000 as ts_ms", "case when id % 19 > 0 then signal_type end as signal_type",
    "case when id % 23 > 0 then confidence * 1.5e0 end as confidence", "case id % 9 when 0 then null when 1 then '  ' else evidence end as evidence",
)


@query("f9_signal_violations", needs=("signals",), sql=f", b as (select {', '.join(BAD_SIGNALS)} from signals)" + r"""
select id, 'TYPE_MISSING' as rule from b where signal_type is null
union all select id, 'CONFIDENCE_RANGE' from b where confidence is null or confidence < 0 or confidence > 1
union all select id, 'NEGATIVE_TIME' from b where ts_ms < 0
union all select id, 'BLANK_EVIDENCE' from b where evidence is null or not regexp_matches(evidence, '\S')""")  # fmt: skip
def f9_signals(t: Tables):
    return R.violations(t("signals").selectExpr(*BAD_SIGNALS), ["id"], R.signal_rules())


BAD_RUNS = (
    "detection_run_id as id", "case when detection_run_id % 7 = 0 then 'PENDING' else status end as status", "observations - 3 as observation_count",
    "observations % 7 as candidate_count", "observations % 3 as detected_count", "observations % 5 as rejected_count", "1000 as created_ms",
    "case when detection_run_id % 6 > 0 then 950 + detection_run_id % 300 end as started_ms",
    "case when status <> 'RUNNING' or detection_run_id % 9 = 0 then 1050 + detection_run_id % 170 end as completed_ms",
    "case when status = 'FAILED' and detection_run_id % 4 <> 1 then 'disk' when detection_run_id % 8 = 0 then ' ' end as failure_reason",
    "case when detection_run_id % 13 = 3 then '' else 'abc' end as configuration_hash",
)


@query("f9_run_violations", needs=("runs",), sql=f", b as (select {', '.join(BAD_RUNS)} from runs)" + r"""
select id, 'CONFIGURATION_BLANK' as rule from b where trim(configuration_hash) = ''
union all select id, 'COUNTERS_INVALID' from b
  where candidate_count < 0 or observation_count < 0 or detected_count < 0 or rejected_count < 0 or detected_count + rejected_count > candidate_count
union all select id, 'LIFECYCLE_INVALID' from b where
  (status = 'PENDING' and (started_ms is not null or completed_ms is not null or failure_reason is not null))
  or (status = 'RUNNING' and (started_ms is null or completed_ms is not null or failure_reason is not null))
  or (status = 'COMPLETED' and (started_ms is null or completed_ms is null or failure_reason is not null))
  or (status = 'FAILED' and (completed_ms is null or failure_reason is null or trim(failure_reason) = ''))
union all select id, 'TIMES_OUT_OF_ORDER' from b where started_ms < created_ms or completed_ms < created_ms or completed_ms < started_ms""")  # fmt: skip
def f9_runs(t: Tables):
    return R.violations(t("runs").selectExpr(*BAD_RUNS), ["id"], R.run_rules())


BAD_TRUTHS = (
    "gt_id", "ts_ms", "case when gt_id % 17 = 0 then ts_ms + 1 else ts_ms - 5000 end as start_ms", "case when gt_id % 3 = 0 then ts_ms + 90000 else ts_ms + 8000 end as end_ms",
    "case when gt_id % 4 = 0 then repeat('ab', cast(1000 + gt_id % 3 as int)) end as note", "duration_ms",
)


@query("f9_truth_violations", needs=("gt_events", "assets"), sql=f", b as (select {', '.join(BAD_TRUTHS)} from gt_events left join assets using (asset_id))" + """
select gt_id, 'TIME_OUTSIDE_WINDOW' as rule from b where ts_ms < start_ms or start_ms < 0 or end_ms <= start_ms
union all select gt_id, 'BEYOND_ASSET' from b where end_ms > duration_ms
union all select gt_id, 'NOTE_TOO_LONG' from b where length(note) > 2000""")  # fmt: skip
def f9_truths(t: Tables):
    rows = t("gt_events").join(t("assets").select("asset_id", "duration_ms"), "asset_id", "left").selectExpr(*BAD_TRUTHS)
    return R.violations(rows, ["gt_id"], R.truth_rules())


BAD_SCORES = (
    "transition_id as id", "case when transition_id % 5 = 0 then ts_ms + 60001 else ts_ms end as ts_ms", "home - transition_id % 2 as home", "away",
    "case when transition_id % 6 > 0 then 'OCR' end as source", "case when transition_id % 4 > 0 then transition_id % 4 / 2e0 end as confidence", "duration_ms",
)


@query("f9_transition_violations", needs=("score_transitions", "assets"), sql=f", b as (select {', '.join(BAD_SCORES)} from score_transitions left join assets using (asset_id))" + """
select id, 'TIME_OUTSIDE_ASSET' as rule from b where ts_ms < 0 or ts_ms > duration_ms
union all select id, 'NEGATIVE_SCORE' from b where home < 0 or away < 0
union all select id, 'SOURCE_MISSING' from b where source is null
union all select id, 'CONFIDENCE_RANGE' from b where confidence < 0 or confidence > 1""")  # fmt: skip
def f9_transitions(t: Tables):
    rows = t("score_transitions").join(t("assets").select("asset_id", "duration_ms"), "asset_id", "left").selectExpr(*BAD_SCORES)
    return R.violations(rows, ["id"], R.transition_rules())


BAD_MARKERS = ("asset_id", "marker_type", "ts_ms * 11 {DIV} 10 - 20000 as ts_ms", "duration_ms")


@query("f9_marker_violations", needs=("markers", "assets"), sql=f", b as (select {', '.join(BAD_MARKERS).replace('{DIV}', '//')} from markers left join assets using (asset_id))" + """
select asset_id, marker_type, 'TIME_OUTSIDE_ASSET' as rule from b where ts_ms < 0 or ts_ms > duration_ms""")  # fmt: skip
def f9_markers(t: Tables):
    rows = t("markers").join(t("assets").select("asset_id", "duration_ms"), "asset_id", "left")
    return R.violations(rows.selectExpr(*(x.replace("{DIV}", "div") for x in BAD_MARKERS)), ["asset_id", "marker_type"], R.marker_rules())


@query("f10_review_violations", needs=("assets", *BOTH), sql=RV + """, r as (select rv.*, duration_ms from rv left join assets using (asset_id)), m as (select * from r where manual_start_ms is not null and manual_end_ms is not null)
select candidate_id, 'BOUNDARY_HALF_SET' as rule from r where (manual_start_ms is null) <> (manual_end_ms is null)
union all select candidate_id, 'BOUNDARY_ORDER' from m where manual_end_ms <= manual_start_ms union all select candidate_id, 'BOUNDARY_TOO_LONG' from m where manual_end_ms - manual_start_ms > 60000
union all select candidate_id, 'BOUNDARY_OUTSIDE_ASSET' from m where manual_end_ms > duration_ms union all select candidate_id, 'DURATION_UNKNOWN' from m where duration_ms is null
union all select candidate_id, 'REJECTED_TWICE_NEEDS_REASON' from r where status = 'REJECTED' and review_status = 'REJECTED' and candidate_id % 5 <> 1""")  # fmt: skip
def f10(t: Tables):
    why = F.when(F.col("candidate_id") % 5 == 1, "offside").when(F.col("candidate_id") % 5 == 2, " ")
    return R.review_rules(reviewed(t).withColumn("human_rejection_reason", why), t("assets"))


ELIGIBLE = """, el as (select ew.*, a.status = 'COMPLETED' and (ew.status = 'DETECTED' or review_status = 'CONFIRMED') and review_status <> 'REJECTED' as eligible from ew left join assets a using (asset_id))
"""


@query("f11_clip_eligible", needs=("assets", *BOTH), sql=RV + ELIGIBLE + "select candidate_id, coalesce(eligible, false) as eligible from el")
def f11(t: Tables):
    return R.clip_eligible(reviewed(t), t("assets")).select("candidate_id", "eligible")


@query("c1_clip_manifest", needs=("assets", "clips", *BOTH), sql=RV + ELIGIBLE + """select candidate_id, asset_id, effective_start_ms, effective_end_ms, effective_end_ms - effective_start_ms as length_ms,
  case when effective_type = 'GOAL' then 'goals' when contains(effective_type, 'CARD') then 'cards' when effective_type = 'SHOT' then 'shots' else 'other' end as category,
  candidate_id in (select candidate_id from clips) and manual_start_ms is null and manual_end_ms is null as reuse from el where eligible""")  # fmt: skip
def c1(t: Tables):
    return R.clip_manifest(reviewed(t), t("assets"), t("clips"))


@query("f12_ready_assets", needs=("assets", "runs", "segments"), sql="""select asset_id from assets a where status = 'COMPLETED' and asset_id in (select asset_id from segments)
and not exists (select 1 from runs r where r.asset_id = a.asset_id and r.status in ('PENDING', 'RUNNING'))""")  # fmt: skip
def f12(t: Tables):
    return R.ready_assets(t("assets"), t("segments"), t("runs")).select("asset_id")


@query("f14_approved_events", needs=BOTH, sql=RV + "select candidate_id, event_type from rv where status <> 'REJECTED' and review_status = 'CONFIRMED' and event_type = 'SHOT'")
def f14(t: Tables):
    return R.filter_approved(reviewed(t), "SHOT").select("candidate_id", "event_type")


@query("j1_with_review", needs=BOTH, sql=RV + "select candidate_id, review_status, manual_start_ms from rv")
def j1(t: Tables):
    return reviewed(t).select("candidate_id", "review_status", "manual_start_ms")


@query("j2_effective_window", needs=BOTH, sql=RV + "select candidate_id, effective_start_ms, effective_end_ms, effective_type, greatest(effective_start_ms, least(effective_end_ms, trigger_ms)) as effective_trigger_ms from ew")
def j2(t: Tables):
    return R.effective_window(reviewed(t)).select("candidate_id", "effective_start_ms", "effective_end_ms", "effective_type", "effective_trigger_ms")


@query("j4_evaluation_ready", needs=("gt_events", "gt_reviews"), sql="select asset_id, count(*) as truths from gt_events join gt_reviews using (asset_id) where review_status = 'COMPLETED' group by asset_id having count(*) >= 5")
def j4(t: Tables):
    return A.evaluation_ready(t("gt_reviews"), t("gt_events"))


@query("j5_match_phase", needs=("signals", "markers"), sql="""select id, coalesce((select marker_type from markers m where m.asset_id = s.asset_id and m.ts_ms <= s.ts_ms order by m.ts_ms desc, ord desc limit 1), 'UNKNOWN') as phase from signals s""")
def j5(t: Tables):
    found = T.asof_last(t("signals"), t("markers"), ["asset_id"], "ts_ms", "ts_ms", ["marker_type"], ["ord"])
    return found.select("id", F.coalesce("marker_type", F.lit("UNKNOWN")).alias("phase"))


@query("j6_score_at_event", needs=("candidates", "score_transitions"), sql="""select candidate_id, x.home, x.away,
  (select count(*) from score_transitions n where n.asset_id = c.asset_id and n.ts_ms between c.start_ms and c.end_ms) as changes_inside
from candidates c left join lateral (select home, away from score_transitions s where s.asset_id = c.asset_id and s.ts_ms <= c.trigger_ms order by s.ts_ms desc, s.transition_id desc limit 1) x on true""")  # fmt: skip
def j6(t: Tables):
    changes = t("score_transitions")
    events = t("candidates").select("candidate_id", "asset_id", "start_ms", "end_ms", "trigger_ms")
    inside = T.range_join(events, changes.select("asset_id", "ts_ms"), ["asset_id"], F.col("start_ms"), F.col("end_ms"), "ts_ms", 30_000).groupBy("candidate_id").agg(F.count(F.lit(1)).alias("changes_inside"))
    at = T.asof_last(events, changes, ["asset_id"], "trigger_ms", "ts_ms", ["home", "away"], ["transition_id"])
    return at.join(inside, "candidate_id", "left").select("candidate_id", "home", "away", F.coalesce("changes_inside", F.lit(0)).alias("changes_inside"))


@query("j10_source_observations", needs=("candidates", "signals"), sql="""select candidate_id, s.id as signal_id from candidates c join signals s on s.asset_id = c.asset_id and s.run_id = c.run_id and s.ts_ms between c.start_ms and c.end_ms
  and coalesce(s.event_type, 'ATTACK') = c.event_type""")  # fmt: skip
def j10(t: Tables):
    events = t("candidates").select("candidate_id", "asset_id", "run_id", "start_ms", "end_ms", F.col("event_type").alias("own_type"))
    seen = t("signals").select("asset_id", "run_id", F.col("id").alias("signal_id"), "ts_ms", F.coalesce("event_type", F.lit("ATTACK")).alias("of_type"))
    return T.range_join(events, seen, ["asset_id", "run_id"], F.col("start_ms"), F.col("end_ms"), "ts_ms", 30_000).where("own_type = of_type").select("candidate_id", "signal_id")


@query("j15_range_exists", needs=("signals",), sql="""select id from signals g where event_type = 'GOAL' and not exists (select 1 from signals r where r.asset_id = g.asset_id and r.run_id = g.run_id
  and r.signal_type = 'REPLAY_CONTEXT' and r.ts_ms between g.ts_ms - 20000 and g.ts_ms - 1)""")  # fmt: skip
def j15(t: Tables):
    goals = t("signals").where("event_type = 'GOAL'").select("id", "asset_id", "run_id", F.col("ts_ms").alias("at_ms"))
    replays = t("signals").where("signal_type = 'REPLAY_CONTEXT'").select("asset_id", "run_id", "ts_ms")
    return T.range_join(goals, replays, ["asset_id", "run_id"], F.col("at_ms") - 20_000, F.col("at_ms") - 1, "ts_ms", 20_000, "left_anti").select("id")


@query("j17_processing_status", needs=("assets", "segments", "runs"), sql="""select a.asset_id, a.status, coalesce(n, 0) as segments, case when n is null then 'NOT_STARTED' else 'COMPLETED' end as transcript_status, coalesce(r, 0) as runs
from assets a left join (select asset_id, count(*) as n from segments group by asset_id) s using (asset_id) left join (select asset_id, count(*) as r from runs group by asset_id) q using (asset_id)""")  # fmt: skip
def j17(t: Tables):
    segments = t("segments").groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"))
    runs = t("runs").groupBy("asset_id").agg(F.count(F.lit(1)).alias("r"))
    rows = t("assets").join(segments, "asset_id", "left").join(runs, "asset_id", "left")
    return rows.select("asset_id", "status", F.coalesce("n", F.lit(0)).alias("segments"), F.when(F.col("n").isNull(), "NOT_STARTED").otherwise("COMPLETED").alias("transcript_status"), F.coalesce("r", F.lit(0)).alias("runs"))


@query("a1_counts_by_status", needs=("assets", "candidates", "runs"), sql="""select 'media' as tile, status as value, count(*) as n from assets group by status union all select 'event_type', event_type, count(*) from candidates group by event_type
union all select 'event_status', status, count(*) from candidates group by status union all select 'run_status', status, count(*) from runs group by status""")  # fmt: skip
def a1(t: Tables):
    c = t("candidates")
    return A.counts_by({"media": (t("assets"), "status"), "event_type": (c, "event_type"), "event_status": (c, "status"), "run_status": (t("runs"), "status")})


@query("a2_totals", needs=("assets", "gt_events", "gt_reviews", *BOTH), sql=RV + """select 'assets' as name, count(*) as n from assets union all select 'events', count(*) from rv union all select 'reviewed', count(*) from rv where review_status <> 'UNREVIEWED'
union all select 'completed', count(*) from assets where status = 'COMPLETED' union all select 'truths', count(*) from gt_events
union all select 'evaluation_ready', count(*) from gt_reviews r where review_status = 'COMPLETED' and (select count(*) from gt_events g where g.asset_id = r.asset_id) >= 5""")  # fmt: skip
def a2(t: Tables):
    return A.totals(t("assets"), reviewed(t), t("gt_events"), t("gt_reviews"))


@query("a3_workload", needs=BOTH, sql=RV + "select count(*) filter (where status <> 'REJECTED' and review_status = 'UNREVIEWED') as awaiting_review, count(*) filter (where status = 'REJECTED' and review_status <> 'REJECTED') as rejected_awaiting from rv")
def a3(t: Tables):
    return A.workload(reviewed(t))


SUMMARY = """, ev as (select asset_id, count(*) filter (where status <> 'MANUAL') as candidates, count(*) filter (where status = 'DETECTED') as detected, count(*) filter (where status = 'REJECTED') as rejected,
  count(*) filter (where status = 'DETECTED' and review_status = 'UNREVIEWED') as needs_review, count(*) filter (where status = 'DETECTED' and review_status = 'CONFIRMED') as approved from rv group by asset_id),
cl as (select asset_id, count(*) as clips from clips group by asset_id),
lr as (select asset_id, detection_run_id as latest_run_id, status as latest_status from (select *, row_number() over (partition by asset_id order by created_order desc, detection_run_id desc) as rn from runs) where rn = 1),
su as (select a.asset_id, a.status, coalesce(candidates, 0) as candidates, coalesce(detected, 0) as detected, coalesce(rejected, 0) as rejected, coalesce(needs_review, 0) as needs_review, coalesce(approved, 0) as approved,
  coalesce(clips, 0) as clips, latest_run_id, latest_status from assets a left join ev using (asset_id) left join cl using (asset_id) left join lr using (asset_id))
"""
MATCHES = SUMMARY + """, ms as (select case when coalesce(trim(home_team), '') <> '' and coalesce(trim(away_team), '') <> '' then 'match:' || lower(trim(competition)) || '|' || lower(trim(home_team)) || '|' || lower(trim(away_team)) else 'asset:' || asset_id end as match_key,
  count(*) as assets, sum(candidates)::bigint as candidates, sum(detected)::bigint as detected, sum(rejected)::bigint as rejected, sum(needs_review)::bigint as needs_review, sum(approved)::bigint as approved, sum(clips)::bigint as clips,
  bool_or(su.status = 'PROCESSING' or coalesce(latest_status in ('PENDING', 'RUNNING'), false)) as processing, bool_or(coalesce(latest_status = 'COMPLETED', false)) as completed
  from su join assets using (asset_id) group by 1)
"""  # fmt: skip
ALL = ("assets", "clips", "runs", *BOTH)


def summary(t: Tables):
    return A.asset_summary(t("assets"), reviewed(t), t("clips"), t("runs"))


@query("a4_asset_summary", needs=ALL, sql=RV + SUMMARY + "select * from su")
def a4(t: Tables):
    return summary(t)


@query("a5_match_summary", needs=ALL, sql=RV + MATCHES + "select * from ms")
def a5(t: Tables):
    return A.match_summary(t("assets"), summary(t))


@query("a5_match_buckets", needs=ALL, sql=RV + MATCHES + """select count(*) as all_matches, count(*) filter (where needs_review > 0) as needs_review, count(*) filter (where detected > 0 and needs_review = 0) as reviewed,
  count(*) filter (where approved > 0) as approved, count(*) filter (where processing) as processing, count(*) filter (where completed) as completed from ms""")  # fmt: skip
def a5b(t: Tables):
    return A.match_buckets(A.match_summary(t("assets"), summary(t)))


@query("a6_run_breakdown", needs=("candidates",), sql="select run_id, event_type, count(*) filter (where status = 'DETECTED') as detected, count(*) filter (where status = 'REJECTED') as rejected from candidates group by run_id, event_type")
def a6(t: Tables):
    return A.run_breakdown(t("candidates"))


@query("a7_run_summary", needs=("candidates", "signals"), sql="""select asset_id, run_id, candidates, detected, rejected, observations from (select asset_id, run_id, count(*) as candidates, count(*) filter (where status = 'DETECTED') as detected,
  count(*) filter (where status = 'REJECTED') as rejected from candidates group by all) join (select asset_id, run_id, count(*) as observations from (select distinct asset_id, run_id, signal_type, event_type, confidence, ts_ms, evidence from signals) group by all) using (asset_id, run_id)""")  # fmt: skip
def a7(t: Tables):
    return A.run_summary(t("candidates"), t("signals"))


@query("a8_distinct_signals", needs=("signals",), sql="select distinct asset_id, run_id, signal_type, event_type, confidence, ts_ms, evidence from signals")
def a8(t: Tables):
    return A.distinct_signals(t("signals"))


@query("a16_timeline_length", needs=("assets", "signals"), sql="select asset_id, greatest(coalesce(case when a.asset_id % 2 = 0 then duration_ms end, m, 1), 1) as length_ms from assets a left join (select asset_id, max(ts_ms) as m from signals group by asset_id) using (asset_id)")
def a16(t: Tables):
    return A.timeline_length(t("assets").withColumn("duration_ms", F.expr("if(asset_id % 2 = 0, duration_ms, null)")), t("signals"))


@query("a17_batch_outcome", needs=("runs",), sql="select asset_id, count(*) filter (where status <> 'PENDING') as finished, count(*) filter (where status = 'FAILED') as failed, case when bool_or(status = 'FAILED') then 'COMPLETED_WITH_FAILURES' else 'COMPLETED' end as outcome from runs group by asset_id")
def a17(t: Tables):
    return A.batch_outcome(t("runs"), "asset_id", "status")


@query("a18_operations_tiles", needs=("assets", "runs"), sql="select (select count(*) from assets where status in ('STORED', 'READY', 'AUDIO_EXTRACTED')) as media_waiting, count(*) filter (where status in ('PENDING', 'RUNNING')) as active_runs, count(*) filter (where status = 'FAILED') as failed_runs from runs")
def a18(t: Tables):
    one = lambda df, *n: df.agg(*n).withColumn("k", F.lit(1))
    media = one(t("assets"), F.count_if(F.col("status").isin("STORED", "READY", "AUDIO_EXTRACTED")).alias("media_waiting"))
    runs = one(t("runs"), F.count_if(F.col("status").isin("PENDING", "RUNNING")).alias("active_runs"), F.count_if(F.col("status") == "FAILED").alias("failed_runs"))
    return media.join(runs, "k").drop("k")


@query("a19_rejection_progress", needs=BOTH, sql=RV + "select asset_id, count(*) as total, count(*) filter (where review_status <> 'REJECTED') as pending, count(*) filter (where review_status = 'REJECTED') as confirmed, round(count(*) filter (where review_status = 'REJECTED') / count(*), 6) as ratio from rv where status = 'REJECTED' group by asset_id")
def a19(t: Tables):
    return R.rejection_progress(reviewed(t))


@query("k1_rank_candidates", needs=("candidates",), sql="select candidate_id, rn as rank from (select *, row_number() over (partition by asset_id, run_id order by (status <> 'DETECTED')::int, score desc, start_ms, event_type, candidate_id) as rn from candidates) where rn <= 20")
def k1(t: Tables):
    return A.rank_candidates(t("candidates"), 20).select("candidate_id", "rank")


@query("k3_latest_run", needs=("runs",), sql="select asset_id, detection_run_id as latest_run_id, status as latest_status from (select *, row_number() over (partition by asset_id order by created_order desc, detection_run_id desc) as rn from runs) where rn = 1")
def k3(t: Tables):
    return A.latest_run(t("runs"))


@query("k6_next_to_review", needs=BOTH, sql=RV + "select asset_id, candidate_id from (select *, row_number() over (partition by asset_id order by (review_status <> 'UNREVIEWED')::int, trigger_ms, candidate_id) as rn from rv where status <> 'REJECTED') where rn = 1")
def k6(t: Tables):
    return R.next_to_review(reviewed(t))


@query("u3_timeline_layers", needs=("signals", "candidates", "markers", "gt_events", "score_transitions"), sql="""select 'observation' as layer, asset_id, id as item_id, ts_ms from signals union all select case status when 'REJECTED' then 'rejected' when 'MANUAL' then 'manual' else 'detected' end, asset_id, candidate_id, trigger_ms from candidates
union all select 'structure', asset_id, ord, ts_ms from markers union all select 'ground_truth', asset_id, gt_id, ts_ms from gt_events union all select 'score', asset_id, transition_id, ts_ms from score_transitions""")  # fmt: skip
def u3(t: Tables):
    item = lambda df, c, ts="ts_ms": df.select("asset_id", F.col(c).alias("item_id"), F.col(ts).alias("ts_ms"))
    c = t("candidates")
    by = {"rejected": "status = 'REJECTED'", "manual": "status = 'MANUAL'", "detected": "status = 'DETECTED'"}
    layers = {"observation": item(t("signals"), "id"), "structure": item(t("markers"), "ord"), "ground_truth": item(t("gt_events"), "gt_id"), "score": item(t("score_transitions"), "transition_id")}
    return A.timeline_layers(layers | {k: item(c.where(test), "candidate_id", "trigger_ms") for k, test in by.items()})


@query("u5_filter_values", needs=("candidates",), sql="select 'event_type' as filter, event_type as value from candidates group by 2 union all select 'status', status from candidates group by 2")
def u5(t: Tables):
    c = t("candidates")
    one = lambda name: c.select(F.lit(name).alias("filter"), F.col(name).alias("value")).distinct()
    return one("event_type").unionByName(one("status"))


@query("w18_queue_neighbours", needs=BOTH, sql=RV + """select asset_id, candidate_id, lag(candidate_id) over w as previous_id, lead(candidate_id) over w as next_id, row_number() over w as position, count(*) over (partition by asset_id) as queue_length
from rv where status = 'DETECTED' window w as (partition by asset_id order by trigger_ms, candidate_id)""")  # fmt: skip
def w18(t: Tables):
    return R.queue_neighbours(reviewed(t))


@query("c4_review_queue", needs=BOTH, sql=RV + "select asset_id, count(*) filter (where status = 'DETECTED' and review_status = 'UNREVIEWED') as pending, count(*) filter (where status = 'REJECTED' and review_status <> 'REJECTED') as rejected_pending from rv group by asset_id")
def c4(t: Tables):
    return R.review_queue(reviewed(t))


@query("c3_rejected_review_windows", needs=("assets", *BOTH), sql=RV + """, r as (select candidate_id, trigger_ms, duration_ms, effective_start_ms as s, effective_end_ms as e, greatest(0, least(trigger_ms - 5000, duration_ms - 10000)) as f from ew join assets using (asset_id) where ew.status = 'REJECTED')
select candidate_id, case when e - s <= 10000 then s else f end as review_start_ms, case when e - s <= 10000 then least(e, duration_ms) else least(f + 10000, duration_ms) end as review_end_ms from r""")  # fmt: skip
def c3(t: Tables):
    rows = R.effective_window(reviewed(t).where("status = 'REJECTED'")).join(t("assets").select("asset_id", "duration_ms"), "asset_id")
    return R.rejected_window(rows, 10_000).select("candidate_id", "review_start_ms", "review_end_ms")


@query("x23_frame_times", needs=("candidates",), sql="select candidate_id, f as frame, trigger_ms - (5 - f) * least(1000, trigger_ms // 5) as ts_ms from (select candidate_id, trigger_ms, unnest(range(0, 5)) as f from candidates where event_type = 'GOAL' and trigger_ms > 0)")
def x23(t: Tables):
    return R.frame_times(t("candidates").where("event_type = 'GOAL'"))


@query("e15_confirm_as_truth", needs=("gt_events", *BOTH), sql=RV + """select candidate_id, asset_id, effective_type as event_type, greatest(effective_start_ms, least(effective_end_ms, trigger_ms)) as ts_ms from ew
where status <> 'REJECTED' and review_status = 'CONFIRMED' and candidate_id not in (select gt_id from gt_events)""")  # fmt: skip
def e15(t: Tables):
    return R.confirm_as_truth(reviewed(t), t("gt_events"))


@query("x19_match_part", needs=("assets",), sql=r"""select asset_id, case when regexp_matches(lower(original_filename), '\b(first|1st)[\s._-]*half\b') then 'FIRST_HALF' when regexp_matches(lower(original_filename), '\b(second|2nd)[\s._-]*half\b') then 'SECOND_HALF' else 'OTHER' end as part from assets""")
def x19(t: Tables):
    return t("assets").select("asset_id", A.match_part(F.col("original_filename")).alias("part"))
