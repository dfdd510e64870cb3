"""Queries of what a reviewer sees beside an event."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import scoreboard as B
from touchline.operators import transcript as P
from touchline.operators import views as V
from touchline.plans.detection_queries import STATES
from touchline.plans.more_queries import CUE
from touchline.plans.registry import Tables, query

FAMILY = "case " + " ".join(f"when signal_type in ({', '.join(repr(k) for k in kinds)}) then '{name}'" for name, kinds in V.FAMILIES.items()) + " else 'OTHER' end"


@query("j6_around_events", needs=("candidates", "score_transitions", "markers"), sql="""select candidate_id, 'SCORE' as kind, home || '-' || away as what, ts_ms as at_ms from candidates c join score_transitions s on s.asset_id = c.asset_id and ts_ms between start_ms and end_ms
union all select candidate_id, 'MARKER', marker_type, ts_ms from candidates c join markers m on m.asset_id = c.asset_id and ts_ms between start_ms and end_ms
union all select c.candidate_id, 'EVENT', o.event_type || ' ' || o.candidate_id, o.trigger_ms from candidates c join candidates o
  on o.asset_id = c.asset_id and o.run_id = c.run_id and o.candidate_id <> c.candidate_id and o.trigger_ms between c.start_ms and c.end_ms""")  # fmt: skip
def j6(t: Tables):
    return V.around_events(t("candidates"), t("score_transitions"), t("markers"))


CLIPS = """, r as (
  select candidate_id, trigger_ms, candidate_id % 5 < 2 as there, review_status, if(candidate_id % 9 = 0, null, trigger_ms + (candidate_id % 13 - 1) * 4000) as len,
    if(candidate_id % 7 = 0, trigger_ms - 20000, start_ms) as s0, if(candidate_id % 7 = 0, trigger_ms + 25000, if(candidate_id % 8 = 1, start_ms + 1000, end_ms)) as e0, manual_start_ms, manual_end_ms
  from candidates left join reviews using (candidate_id) where status = 'REJECTED'),
w as (select *, if(len > 0, len, null) as l, coalesce(if(manual_end_ms is null, s0, manual_start_ms), s0) as s, coalesce(if(manual_start_ms is null, e0, manual_end_ms), e0) as e, greatest(0, trigger_ms - 15000) as g from r),
a as (
  select *, if(e - s > 30000, if(coalesce(g + 30000 > l, false), greatest(0, l - 30000), g), least(s, l)) as a, if(e - s > 30000, least(g + 30000, l), least(e, l)) as b from w),
f as (
  select *, if(b <= a or trigger_ms not between a and b, if(coalesce(trigger_ms + 15000 > l, false), greatest(0, l - 30000), g), a) as f_ms, if(b <= a or trigger_ms not between a and b, least(trigger_ms + 15000, l), b) as t_ms from a)
select candidate_id, if(t_ms <= f_ms or trigger_ms > t_ms, null, f_ms) as from_ms, if(t_ms <= f_ms or trigger_ms > t_ms, null, t_ms) as to_ms,
  case when review_status = 'REJECTED' then if(there, 'FAILED', 'DELETED') when there then 'READY' else 'ABSENT' end as state from f"""


@query("c3_rejected_clips", needs=("candidates", "reviews"), sql=CLIPS)
def c3(t: Tables):
    own = F.col("candidate_id")
    rows = t("candidates").join(t("reviews").select("candidate_id", "review_status", "manual_start_ms", "manual_end_ms"), "candidate_id", "left")
    rows = rows.withColumns({
        "duration_ms": F.when(own % 9 != 0, F.col("trigger_ms") + (own % 13 - 1) * 4000),
        "start_ms": F.when(own % 7 == 0, F.col("trigger_ms") - 20_000).otherwise(F.col("start_ms")),
        "end_ms": F.when(own % 7 == 0, F.col("trigger_ms") + 25_000).when(own % 8 == 1, F.col("start_ms") + 1000).otherwise(F.col("end_ms")),
    })
    return V.rejected_clips(rows, t("candidates").where(own % 5 < 2).select("candidate_id"))


@query("a14_runs_side_by_side", needs=("moments", "footage"), sql=f"""select asset_id, side, {FAMILY} as family, count(*) as n, max(confidence) as top from (
  select *, (k - 1) * 20 // c as share, lag((k - 1) * 20 // c) over (partition by asset_id, side order by k) as last from (
    select *, row_number() over (partition by asset_id, side order by ts_ms, id) as k, count(*) over (partition by asset_id, side) as c from (
      select m.*, if(run_id = 0, 'LEFT', 'RIGHT') as side from moments m left join footage f using (asset_id) where ts_ms between 20000 and least(140000, duration_ms))))
where last is null or share <> last group by all""")  # fmt: skip
def a14(t: Tables):
    return V.compare_observations(t("moments"), t("footage"), 0, 1, 80_000, 60_000, 20)


@query("x20_match_keys", needs=("assets",), sql="""select asset_id, if(coalesce(trim(home_team), '') <> '' and coalesce(trim(away_team), '') <> '' and day is not null,
  'match:' || lower(trim(competition)) || '|' || day || '|' || lower(trim(home_team)) || '|' || lower(trim(away_team)), 'asset:' || asset_id) as match_key
from (select *, if(asset_id % 6 = 0, null, '2024-01-0' || (asset_id % 3 + 1)) as day from assets)""")  # fmt: skip
def x20(t: Tables):
    day = F.when(F.col("asset_id") % 6 != 0, F.concat(F.lit("2024-01-0"), (F.col("asset_id") % 3 + 1).cast("string")).cast("date"))
    rows = t("assets").withColumn("match_date", day)
    return rows.select("asset_id", V.match_key(rows).alias("match_key"))


RULES = """, ev as (
  select candidate_id, asset_id, run_id, if(candidate_id % 19 = 0, end_ms + 1, start_ms) as s, end_ms as e, trigger_ms + candidate_id % 12 * 1000 as t, if(candidate_id % 23 = 0, 1.5e0, score) as score,
    case candidate_id % 6 when 0 then [candidate_id, candidate_id] when 1 then [candidate_id + 1] when 2 then [candidate_id, candidate_id + 1] else [candidate_id] end as src, if(candidate_id % 4 = 2, 'merged', null) as reason from candidates),
own as (select c.candidate_id, g.ts_ms from candidates c join signals g on g.asset_id = c.asset_id and g.run_id = c.run_id and g.ts_ms between c.trigger_ms - 4000 and c.trigger_ms + 9000 and c.candidate_id % 5 > 0),
o as (select ev.candidate_id, bool_or(ts_ms not between s and e) as outside from ev join own using (candidate_id) group by 1),
r as (select candidate_id, list_filter([if(s < 0 or e <= s, 'WINDOW_ORDER', null), if(t not between s and e, 'TRIGGER_OUTSIDE', null), if(score not between 0 and 1, 'SCORE_RANGE', null),
  if(len(list_distinct(src)) < len(src), 'SOURCES_NOT_UNIQUE', null), if(not list_contains(src, candidate_id), 'SOURCES_WITHOUT_ITSELF', null), if(len(src) > 1 and coalesce(reason, '') = '', 'MERGED_WITHOUT_REASON', null),
  if(outside is null, 'NO_SIGNALS', null), if(outside, 'SIGNAL_OUTSIDE', null)], lambda x: x is not null) as l from ev left join o using (candidate_id))
select candidate_id, unnest(l) as rule from r"""


@query("f8_event_rules", needs=("candidates", "signals"), sql=RULES)
def f8(t: Tables):
    from touchline.operators import timejoin as T

    c, own = t("candidates"), F.col("candidate_id")
    sources = F.when(own % 6 == 0, F.array(own, own)).when(own % 6 == 1, F.array(own + 1)).when(own % 6 == 2, F.array(own, own + 1)).otherwise(F.array(own))
    events = c.withColumns({
        "start_ms": F.when(own % 19 == 0, F.col("end_ms") + 1).otherwise(F.col("start_ms")), "trigger_ms": F.col("trigger_ms") + own % 12 * 1000, "score": F.when(own % 23 == 0, 1.5).otherwise(F.col("score")),
        "sources": sources, "merge_reason": F.when(own % 4 == 2, "merged"),
    })
    left = c.where(own % 5 > 0).select("candidate_id", "asset_id", "run_id", "trigger_ms")
    signals = T.range_join(left, t("signals").select("asset_id", "run_id", "ts_ms"), ["asset_id", "run_id"], F.col("trigger_ms") - 4000, F.col("trigger_ms") + 9000, "ts_ms", 30_000)
    return V.event_rules(events, signals.select("candidate_id", "ts_ms"))


@query("f3_inventory", needs=("candidates", "signals"), sql="""select candidate_id, event_type, status, trigger_ms, score from candidates c
where status = 'REJECTED' and (contains(lower(event_type || ' ' || coalesce(context, '')), '7') or exists (
  select 1 from signals g where g.asset_id = c.asset_id and g.run_id = c.run_id and g.ts_ms between c.start_ms and c.end_ms and contains(lower(g.evidence), '7')))""")  # fmt: skip
def f3(t: Tables):
    from touchline.operators import timejoin as T

    left = t("candidates").select("candidate_id", "asset_id", "run_id", "start_ms", "end_ms")
    signals = T.range_join(left, t("signals").select("asset_id", "run_id", "ts_ms", "evidence"), ["asset_id", "run_id"], F.col("start_ms"), F.col("end_ms"), "ts_ms", 30_000)
    found = V.inventory(t("candidates"), signals.select("candidate_id", "ts_ms", "evidence"), " 7 ", "REJECTED", sort="status")
    return found.select("candidate_id", "event_type", "status", "trigger_ms", "score")


@query("f11_clip_targets", needs=("candidates", "reviews", "assets"), sql="""select candidate_id, if(m, manual_start_ms, start_ms) as start_ms, if(m, manual_end_ms, end_ms) as end_ms, m as manual
from (select c.*, manual_start_ms, manual_end_ms, coalesce(review_status, 'UNREVIEWED') as r, manual_start_ms is not null and manual_end_ms is not null as m
  from candidates c left join reviews using (candidate_id) semi join (from assets where status = 'COMPLETED') using (asset_id))
where candidate_id % 10 = 3 or ((status = 'DETECTED' or r = 'CONFIRMED') and r <> 'REJECTED')""")  # fmt: skip
def f11(t: Tables):
    reviewed = t("candidates").join(t("reviews"), "candidate_id", "left")
    return V.clip_targets(reviewed, t("assets"), t("candidates").where("candidate_id % 10 = 3"))


@query("k4_assets_by_duration", needs=("assets",), sql="select asset_id, duration_ms, (select count(*) from assets) as total, (select ceil(count(*) / 4) from assets)::bigint as pages from assets order by duration_ms desc, asset_id limit 4 offset 4")
def k4(t: Tables):
    return V.asset_page(t("assets"), "durationMs", True, 1, 4).select("asset_id", "duration_ms", "total", "pages")


@query("x22_event_types", needs=("candidates",), sql=f"""select event_type, replace(event_type, '_', ' ') as label, coalesce(n, 0) as n from (select unnest([{", ".join(repr(k) for k in V.EVENT_TYPES)}]) as event_type)
left join (select event_type, count(*) as n from candidates group by 1) using (event_type)""")  # fmt: skip
def x22(t: Tables):
    return V.taxonomy(t("candidates"))


@query("u3_timeline", needs=("signals", "candidates", "reviews", "assets", "markers", "gt_events", "score_transitions", "ocr_readings"), sql=STATES + """, a as (select asset_id, if(asset_id % 4 = 0, null, duration_ms) as d from assets),
rv as (select c.*, coalesce(review_status, 'UNREVIEWED') as r from candidates c left join reviews using (candidate_id)),
rows as (
  select asset_id, case status when 'REJECTED' then 'rejected' when 'MANUAL' then 'manual' else 'detected' end as layer, candidate_id::varchar as item, trigger_ms as at_ms from rv
  union all select asset_id, 'confirmed', candidate_id::varchar, trigger_ms from rv where status = 'DETECTED' and r = 'CONFIRMED' union all select asset_id, 'human_rejected', candidate_id::varchar, trigger_ms from rv where r = 'REJECTED'
  union all select asset_id, 'structure', marker_type, ts_ms from markers union all select asset_id, 'observations', id::varchar, ts_ms from signals union all select asset_id, 'score', transition_id::varchar, ts_ms from score_transitions
  union all select asset_id, 'ground_truth', gt_id::varchar, ts_ms from gt_events union all select asset_id, 'ocr', if(pv is null, 'SCORE_STATE', 'SCORE_TRANSITION'), ts_ms from states),
len as (select a.asset_id, coalesce(d, greatest(1, max(t)), 1) as l from a left join (
  select asset_id, at_ms as t from rows where layer in ('structure', 'score', 'observations', 'ocr') union all select asset_id, end_ms from candidates) k using (asset_id) group by a.asset_id, d)
select asset_id, layer, item, at_ms, round(greatest(0, least(100, at_ms * 100e0 / l)), 6) as percent from rows join len using (asset_id)""")  # fmt: skip
def u3(t: Tables):
    assets = t("assets").withColumn("duration_ms", F.when(F.col("asset_id") % 4 != 0, F.col("duration_ms")))
    reviewed = t("candidates").join(t("reviews").select("candidate_id", "review_status"), "candidate_id", "left").withColumn("review_status", F.coalesce("review_status", F.lit("UNREVIEWED")))
    readings = B.scoreboard_states(t("ocr_readings")).withColumn("kind", F.when(F.col("previous_home").isNull(), "SCORE_STATE").otherwise("SCORE_TRANSITION"))
    rows = V.timeline(assets, reviewed, t("markers"), t("signals"), t("score_transitions"), t("gt_events"), readings)
    return rows.withColumn("percent", F.round("percent", 6))


READINGS = """select asset_id, if(ts_ms % 35000 = 0, -1 - ts_ms, ts_ms) as ts_ms, case ts_ms // 5000 % 11 when 3 then 'OCR' when 4 then null when 5 then 'SCORE_STATE' else 'OCR_OBSERVATION' end as kind,
    confidence + ts_ms // 5000 % 4 * 0.2e0 as confidence, ts_ms // 5000 % 17 as home, asset_id % 3 as away, case ts_ms // 5000 % 6 when 0 then -1 when 1 then null else 2 end as previous_home, null::int as previous_away,
    case ts_ms // 5000 % 5 when 0 then '{"a":1}' when 1 then '[1]' when 2 then '{"a":' else '{}' end as details from ocr_readings"""


@query("f9_reading_violations", needs=("ocr_readings",), sql=f", r as ({READINGS})" + """ select asset_id, ts_ms, unnest(l) as rule from (select asset_id, ts_ms, list_filter([
  if(ts_ms < 0, 'NEGATIVE_TIME', null), if(kind is null or kind not in ('OCR_OBSERVATION', 'SCORE_STATE', 'SCORE_TRANSITION', 'SCORE_REVERSAL'), 'UNKNOWN_KIND', null), if(confidence not between 0 and 1, 'CONFIDENCE_RANGE', null),
  if(home not between 0 and 15 or away not between 0 and 15 or coalesce(previous_home not between 0 and 15, false), 'SCORE_RANGE', null), if(details in ('[1]', '{"a":'), 'DETAILS_NO_OBJECT', null)], lambda x: x is not null) as l from r)""")  # fmt: skip
def f9r(t: Tables):
    n = F.floor(F.col("ts_ms") / 5000)
    rows = t("ocr_readings").select(
        "asset_id", F.when(F.col("ts_ms") % 35_000 == 0, -1 - F.col("ts_ms")).otherwise(F.col("ts_ms")).alias("ts_ms"),
        F.when(n % 11 == 3, "OCR").when(n % 11 == 4, F.lit(None)).when(n % 11 == 5, "SCORE_STATE").otherwise("OCR_OBSERVATION").alias("kind"), (F.col("confidence") + n % 4 * 0.2).alias("confidence"), (n % 17).alias("home"),
        (F.col("asset_id") % 3).alias("away"), F.when(n % 6 == 0, -1).when(n % 6 == 1, F.lit(None)).otherwise(2).alias("previous_home"), F.lit(None).cast("int").alias("previous_away"),
        F.when(n % 5 == 0, '{"a":1}').when(n % 5 == 1, "[1]").when(n % 5 == 2, '{"a":').otherwise("{}").alias("details"),
    )
    return V.reading_rules(rows)


@query("f9_component_violations", needs=("candidates",), sql="""select candidate_id, component, unnest(l) as rule from (
  select candidate_id, if(candidate_id % 9 = 0, null, event_type) as component, list_filter([if(candidate_id % 9 = 0, 'UNKNOWN_COMPONENT', null), if(score + candidate_id % 4 * 0.3e0 not between 0 and 1, 'CONFIDENCE_RANGE', null),
    if(candidate_id % 7 = 0, 'NOT_FINITE', null), if(candidate_id % 5 < 2, 'NO_EXPLANATION', null)], lambda x: x is not null) as l from candidates)""")  # fmt: skip
def f9c(t: Tables):
    own = F.col("candidate_id")
    rows = t("candidates").select(
        "candidate_id", F.when(own % 9 != 0, F.col("event_type")).alias("component"), (F.col("score") + own % 4 * 0.3).alias("evidence_confidence"), F.when(own % 14 == 0, float("inf")).when(own % 7 != 0, 0.7).alias("weight"),
        F.lit(0.1).alias("contribution"), F.when(own % 5 == 0, " ").when(own % 5 > 1, "why").alias("explanation"),
    )
    return V.component_rules(rows)


MANIFEST = CUE.replace("min(start_ms) as goal_ms", "asset_id % 9 * 800 as goal_ms") + """, kept as (
  select goal_id, min(cue_ms) as cue_ms, 1 as k, max(last_ms) as last_ms from f group by goal_id
  union all select h.goal_id, min(f.cue_ms), h.k + 1, h.last_ms from kept h join f on f.goal_id = h.goal_id and f.cue_ms > h.cue_ms + 25000 where h.k < 3 group by h.goal_id, h.cue_ms, h.k, h.last_ms)
select goal_id, 'FRAME' as kind, i as number, if(goal_ms >= 5000, goal_ms - 5000 + (i - 1) * 1000, goal_ms * i // 6) as from_ms, null as to_ms from gl, range(1, 6) r(i) where goal_ms > 0
union all select goal_id, 'REPLAY', k, greatest(0, cue_ms - 8000), least(last_ms, cue_ms + 25000) from kept"""  # fmt: skip


@query("c2_review_manifest", needs=("segments",), sql=MANIFEST)
def c2(t: Tables):
    s = t("segments")
    goals = s.groupBy("asset_id").agg((F.col("asset_id") * 1000 + F.min("seq")).alias("goal_id"), (F.col("asset_id") % 9 * 800).alias("goal_ms"))
    return V.goal_manifest(goals, P.goal_replay_cues(goals, s, ("with", "dans"), ("the", "les")))
