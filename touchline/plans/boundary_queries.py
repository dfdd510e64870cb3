"""Queries of boundaries, associations, final signals, manifests of goals and small text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import evidence as V
from touchline.functions import text as X
from touchline.operators import assemble as E
from touchline.operators import review as R
from touchline.plans.detection_queries import ASSEMBLE, NORM, r6
from touchline.plans.registry import Tables, query


def goals_of(t: Tables):
    return t("signals").where("event_type = 'GOAL'").select("asset_id", "run_id", F.col("id").alias("goal_id"), F.col("ts_ms").alias("goal_ms"))


@query("e10_goal_start", needs=("signals",), sql=""", go as (select asset_id, run_id, id as goal_id, ts_ms as goal_ms from signals where event_type = 'GOAL'),
nr as (select goal_id, goal_ms, g.ts_ms, g.signal_type from go join signals g on g.asset_id = go.asset_id and g.run_id = go.run_id and g.ts_ms between greatest(0, goal_ms - 90000) and goal_ms),
fe as (select goal_id, max(ts_ms) as fence_ms from nr where signal_type = 'REPLAY_CONTEXT' and ts_ms < goal_ms group by 1),
af as (select nr.*, fence_ms from nr left join fe using (goal_id) where (fence_ms is null or ts_ms > fence_ms) and goal_ms - ts_ms <= 45000),
ch as (select *, coalesce(lag(ts_ms) over (partition by goal_id order by ts_ms desc), goal_ms) - ts_ms > 8000 as far from af where signal_type = 'ATTACK_BUILDUP'), cb as (select *, max(far::int) over (partition by goal_id order by ts_ms desc rows unbounded preceding) as b from ch),
ak as (select goal_id, min(ts_ms) as attack_ms from cb where b = 0 group by 1), sh as (select goal_id, max(ts_ms) as action_ms from af where signal_type = 'TRANSCRIPT_SHOT' and ts_ms < goal_ms group by 1),
n as (select goal_id, goal_ms, g.ts_ms, g.signal_type, case when g.ts_ms - lag(g.ts_ms) over (partition by goal_id order by g.ts_ms) > 4000 then 1 else 0 end as nw from go join signals g on g.asset_id = go.asset_id and g.signal_type in ('AUDIO_SPIKE', 'ATTACK_BUILDUP') and g.ts_ms between greatest(0, goal_ms - 45000) and goal_ms),
c as (select *, sum(nw) over (partition by goal_id order by ts_ms) as cl from n), p as (select goal_id, goal_ms, cl, min(ts_ms) as from_ms, max(ts_ms) as to_ms from c group by all having count(distinct signal_type) >= 2 and goal_ms - max(ts_ms) <= 24000),
lo as (select goal_id, from_ms as loud_ms from (select *, row_number() over (partition by goal_id order by to_ms desc) as k from p) where k = 1),
al as (select goal_id, goal_ms, fence_ms, attack_ms, case when loud_ms > coalesce(fence_ms, -1) then loud_ms end as loud, action_ms from go left join fe using (goal_id) left join ak using (goal_id) left join lo using (goal_id) left join sh using (goal_id))
select goal_id, greatest(coalesce(fence_ms, 0), coalesce(coalesce(attack_ms, loud, action_ms) - 5000, goal_ms - 30000), 0) as start_ms,
  case when attack_ms is not null then 'CONNECTED_ATTACK' when loud is not null then 'AUDIO_BUILDUP' when action_ms is not null then 'DECISIVE_ACTION' else 'FALLBACK_PRE_ROLL' end as reason from al""")  # fmt: skip
def e10(t: Tables):
    return E.goal_start(goals_of(t), t("signals"))


@query("j13_preceding_foul", needs=("candidates",), sql=r""", w as (select candidate_id, asset_id, run_id, trigger_ms, event_type, list_distinct(regexp_extract_all(lower(context), '[\p{L}\p{N}]+')) as w from candidates),
p as (select a.candidate_id as event_id, b.candidate_id as foul_id, row_number() over (partition by a.candidate_id order by a.trigger_ms - b.trigger_ms, b.candidate_id) as k from w a join w b on a.asset_id = b.asset_id and a.run_id = b.run_id and a.event_type = 'GOAL' and b.event_type = 'ATTACK' and b.trigger_ms between greatest(0, a.trigger_ms - 15000) and a.trigger_ms
  and len(list_intersect(a.w, b.w)) / greatest(1, least(len(a.w), len(b.w))) >= 0.6e0) select event_id, foul_id from p where k = 1""")  # fmt: skip
def j13(t: Tables):
    rows = t("candidates").withColumn("words", X.token_set(F.col("context"), "raw"))
    side = lambda kind, p: rows.where(F.col("event_type") == kind).select("asset_id", "run_id", F.col("candidate_id").alias(f"{p}_id"), F.col("trigger_ms").alias(f"{p}_ms"), F.col("words").alias(f"{p}_words"))
    return E.preceding_foul(side("GOAL", "event"), side("ATTACK", "foul"), least=0.6)


@query("e13_final_signals", needs=("signals",), sql=ASSEMBLE + """, jd as (select anchor_id, event_type, ru, live, list_filter([case when ru > 0 then 'REPLAY_OF_EXISTING_GOAL' end, case when negative > 0 then 'REPLAY_COMMENTARY_REFERENCE' end, case when direct < 0.8 then 'INSUFFICIENT_EVENT_SPECIFIC_EVIDENCE' end,
  case when event_type = 'GOAL' and audio < 0.45 then 'GOAL_WITHOUT_REACTION_CORROBORATION' end, case when live < 0.55 then 'LOW_LIVE_EVENT_PROBABILITY' end, case when score < 0.52 then 'LOW_CANDIDATE_SCORE' end], lambda x : x is not null) as l from sc),
ev as (select distinct anchor_id, event_type, signal_type, confidence from su union all select anchor_id, event_type, 'LIVE_EVENT_CONTEXT', live from jd union all select anchor_id, event_type, 'EVENT_ASSOCIATION', ru from jd where ru > 0 union all select anchor_id, event_type, 'REJECTION_REASON:' || unnest(l), 1 from jd)
select anchor_id, event_type, signal_type, count(*) as n, round(max(confidence), 6) as top from ev group by all""")  # fmt: skip
def e13(t: Tables):
    a = E.anchors(t("signals"))
    support = E.attach_support(a, t("signals"))
    judged = E.rejection_reasons(E.score_candidates(E.family_confidences(a, support)))
    return E.final_signals(judged, support).groupBy("anchor_id", "event_type", "signal_type").agg(F.count(F.lit(1)).alias("n"), r6(F.max("confidence")).alias("top"))


@query("e2_emission_groups", needs=("signals",), sql="select asset_id, run_id, event_type, ts_ms, string_agg(distinct id::varchar, ',' order by id::varchar) as members, max(confidence) as top from signals where event_type is not null group by all")
def e2(t: Tables):
    rows = t("signals").withColumn("id", F.col("id").cast("string"))
    return E.emission_groups(rows, "id")


@query("c2_goal_manifest", needs=("candidates",), sql="""select candidate_id, 'frame' as kind, f as part, trigger_ms - (5 - f) * least(1000, trigger_ms // 5) as ts_ms from (select candidate_id, trigger_ms, unnest(range(0, 5)) as f from candidates where event_type = 'GOAL' and status = 'DETECTED' and trigger_ms > 0)
union all select candidate_id, 'clip', 0, start_ms from candidates where event_type = 'GOAL' and status = 'DETECTED'""")  # fmt: skip
def c2(t: Tables):
    goals = t("candidates").where("event_type = 'GOAL' and status = 'DETECTED'")
    frames = R.frame_times(goals).select("candidate_id", F.lit("frame").alias("kind"), F.col("frame").alias("part"), "ts_ms")
    return frames.unionByName(goals.select("candidate_id", F.lit("clip").alias("kind"), F.lit(0).alias("part"), F.col("start_ms").alias("ts_ms")))


def told(*openings: tuple[str, str]) -> str:
    """SQL for both engines: segments whose text has, by their place, one of some openings and endings put around it; the last of each round has none."""
    cases = " ".join(f"when {k} then '{a}' || text || '{b}'" for k, (a, b) in enumerate(openings))
    return f"select asset_id, seq, case seq % {len(openings) + 1} {cases} else text end as text from segments"


def with_openings(t: Tables, openings):
    return t("segments").sparkSession.sql(told(*openings).replace("from segments", "from {segments}"), segments=t("segments")).withColumn("norm", X.normalize_text(F.col("text")))


CALLS = (("Il ramène ", " dans le match"), ("GOOOOL! ", ""), ("On relance, une occasion ", " dans ce match"))


@query("x8_goal_calls", needs=("segments",), sql=f""", told as ({told(*CALLS)}), n as (select asset_id, seq, {NORM} as norm from told)
select asset_id, seq, regexp_matches(norm, '{X.ELONGATED_CALL}') as elongated, regexp_matches(norm, '{X.COMEBACK_CALL}') and not regexp_matches(norm, '{"|".join(X.COMEBACK_VETOES)}') as comeback from n""")
def x8(t: Tables):
    return with_openings(t, CALLS).select("asset_id", "seq", F.col("norm").rlike(X.ELONGATED_CALL).alias("elongated"), X.comeback_goal(F.col("norm")).alias("comeback"))


SEASONS = (("The first goal of the season: ", ""), ("Le premier but de saison, ", ""), ("A goal of the season ", ""))


@query("x9_goal_vetoes", needs=("segments",), sql=f""", told as ({told(*SEASONS)}) select asset_id, seq, regexp_matches({NORM}, '{X.SEASON_GOAL}') as veto from told""")
def x9(t: Tables):
    return with_openings(t, SEASONS).select("asset_id", "seq", F.col("norm").rlike(X.SEASON_GOAL).alias("veto"))


@query("x11_parse_score_text", needs=("ocr_readings",), sql=r"""select asset_id, ts_ms, h::int as home, a::int as away from (select *, regexp_extract(x, '(\d{1,2})\s*[-–—:]\s*(\d{1,2})', 1) as h, regexp_extract(x, '(\d{1,2})\s*[-–—:]\s*(\d{1,2})', 2) as a from (select *, replace(raw_text, 'O ', '0 ') as x from ocr_readings)) where h <> '' and h::int <= 20 and a::int <= 20""")
def x11(t: Tables):
    score = X.parse_score_text(F.replace("raw_text", F.lit("O "), F.lit("0 ")))
    return t("ocr_readings").select("asset_id", "ts_ms", score.alias("s")).where("s is not null").select("asset_id", "ts_ms", "s.home", "s.away")


@query("x15_containment", sql=r"""with w as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as a, lag(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) over (partition by conv_id order by turn) as b from conversations)
select conv_id, turn, case when len(a) > 0 and len(b) > 0 then round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) else 0 end as share from w where b is not null""")  # fmt: skip
def x15(t: Tables):
    from pyspark.sql import Window

    rows = t("conversations").withColumn("a", X.token_set(F.col("text"), "raw")).withColumn("b", F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return rows.select("conv_id", "turn", r6(X.containment(F.col("a"), F.col("b"))).alias("share"))


@query("x16_outcome_fields", needs=("signals",), sql="select id, case id % 3 when 0 then 'SAVE' when 1 then 'PENALTY_AWARDED' end as outcome from signals")
def x16(t: Tables):
    told = F.when(F.col("id") % 3 == 0, "OUTCOME=SAVE; phrase").when(F.col("id") % 3 == 1, "x OUTCOME=PENALTY_AWARDED;").otherwise("no field")
    return t("signals").select("id", V.outcome_of(told).alias("outcome"))


@query("x21_clip_category", needs=("candidates",), sql="select candidate_id, case event_type when 'GOAL' then 'goals' when 'SHOT' then 'shots' else 'other' end as category from candidates")
def x21(t: Tables):
    return t("candidates").select("candidate_id", R.clip_category(F.col("event_type")).alias("category"))


@query("e11_event_start", needs=("candidates", "signals"), sql=""", ev as (select * from candidates where event_type <> 'GOAL'), n as (select candidate_id, trigger_ms, g.ts_ms, coalesce(lag(g.ts_ms) over (partition by candidate_id order by g.ts_ms desc), trigger_ms) - g.ts_ms > 8000 as far from ev join signals g on g.asset_id = ev.asset_id and g.run_id = ev.run_id
  and g.signal_type = 'ATTACK_BUILDUP' and g.ts_ms between greatest(0, trigger_ms - 45000) and trigger_ms), b as (select *, max(far::int) over (partition by candidate_id order by ts_ms desc rows unbounded preceding) as k from n), c as (select candidate_id, min(ts_ms) as e from b where k = 0 group by 1)
select candidate_id, greatest(0, coalesce(e, trigger_ms - 5000)) as start_ms, case when e is not null then 'CONNECTED_BUILDUP' else 'PADDING' end as reason from ev left join c using (candidate_id)""")  # fmt: skip
def e11(t: Tables):
    events = t("candidates").where("event_type <> 'GOAL'").select("asset_id", "run_id", "candidate_id", "trigger_ms")
    return E.event_start(events, t("signals"))


@query("m5_replay_support", needs=("candidates",), sql=r""", w as (select candidate_id, asset_id, run_id, trigger_ms, status, list_distinct(regexp_extract_all(lower(context), '[\p{L}\p{N}]+')) as w from candidates where event_type = 'GOAL'),
p as (select a.candidate_id, b.candidate_id as live, row_number() over (partition by a.candidate_id order by len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) desc, b.trigger_ms desc, b.candidate_id) as k from w a join w b on a.asset_id = b.asset_id and a.run_id = b.run_id and a.status = 'REJECTED' and b.status = 'DETECTED'
  and b.trigger_ms between greatest(0, a.trigger_ms - 120000) and a.trigger_ms - 1) select candidate_id, live as supports from p where k = 1""")  # fmt: skip
def m5(t: Tables):
    rows = t("candidates").where("event_type = 'GOAL'").withColumn("words", X.token_set(F.col("context"), "raw"))
    live = rows.where("status = 'DETECTED'").select("asset_id", "run_id", F.col("candidate_id").alias("live_id"), F.col("trigger_ms").alias("live_ms"), F.col("words").alias("live_words"))
    return E.replay_support(rows.where("status = 'REJECTED'").select("asset_id", "run_id", "candidate_id", "trigger_ms", "words"), live)


@query("e3_replayed_goals", needs=("signals",), sql=""", cu as (select asset_id, run_id, id as cue_id, ts_ms as cue_ms from signals where signal_type = 'REPLAY_CONTEXT'), at_ as (select asset_id, run_id, id as attack_id, ts_ms as attack_ms from signals where signal_type = 'ATTACK_BUILDUP'),
fe as (select distinct asset_id, run_id, ts_ms as f from signals where event_type = 'GOAL'), p as (select cu.*, attack_id, row_number() over (partition by cue_id order by attack_ms desc, attack_id) as k from cu join at_ using (asset_id, run_id) where attack_ms between greatest(0, cue_ms - 120000) and cue_ms - 1
  and not exists (select 1 from fe where fe.asset_id = cu.asset_id and fe.run_id = cu.run_id and f > attack_ms and f < cue_ms)) select attack_id, arg_min(cue_id, cue_ms * 1000000 + cue_id) as cue_id from p where k = 1 group by attack_id""")  # fmt: skip
def e3(t: Tables):
    s = t("signals")
    pick = lambda test, p: s.where(test).select("asset_id", "run_id", F.col("id").alias(f"{p}_id"), F.col("ts_ms").alias(f"{p}_ms"))
    return E.confirm_replayed_goals(pick("signal_type = 'REPLAY_CONTEXT'", "cue"), pick("signal_type = 'ATTACK_BUILDUP'", "attack"), s.where("event_type = 'GOAL'").select("asset_id", "run_id", "ts_ms"))
