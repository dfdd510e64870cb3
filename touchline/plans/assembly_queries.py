"""Queries of the assembly: what it makes of signals of every type, each compared with the same rules in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import assembly as A
from touchline.operators import boundaries as B
from touchline.operators import clustering as C
from touchline.operators import discovery as G
from touchline.operators import similarity as L
from touchline.operators import story as S
from touchline.operators.lineage import settled
from touchline.plans.registry import Tables, query

TABLES = ("moments", "footage", "spoken")


def some(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def norm(text: str) -> str:
    return rf"trim(regexp_replace(strip_accents(lower({text})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def holds(text: str, phrases) -> str:
    return "(" + " or ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


def specific(kind: str, event: str) -> str:
    return f"""({event} is not null and {event} not in {some(A.NO_EVENTS)} and case when {event} = 'GOAL' then {kind} in ('TRANSCRIPT_GOAL', 'AUDIO_GOAL_HYPOTHESIS', 'OWN_GOAL')
    when {event} in ('SHOT', 'NEAR_MISS') then {kind} = 'TRANSCRIPT_SHOT' when {event} in ('PENALTY', 'MISSED_PENALTY', 'PENALTY_MISSED') then {kind} = 'TRANSCRIPT_PENALTY'
    when {event} in ('YELLOW_CARD', 'RED_CARD') then {kind} = 'TRANSCRIPT_CARD' else {kind} = 'TRANSCRIPT_EVENT' end)"""


def said(windows: str, keys: str) -> str:
    """SQL: keys and context of windows (asset_id, from_ms, to_ms)."""
    return f"""select {keys}, left(string_agg(text, ' ' order by start_ms, seq), 6000) as context
  from {windows} w join spoken s on s.asset_id = w.asset_id and s.start_ms <= w.to_ms and s.end_ms >= w.from_ms group by {keys}"""


def words(text: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({norm(text)}, ' '), lambda x: x <> '')))"


def names(of: str) -> str:
    return f"list_filter({of}, lambda x: length(x) >= 4 and x not in {some(L.IDENTITY_STOP_WORDS)})"


def alike(a: str, b: str) -> str:
    both, own = f"len(list_intersect({a}.ws, {b}.ws))", f"len(list_intersect({a}.ns, {b}.ns))"
    return f"({own} >= 3 and greatest({both} / (len({a}.ws) + len({b}.ws) - {both}), {own} / least(len({a}.ns), len({b}.ns))) >= 0.7e0)"


SAME = "{0}.asset_id = {1}.asset_id and {0}.run_id = {1}.run_id"
PAST, NEGATIVE = some(A.PAST), some(A.NEGATIVE)

ANCHORS = f""", po as (select m.*, duration_ms from moments m join footage using (asset_id) where ts_ms <= duration_ms),
ds as (select asset_id, run_id, ts_ms, signal_type, event_type, confidence, evidence, min(id) as id from po group by all),
own as (select * from po where {specific("signal_type", "event_type")}),
a0 as (select asset_id, run_id, event_type, ts_ms as trigger_ms, min(id) as anchor_id from own group by all),
m0 as (
  select distinct anchor_id, x.asset_id, x.run_id, ts_ms, signal_type, x.event_type, confidence, evidence
  from (select * from own union all select * from po k where signal_type = 'TRANSCRIPT_KEYWORD'
    and exists (select 1 from own o where {SAME.format("o", "k")} and o.event_type = k.event_type and o.ts_ms = k.ts_ms and o.obs_id = k.obs_id)) x
  join a0 on {SAME.format("a0", "x")} and a0.event_type = x.event_type and trigger_ms = ts_ms),
"""
CONFIRMED = f"""goals as (select asset_id, run_id, anchor_id as goal_id, trigger_ms as goal_ms from a0 where event_type = 'GOAL'),
wide as (select asset_id, anchor_id, greatest(0, trigger_ms - 30000) as from_ms, trigger_ms + 30000 as to_ms from a0 where event_type in ('GOAL', 'ATTACK')),
told as (select anchor_id, ws, {names("ws")} as ns from (select anchor_id, {words("context")} as ws from ({said("wide", "anchor_id")}))),
strong as (
  select g.*, phrase_sure, cue_ms, cue_sure, row_number() over (partition by g.goal_id order by cue_sure desc, cue_ms) as k
  from goals g join (select anchor_id, max(confidence) as phrase_sure from m0
    where signal_type = 'TRANSCRIPT_KEYWORD' and event_type = 'GOAL' and confidence >= 0.8e0 and starts_with(evidence, '{A.SCORING_PHRASE}') group by 1) s on s.anchor_id = goal_id
  join (select asset_id, run_id, ts_ms as cue_ms, confidence as cue_sure from ds where signal_type in {PAST} and confidence >= 0.68e0 and starts_with(evidence, '{A.CUE_PHRASE}')) c
    on {SAME.format("c", "g")} and cue_ms between goal_ms - 8000 and goal_ms),
attacks as (
  select asset_id, run_id, anchor_id as attack_id, trigger_ms as attack_ms from a0
  where event_type = 'ATTACK' and exists (select 1 from m0 where m0.anchor_id = a0.anchor_id and signal_type = 'TRANSCRIPT_EVENT' and confidence >= 0.62e0)
    and exists (select 1 from ds where {SAME.format("ds", "a0")} and signal_type = 'SPEECH_RATE_SPIKE' and confidence >= 0.58e0 and abs(ts_ms - trigger_ms) <= 8000)),
shown as (
  select s.*, attack_id, attack_ms, row_number() over (partition by s.goal_id order by attack_ms desc, attack_id) as n
  from strong s join attacks t on {SAME.format("t", "s")} and attack_ms between goal_ms - 120000 and goal_ms - 1 join told gw on gw.anchor_id = s.goal_id join told tw on tw.anchor_id = attack_id
  where k = 1 and (len(list_intersect(gw.ws, tw.ws)) / (len(gw.ws) + len(tw.ws) - len(list_intersect(gw.ws, tw.ws))) >= 0.1e0 or len(list_intersect(gw.ns, tw.ns)) >= 2)
    and not exists (select 1 from goals o where {SAME.format("o", "s")} and o.goal_ms > attack_ms and o.goal_ms < s.goal_ms)
    and not exists (select 1 from ds where {SAME.format("ds", "s")} and signal_type in ('SCORE_STATE_TRANSITION', 'INJURY_CONTEXT') and ts_ms between attack_ms and s.goal_ms)),
known as (
  select distinct s.goal_id from (from shown where n = 1) s join goals o on {SAME.format("o", "s")} and o.goal_ms < s.goal_ms join told ow on ow.anchor_id = o.goal_id join told gw on gw.anchor_id = s.goal_id
  where {alike("gw", "ow")}),
confirmed as (select * from shown where n = 1 and goal_id not in (select goal_id from known)),
"""
SUPPORT = f"""a1 as (
  select a0.asset_id, a0.run_id, a0.anchor_id, if(c.attack_id is null, a0.event_type, 'GOAL') as a_event, trigger_ms
  from a0 left join confirmed c on c.attack_id = a0.anchor_id where a0.anchor_id not in (select goal_id from confirmed)),
m1 as (
  select * from m0 where anchor_id not in (select goal_id from confirmed)
  union all select attack_id, asset_id, run_id, attack_ms, 'EVENT_RECONSTRUCTION', 'GOAL', phrase_sure, '{A.CONFIRMED}' from confirmed
  union all select attack_id, asset_id, run_id, attack_ms, 'EVENT_ASSOCIATION', 'GOAL', cue_sure, 'REPLAY_EVIDENCE_FOR_LIVE_EVENT; cue at ' || cue_ms || ' ms' from confirmed),
a2 as (
  select a.*, (select max(b.trigger_ms) from a1 b where {SAME.format("b", "a")} and b.trigger_ms < a.trigger_ms) as anchor_ms,
    (select max(b.trigger_ms) from a1 b where {SAME.format("b", "a")} and b.a_event = 'GOAL' and b.trigger_ms < a.trigger_ms) as goal_ms
  from a1 a),
near as (
  select a.*, g.id, g.ts_ms, g.signal_type as kind, g.event_type as s_event, g.confidence as sure, g.evidence, g.ts_ms - trigger_ms as gap
  from a2 a join ds g on {SAME.format("g", "a")} and g.ts_ms between trigger_ms - 120000 and trigger_ms + 30000),
listed as (
  select distinct anchor_id, a_event, trigger_ms, ts_ms, kind, s_event, sure, evidence, gap from near where case
    when kind in {PAST} then gap <= 0 when kind in {NEGATIVE} then gap between -8000 and 0 when kind = 'INJURY_CONTEXT' then gap <= 0 when kind = 'RESTART_CONTEXT' then gap <= 30000
    when kind = 'ATTACK_BUILDUP' then gap between -45000 and 0 and ts_ms >= coalesce(anchor_ms, ts_ms)
    when a_event = 'GOAL' and kind = 'SCORE_STATE_TRANSITION' then gap between 0 and 30000
    when a_event = 'GOAL' and (kind = 'TRANSCRIPT_SHOT' or (kind = 'EVENT_RECONSTRUCTION' and s_event = 'GOAL')
      or (kind = 'TRANSCRIPT_EVENT' and s_event in ('ATTACK', 'COUNTER_ATTACK', 'BIG_CHANCE', 'SHOT', 'PENALTY'))) then abs(gap) <= 20000
    when a_event = 'GOAL' and kind = 'SHOT_OUTCOME_CONTEXT' then abs(gap) <= 8000
    when kind = 'AUDIO_ENERGY_RISE' then gap between -45000 and 0 and ts_ms >= coalesce(anchor_ms, ts_ms)
    else abs(gap) <= 8000 and (kind in {some((*A.SAID, "SPEECH_RATE_SPIKE", *A.VOICE, *A.LOUD))} or (s_event = 'CELEBRATION' and kind in {some(A.SPOKEN)})) end
  union select anchor_id, a_event, trigger_ms, m1.ts_ms, signal_type, event_type, confidence, evidence, m1.ts_ms - trigger_ms from m1 join a2 using (anchor_id)),
"""


def top(test: str) -> str:
    return f"coalesce(max(sure) filter (where {test}), 0)"


def any_(test: str) -> str:
    return f"coalesce(bool_or({test}), false)"


AGAINST = f"(a_event = 'GOAL' and kind in {some((*A.PAST, *A.NEGATIVE))} and sure >= 0.68e0 and gap between -8000 and 0)"
CONFIRMS = f"(kind = 'EVENT_RECONSTRUCTION' and s_event = 'GOAL' and starts_with(evidence, '{A.CONFIRMED}'))"
EVIDENCE = f"""ev as (
  select anchor_id, a_event, trigger_ms, {top(f"{specific('kind', 'a_event')} or (a_event = 'GOAL' and {CONFIRMS})")} as direct,
    greatest({top(f"kind in {some(A.VOICE)}")}, {top(f"kind in {some(A.LOUD)}")} * 0.6e0) as audio, {top(f"kind in {some(A.SAID)}")} as textual, {top("kind = 'SPEECH_RATE_SPIKE'")} as rate,
    {top(f"s_event = 'CELEBRATION' and kind in {some(A.SPOKEN)}")} as celebration,
    greatest({top("kind = 'ATTACK_BUILDUP' or (kind = 'TRANSCRIPT_EVENT' and s_event in ('ATTACK', 'COUNTER_ATTACK'))")}, {top("kind = 'AUDIO_ENERGY_RISE'")} * 0.25e0) as buildup,
    {top(f"kind in {PAST}")} as replay, {top(AGAINST)} as negative, {top("kind = 'RETROSPECTIVE_CONTEXT' and abs(gap) <= 30000 and sure >= 0.68e0")} as looking_back,
    {any_(CONFIRMS)} as confirmed, {any_(f"kind = 'TRANSCRIPT_KEYWORD' and s_event = 'GOAL' and sure >= 0.8e0 and starts_with(evidence, '{A.SCORING_PHRASE}')")} as phrase,
    {any_(f"s_event = 'GOAL' and (kind = 'AUDIO_GOAL_HYPOTHESIS' or (kind = 'TRANSCRIPT_GOAL' and starts_with(evidence, '{A.INFERRED}')))")} as inferred,
    {any_(f"{AGAINST} and kind = 'NEGATION_CONTEXT'")} as negated, {any_(f"{AGAINST} and kind = 'CORRECTION_CONTEXT'")} as corrected,
    {any_(f"{AGAINST} and kind = 'HISTORICAL_REFERENCE'")} as historical, {any_(f"{AGAINST} and kind = 'REPLAY_CONTEXT'")} as replay_told,
    {any_(f"{AGAINST} and kind = 'RETROSPECTIVE_CONTEXT'")} as past_told, {any_(f"kind in {PAST} and gap <= 0 and sure >= 0.68e0")} as replayed,
    {any_("kind = 'INJURY_CONTEXT' and gap between -90000 and 0")} as injured, {any_("a_event = 'GOAL' and kind = 'RESTART_CONTEXT' and gap between -30000 and -1")} as restarted,
    {any_("kind = 'SCORE_STATE_TRANSITION'")} as score_moved, {any_("kind = 'TRANSCRIPT_SHOT' and abs(gap) <= 10000")} as shot_near,
    {any_("kind = 'TRANSCRIPT_SHOT' and abs(gap) <= 20000")} as shot_around, {any_("s_event in ('SAVE', 'MISSED_PENALTY') and abs(gap) <= 20000")} as saved,
    {any_("kind = 'ATTACK_BUILDUP' and gap between -45000 and -1")} as led, {any_("kind = 'TRANSCRIPT_EVENT' and s_event = 'ATTACK' and gap between 1 and 15000")} as play_on
  from listed group by all),
spans as (
  select asset_id, anchor_id, which, greatest(0, trigger_ms - s) as from_ms, if(which = 'local', least(trigger_ms + s, duration_ms), trigger_ms + s) as to_ms
  from a2 join footage using (asset_id) join (values ('penalty', 20000), ('corner', 30000), ('local', 8000)) v(which, s) on a_event = 'GOAL'),
spoke as (
  select anchor_id, bool_or(which = 'penalty' and {holds("n", A.PENALTIES)} and not {holds("n", A.MISSED)}) as penalty, bool_or(which = 'corner' and {holds("n", A.CORNERS)}) as corner,
    max(context) filter (where which = 'local') as local
  from (select *, {norm("context")} as n from ({said("spans", "anchor_id, which")})) group by 1),
shots as (select anchor_id, ts_ms as p_ms, sure, row_number() over (partition by anchor_id order by ts_ms desc, sure desc) as k from near
  where a_event = 'GOAL' and kind = 'TRANSCRIPT_SHOT' and s_event = 'SHOT' and gap between -45000 and -1 and ts_ms >= coalesce(goal_ms, ts_ms)),
builds as (select anchor_id, ts_ms as p_ms, sure, row_number() over (partition by anchor_id order by abs(gap), id) as k from near
  where a_event = 'GOAL' and kind = 'EVENT_RECONSTRUCTION' and s_event = 'GOAL' and abs(gap) <= 20000 and (starts_with(evidence, 'Event action is anchored') or starts_with(evidence, 'Goal action is anchored'))),
fouled as (
  select a.asset_id, a.anchor_id, a.trigger_ms, g.id as foul_id, g.ts_ms as foul_ms from a2 a join ds g on {SAME.format("g", "a")} and g.signal_type = 'TRANSCRIPT_EVENT' and g.event_type = 'FOUL'
  where a.a_event in ('PENALTY', 'YELLOW_CARD', 'RED_CARD') and g.ts_ms between greatest(0, a.trigger_ms - 15000) and a.trigger_ms),
sides as (select asset_id, anchor_id, foul_id, side, greatest(0, p_ms - 2500) as from_ms, p_ms + 2500 as to_ms
  from (select *, 'foul' as side, foul_ms as p_ms from fouled union all select *, 'event', trigger_ms from fouled)),
compared as (
  select anchor_id, foul_id, max(w) filter (where side = 'foul') as a, max(w) filter (where side = 'event') as b
  from (select anchor_id, foul_id, side, list_filter(string_split({norm("context")}, ' '), lambda x: x <> '') as w from ({said("sides", "anchor_id, foul_id, side")})) group by all),
fouls as (
  select anchor_id, foul_ms, foul_sure, row_number() over (partition by anchor_id order by foul_ms desc, foul_id) as k
  from (select anchor_id, foul_id, len(list_intersect(a, b)) / least(len(a), len(b)) as foul_sure from compared where len(a) > 0 and len(b) > 0) join fouled using (anchor_id, foul_id)
  where foul_sure >= 0.25e0),
base as (
  select a2.asset_id, a2.run_id, ev.*, duration_ms, coalesce(penalty, false) as penalty, coalesce(corner, false) as corner, local,
    coalesce(if(confirmed, ev.trigger_ms, null), s.p_ms, b.p_ms) as action_ms, coalesce(s.sure, b.sure) as action_sure, foul_ms, foul_sure, greatest(audio, textual, rate * 0.25e0, celebration * 0.75e0) as reaction
  from a2 join ev using (anchor_id) join footage using (asset_id) left join spoke using (anchor_id) left join (from shots where k = 1) s using (anchor_id)
  left join (from builds where k = 1) b using (anchor_id) left join (from fouls where k = 1) f using (anchor_id)),
weighed as (
  select *, g and inferred and not explicit and not score_moved and not confirmed and not penalty_scored and not in_order as hypothesis from (
    select *, a_event = 'GOAL' as g, a_event = 'GOAL' and negative = 0 and (phrase or confirmed) as explicit, a_event = 'GOAL' and (past_told or historical or looking_back > 0) as retold,
      a_event = 'GOAL' and penalty and shot_near and reaction >= 0.45e0 and not saved as penalty_scored, a_event = 'GOAL' and corner and shot_around as set_piece,
      a_event = 'GOAL' and reaction >= 0.45e0 and textual >= 0.68e0 and led and shot_around as in_order, a_event = 'GOAL' and replay >= 0.68e0 as told_again
    from base)),
"""
ATTACK_CUES = f"(kind = 'ATTACK_BUILDUP' or (kind = 'TRANSCRIPT_EVENT' and s_event in {some(B.ATTACKS)}))"
BUILDS = f"(kind in ('ATTACK_BUILDUP', 'AUDIO_ENERGY_RISE') or (kind = 'TRANSCRIPT_SHOT' and s_event = 'SHOT') or (kind = 'TRANSCRIPT_EVENT' and s_event in {some(B.ATTACKS)}))"
TAKEN = """((kind = 'TRANSCRIPT_SHOT' and s_event = 'SHOT') or (kind = 'TRANSCRIPT_PENALTY' and s_event = 'PENALTY') or (kind = 'TRANSCRIPT_EVENT' and s_event in ('SHOT', 'PENALTY')))"""
OTHER = f"(({BUILDS} and kind = 'TRANSCRIPT_SHOT') or (kind in ('TRANSCRIPT_PENALTY', 'TRANSCRIPT_KEYWORD') and s_event = 'PENALTY'))"
WINDOWS = f"""events as (
  select asset_id, run_id, anchor_id, a_event, a_event = 'GOAL' as g, trigger_ms, duration_ms, coalesce(action_ms, foul_ms, trigger_ms) as ref_ms, coalesce(action_ms, foul_ms) is not null as rebuilt,
    greatest(0, coalesce(action_ms, foul_ms, trigger_ms) - 45000) as search_ms from weighed),
reach as (
  select e.*, s.id, s.ts_ms, s.signal_type as kind, s.event_type as s_event, s.confidence as sure, s.evidence from events e join ds s on {SAME.format("s", "e")} and s.ts_ms between search_ms and ref_ms + 120000),
fenced as (
  select e.*, max(ts_ms) filter (where kind in {some(B.GOAL_FENCES)} and ts_ms < ref_ms) as fence_ms, max(ts_ms) filter (where kind in {some(B.REPLAYS)} and ts_ms > search_ms and ts_ms < ref_ms) as past_ms,
    min(ts_ms) filter (where g and kind in {some(B.REPLAYS)} and ts_ms > ref_ms) as replay_ms, min(ts_ms) filter (where g and kind = 'RESTART_CONTEXT' and ts_ms > ref_ms and ts_ms - ref_ms <= 30000) as restart_ms
  from events e left join (select anchor_id, ts_ms, kind from reach) r using (anchor_id) group by all),
opened as (
  select *, if(g, greatest(search_ms, coalesce(fence_ms, search_ms)), search_ms) as from_ms,
    (select max(b.trigger_ms) from a2 b where {SAME.format("b", "f")} and b.a_event = 'GOAL' and b.anchor_id <> f.anchor_id and b.trigger_ms < f.ref_ms and b.trigger_ms >= f.search_ms) as mark_ms,
    least(duration_ms, greatest(ref_ms, trigger_ms) + if(g, 20000, 8000), replay_ms, restart_ms) as limit_ms
  from fenced f),
seen as (
  select o.*, r.id, r.ts_ms, r.kind, r.s_event, r.sure, r.evidence from opened o join (select anchor_id, id, ts_ms, kind, s_event, sure, evidence from reach) r using (anchor_id)
  where r.ts_ms between from_ms and ref_ms and r.sure >= 0.55e0 and r.ts_ms >= coalesce(mark_ms, 0) and (g or r.ts_ms > coalesce(past_ms, -1))),
decisive as (
  select anchor_id, ts_ms as d_ms, sure as d_sure, row_number() over (partition by anchor_id order by first, ts_ms desc, id) as k
  from (select *, case when g and {TAKEN} then 1 when not g and {OTHER} then 1 when not g and kind = 'AUDIO_ENERGY_RISE' then 2 end as first from seen) where first is not null),
cues as (
  select asset_id, anchor_id, ref_ms, d_ms, ts_ms, arg_max(sure, id) as sure, arg_max(kind, id) as kind from seen left join (from decisive where k = 1) using (anchor_id)
  where g and {ATTACK_CUES} and (d_ms is null or ts_ms < d_ms) group by all),
steps as (select *, coalesce(lag(ts_ms) over (partition by anchor_id order by ts_ms desc), d_ms) as b_ms from cues),
holes as (
  select anchor_id, ts_ms, max(case when r < b_ms then start_ms - r else 0 end) as hole, max(end_ms) as e from (
    select c.anchor_id, c.ts_ms, c.b_ms, start_ms, end_ms,
      greatest(c.ts_ms, coalesce(max(end_ms) over (partition by anchor_id, ts_ms order by start_ms, end_ms rows between unbounded preceding and 1 preceding), c.ts_ms)) as r
    from steps c join spoken s on s.asset_id = c.asset_id and start_ms <= c.b_ms and end_ms >= c.ts_ms) group by all),
chained as (
  select *, max(far::int) over (partition by anchor_id order by ts_ms desc rows unbounded preceding) as broken from (
    select s.*, b_ms is not null and (b_ms - ts_ms > 32000 or coalesce(hole, 0) > 8000 or b_ms - greatest(ts_ms, coalesce(e, ts_ms)) > 8000) as far from steps s left join holes using (anchor_id, ts_ms))),
attacked as (
  select anchor_id, min(ts_ms) as attack_ms, arg_min(sure, ts_ms) as attack_sure from chained where broken = 0 group by anchor_id, ref_ms, d_ms
  having d_ms is not null or count(*) > 1 or ref_ms - min(ts_ms) <= 8000 or arg_min(kind, ts_ms) = 'ATTACK_BUILDUP'),
loud as (
  select *, sum(nw) over (partition by anchor_id order by ts_ms) as part from (
    select *, case when ts_ms - lag(ts_ms) over (partition by anchor_id order by ts_ms) > 4000 then 1 else 0 end as nw from (
      select anchor_id, ref_ms, ts_ms, sure, case when kind in ('AUDIO_ENERGY_RISE', 'AUDIO_SPIKE', 'AUDIO_SUSTAINED') then 'ENERGY' when kind in ('SPEECH_RATE_SPIKE', 'PITCH_RISE') then kind end as family
      from seen where g and ts_ms < ref_ms and ref_ms - ts_ms <= 48000 and sure >= 0.6e0) where family is not null)),
rising as (
  select *, row_number() over (partition by anchor_id order by to_ms desc) as k from (
    select anchor_id, min(ts_ms) as loud_ms, max(ts_ms) as to_ms, max(sure) as loud_sure from loud group by anchor_id, ref_ms, part having count(distinct family) >= 2 and ref_ms - max(ts_ms) <= 24000)),
rises as (select anchor_id, ts_ms as rise_ms, sure as rise_sure, row_number() over (partition by anchor_id order by ts_ms desc, id) as k from seen where g and kind = 'AUDIO_ENERGY_RISE' and sure >= 0.65e0 and ts_ms < ref_ms),
spots as (select anchor_id, asset_id, from_ms, ref_ms as to_ms, ts_ms as spot_ms, sure as spot_sure, row_number() over (partition by anchor_id order by ts_ms, id) as k
  from seen where g and s_event = 'PENALTY' and kind in ('TRANSCRIPT_PENALTY', 'TRANSCRIPT_EVENT', 'TRANSCRIPT_KEYWORD')),
spotted as (select anchor_id from ({said("(from spots where k = 1)", "anchor_id")}) where {holds(norm("context"), B.PENALTY_WORDS)}),
setups as (select anchor_id, min(start_ms) as setup_ms from opened o join spoken s on s.asset_id = o.asset_id and start_ms >= from_ms and start_ms < ref_ms where g and {holds(norm("text"), B.PENALTY_SETUP)} group by 1),
firsts as (select anchor_id, ts_ms as built_ms, kind as built_kind, sure as built_sure, row_number() over (partition by anchor_id order by ts_ms, id) as k from seen where not g and {BUILDS}),
glows as (
  select anchor_id, max(ts_ms) as glow from opened join (select anchor_id, ts_ms, kind, s_event from reach) using (anchor_id)
  where ts_ms between ref_ms and limit_ms and (kind in {some(B.AFTERGLOW)} or s_event = 'CELEBRATION') group by 1),
begun as (
  select o.*, coalesce(glow, least(greatest(ref_ms, trigger_ms), limit_ms)) as glow_at, case
      when g and spotted.anchor_id is not null then {{'p': spot_ms - 5000, 'sure': spot_sure, 'reason': 'START=PENALTY_SETUP'}} when g and setup_ms is not null then {{'p': setup_ms - 5000, 'sure': 0.64e0, 'reason': 'START=PENALTY_SETUP'}}
      when attack_ms is not null then {{'p': attack_ms - 5000, 'sure': attack_sure, 'reason': 'START=CONNECTED_ATTACK'}} when loud_ms is not null then {{'p': loud_ms - 5000, 'sure': loud_sure, 'reason': 'START=AUDIO_BUILDUP'}}
      when rise_ms is not null then {{'p': rise_ms - 5000, 'sure': rise_sure, 'reason': 'START=ATTACK_INTENSITY_RISE'}}
      when built_ms is not null then {{'p': built_ms - 5000, 'sure': built_sure, 'reason': if(built_kind = 'AUDIO_ENERGY_RISE', 'START=ATTACK_INTENSITY_RISE', 'START=BUILDUP_SIGNAL')}}
      when d_ms is not null then {{'p': d_ms - 5000, 'sure': d_sure, 'reason': 'START=DECISIVE_ACTION'}} when g or rebuilt then {{'p': ref_ms - 30000, 'sure': 0.55e0, 'reason': 'START=FALLBACK_PRE_ROLL'}}
      else {{'p': trigger_ms - 5000, 'sure': 0.55e0, 'reason': 'START=PADDING'}} end as st
  from opened o left join (from decisive where k = 1) using (anchor_id) left join attacked using (anchor_id) left join (from rising where k = 1) using (anchor_id) left join (from rises where k = 1) using (anchor_id)
  left join (select anchor_id, spot_ms, spot_sure from spots where k = 1) using (anchor_id) left join spotted using (anchor_id) left join setups using (anchor_id)
  left join (from firsts where k = 1) using (anchor_id) left join glows using (anchor_id)),
e1 as (
  select *, greatest(0, st.p) as s, least(duration_ms, coalesce(restart_ms, glow_at + 8000)) as e,
    case when restart_ms is not null then 'END=IMMEDIATE_RESTART' when replay_ms <= glow_at then 'END=REPLAY_BOUNDARY' when glow_at > ref_ms then 'END=GOAL_REACTION' else 'END=FALLBACK_POST_WINDOW' end as er from begun),
e2 as (select * replace (if(coalesce(replay_ms <= e, false), replay_ms, e) as e, if(coalesce(replay_ms <= e, false), 'END=REPLAY_BOUNDARY', er) as er) from e1),
e3 as (select * replace (if(e <= s, least(duration_ms, greatest(s, ref_ms) + 8000), e) as e, if(e <= s, least(s, greatest(0, ref_ms - 1)), s) as s) from e2),
e4 as (
  select *, least(s, trigger_ms) as s4, greatest(e, trigger_ms) as e4, if(s > trigger_ms, st.reason || '; WINDOW=EXTENDED_TO_INCLUDE_TRIGGER', st.reason) as sr,
    if(e < trigger_ms, er || '; WINDOW=EXTENDED_TO_INCLUDE_TRIGGER', er) as er4 from e3),
e5 as (
  select *, if(e4 - s4 > 60000, least(greatest(0, e4 - 60000), trigger_ms), s4) as s5, if(e4 - s4 > 60000 and greatest(0, e4 - 60000) > trigger_ms, least(e4, trigger_ms + 60000), e4) as e5,
    if(e4 - s4 > 60000, sr || '; START=MAXIMUM_DURATION_TRIM', sr) as start_reason from e4),
e6 as (select *, greatest(0, least(s5, duration_ms - 1)) as start_ms from e5),
windows as (
  select anchor_id, start_ms, greatest(start_ms + 1, least(e5, duration_ms)) as end_ms, st.sure as start_sure, if(glow_at > trigger_ms, 0.78e0, 0.55e0) as end_sure, start_reason,
    er4 || if(restart_ms is not null, '; POST_RESTART', '') || if(coalesce(replay_ms <= greatest(start_ms + 1, least(e5, duration_ms)), false), '; REPLAY_CONTEXT', '') as end_reason from e6),
"""


def judged(source: str, again: str) -> str:
    """SQL: what judge() adds to rows of source; again says which goals are replays."""
    open_goal = "g and not explicit and not score_moved"
    tests = {
        "REPLAY_OF_EXISTING_GOAL": again, "REPLAY_COMMENTARY_REFERENCE": "replay_told", "NEGATED_GOAL_REFERENCE": "negated", "CORRECTED_GOAL_REFERENCE": "corrected", "HISTORICAL_GOAL_REFERENCE": "historical",
        "INJURY_THEN_REPLAY": f"{again} and replayed and injured", "POST_RESTART": f"{again} and restarted and not score_moved", "NO_NEW_SCORE_TRANSITION": f"{again} and restarted and not score_moved",
        "RETROSPECTIVE_GOAL_REFERENCE": f"{open_goal} and retold", "GOAL_HYPOTHESIS_UNCONFIRMED": "hypothesis", "SET_PIECE_SHOT_WITHOUT_SCORING_CONFIRMATION": "hypothesis and set_piece",
        "NON_SCORING_SHOT_CONTINUED_PLAY": f"{open_goal} and not penalty_scored and shot_near and play_on", "INSUFFICIENT_EVENT_SPECIFIC_EVIDENCE": "direct < if(a_event = 'ATTACK', 0.62e0, 0.8e0)",
        "GOAL_WITHOUT_REACTION_CORROBORATION": "g and round(reaction, 9) < 0.45e0 and not explicit",
        "ATTACK_WITHOUT_LOCAL_BUILDUP_AND_REACTION": "a_event = 'ATTACK' and (buildup < 0.7e0 or round(audio, 9) < 0.55e0)", "LOW_LIVE_EVENT_PROBABILITY": "live < 0.55e0", "LOW_CANDIDATE_SCORE": "score < 0.52e0",
    }
    reasons = ", ".join(f"if({t}, '{n}', null)" for n, t in tests.items())
    return f"""select *, if(len(reasons) = 0, 'DETECTED', 'REJECTED') as status from (
  select *, list_filter([{reasons}], lambda x: x is not null) as reasons from (
    select *, round(greatest(0, least(1, 0.20e0 + 0.45e0 * direct + 0.25e0 * audio + 0.08e0 * textual + 0.07e0 * buildup - 0.40e0 * if({again}, replay, 0) - 0.45e0 * negative)), 9) as live,
      round(greatest(0, least(0.98e0, 0.70e0 * direct + 0.30e0 * audio + if(direct > 0 and audio > 0, 0.025e0, 0) + 0.05e0 * buildup - 0.20e0 * if({again}, replay, 0) - 0.45e0 * negative)), 9) as score
    from {source}))"""


FOLD = f"""spoken_in as (select asset_id, anchor_id, start_ms as from_ms, end_ms as to_ms from windows join a2 using (anchor_id)),
told_in as (select weighed.*, w.* exclude (anchor_id), context from weighed join windows w using (anchor_id) left join ({said("spoken_in", "anchor_id")}) c using (anchor_id)),
free as (
  select asset_id, run_id, anchor_id, trigger_ms, status = 'DETECTED' as stands, told_again and not score_moved and local is not null as asks, {words("coalesce(local, '')")} as lw, {words("coalesce(context, '')")} as cw
  from ({judged("told_in", "false")}) where g),
likely as (
  select l.anchor_id, list(r.anchor_id) as earlier
  from (select *, lw as ws, {names("lw")} as ns from free where asks) l join (select *, cw as ws, {names("cw")} as ns from free where stands) r on {SAME.format("l", "r")} and r.trigger_ms < l.trigger_ms and {alike("l", "r")}
  group by 1),
lined as (
  select f.asset_id, f.run_id, f.anchor_id, stands, coalesce(earlier, []) as earlier, row_number() over (partition by f.asset_id, f.run_id order by f.trigger_ms, f.anchor_id) as i
  from free f left join likely using (anchor_id) where stands or earlier is not null),
folded as (
  select asset_id, run_id, 0::bigint as i, 0::bigint as anchor_id, false as is_replay, []::bigint[] as standing from (select distinct asset_id, run_id from lined)
  union all
  select l.asset_id, l.run_id, l.i, l.anchor_id, list_has_any(l.earlier, standing), if(l.stands and not list_has_any(l.earlier, standing), list_append(standing, l.anchor_id), standing)
  from folded f join lined l on {SAME.format("l", "f")} and l.i = f.i + 1),
final as ({judged("(select t.*, coalesce(f.is_replay, false) as is_replay from told_in t left join (from folded where i > 0) f using (anchor_id))", "is_replay")})
"""
WHOLE = ANCHORS + CONFIRMED + SUPPORT + EVIDENCE + WINDOWS + FOLD


def made(t: Tables, told: bool = False) -> A.Assembled:
    return A.assemble(t("moments"), t("spoken"), t("footage"), told=told)


def r6(c):
    return F.round(c, 6)


@query("e1_assembly", needs=TABLES, sql=WHOLE + """select asset_id, run_id, anchor_id, a_event, trigger_ms, start_ms, end_ms, round(live, 6) as live, round(score, 6) as score, status,
  array_to_string(reasons, ',') as reasons, md5(coalesce(context, '')) as context_md5 from (
  select *, row_number() over (partition by asset_id, run_id order by (status <> 'DETECTED')::int, score desc, start_ms, a_event, anchor_id) as k from final) where k <= 100""")  # fmt: skip
def e1(t: Tables):
    found = made(t, told=True)
    rows = A.ranked(found.candidates).join(found.contexts, "anchor_id", "left")
    return rows.select(
        *A.KEY, "anchor_id", "a_event", "trigger_ms", "start_ms", "end_ms", r6("live").alias("live"), r6("score").alias("score"), "status", F.array_join("reasons", ",").alias("reasons"), F.md5(F.coalesce("context", F.lit(""))).alias("context_md5")
    )


@query("e3_confirmed_goals", needs=TABLES, sql=ANCHORS + CONFIRMED.rstrip().rstrip(",") + "select goal_id, attack_id, cue_ms, phrase_sure, cue_sure from confirmed")
def e3(t: Tables):
    rows = settled(A.pool(t("moments"), t("footage")))
    anchor, members = map(settled, A.anchors(rows))
    found = A.confirmed_goals(anchor, members, settled(A.distinct_signals(rows)), A.heard(t("spoken"), anchor))
    return found.select("goal_id", "attack_id", "cue_ms", "phrase_sure", "cue_sure")


@query("e6_goal_evidence", needs=TABLES, sql=ANCHORS + CONFIRMED + SUPPORT + EVIDENCE.rstrip().rstrip(",") + """select anchor_id, explicit, retold, penalty_scored, in_order, set_piece, told_again, hypothesis, restarted, injured, play_on, score_moved,
  round(direct, 6) as direct, round(audio, 6) as audio, round(textual, 6) as textual, round(buildup, 6) as buildup, round(replay, 6) as replay, round(negative, 6) as negative, round(reaction, 6) as reaction from weighed""")  # fmt: skip
def e6(t: Tables):
    flags = ["explicit", "retold", "penalty_scored", "in_order", "set_piece", "told_again", "hypothesis", "restarted", "injured", "play_on", "score_moved"]
    return made(t).candidates.select("anchor_id", *flags, *(r6(c).alias(c) for c in ("direct", "audio", "textual", "buildup", "replay", "negative", "reaction")))


@query("e9_same_action_goals", needs=TABLES, sql=WHOLE + "select anchor_id, trigger_ms, status from final where is_replay")
def e9(t: Tables):
    return made(t).candidates.where("is_replay").select("anchor_id", "trigger_ms", "status")


@query("e12_event_windows", needs=TABLES, sql=ANCHORS + CONFIRMED + SUPPORT + EVIDENCE + WINDOWS.rstrip().rstrip(",") + "select anchor_id, start_ms, end_ms, round(start_sure, 6) as start_sure, end_sure, start_reason, end_reason from windows")
def e12(t: Tables):
    return made(t).candidates.select("anchor_id", "start_ms", "end_ms", r6("start_sure").alias("start_sure"), "end_sure", "start_reason", "end_reason")


STORED = f""", stored as (
  select anchor_id, kind as signal_type, s_event as event_type, sure as confidence, ts_ms, evidence from listed join (select anchor_id, start_ms, end_ms from final) using (anchor_id) where ts_ms between start_ms and end_ms
  union all select anchor_id, 'EVENT_RECONSTRUCTION', a_event, action_sure, action_ms, 'Goal action reconstructed' from final where not confirmed and action_ms between start_ms and end_ms
  union all select anchor_id, 'EVENT_RECONSTRUCTION', a_event, foul_sure, foul_ms, 'Sequence anchored to the preceding foul' from final where foul_ms between start_ms and end_ms
  union all select anchor_id, 'LIVE_EVENT_CONTEXT', a_event, live, trigger_ms, if(negative > 0, 'CLASSIFICATION=SUPPRESSED_GOAL', 'CLASSIFICATION=LIVE_EVENT') from final
  union all select anchor_id, 'REPLAY_CONTEXT', a_event, replay, trigger_ms, if(is_replay, 'CLASSIFICATION=REPLAY_OF_EXISTING_GOAL', 'REPLAY/RETROSPECTIVE_CONTEXT') from final where told_again
  union all select anchor_id, unnest(['POST_EVENT_COMMENTARY', 'UNRELATED_ACTION_CONTEXT']), a_event, replay, trigger_ms,
    unnest(['CLASSIFICATION=POST_EVENT_COMMENTARY', 'POST_RESTART_NO_NEW_SCORE_TRANSITION']) from final where is_replay and restarted and not score_moved
  union all select anchor_id, 'INJURY_CONTEXT', a_event, 0.9e0, trigger_ms, 'INJURY_THEN_REPLAY' from final where is_replay and replayed and injured
  union all select anchor_id, 'EVENT_ASSOCIATION', a_event, 0.82e0, trigger_ms, 'PENALTY_ATTEMPT_WITH_INDEPENDENT_REACTION' from final where penalty_scored
  union all select anchor_id, 'UNRELATED_ACTION_CONTEXT', a_event, 0.82e0, trigger_ms, 'SET_PIECE_SHOT_WITHOUT_SCORING_CONFIRMATION' from final where hypothesis and set_piece
  union all select anchor_id, 'RETROSPECTIVE_CONTEXT', a_event, looking_back, trigger_ms, 'RETROSPECTIVE_GOAL_REFERENCE' from final where retold and not explicit and not score_moved
  union all select anchor_id, 'EVENT_BOUNDARY', a_event, start_sure, start_ms, start_reason from final union all select anchor_id, 'EVENT_AFTERGLOW', a_event, end_sure, end_ms, end_reason from final
  union all select anchor_id, 'EVENT_ASSOCIATION', a_event, foul_sure, trigger_ms, 'Associated with the preceding foul' from final where foul_ms is not null
  union all select anchor_id, 'REJECTION_REASON', a_event, greatest(0.5e0, 1 - live), trigger_ms, unnest(reasons) from final)
"""


def codes(of: dict[str, str], column: str) -> str:
    return f"case {column} " + " ".join(f"when '{a}' then '{b}'" for a, b in of.items()) + " end"


TIES = f"(signal_type = 'EVENT_ASSOCIATION' and (starts_with(evidence, '{S.ASSOCIATED[0]}') or starts_with(evidence, '{S.ASSOCIATED[1]}')))"
ATOMS = STORED + f""", meant as (
  select anchor_id, score, detected, c_event, trigger_ms, ts_ms, signal_type, confidence, evidence, {TIES} as ties, case when {TIES} then 'REPLAY_EVENT'
    when signal_type = 'SHOT_OUTCOME_CONTEXT' then if(outcome in {some(S.OUTCOMES)}, outcome, 'OTHER') when event_type in ('MISSED_PENALTY', 'FOUL', 'CELEBRATION') then event_type
    when event_type in ('YELLOW_CARD', 'RED_CARD') then 'CARD' when spoken and event_type in ('ATTACK', 'COUNTER_ATTACK') then 'ATTACK' when spoken and event_type = 'BIG_CHANCE' then 'DANGEROUS_ATTACK'
    when spoken and event_type in ('SHOT', 'SAVE') then event_type when spoken and event_type = 'NEAR_MISS' then if(outcome = 'POST', 'POST', 'WIDE')
    when event_type = 'GOAL' and signal_type in ('TRANSCRIPT_GOAL', 'TRANSCRIPT_EVENT', 'TRANSCRIPT_KEYWORD', 'AUDIO_GOAL_HYPOTHESIS') then if(detected, 'GOAL', if(replayed, 'REPLAY_EVENT', 'GOAL_HYPOTHESIS'))
    when signal_type = 'EVENT_RECONSTRUCTION' then 'RECONSTRUCTED_ACTION' when event_type = 'PENALTY' and signal_type = 'TRANSCRIPT_PENALTY' then 'PENALTY_ATTEMPT'
    when event_type = 'PENALTY' and spoken then 'PENALTY_AWARDED' else {codes(S.ATOM_OF, "signal_type")} end as atom
  from (
    select s.*, score, status = 'DETECTED' as detected, a_event as c_event, trigger_ms, signal_type = 'TRANSCRIPT_EVENT' as spoken, upper(trim(regexp_extract(evidence, 'OUTCOME=([^;]*)', 1))) as outcome,
      coalesce(max(confidence) filter (where signal_type in {PAST}) over (partition by s.anchor_id) > 0, false) as replayed
    from stored s join (select anchor_id, a_event, trigger_ms, score, status from final) f using (anchor_id))),
grouped as (
  select anchor_id, at_ms as ts_ms, atom, coalesce(max(confidence), max(score)) as confidence, list_sort(list(distinct signal_type) filter (where signal_type is not null)) as sources, list_sort(list_distinct(flatten(list(family)))) as families
  from (
    select anchor_id, null as score, atom, confidence, signal_type, case when atom = 'GOAL' and c_event = 'GOAL' then trigger_ms
        when atom = 'REPLAY_EVENT' and regexp_extract(evidence, ' at (\\d+) ms', 1) <> '' then regexp_extract(evidence, ' at (\\d+) ms', 1)::bigint else ts_ms end as at_ms,
      if(ties, ['ASSOCIATION', 'REPLAY_CONTEXT'], [coalesce({codes(S.FAMILY_OF, "signal_type")}, 'TRANSCRIPT')]) as family from meant where atom is not null
    union all select anchor_id, score, 'GOAL', null, null, trigger_ms, []::varchar[] from final where status = 'DETECTED' and g) group by all),
atoms as (
  select anchor_id, row_number() over (partition by anchor_id order by ts_ms, atom) - 1 as ordinal, ts_ms, atom, confidence, if(sources is null or len(sources) = 0, 'CANONICAL_CANDIDATE', array_to_string(sources, ',')) as sources,
    if(sources is null or len(sources) = 0, 'CLASSIFICATION', array_to_string(families, ',')) as families, atom in {some(S.NEGATIVE)} as negative from grouped)
"""


def nearest_before(names: tuple[str, ...], reach: int) -> str:
    """SQL: for each atom c the latest of these types at most so long before it; ties by ordinal."""
    return f"""(select c.anchor_id, c.ordinal, c.ts_ms, arg_max(p.ordinal, p.ts_ms * 1000 - p.ordinal) as found, max(p.ts_ms) as found_ms from atoms c join atoms p on p.anchor_id = c.anchor_id
    and p.atom in {some(names)} and p.ts_ms <= c.ts_ms and c.ts_ms - p.ts_ms <= {reach} group by all)"""


UNFENCED = f"""not exists (select 1 from atoms f where f.anchor_id = n.anchor_id and f.atom in {some(S.FENCES)} and f.ts_ms > n.found_ms and f.ts_ms < n.ts_ms)"""
RELATIONS = f""", goal as (select anchor_id, min(ordinal) as ordinal from atoms where atom = 'GOAL' group by 1),
edges as (
  select anchor_id, ordinal as from_ordinal, ordinal + 1 as to_ordinal, 'PRECEDES' as relation from atoms semi join (select anchor_id, ordinal - 1 as ordinal from atoms) using (anchor_id, ordinal)
  union all select n.anchor_id, found, n.ordinal, 'OUTCOME_OF' from {nearest_before(("SHOT",), 8000)} n join atoms using (anchor_id, ordinal) where negative and {UNFENCED}
  union all select n.anchor_id, found, n.ordinal, 'OUTCOME_OF' from {nearest_before(("ATTACK",), 8000)} n join atoms using (anchor_id, ordinal) where atom = 'CONTINUED_PLAY' and {UNFENCED}
  union all select n.anchor_id, found, n.ordinal, 'SUPPORTS' from {nearest_before(("PENALTY_AWARDED",), 8000)} n join atoms using (anchor_id, ordinal) where atom = 'PENALTY_ATTEMPT' and {UNFENCED}
  union all select n.anchor_id, found, n.ordinal, 'SUPPORTS' from {nearest_before(("SHOT",), 8000)} n join goal using (anchor_id, ordinal) where {UNFENCED}
  union all select n.anchor_id, found, n.ordinal, 'SUPPORTS' from {nearest_before(("ATTACK", "DANGEROUS_ATTACK"), 45000)} n join goal using (anchor_id, ordinal) where {UNFENCED}
  union all select anchor_id, min(a.ordinal), any_value(goal.ordinal), 'REPLAY_OF' from atoms a join goal using (anchor_id) where atom in {some(S.REPLAYS)}
    and anchor_id in (select anchor_id from stored where {TIES} or (signal_type = 'REJECTION_REASON' and regexp_matches(evidence, 'REPLAY_OF_EXISTING_GOAL|DUPLICATE_EVENT'))) group by anchor_id
  union all select r.anchor_id, arg_min(o.ordinal, abs(o.ts_ms - r.ts_ms) * 1000 + o.ordinal), r.ordinal, 'CONTRADICTS' from atoms r join atoms o on o.anchor_id = r.anchor_id and o.ordinal <> r.ordinal
    where r.atom = 'REJECTION' and r.anchor_id in (select anchor_id from final where status = 'REJECTED') group by r.anchor_id, r.ordinal)
"""


def stories(t: Tables):
    """Candidates and their stored signals, as the stories' operators take them."""
    found = made(t)
    rows = found.candidates.select(F.col("anchor_id").alias("candidate_id"), F.col("a_event").alias("event_type"), "trigger_ms", "score", "status")
    return settled(rows), settled(A.stored_signals(found).withColumnRenamed("anchor_id", "candidate_id"))


@query("e13_stored_signals", needs=TABLES, sql=WHOLE + STORED + "select anchor_id, signal_type, event_type, round(confidence, 6) as confidence, ts_ms, evidence, count(*) as n from stored group by all")
def e13(t: Tables):
    rows = A.stored_signals(made(t)).withColumn("confidence", r6("confidence"))
    return rows.groupBy("anchor_id", "signal_type", "event_type", "confidence", "ts_ms", "evidence").agg(F.count(F.lit(1)).alias("n"))


@query("g1_story_atoms", needs=TABLES, sql=WHOLE + ATOMS + "select anchor_id as candidate_id, ordinal, ts_ms, atom, round(confidence, 6) as confidence, sources, families, negative from atoms")
def g1(t: Tables):
    return S.atoms(*stories(t)).withColumn("confidence", r6("confidence"))


@query("g3_story_relations", needs=TABLES, sql=WHOLE + ATOMS + RELATIONS + "select anchor_id as candidate_id, from_ordinal, to_ordinal, relation from edges")
def g3(t: Tables):
    candidates, signals = stories(t)
    return S.relations(settled(S.atoms(candidates, signals)), candidates, signals)


@query("g4_story_labels", needs=TABLES, sql=WHOLE + """select anchor_id as candidate_id, case when status = 'DETECTED' then if(g, 'CANONICAL_GOAL', 'DETECTED_EVENT') when is_replay then 'REPLAY_OR_DUPLICATE' else 'REJECTED_HYPOTHESIS' end as label from final""")
def g4(t: Tables):
    return S.assessments(*stories(t))


NO_GOAL = f"""(event_type in ('SAVE', 'NEAR_MISS', 'MISSED_PENALTY') or (signal_type = 'SHOT_OUTCOME_CONTEXT' and regexp_matches(evidence, '{"|".join(f"OUTCOME={o}" for o in G.NO_GOAL)}')))"""
FOUND = f""", shots as (select asset_id, run_id, id, ts_ms as at_ms from moments where signal_type = 'TRANSCRIPT_SHOT' and event_type = 'SHOT'),
shot_near as (select s.*, m.* exclude (asset_id, run_id, id) from shots s join moments m on {SAME.format("m", "s")} and ts_ms between greatest(0, at_ms - 45000) and at_ms + 8000),
shot_one as (
  select asset_id, run_id, id, at_ms, arg_max(confidence, {{'t': ts_ms, 'c': confidence}}) filter (where signal_type = 'ATTACK_BUILDUP' and ts_ms < at_ms) as built,
    max(confidence) filter (where ts_ms >= at_ms and signal_type in {some((*G.VOICED, *G.PITCHED, *G.LOUD))}) as audio,
    max(confidence) filter (where ts_ms >= at_ms and (signal_type in ('TRANSCRIPT_EMPHASIS', 'TRANSCRIPT_REPETITION') or (signal_type = 'TRANSCRIPT_KEYWORD' and event_type = 'CELEBRATION'))) as said,
    coalesce(max(confidence) filter (where ts_ms >= at_ms and signal_type = 'SPEECH_RATE_SPIKE'), 0) as rate,
    coalesce(bool_or((signal_type = 'GOAL_KICK_CONTEXT' and ts_ms >= at_ms - 3000) or (ts_ms >= at_ms and {NO_GOAL})), false) as veto from shot_near group by all),
shot_goals as (
  select asset_id, run_id, 'SHOT' as source, id, at_ms as ts_ms, least(0.88e0, 0.76e0 + 0.12e0 * least(audio, greatest(coalesce(built, 0), coalesce(said, 0), rate))) as confidence, at_ms as action_ms,
    case when built is not null then 'attack buildup' when said is not null then 'post-action commentary' else 'speech-rate increase' end as led
  from shot_one where audio >= 0.45e0 and not veto and (built is not null or said is not null or rate >= 0.58e0)),
marks as (select asset_id, run_id, id, ts_ms as at_ms from moments where signal_type in {some((*G.VOICED, *G.PITCHED))}),
mark_near as (select s.*, m.* exclude (asset_id, run_id, id), abs(ts_ms - at_ms) as far from marks s join moments m on {SAME.format("m", "s")} and ts_ms between greatest(0, at_ms - 20000) and at_ms + 30000),
mark_one as (
  select asset_id, run_id, id, at_ms, coalesce(max(confidence) filter (where far <= 20000 and signal_type in {some(G.VOICED)}), 0) as voice, coalesce(max(confidence) filter (where far <= 20000 and signal_type in {some(G.PITCHED)}), 0) as pitch,
    coalesce(max(confidence) filter (where far <= 20000 and signal_type = 'SPEECH_RATE_SPIKE'), 0) as rate, coalesce(max(confidence) filter (where far <= 20000 and signal_type = 'AUDIO_ENERGY_RISE'), 0) as rise,
    min({{'far': far, 'c': -confidence, 'ts_ms': ts_ms}}) filter (where far <= 20000 and confidence >= 0.55e0 and (signal_type in ('ATTACK_BUILDUP', 'TRANSCRIPT_SHOT') or (signal_type = 'OWN_GOAL' and event_type = 'GOAL')
      or (signal_type = 'TRANSCRIPT_EVENT' and event_type in ('ATTACK', 'COUNTER_ATTACK', 'BIG_CHANCE', 'SHOT', 'PENALTY')))) as action,
    coalesce(bool_or(signal_type = 'SCORE_STATE_TRANSITION' and ts_ms >= at_ms), false) as scored, coalesce(bool_or(far <= 8000 and (signal_type = 'GOAL_KICK_CONTEXT' or {NO_GOAL})), false) as veto
  from mark_near group by all),
mark_goals as (
  select asset_id, run_id, 'AUDIO' as source, id, at_ms as ts_ms, least(0.92e0, 0.76e0 + 0.12e0 * greatest(voice, pitch, rate, rise)) as confidence, if(scored or action is null, at_ms, action.ts_ms) as action_ms,
    if(action is not null, 'typed football-action evidence', 'a later score-state transition') as led
  from (select *, voice >= 0.6e0 and (pitch >= 0.6e0 or rate >= 0.58e0 or rise >= 0.65e0) as moderate from mark_one)
  where not veto and ((moderate and action is not null) or (scored and (voice >= 0.6e0 or pitch >= 0.6e0) and (moderate or (voice >= 0.72e0 and action is not null)))))
"""


@query("d8_goal_hypotheses", needs=("moments",), sql=FOUND + f"""select * replace (round(confidence, 6) as confidence) from shot_goals union all select * replace (round(confidence, 6) as confidence) from mark_goals m
where not exists (select 1 from shot_goals s where {SAME.format("s", "m")} and abs(s.ts_ms - m.ts_ms) <= 20000)""")  # fmt: skip
def d8(t: Tables):
    return G.discover(t("moments")).withColumn("confidence", r6("confidence"))


@query("u1_signals_with_discovered", needs=("moments",), sql=FOUND + f""", found as (select * from shot_goals union all select * from mark_goals m where not exists (select 1 from shot_goals s where {SAME.format("s", "m")} and abs(s.ts_ms - m.ts_ms) <= 20000)),
every as (select asset_id, run_id, signal_type from moments union all
  select asset_id, run_id, unnest(if(source = 'SHOT', ['TRANSCRIPT_KEYWORD', 'TRANSCRIPT_GOAL'], ['AUDIO_GOAL_HYPOTHESIS', 'EVENT_RECONSTRUCTION'])) from found)
select asset_id, run_id, signal_type, count(*) as n from every group by all""")  # fmt: skip
def u1(t: Tables):
    every = t("moments").select(*A.KEY, "signal_type").unionByName(G.as_signals(G.discover(t("moments"))).select(*A.KEY, "signal_type"))
    return every.groupBy(*A.KEY, "signal_type").agg(F.count(F.lit(1)).alias("n"))


def clustered(t: Tables):
    """Candidates, their stored signals and their clusters."""
    found = made(t, told=True)
    signals = settled(A.stored_signals(found).withColumnRenamed("anchor_id", "candidate_id"))
    rows = settled(found.candidates.join(found.contexts, "anchor_id", "left").select(*A.KEY, F.col("anchor_id").alias("candidate_id"), F.col("a_event").alias("event_type"), "trigger_ms", "start_ms", "end_ms", "score", "status", "context"))
    return rows, signals, settled(C.cluster_events(rows, signals))


@query("m3_event_clusters")
def m3(t: Tables):
    return clustered(t)[2]


@query("m6_merged_events")
def m6(t: Tables):
    events, signals = C.merge_events(*clustered(t))
    n = signals.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_signals"))
    return events.join(n, "cluster_id", "left").withColumns({"score": r6("score"), "sources": F.array_join("sources", ","), "context": F.md5(F.coalesce("context", F.lit("")))})
