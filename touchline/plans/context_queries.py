"""Query of the context detector, on segments in which scores are named."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import text as X
from touchline.operators import phrases
from touchline.operators import transcript as P
from touchline.plans.detection_queries import LEXICON
from touchline.plans.registry import Tables, query
from touchline.settings import EVENT_CONFIDENCE

#: Common words of the test texts stand in for phrases of each kind.
KINDS = [
    ("en", "REPLAY", "of the"), ("en", "RETROSPECTIVE", "which"), ("en", "BUILDUP", "was"), ("en", "RESTART", "from"), ("en", "INJURY", "are"), ("en", "SCORING", "this"), ("en", "RETROSPECTIVE", "was on"),
    ("fr", "REPLAY", "dans"), ("fr", "RETROSPECTIVE", "pour la"), ("fr", "BUILDUP", "par"), ("fr", "RESTART", "sur"), ("fr", "SCORING", "est"), ("de", "REPLAY", "auf"), ("de", "RESTART", "mit"), ("de", "INJURY", "sich"),
    ("es", "REPLAY", "una"), ("es", "BUILDUP", "para"), ("es", "BUILDUP", "por"), ("es", "INJURY", "con"), ("und", "RETROSPECTIVE", "de la"),
]
TOLD = """select asset_id, language, seq, start_ms, end_ms, case seq % 7 when 1 then concat(text, ' it is ', cast(seq % 35 % 4 as varchar(10)), '-', cast(asset_id % 2 as varchar(10)))
  when 3 then concat('The score was 1-0. ', text) when 5 then concat(text, ' 2 - 1 or 2:1') when 6 then concat('Not a goal, disallowed 3-', cast(seq % 5 as varchar(10)), ' ', text) else text end as text from """


def norm(text: str) -> str:
    return rf"trim(regexp_replace(strip_accents(lower({text})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def near(of: str) -> str:
    return f"case when {of}.e >= greatest(0, start_ms - 3000) and {of}.s <= end_ms + 3000 then {of}.x end"


def count(kind: str, text: str) -> str:
    return f"(select count(distinct phrase) from lex where lex.kind = '{kind}' and (of_lang = language or of_lang = 'und') and contains(' ' || {text} || ' ', ' ' || phrase || ' '))"


def overlaps(*types: str) -> str:
    return f"list_has_any(types, [{', '.join(repr(t) for t in types)}])"


PAST = f"(regexp_matches(ctx, '{X.PAST_SCORING}') or regexp_matches(ctx, '{'|'.join(X.PAST_PHRASES)}'))"
SQL = f""", lex(of_lang, kind, phrase) as (values {", ".join(map(str, KINDS))}),
told as ({TOLD} segments), n as (select *, {norm("text")} as norm from told),
w as (select *, lag({{'s': start_ms, 'e': end_ms, 'x': norm}}, 2) over o as a, lag({{'s': start_ms, 'e': end_ms, 'x': norm}}) over o as b, lead({{'s': start_ms, 'e': end_ms, 'x': norm}}) over o as c,
  lead({{'s': start_ms, 'e': end_ms, 'x': norm}}, 2) over o as d from n window o as (partition by asset_id order by start_ms, seq)),
c as (select asset_id, language, seq, start_ms, text, norm, concat_ws(' ', {near("a")}, {near("b")}, norm, {near("c")}, {near("d")}) as ctx from w),
scored as (
  select *, list_distinct(list_transform(regexp_extract_all(' ' || text || ' ', '[^0-9]([0-9]{{1,2}}\\s*[-–—:]\\s*[0-9]{{1,2}})[^0-9]', 1), lambda p: [regexp_extract(p, '^[0-9]+')::int, regexp_extract(p, '[0-9]+$')::int])) as pairs,
    list_filter([if(regexp_matches(ctx, '{X.NEGATED}'), 'NEGATION_CONTEXT', null), if(regexp_matches(ctx, '{X.CORRECTED}'), 'CORRECTION_CONTEXT', null), if(regexp_matches(ctx, '{"|".join(X.REPLAY_PHRASES)}'), 'REPLAY_CONTEXT', null),
      if({PAST}, 'RETROSPECTIVE_CONTEXT', null), if({PAST}, 'HISTORICAL_REFERENCE', null)], lambda x: x is not null) as types,
    {", ".join(f"{count(k, 'ctx')} as n_{k}" for k in (*P.CONTEXT_KINDS, "SCORING"))}, {count("RETROSPECTIVE", "norm")} > 0 as past_here,
    regexp_matches(ctx, '{X.SEASON_GOAL}') or regexp_matches(ctx, '{X.SCORE_REPORT}') as reported, regexp_matches(regexp_replace(norm, '([0-9])([0-9])', '\\1 \\2', 'g'), '{X.SCORE_REPORT}') as report
  from c),
known as (
  select *, if(len(pairs) = 1 and pairs[1][1] <= 20 and pairs[1][2] <= 20, pairs[1], null) as score,
    n_REPLAY > 0 or report or past_here or {overlaps("CORRECTION_CONTEXT", "HISTORICAL_REFERENCE", "NEGATION_CONTEXT")} as history from scored),
moved as (
  select *, if(history, null, score) as now, last_value(if(history, null, score) ignore nulls) over (partition by asset_id order by start_ms, seq rows between unbounded preceding and 1 preceding) as b4 from known),
made as (
  select asset_id, seq, start_ms as ts_ms, unnest(['REPLAY_CONTEXT', 'RETROSPECTIVE_CONTEXT', 'ATTACK_BUILDUP', 'RESTART_CONTEXT', 'INJURY_CONTEXT']) as signal_type,
    unnest([n_REPLAY, n_RETROSPECTIVE + reported::int, n_BUILDUP, n_RESTART, n_INJURY]) as n, unnest([0.84e0, if(n_SCORING > 0, 0.2e0, 0.8e0), 0.7e0, 0.91e0, 0.86e0]) as sure from moved),
hits as (select * from made where n > 0),
kept as (
  select asset_id, signal_type, min(ts_ms) as ts_ms from hits group by all
  union all select k.asset_id, k.signal_type, min(s.ts_ms) from kept k join hits s on s.asset_id = k.asset_id and s.signal_type = k.signal_type and s.ts_ms >= k.ts_ms + 4000 group by k.asset_id, k.signal_type, k.ts_ms)
select asset_id, seq, start_ms as ts_ms, unnest(types) as signal_type, 'GOAL' as event_type, unnest(list_transform(types, lambda x: case x when 'NEGATION_CONTEXT' then 0.94 when 'CORRECTION_CONTEXT' then 0.92 else 0.9 end))::double as confidence,
  'goal context' as evidence from moved
union all select asset_id, seq, start_ms, 'SCORE_STATE', null, 0.72, 'Transcript explicitly mentions score ' || score[1] || '-' || score[2] from moved where score is not null
union all select asset_id, seq, start_ms, 'SCORE_STATE_TRANSITION', null, 0.82, 'Transcript score changed from ' || b4[1] || '-' || b4[2] || ' to ' || now[1] || '-' || now[2] from moved
  where (now[1] - b4[1] = 1 and now[2] = b4[2]) or (now[1] = b4[1] and now[2] - b4[2] = 1)
union all select asset_id, seq, ts_ms, signal_type, null, round(least(0.96e0, sure + least(0.08e0, 0.02e0 * (n - 1))), 6), 'Context phrase or structure match: ' || n from hits semi join kept using (asset_id, signal_type, ts_ms)
"""


@query("d4_context_signals", needs=("segments",), sql=SQL)
def d4(t: Tables):
    segments = t("segments")
    told = segments.sparkSession.sql(TOLD + "{segments}", segments=segments)
    found = P.detect_context_signals(told, phrases.as_rows(segments.sparkSession, KINDS, ["lang", "event_type", "phrase"]))
    return found.withColumn("confidence", F.round("confidence", 6))


EVENTS = [*LEXICON, ("und", "GOAL", "gol"), ("en", "GOAL", "goal")]
MARKS = [("en", "STRONG", "he scores"), ("en", "SCORING", "scores"), ("en", "OWN_GOAL", "own net"), ("en", "GOAL_KICK", "goal kick"), ("fr", "GOAL_KICK", "coup de pied de but"), ("fr", "STRONG", "est"), ("es", "OWN_GOAL", "de")]
CALLED = """select asset_id, language, seq, start_ms, end_ms, case seq % 12 when 1 then concat('Goal kick now. ', text) when 2 then concat('GOOOOL! ', text) when 3 then concat('The score was level with ', text)
  when 4 then concat('He scores, goal number three ', text) when 5 then concat('revoir le but dans ', text) when 6 then 'Gol!!' when 7 then concat('Il relance dans le match. ', text)
  when 8 then concat(text, ' into his own net with no goal') when 9 then concat('juste apres le but dans ', text) else text end as text from """
TYPED = """case when event_type = 'GOAL' then 'TRANSCRIPT_GOAL' when event_type in ('SHOT', 'NEAR_MISS') then 'TRANSCRIPT_SHOT' when event_type in ('PENALTY', 'MISSED_PENALTY') then 'TRANSCRIPT_PENALTY'
  when event_type in ('YELLOW_CARD', 'RED_CARD') then 'TRANSCRIPT_CARD' else 'TRANSCRIPT_EVENT' end"""


def has(kind: str, own: str = "of_lang = language") -> str:
    return f"(select list_sort(list(distinct phrase)) from mark where mark.kind = '{kind}' and {own} and contains(' ' || norm || ' ', ' ' || phrase || ' '))"


PHRASES = f""", ev(of_lang, event_type, phrase) as (values {", ".join(map(str, EVENTS))}), mark(of_lang, kind, phrase) as (values {", ".join(map(str, MARKS))}),
base(event_type, b) as (values {", ".join(f"('{k}', {v}e0)" for k, v in EVENT_CONFIDENCE.items())}),
told as ({CALLED} segments), n as (select *, {norm("text")} as norm from told),
w as (select *, lag({{'s': start_ms, 'e': end_ms, 'x': norm}}, 2) over o as a, lag({{'s': start_ms, 'e': end_ms, 'x': norm}}) over o as b, lead({{'s': start_ms, 'e': end_ms, 'x': norm}}) over o as c,
  lead({{'s': start_ms, 'e': end_ms, 'x': norm}}, 2) over o as d from n window o as (partition by asset_id order by start_ms, seq)),
c as (
  select asset_id, language, seq, start_ms, text, norm, concat_ws(' ', {near("a")}, {near("b")}, norm, {near("c")}, {near("d")}) as ctx, regexp_matches(norm, '{X.ELONGATED_CALL}') as drawn,
    len({has("STRONG")}) > 0 as strong, len({has("SCORING")}) > 0 as scoring, {has("OWN_GOAL")} as own_goal,
    len({has("GOAL_KICK", "(of_lang = language or language not in (select of_lang from mark where kind = 'GOAL_KICK'))")}) > 0 as kick from w),
hit as (select c.*, event_type, list_sort(list(distinct phrase))[1:3] as said from c join ev on (of_lang = language or of_lang = 'und') and contains(' ' || norm || ' ', ' ' || phrase || ' ') group by all),
every as (
  select *, if(event_type = 'GOAL' and drawn, list_append(said, '{P.ELONGATED}'), said) as matches from hit
  union all select c.*, 'GOAL', [], ['{P.ELONGATED}'] from c where drawn and not exists (select 1 from hit where hit.asset_id = c.asset_id and hit.seq = c.seq and event_type = 'GOAL')),
open as (
  select *, array_to_string(matches, '|') as fp from every where event_type <> 'GOAL' or not (coalesce(kick, false) or regexp_matches(norm, '{"|".join(X.NO_GOAL_TOLD)}')
    or (contains(norm, '{X.AFTER_GOAL}') and not regexp_matches(norm, '{"|".join(X.JUST_SCORED)}'))
    or (regexp_matches(norm, '{X.SEASON_GOAL}|{"|".join((*X.SCORE_TOLD, *X.GOAL_NUMBERS))}') and not coalesce(scoring, false)))),
lined as (select *, lag(start_ms) over (partition by asset_id, event_type, fp order by start_ms, seq) as b4 from open),
kept as (
  select l.*, {TYPED} as typed, if(l.event_type = 'GOAL' and not coalesce(strong, false) and not drawn and not (regexp_matches(norm, '^{X.BARE_GOAL}$') and regexp_matches(trim(text), '(?i)^{X.BARE_GOAL}\\s*!+$')),
    least(0.68e0, least(0.98e0, b + 0.07e0 * (len(matches) - 1))), least(0.98e0, b + 0.07e0 * (len(matches) - 1))) as sure
  from lined l join base using (event_type) where l.event_type <> 'GOAL' or b4 is null or start_ms - b4 > 90000),
around as (select *, list_filter([if(regexp_matches(ctx, '{X.NEGATED}'), 'NEGATION_CONTEXT', null), if(regexp_matches(ctx, '{X.CORRECTED}'), 'CORRECTION_CONTEXT', null), if(regexp_matches(ctx, '{"|".join(X.REPLAY_PHRASES)}'), 'REPLAY_CONTEXT', null),
      if({PAST}, 'RETROSPECTIVE_CONTEXT', null), if({PAST}, 'HISTORICAL_REFERENCE', null)], lambda x: x is not null) as types from kept where event_type = 'GOAL')
select asset_id, seq, start_ms as ts_ms, event_type as obs, event_type, 'TRANSCRIPT_KEYWORD' as signal_type, round(sure, 6) as confidence, 'Football phrase match: ' || array_to_string(matches, ', ') as evidence from kept
union all select asset_id, seq, start_ms, event_type, event_type, typed, round(sure, 6), 'Event-specific transcript phrase match' from kept
union all select asset_id, seq, start_ms, event_type, event_type, unnest(types), unnest(list_transform(types, lambda x: case x when 'NEGATION_CONTEXT' then 0.94e0 when 'CORRECTION_CONTEXT' then 0.92e0 else 0.9e0 end)), 'goal context' from around
union all select asset_id, seq, start_ms, event_type, event_type, 'OWN_GOAL', round(sure, 6), 'OWN_GOAL; phrase match: ' || array_to_string(own_goal, ', ') from kept where event_type = 'GOAL' and len(own_goal) > 0
union all select asset_id, seq, start_ms, 'GOAL_KICK', 'GOAL', 'GOAL_KICK_CONTEXT', 0.96e0, 'Typed football expression identifies a goal kick, not a scoring event' from c where kick
union all select asset_id, seq, start_ms, 'COMEBACK', 'GOAL', unnest(['TRANSCRIPT_KEYWORD', 'TRANSCRIPT_GOAL']), 0.84e0,
  unnest(['Football phrase match: French commentary says a team is being put back into the match', 'French comeback phrase suggests a score change'])
  from c where language = 'fr' and regexp_matches(norm, '{X.COMEBACK_CALL}') and not regexp_matches(norm, '{"|".join(X.COMEBACK_VETOES)}')
"""


@query("d1_phrase_signals", needs=("segments",), sql=PHRASES)
def d1(t: Tables):
    segments = t("segments")
    told = segments.sparkSession.sql(CALLED + "{segments}", segments=segments)
    names = ["lang", "event_type", "phrase"]
    rows = P.detect_phrase_signals(told, phrases.as_rows(segments.sparkSession, EVENTS, names), phrases.as_rows(segments.sparkSession, MARKS, names))
    return rows.withColumn("confidence", F.round("confidence", 6))
