"""Analytic tables derived from the test data, as Spark DataFrames and as SQL for DuckDB.

One hour of event time is one second of media time, so that the operators' windows (3 s to 120 s) hold a useful share of pairs. The two
engines share one SQL text each; {US} and {DIV} are what differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.session import read_table

#: name: (tables of files it reads, derived tables it reads, SQL)
TABLES: dict[str, tuple[tuple[str, ...], tuple[str, ...], str]] = {
    "signals": (("events",), (), """
select user_id as asset_id, event_id % 2 as run_id, event_id as id, {US} {DIV} 3600000 as ts_ms,
  case event_type when 'click' then 'ATTACK_BUILDUP' when 'view' then 'TRANSCRIPT_SHOT' when 'purchase' then 'TRANSCRIPT_GOAL'
    when 'signup' then 'AUDIO_SPIKE' else 'REPLAY_CONTEXT' end as signal_type,
  case event_type when 'view' then 'SHOT' when 'purchase' then 'GOAL' end as event_type,
  least(value / 100e0, 1e0) as confidence, props as evidence
from {events}"""),
    "candidates": ((), ("signals",), """
select id as candidate_id, asset_id, run_id, greatest(ts_ms - 5000, 0) as start_ms, ts_ms + 8000 as end_ms, ts_ms as trigger_ms,
  coalesce(event_type, 'ATTACK') as event_type, confidence as score, evidence as context,
  case when confidence >= 0.35e0 then 'DETECTED' when id % 11 = 0 then 'MANUAL' else 'REJECTED' end as status
from signals"""),
    "reviews": ((), ("candidates",), """
select candidate_id, case candidate_id % 4 when 0 then 'CONFIRMED' when 1 then 'REJECTED' else 'UNREVIEWED' end as review_status,
  case when candidate_id % 6 = 0 then start_ms + 1000 end as manual_start_ms,
  case when candidate_id % 6 = 0 then end_ms - 1000 end as manual_end_ms,
  case when candidate_id % 12 = 0 then 'SAVE' end as event_type_override
from candidates where candidate_id % 3 <> 2"""),
    "assets": (("customer",), ("signals",), """
select u.asset_id, c_name as title, c_mktsegment as competition, u.duration_ms,
  case u.asset_id % 5 when 0 then 'STORED' when 1 then 'PROCESSING' when 2 then 'FAILED' else 'COMPLETED' end as status,
  case when u.asset_id % 7 = 0 then null else concat('Home ', cast(u.asset_id % 9 as varchar(10))) end as home_team,
  concat('Away ', cast(u.asset_id % 4 as varchar(10))) as away_team,
  case when u.asset_id % 8 = 0 then 'Feed of home 3' when u.asset_id % 3 = 0 then 'upload' end as source,
  concat('match_', cast(u.asset_id as varchar(10)), case u.asset_id % 3 when 0 then '_1st-half' when 1 then ' second half' else '' end, '.mp4') as original_filename
from (select asset_id, max(ts_ms) + 60000 as duration_ms from signals group by asset_id) u join {customer} on c_custkey = u.asset_id"""),
    "gt_events": ((), ("candidates",), """
select candidate_id as gt_id, asset_id, event_type, trigger_ms + (candidate_id % 41 - 20) * 1000 as ts_ms
from candidates where candidate_id % 5 = 0 and trigger_ms >= 20000"""),
    "gt_reviews": ((), ("assets",), """
select asset_id, case when asset_id % 3 = 0 then 'IN_PROGRESS' else 'COMPLETED' end as review_status from assets"""),
    "markers": ((), ("assets",), """
select asset_id, m.marker_type, m.ord, duration_ms * m.pct {DIV} 100 as ts_ms
from assets cross join (values ('PRE_MATCH', 1, 2), ('FIRST_HALF_START', 3, 10), ('HALF_TIME', 4, 48), ('SECOND_HALF_START', 5, 55), ('FULL_TIME', 6, 97)) m(marker_type, ord, pct)"""),
    "audio_windows": (("events",), (), """
select user_id as asset_id, 500 + 1000 * (row_number() over (partition by user_id order by ts, event_id) - 1) as ts_ms,
  greatest(-100e0, least(0e0, -50e0 + value / 4e0)) as dbfs, greatest(-100e0, least(0e0, -48e0 + value / 4e0)) as peak_dbfs,
  event_id % 25 / 100e0 as zero_crossing_rate, 120e0 + value as median_pitch_hz, value / 3e0 as pitch_variance_hz,
  event_id % 3 / 2e0 as voiced_frame_ratio
from {events}"""),
    "ocr_readings": (("lineitem",), (), """
select asset_id, (rn - 1) * 5000 as ts_ms,
  concat('HOME ', cast(case when rn % 13 = 0 then 9 else least(rn {DIV} 40, 15) end as varchar(10)), case when rn % 17 = 0 then ' ' else '-' end,
    case when rn % 3 = 0 then 'O' else '0' end, ' AWAY') as raw_text,
  4e-1 + rn % 60 / 100e0 as confidence
from (select l_suppkey as asset_id, row_number() over (partition by l_suppkey
  order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) as rn from {lineitem}) t"""),
    "runs": ((), ("signals",), """
select asset_id, run_id, asset_id * 10 + run_id as detection_run_id, count(*) as observations,
  case (asset_id + run_id) % 4 when 0 then 'RUNNING' when 1 then 'FAILED' else 'COMPLETED' end as status, max(id) as created_order
from signals group by asset_id, run_id"""),
    "clips": ((), ("candidates",), """
select candidate_id, asset_id, run_id from candidates where candidate_id % 8 < 2 and status <> 'REJECTED'"""),
    "score_transitions": ((), ("signals",), """
select asset_id, id as transition_id, ts_ms, id % 3 as home, id % 2 as away from signals where event_type = 'GOAL'"""),
    # signals of every type, two hours to half a second; keywords are emitted with the event they name (one in five by themselves), some rows are there twice,
    # attacks come with faster speech, and some goals with a replay
    "moments": (("events",), (), """
select asset_id, run_id, id + copy * 100000000 as id, case when copy = 1 and id % 5 = 1 then -id else id end as obs_id, ts_ms,
  case copy when 1 then 'TRANSCRIPT_KEYWORD' when 3 then 'SPEECH_RATE_SPIKE' when 4 then 'REPLAY_CONTEXT' else signal_type end as signal_type, case when copy < 3 then event_type end as event_type, 0.5e0 + id * 37 % 50 / 100e0 as confidence,
  case when copy = 1 then 'Football phrase match: goal' when copy = 3 then 'SPEECH_RATE_SPIKE' when copy = 4 then 'Context phrase or structure match: replay'
    when signal_type = 'TRANSCRIPT_GOAL' and id % 3 = 1 then 'Inferred goal hypothesis from a shot' when signal_type = 'AUDIO_GOAL_HYPOTHESIS' then 'Inferred live goal hypothesis'
    when signal_type in ('REPLAY_CONTEXT', 'RETROSPECTIVE_CONTEXT') then 'Context phrase or structure match: replay'
    when signal_type = 'SCORE_STATE_TRANSITION' then concat('Score changed to ', cast(id % 4 as varchar(10)), '-', cast(id % 3 as varchar(10)))
    when signal_type = 'SHOT_OUTCOME_CONTEXT' then concat('OUTCOME=', case id % 3 when 0 then 'SAVE' when 1 then 'WIDE' else 'GOAL' end, '; phrase')
    when signal_type = 'EVENT_RECONSTRUCTION' then 'Goal action is anchored to a shot' else signal_type end as evidence
from (
  select user_id as asset_id, event_id % 2 as run_id, event_id as id, {US} {DIV} 14400000 as ts_ms,
    case event_id {DIV} 2 % 48 when 6 then 'AUDIO_GOAL_HYPOTHESIS' when 7 then 'OWN_GOAL' when 20 then 'TRANSCRIPT_PENALTY' when 21 then 'TRANSCRIPT_CARD'
      when 22 then 'ATTACK_BUILDUP' when 23 then 'ATTACK_BUILDUP' when 24 then 'ATTACK_BUILDUP' when 25 then 'AUDIO_ENERGY_RISE' when 26 then 'AUDIO_SPIKE' when 27 then 'AUDIO_SUSTAINED'
      when 28 then 'HIGH_EXCITEMENT' when 29 then 'VOICE_EXCITEMENT' when 30 then 'PITCH_RISE' when 31 then 'PITCH_VARIANCE' when 32 then 'CROWD_REACTION_PROXY'
      when 33 then 'TRANSCRIPT_EMPHASIS' when 34 then 'TRANSCRIPT_REPETITION' when 35 then 'SPEECH_RATE_SPIKE' when 36 then 'REPLAY_CONTEXT' when 37 then 'RETROSPECTIVE_CONTEXT'
      when 38 then 'NEGATION_CONTEXT' when 39 then 'CORRECTION_CONTEXT' when 40 then 'HISTORICAL_REFERENCE' when 41 then 'INJURY_CONTEXT' when 42 then 'RESTART_CONTEXT'
      when 43 then 'GOAL_KICK_CONTEXT' when 44 then 'SCORE_STATE_TRANSITION' when 45 then 'SHOT_OUTCOME_CONTEXT' when 46 then 'EVENT_RECONSTRUCTION' when 47 then 'UNRELATED_ACTION_CONTEXT'
      else case when event_id {DIV} 2 % 48 < 6 then 'TRANSCRIPT_GOAL' when event_id {DIV} 2 % 48 < 13 then 'TRANSCRIPT_SHOT' else 'TRANSCRIPT_EVENT' end end as signal_type,
    case when event_id {DIV} 2 % 48 < 8 or event_id {DIV} 2 % 48 = 46 then 'GOAL' when event_id {DIV} 2 % 48 < 12 then 'SHOT' else case event_id {DIV} 2 % 48
      when 12 then 'NEAR_MISS' when 13 then 'ATTACK' when 14 then 'ATTACK' when 15 then 'COUNTER_ATTACK' when 16 then 'FOUL' when 17 then 'BIG_CHANCE' when 18 then 'SAVE' when 19 then 'CELEBRATION'
      when 20 then 'PENALTY' when 21 then 'YELLOW_CARD' when 33 then 'COMMENTATOR_REACTION' when 34 then 'COMMENTATOR_REACTION' end end as event_type
  from {events}) m join (values (0), (1), (2), (3), (4)) c(copy) on copy = 0 or (copy = 1 and event_type = 'GOAL' and signal_type <> 'EVENT_RECONSTRUCTION' and id % 7 < 4) or (copy = 2 and id % 17 = 0)
  or (copy = 3 and event_type = 'ATTACK') or (copy = 4 and signal_type = 'TRANSCRIPT_GOAL' and id % 7 < 4 and id % 3 = 0)"""),
    "footage": ((), ("moments",), "select asset_id, max(ts_ms) - 3000 as duration_ms from moments group by asset_id"),
    # segments with some football in them, and silences of twelve seconds
    "spoken": ((), ("segments",), """
select asset_id, seq, start_ms, end_ms, case
    when asset_id % 3 = 0 then case seq % 2 when 0 then 'Raphinha scores again, Barcelona crossing' else 'Keeper beaten by striker Raphinha' end
    when seq % 11 = 3 then concat(text, ' penalty kick') when seq % 11 = 5 then concat(text, ' from the corner') else text end as text
from segments where seq % 13 not in (5, 6, 7, 8)"""),
    "segments": (("documents",), (), """
select doc_id as asset_id, lang as language, pos as seq, pos * 3000 as start_ms, pos * 3000 + 2500 as end_ms, text from (
  select doc_id, lang, {POS}) t where text <> ''"""),
}

SPLIT = {
    "spark": "pos, trim(x) as text from {documents} lateral view posexplode(split(text, '[.!?\\\\n]+')) e as pos, x",
    "duckdb": "i - 1 as pos, trim(p[i]) as text from (select doc_id, lang, regexp_split_to_array(text, '[.!?\\n]+') as p, "
    "unnest(range(1, len(regexp_split_to_array(text, '[.!?\\n]+')) + 1)) as i from {documents}) d",
}
WORDS = {
    "spark": {"US": "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))", "DIV": "div"},
    "duckdb": {"US": "(epoch_us(ts) - 1704067200000000)", "DIV": "//"},
}


def needed(names: tuple[str, ...]) -> list[str]:
    """Derived tables in an order in which each comes after those it reads."""
    out: list[str] = []
    for name in names:
        for x in [*needed(TABLES[name][1]), name]:
            if x not in out:
                out.append(x)
    return out


def prefix(names: tuple[str, ...], engine: str, sources: dict[str, str]) -> str:
    """The WITH clause that defines derived tables, up to where a query goes on."""
    parts = []
    for name in needed(names):
        sql = TABLES[name][2].replace("{POS}", SPLIT[engine])
        for word, text in (WORDS[engine] | sources).items():
            sql = sql.replace("{" + word + "}", text)
        parts.append(f"{name} as ({sql})")
    return "with recursive " + ",\n".join(parts) if parts and engine == "duckdb" else "with " + ",\n".join(parts) if parts else ""


def files_of(names: tuple[str, ...]) -> list[str]:
    return sorted({f for n in needed(names) for f in TABLES[n][0]})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or one of the files."""
    if name not in TABLES:
        return read_table(spark, sf_dir, name)
    files = files_of((name,))
    sql = prefix((name,), "spark", {f: "{" + f + "}" for f in files})
    return spark.sql(f"{sql} select * from {name}", **{f: spread(read_table(spark, sf_dir, f), f) for f in files})


def spread(rows: DataFrame, name: str) -> DataFrame:
    """Documents by id: a file of texts has few row groups, hence few tasks, and what is done with the segments of a text is much more than reading it. As a
    document is a recording, what comes by recording needs no other shuffle."""
    return rows.repartition("doc_id") if name == "documents" else rows


def duckdb_sql(names: tuple[str, ...], body: str) -> str:
    """A query over derived tables, for DuckDB over the files' tables."""
    head = prefix(names, "duckdb", {f: f for f in files_of(names)})
    return f"{head}{',' if body.lstrip().startswith(',') else ''}\n{body.lstrip().removeprefix(',')}"
