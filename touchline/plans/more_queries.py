"""More queries: evidence, manifests, discovery, boundaries, features of audio."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.functions import evidence as V
from touchline.functions import text as X
from touchline.operators import analytics as A
from touchline.operators import assemble as E
from touchline.operators import audio as D
from touchline.operators import phrases
from touchline.operators import review as R
from touchline.operators import timejoin as T
from touchline.operators import transcript as P
from touchline.plans.boundary_queries import told, with_openings
from touchline.plans.detection_queries import NORM, lexicon, r6
from touchline.plans.registry import Tables, query
from touchline.settings import DEFAULTS


def with_signals(t: Tables):
    """Candidates with the signals inside their windows as an array."""
    c = t("candidates").select("candidate_id", "asset_id", "run_id", "start_ms", "end_ms", "context")
    s = t("signals").select("asset_id", "run_id", "id", "ts_ms", "signal_type", "confidence")
    pairs = T.range_join(c, s, ["asset_id", "run_id"], F.col("start_ms"), F.col("end_ms"), "ts_ms", 30_000)
    return pairs.groupBy("candidate_id").agg(F.sort_array(F.collect_list(F.struct("ts_ms", "id", "signal_type", "confidence"))).alias("signals"))


IN_WINDOW = ", iw as (select candidate_id, g.signal_type, g.confidence, g.ts_ms, g.id from candidates c join signals g on g.asset_id = c.asset_id and g.run_id = c.run_id and g.ts_ms between c.start_ms and c.end_ms)"
TAGGED = """, tg as (select candidate_id, list_filter([case when bool_or(signal_type = 'AUDIO_SPIKE') then '{0}' end, case when bool_or(signal_type like 'TRANSCRIPT_%') then '{1}' end, case when bool_or(signal_type = 'ATTACK_BUILDUP') then '{2}' end], lambda x : x is not null) as l,
  count(*) filter (where regexp_matches(signal_type, 'AUDIO|CROWD|PITCH|SPEECH_RATE')) as audio, count(*) filter (where regexp_matches(signal_type, 'REPLAY|RETROSPECTIVE|EVENT_ASSOCIATION')) as replays from iw group by candidate_id)
"""


@query("f6_evidence_tags", needs=("candidates", "signals"), sql=IN_WINDOW + TAGGED.format("Audio reaction", "Transcript", "Live context") + "select candidate_id, case when len(l) = 0 then 'Evidence details available' else array_to_string(l, ',') end as tags from tg")
def f6(t: Tables):
    return with_signals(t).select("candidate_id", F.array_join(V.evidence_tags(F.col("signals"), F.lit(False)), ",").alias("tags"))


@query("f7_signal_families", needs=("candidates", "signals"), sql=IN_WINDOW + TAGGED.format("a", "b", "c") + "select candidate_id, audio, replays from tg")
def f7(t: Tables):
    n = lambda p: F.size(V.signals_of_family(F.col("signals"), p)).cast("long")
    return with_signals(t).select("candidate_id", n(V.AUDIO).alias("audio"), n(V.REPLAY).alias("replays"))


@query("f15_evidence_summary", needs=("candidates", "signals"), sql=IN_WINDOW + TAGGED.format("Audio or crowd-reaction signal", "Football transcript evidence", "Live-event or attacking context") + "select candidate_id, case when len(l) = 0 then 'replay context' else array_to_string(l, ';') end as summary from tg")
def f15(t: Tables):
    return with_signals(t).select("candidate_id", F.array_join(V.evidence_summary(F.col("signals")), ";").alias("summary"))


@query("a13_replay_probability", needs=("candidates", "signals"), sql=IN_WINDOW + "select candidate_id, coalesce(max(confidence) filter (where signal_type = 'REPLAY_CONTEXT'), 0) as replay, 0e0 as live from iw group by candidate_id")
def a13(t: Tables):
    return with_signals(t).select("candidate_id", V.replay_probability(F.col("signals")).alias("replay"), V.live_probability(F.col("signals")).alias("live"))


@query("f13_manifest_violations", needs=("assets",), sql=r""", f as (select asset_id as file_id, case asset_id % 6 when 0 then 'C:\up\' || original_filename when 1 then '/a/..' when 2 then 'noext' when 3 then title || '.MOV' when 4 then 'x.txt' else original_filename end as name, case when asset_id % 10 = 0 then 0 else asset_id * 20000000 end as size from assets),
b as (select *, nullif(nullif(trim(regexp_replace(replace(name, '\', '/'), '^.*/', '')), '..'), '') as base from f), x as (select *, nullif(lower(regexp_extract(base, '^.+\.([^.]+)$', 1)), '') as ext from b)
select file_id, 'EMPTY_FILE' as rule from x where size < 1 union all select file_id, 'TOO_LARGE' from x where size > 2147483648 union all select file_id, 'NO_NAME' from x where base is null
union all select file_id, 'UNSUPPORTED_TYPE' from x where base is not null and not coalesce(ext in ('mp4', 'mov', 'mkv'), false)""")  # fmt: skip
def f13(t: Tables):
    k = F.col("asset_id") % 6
    name = F.when(k == 0, F.concat(F.lit("C:\\up\\"), "original_filename")).when(k == 1, "/a/..").when(k == 2, "noext").when(k == 3, F.concat("title", F.lit(".MOV"))).when(k == 4, "x.txt").otherwise(F.col("original_filename"))
    files = t("assets").select(F.col("asset_id").alias("file_id"), name.alias("name"), F.when(F.col("asset_id") % 10 == 0, 0).otherwise(F.col("asset_id") * 20_000_000).alias("size"))
    return R.manifest_violations(files, "name", "size", 2_147_483_648, ("mp4", "mov", "mkv"))


@query("e14_manual_events", needs=("reviews", "candidates", "assets"), sql="""select c.asset_id, c.event_type, manual_start_ms as start_ms, manual_end_ms as end_ms, (manual_start_ms + manual_end_ms) // 2 as trigger_ms, 1e0 as score, 'MANUAL' as status
from reviews r join candidates c using (candidate_id) join assets a on a.asset_id = c.asset_id where manual_start_ms >= 0 and manual_end_ms > manual_start_ms and manual_end_ms <= duration_ms""")  # fmt: skip
def e14(t: Tables):
    rows = t("reviews").where("manual_start_ms is not null").join(t("candidates").select("candidate_id", "asset_id", "event_type"), "candidate_id")
    return R.manual_events(rows.select("asset_id", "event_type", F.col("manual_start_ms").alias("start_ms"), F.col("manual_end_ms").alias("end_ms")), t("assets"))


GOALS = ", go as (select asset_id, run_id, id as goal_id, ts_ms as goal_ms from signals where event_type = 'GOAL'), sh as (select asset_id, run_id, id as shot_id, ts_ms as shot_ms, confidence from signals where event_type = 'SHOT')"


@query("j12_goal_action", needs=("signals",), sql=GOALS + """, p as (select go.goal_id, sh.*, row_number() over (partition by goal_id order by shot_ms desc, confidence desc, shot_id) as k from go join sh on sh.asset_id = go.asset_id and sh.run_id = go.run_id and shot_ms between greatest(0, goal_ms - 45000) and goal_ms - 1
  where not exists (select 1 from go o where o.asset_id = go.asset_id and o.run_id = go.run_id and o.goal_ms > shot_ms and o.goal_ms < go.goal_ms)) select goal_id, shot_id, shot_ms from p where k = 1""")  # fmt: skip
def j12(t: Tables):
    s = t("signals")
    goals = s.where("event_type = 'GOAL'").select("asset_id", "run_id", F.col("id").alias("goal_id"), F.col("ts_ms").alias("goal_ms"))
    shots = s.where("event_type = 'SHOT'").select("asset_id", "run_id", F.col("id").alias("shot_id"), F.col("ts_ms").alias("shot_ms"), "confidence")
    return E.goal_action(goals, shots)


@query("u4_exclude_near", needs=("signals",), sql=GOALS + " select goal_id from go where not exists (select 1 from sh where sh.asset_id = go.asset_id and shot_ms between goal_ms - 3000 and goal_ms + 3000)")
def u4(t: Tables):
    s = t("signals")
    goals = s.where("event_type = 'GOAL'").select("asset_id", F.col("id").alias("goal_id"), F.col("ts_ms").alias("goal_ms"))
    return E.exclude_near(goals, s.where("event_type = 'SHOT'").withColumnRenamed("ts_ms", "shot_ms"), "goal_ms", "shot_ms", 3000).select("goal_id")


@query("w7_audio_buildup", needs=("signals",), sql=GOALS + """, n as (select goal_id, goal_ms, g.ts_ms, g.signal_type, case when g.ts_ms - lag(g.ts_ms) over (partition by goal_id order by g.ts_ms) > 4000 then 1 else 0 end as nw from go join signals g on g.asset_id = go.asset_id and g.signal_type in ('AUDIO_SPIKE', 'ATTACK_BUILDUP')
  and g.ts_ms between greatest(0, goal_ms - 45000) and goal_ms), c as (select *, sum(nw) over (partition by goal_id order by ts_ms) as cl from n),
p as (select goal_id, goal_ms, cl, min(ts_ms) as from_ms, max(ts_ms) as to_ms from c group by all having count(distinct signal_type) >= 2 and goal_ms - max(ts_ms) <= 24000)
select goal_id, from_ms, to_ms from (select *, row_number() over (partition by goal_id order by to_ms desc) as k from p) where k = 1""")  # fmt: skip
def w7(t: Tables):
    s = t("signals")
    goals = s.where("event_type = 'GOAL'").select("asset_id", F.col("id").alias("goal_id"), F.col("ts_ms").alias("goal_ms"))
    return E.audio_buildup(goals, s.where("signal_type in ('AUDIO_SPIKE', 'ATTACK_BUILDUP')"))


@query("a14_observations_by_family", needs=("signals",), sql="""select asset_id, run_id, case signal_type when 'ATTACK_BUILDUP' then 'ATTACK_BUILDUP' when 'AUDIO_SPIKE' then 'AUDIO_ENERGY' when 'REPLAY_CONTEXT' then 'REPLAY' else 'TRANSCRIPT' end as family, count(*) as n, max(confidence) as top
from signals where ts_ms between 140000 and 260000 group by all""")  # fmt: skip
def a14(t: Tables):
    return E.observations_by_family(t("signals"), 200_000)


@query("j3_scoreboard_range", needs=("score_transitions", "assets"), sql="select asset_id, transition_id, s.ts_ms from score_transitions s join assets a using (asset_id) where a.status = 'COMPLETED' and s.ts_ms between 30000 and 90000 order by s.ts_ms, transition_id limit 500")
def j3(t: Tables):
    done = t("assets").where("status = 'COMPLETED'").select("asset_id")
    return t("score_transitions").where(F.col("ts_ms").between(30_000, 90_000)).join(done, "asset_id").orderBy("ts_ms", "transition_id").limit(500).select("asset_id", "transition_id", "ts_ms")


@query("k2_sorted_candidates", needs=("candidates",), sql="select candidate_id, row_number() over (partition by asset_id order by score desc, start_ms, candidate_id) as by_score, row_number() over (partition by asset_id order by start_ms, score desc, candidate_id) as by_time from candidates")
def k2(t: Tables):
    n = lambda *order: F.row_number().over(Window.partitionBy("asset_id").orderBy(*order, "candidate_id"))
    return t("candidates").select("candidate_id", n(F.desc("score"), "start_ms").alias("by_score"), n("start_ms", F.desc("score")).alias("by_time"))


CUE = f""", n as (select asset_id, seq, start_ms, end_ms, {NORM} as norm from segments), w as (select *, lead(start_ms) over o as s1, lead(norm) over o as t1, lead(start_ms, 2) over o as s2, lead(norm, 2) over o as t2, max(end_ms) over (partition by asset_id) as last_ms from n window o as (partition by asset_id order by start_ms, seq)),
x as (select *, concat_ws(' ', norm, case when s1 - start_ms < 12000 then t1 end, case when s1 - start_ms < 6000 and s2 - start_ms < 12000 then t2 end) as words from w), cue as (select asset_id, start_ms as cue_ms, last_ms from x where (contains(words, 'with') or contains(words, 'dans')) and (contains(words, 'the') or contains(words, 'les'))),
gl as (select asset_id, asset_id * 1000 + min(seq) as goal_id, min(start_ms) as goal_ms from n group by asset_id), f as (select goal_id, cue_ms, last_ms from gl join cue using (asset_id) where cue_ms between goal_ms + 5000 and goal_ms + 300000)
"""


@query("d9_goal_replay_cues", needs=("segments",), sql=CUE + """, thin as (with recursive kept as (select goal_id, min(cue_ms) as cue_ms, 1 as k, max(last_ms) as last_ms from f group by goal_id union all select h.goal_id, min(f.cue_ms), h.k + 1, h.last_ms from kept h join f on f.goal_id = h.goal_id and f.cue_ms > h.cue_ms + 25000 where h.k < 3 group by h.goal_id, h.cue_ms, h.k, h.last_ms) select * from kept)
select goal_id, cue_ms, greatest(0, cue_ms - 8000) as from_ms, least(last_ms, cue_ms + 25000) as to_ms from thin""")  # fmt: skip
def d9(t: Tables):
    s = t("segments")
    goals = s.groupBy("asset_id").agg((F.col("asset_id") * 1000 + F.min("seq")).alias("goal_id"), F.min("start_ms").alias("goal_ms"))
    return P.goal_replay_cues(goals, s, ("with", "dans"), ("the", "les"))


OUTCOMES = [("en", "SAVE", 0, "with the"), ("en", "SAVE", 1, "and"), ("en", "CORNER", 0, "from"), ("fr", "SAVE", 0, "dans la"), ("fr", "PENALTY_TAKEN", 0, "avec"), ("de", "WIDE", 0, "auf"), ("es", "POST", 0, "para")]


@query("d6_outcome_cues", needs=("segments",), sql=", oc(of_lang, outcome, phrase_rank, phrase) as (values " + ", ".join(map(str, OUTCOMES)) + f"""), n as (select asset_id, seq, start_ms, language, {NORM} as norm from segments)
select asset_id, seq, start_ms as ts_ms, outcome, arg_min(phrase, phrase_rank) as phrase, case when outcome = 'CORNER' or outcome like 'PENALTY\\_%' escape '\\' then 0.72 else 0.78 end as confidence from n join oc on of_lang = language and contains(norm, phrase) group by asset_id, seq, start_ms, outcome""")  # fmt: skip
def d6(t: Tables):
    names = ("lang", "outcome", "phrase_rank", "phrase")
    table = phrases.as_rows(t("segments").sparkSession, OUTCOMES, ["lang", "outcome", "phrase_rank", "phrase"])
    return P.detect_outcomes(t("segments"), table)


AGAINST = (("No goal is given. ", ""), ("A correction of the score: ", ""), ("In slow motion, ", ""), ("She had already scored: ", ""), ("As mentioned earlier, the replay shows ", ""))


@query("x10_goal_context", needs=("segments",), sql=f""", told as ({told(*AGAINST)}), n as (select asset_id, seq, {NORM} as norm from told), f as (select *, regexp_matches(norm, '{X.PAST_SCORING}') or regexp_matches(norm, '{"|".join(X.PAST_PHRASES)}') as past from n)
select asset_id, seq, array_to_string(list_filter([case when regexp_matches(norm, '{X.NEGATED}') then 'NEGATION_CONTEXT' end, case when regexp_matches(norm, '{X.CORRECTED}') then 'CORRECTION_CONTEXT' end,
  case when regexp_matches(norm, '{"|".join(X.REPLAY_PHRASES)}') then 'REPLAY_CONTEXT' end, case when past then 'RETROSPECTIVE_CONTEXT' end, case when past then 'HISTORICAL_REFERENCE' end], lambda x : x is not null), ',') as types from f""")  # fmt: skip
def x10(t: Tables):
    found = X.goal_context(F.col("norm"))
    return with_openings(t, AGAINST).select("asset_id", "seq", F.array_join(F.transform(found, lambda x: x.type), ",").alias("types"))


@query("x17_language_tag", needs=("segments",), sql="select asset_id, seq, language as lang from segments")
def x17(t: Tables):
    names = {"en": "English", "fr": "fr-FR", "de": "DE_at", "es": "Spanish"}
    spelled = F.element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), F.col("language"))
    return t("segments").select("asset_id", "seq", X.primary_language(spelled).alias("lang"))


@query("x22_taxonomy", needs=("signals",), sql="select signal_type, replace(signal_type, '_', ' ') as label, count(*) as n from signals group by signal_type")
def x22(t: Tables):
    return t("signals").groupBy("signal_type").agg(F.count(F.lit(1)).alias("n")).select("signal_type", V.readable(F.col("signal_type")).alias("label"), "n")


@query("x25_failure_text", sql=r"select doc_id, case when t = '' then 'unknown failure' else t[1:80] end as reason from (select doc_id, trim(regexp_replace(text, '[\x00-\x1F\x7F]+', ' ', 'g')) as t from documents)")
def x25(t: Tables):
    return t("documents").select("doc_id", X.failure_text(F.col("text"), 80, "unknown failure").alias("reason"))


def sampled(t: Tables, waves: int, rate: int, samples: int, wave):
    """A window of samples for each event: one of some waves, each made once and broadcast (constants: event_id % waves says which). A window is a thousand
    times as long as the event it is made of, so events are dealt to all tasks first."""
    spark = t("events").sparkSession
    made = spark.range(1 - waves, waves).select(F.col("id").alias("k"), F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: wave(i, F.col("id"))).alias("samples"))
    rows = t("events").select(F.col("user_id").alias("asset_id"), F.col("event_id").alias("window"), F.lit(rate).alias("rate"), (F.col("event_id") % waves).alias("k"))
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "window").join(F.broadcast(made), "k", "left").drop("k")


@query("a9_audio_features")
def a9(t: Tables):
    return D.audio_windows(sampled(t, 7, 1600, 1600, lambda i, k: F.sin(i * (0.1 + k * 0.01)) * 0.1 * (k + 1)))


@query("a10_pitch_features")
def a10(t: Tables):
    return D.pitch_features(sampled(t, 10, 8000, 8000, lambda i, k: F.sin(i * (6.283185307179586 * (100 + k * 20) / 8000))))


@query("d3_penalty_goals", needs=("signals",), sql=""", p as (select distinct asset_id, ts_ms from signals where event_type = 'SHOT'), s2 as (select p.* from p where exists (select 1 from signals a where a.asset_id = p.asset_id and a.signal_type = 'ATTACK_BUILDUP' and a.ts_ms between p.ts_ms and p.ts_ms + 45000)
  and exists (select 1 from signals a where a.asset_id = p.asset_id and a.signal_type = 'AUDIO_SPIKE' and a.ts_ms between p.ts_ms and p.ts_ms + 45000) and not exists (select 1 from signals a where a.asset_id = p.asset_id and a.signal_type = 'REPLAY_CONTEXT' and a.ts_ms between p.ts_ms and p.ts_ms + 45000)
  and not exists (select 1 from signals a where a.asset_id = p.asset_id and a.event_type = 'GOAL' and a.ts_ms between p.ts_ms - 90000 and p.ts_ms + 90000)),
thin as (with recursive kept as (select asset_id, min(ts_ms) as ts_ms from s2 group by asset_id union all select k.asset_id, min(s.ts_ms) from kept k join s2 s on s.asset_id = k.asset_id and s.ts_ms > k.ts_ms + 90000 group by k.asset_id, k.ts_ms) select * from kept) select asset_id, ts_ms from thin""")  # fmt: skip
def d3(t: Tables):
    s = t("signals")
    return P.penalty_goals(t("segments"), s.where("event_type = 'SHOT'"), s.where("signal_type = 'ATTACK_BUILDUP'"), s.where("signal_type = 'AUDIO_SPIKE'"), s.where("signal_type = 'REPLAY_CONTEXT'"), s.where("event_type = 'GOAL'"))


@query("w16_continuity", needs=("segments", "assets"), sql=""", p as (select asset_id as pair_id, asset_id, 1000 as a_ms, 20000 + asset_id % 5 * 10000 as b_ms from assets), n as (select p.*, s.start_ms, s.end_ms from p join segments s on s.asset_id = p.asset_id and s.start_ms < b_ms and s.end_ms > a_ms),
h as (select *, start_ms - greatest(a_ms, coalesce(max(end_ms) over (partition by pair_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding), a_ms)) as hole from n), m as (select pair_id, max(hole) as hole, max(end_ms) as e from h group by 1)
select p.pair_id, coalesce(hole <= 2000 and b_ms - e <= 2000, false) as continuous from p left join m using (pair_id)""")  # fmt: skip
def w16(t: Tables):
    pairs = t("assets").select(F.col("asset_id").alias("pair_id"), "asset_id", F.lit(1000).alias("a_ms"), (20_000 + F.col("asset_id") % 5 * 10_000).alias("b_ms"))
    return P.is_continuous(pairs, t("segments"), 2000).select("pair_id", "continuous")


@query("e9_replays_of_goals")
def e9(t: Tables):
    goals = t("candidates").where("event_type = 'GOAL'").select("asset_id", "run_id", F.col("candidate_id").alias("goal_id"), F.col("trigger_ms").alias("goal_ms"), "status")
    near = DEFAULTS.attach_ms
    windows = goals.select("asset_id", "goal_id", F.greatest(F.lit(0), F.col("goal_ms") - near).alias("start_ms"), (F.col("goal_ms") + near).alias("end_ms"))
    told = goals.join(P.window_context(windows, t("segments"), ["goal_id"]), "goal_id")
    return E.resolve_replays(goals, E.replay_pairs(told))


@query("u1_union_of_detectors")
def u1(t: Tables):
    words = P.detect_lexical(t("segments"), lexicon(t), 2).select("asset_id", "ts_ms", F.col("event_type").alias("signal_type"), "confidence")
    loud = P.detect_emphasis(t("segments")).select("asset_id", "ts_ms", "signal_type", "confidence")
    fast = P.detect_speech_rate(t("segments")).select("asset_id", "ts_ms", F.lit("SPEECH_RATE_SPIKE").alias("signal_type"), "confidence")
    context = P.detect_context(t("segments")).select("asset_id", "ts_ms", "signal_type", "confidence")
    every = words.unionByName(loud).unionByName(fast).unionByName(context).unionByName(D.detect_audio(t("audio_windows")))
    return every.groupBy("signal_type").agg(F.count(F.lit(1)).alias("n"), r6(F.max("confidence")).alias("top"))


@query("w11_score_changes")
def w11(t: Tables):
    told = t("ocr_readings").select("asset_id", F.lit("en").alias("language"), F.floor(F.col("ts_ms") / 5000).cast("int").alias("seq"), F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + 2500).alias("end_ms"), F.translate("raw_text", "O", "0").alias("text"))
    return P.score_changes(told)


@query("a5_match_keys", needs=("assets",), sql="select asset_id, case when coalesce(trim(home_team), '') <> '' and coalesce(trim(away_team), '') <> '' then 'match:' || lower(trim(competition)) || '|' || lower(trim(home_team)) || '|' || lower(trim(away_team)) else 'asset:' || asset_id end as match_key from assets")
def a5k(t: Tables):
    return t("assets").select("asset_id", A.match_key(t("assets")).alias("match_key"))
