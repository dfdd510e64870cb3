"""Queries of text functions, detectors, assembly, matching and sequences, each with its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import text as X
from touchline.operators import assemble as E
from touchline.operators import audio as D
from touchline.operators import matching as M
from touchline.operators import phrases as R
from touchline.operators import scoreboard as B
from touchline.operators import sequence as S
from touchline.operators import timejoin as T
from touchline.operators import transcript as P
from touchline.plans.registry import Tables, query

NORM = r"trim(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]+', ' ', 'g'))"
#: Common words of the test texts stand in for football phrases.
LEXICON = [("en", "GOAL", "with"), ("en", "GOAL", "from"), ("en", "SHOT", "was"), ("en", "SAVE", "are"), ("en", "PENALTY", "for this"), ("fr", "GOAL", "dans"), ("fr", "SHOT", "pour"), ("fr", "FOUL", "par"), ("de", "GOAL", "auf"), ("de", "SHOT", "mit"), ("de", "FOUL", "sich"), ("es", "GOAL", "una"), ("es", "SHOT", "para"), ("es", "FOUL", "por"), ("und", "VAR", "of the"), ("und", "VAR", "de la")]
LEX_SQL = ", lex(of_lang, event_type, phrase) as (values " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in LEXICON) + ")"


def lexicon(t: Tables):
    return R.as_rows(t("segments").sparkSession, LEXICON, ["lang", "event_type", "phrase"])


def r6(c):
    return F.round(c, 6)


@query("x1_normalize_text", needs=("segments",), sql=f"select asset_id, seq, {NORM} as norm from segments")
def x1(t: Tables):
    return t("segments").select("asset_id", "seq", X.normalize_text(F.col("text")).alias("norm"))


@query("x2_repair_mojibake")
def x2(t: Tables):
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return t("segments").select("asset_id", "seq", X.repair_mojibake(broken).alias("text"))


@query("x3_contains_phrase", needs=("segments",), sql=f"select asset_id, seq from segments where contains(' ' || {NORM} || ' ', ' of the ') or contains(' ' || {NORM} || ' ', ' de la ')")
def x3(t: Tables):
    norm = X.normalize_text(F.col("text"))
    return t("segments").where(X.contains_phrase(norm, "of the") | X.contains_phrase(norm, "de la")).select("asset_id", "seq")


MATCHED = LEX_SQL + f""", n as (select asset_id, seq, start_ms, language, {NORM} as norm from segments),
hit as (select distinct asset_id, seq, start_ms, event_type, phrase from n join lex on (of_lang = language or of_lang = 'und') and contains(' ' || norm || ' ', ' ' || phrase || ' '))
"""


@query("x4_match_lexicon", needs=("segments",), sql=MATCHED + "select asset_id, seq, event_type, phrase from hit")
def x4(t: Tables):
    return P.match_lexicon(P.normalized(t("segments")), lexicon(t), 2).select("asset_id", "seq", "event_type", "phrase")


@query("d1_lexical_events", needs=("segments",), sql=MATCHED + r""", base(event_type, b) as (values ('GOAL', 0.88e0), ('SHOT', 0.82e0), ('SAVE', 0.76e0), ('PENALTY', 0.84e0), ('FOUL', 0.65e0), ('VAR', 0.76e0)),
m as (select asset_id, seq, start_ms, event_type, list_sort(list(phrase))[1:3] as matches from hit group by all),
f as (select *, array_to_string(matches, '|') as fp from m),
l as (select *, lag(start_ms) over (partition by asset_id, event_type, fp order by start_ms, seq) as b4 from f)
select asset_id, seq, start_ms as ts_ms, l.event_type, round(least(0.98, b + 0.07 * (len(matches) - 1)), 6) as confidence, fp as matches from l join base using (event_type)
where event_type <> 'GOAL' or b4 is null or start_ms - b4 > 90000""")  # fmt: skip
def d1(t: Tables):
    return P.detect_lexical(t("segments"), lexicon(t), 2).select("asset_id", "seq", "ts_ms", "event_type", r6(F.col("confidence")).alias("confidence"), F.array_join("matches", "|").alias("matches"))


EMPHASIS = r"""case when m > 0 or (l >= 8 and c >= 0.65e0) then round(least(0.98e0, 0.48e0 + least(m, 4) * 0.08e0 + greatest(0, c - 0.65e0) * 0.6e0), 6) end"""


@query("x6_emphasis", sql=rf"""select doc_id, {EMPHASIS} as confidence from (select doc_id, length(regexp_replace(text, '[^!]', '', 'g')) as m, length(regexp_replace(text, '\P{{L}}', '', 'g')) as l,
  length(regexp_replace(text, '\P{{Lu}}', '', 'g')) / greatest(1, length(regexp_replace(text, '\P{{L}}', '', 'g'))) as c from documents)""")  # fmt: skip
def x6(t: Tables):
    return t("documents").select("doc_id", r6(X.emphasis_confidence(F.col("text"), 8, 0.65)).alias("confidence"))


@query("x7_repeated_words", needs=("segments",), sql=f"select asset_id, seq, len(list_filter(range(2, len(w) + 1), lambda i : w[i] = w[i - 1])) as n from (select asset_id, seq, list_filter(string_split({NORM}, ' '), lambda x : x <> '') as w from segments)")
def x7(t: Tables):
    return t("segments").select("asset_id", "seq", X.repeated_words(X.normalize_text(F.col("text"))).alias("n"))


@query("x13_word_count", sql=r"select doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+')) as words from documents")
def x13(t: Tables):
    return t("documents").select("doc_id", X.word_count(F.col("text")).alias("words"))


@query("x14_jaccard_of_turns", sql=r"""with w as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as a, lag(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) over (partition by conv_id order by turn) as b from conversations)
select conv_id, turn, case when len(a) > 0 and len(b) > 0 then round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) else 0 end as similarity from w where b is not null""")  # fmt: skip
def x14(t: Tables):
    from pyspark.sql import Window

    own = X.token_set(F.col("text"), "raw")
    rows = t("conversations").withColumn("a", own).withColumn("b", F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return rows.select("conv_id", "turn", r6(X.jaccard(F.col("a"), F.col("b"))).alias("similarity"))


@query("x12_parse_scoreboard", needs=("ocr_readings",), sql=r"""select asset_id, ts_ms, h::int as home, a::int as away from (select asset_id, ts_ms, translate(regexp_extract(raw_text, '([0-9OIl]{1,2})\s*[-:–—]\s*([0-9OIl]{1,2})', 1), 'OIl', '011') as h,
  translate(regexp_extract(raw_text, '([0-9OIl]{1,2})\s*[-:–—]\s*([0-9OIl]{1,2})', 2), 'OIl', '011') as a from ocr_readings) where h <> '' and h::int <= 15 and a::int <= 15""")  # fmt: skip
def x12(t: Tables):
    return t("ocr_readings").select("asset_id", "ts_ms", X.parse_score_ocr(F.col("raw_text")).alias("s")).where("s is not null").select("asset_id", "ts_ms", "s.home", "s.away")


@query("j7_local_context", needs=("segments",), sql=f""", n as (select *, {NORM} as norm from segments), w as (select *, lag(struct_pack(s := start_ms, e := end_ms, x := norm), 2) over o as a, lag(struct_pack(s := start_ms, e := end_ms, x := norm)) over o as b,
  lead(struct_pack(s := start_ms, e := end_ms, x := norm)) over o as c, lead(struct_pack(s := start_ms, e := end_ms, x := norm), 2) over o as d from n window o as (partition by asset_id order by start_ms, seq))
select asset_id, seq, concat_ws(' ', case when a.e >= greatest(0, start_ms - 3000) and a.s <= end_ms + 3000 then a.x end, case when b.e >= greatest(0, start_ms - 3000) and b.s <= end_ms + 3000 then b.x end, norm,
  case when c.e >= greatest(0, start_ms - 3000) and c.s <= end_ms + 3000 then c.x end, case when d.e >= greatest(0, start_ms - 3000) and d.s <= end_ms + 3000 then d.x end) as context from w""")  # fmt: skip
def j7(t: Tables):
    return P.local_context(t("segments")).select("asset_id", "seq", "context")


@query("j8_window_context", needs=("candidates", "segments"), sql="""select candidate_id, string_agg(text, ' ' order by s.start_ms, s.seq)[1:6000] as context from candidates c join segments s on s.asset_id = c.asset_id and s.start_ms < c.end_ms and s.end_ms > c.start_ms group by candidate_id""")
def j8(t: Tables):
    windows = t("candidates").select("candidate_id", "asset_id", "start_ms", "end_ms")
    return P.window_context(windows, t("segments"), ["candidate_id"])


@query("w9_repetition", needs=("segments",), sql=f""", n as (select asset_id, seq, start_ms, {NORM} as norm from segments where {NORM} <> ''), w as (select *, count(*) over (partition by asset_id, norm order by start_ms range between 20000 preceding and current row) as recent,
  list_filter(string_split(norm, ' '), lambda x : x <> '') as t from n), g as (select *, greatest(recent, len(list_filter(range(2, len(t) + 1), lambda i : t[i] = t[i - 1])) + 1) as times from w)
select asset_id, seq, start_ms as ts_ms, round(least(0.97, 0.58 + 0.08 * (times - 2)), 6) as confidence from g where len(t) >= 2 and times >= 2""")  # fmt: skip
def w9(t: Tables):
    return P.detect_emphasis(t("segments")).where("signal_type = 'TRANSCRIPT_REPETITION'").select("asset_id", "seq", "ts_ms", r6(F.col("confidence")).alias("confidence"))


RATE = rf""", n as (select asset_id, seq, start_ms, len(regexp_extract_all({NORM}, '[\p{{L}}\p{{N}}]+')) as own from segments),
w as (select *, coalesce(sum(own) over (partition by asset_id order by start_ms range between 10000 preceding and current row), 0)::bigint as words,
  coalesce(sum(own) over (partition by asset_id order by start_ms range between 20000 preceding and 10001 preceding), 0)::bigint as before from n),
fast as (select asset_id, seq, start_ms as ts_ms, words, before, (words + 1) / (before + 1) as ratio from w where (words + 1) / (before + 1) >= 1.8e0 and words >= 8 and not (before = 0 and start_ms < 20000))
"""


@query("w8_speech_rate", needs=("segments",), sql=RATE + "select asset_id, seq, ts_ms, words, before, round(ratio, 6) as ratio from fast")
def w8(t: Tables):
    return P.speech_rate(t("segments")).withColumn("ratio", r6(F.col("ratio")))


@query("d5_speech_rate_signals")
def d5(t: Tables):
    return P.detect_speech_rate(t("segments"))


@query("w12_thin_by_last_kept", needs=("signals",), sql=""", s as (select asset_id, min(ts_ms) as ts_ms from signals where signal_type = 'REPLAY_CONTEXT' group by asset_id, ts_ms), thin as (
  with recursive kept as (select asset_id, min(ts_ms) as ts_ms from s group by asset_id union all
    select k.asset_id, min(s.ts_ms) from kept k join s on s.asset_id = k.asset_id and s.ts_ms > k.ts_ms + 25000 group by k.asset_id, k.ts_ms) select * from kept)
select asset_id, ts_ms from thin""")  # fmt: skip
def w12(t: Tables):
    cues = t("signals").where("signal_type = 'REPLAY_CONTEXT'").select("asset_id", "ts_ms").distinct()
    return S.thin_by_last_kept(cues, ["asset_id"], "ts_ms", 25_000, False)


AUDIO = """, b as (select *, list_sort(list_concat(coalesce(list(dbfs) over (partition by asset_id order by ts_ms range between 15000 preceding and 1001 preceding), []), coalesce(list(dbfs) over (partition by asset_id order by ts_ms range between 1001 following and 15000 following), []))) as near,
  list_sort(list_reverse(coalesce(list(median_pitch_hz) filter (where voiced_frame_ratio >= 0.34 and median_pitch_hz > 0) over (partition by asset_id order by ts_ms range between 15000 preceding and 1 preceding), []))[1:15]) as pit,
  dbfs - lag(dbfs, 3) over (partition by asset_id order by ts_ms) as rise_db, voiced_frame_ratio >= 0.34 and median_pitch_hz > 0 as voiced from audio_windows),
c as (select *, case len(near) when 0 then null else list_aggregate(near, 'median') end as baseline_db, case when len(pit) > 0 then pit[len(pit) // 2 + 1] end as pitch_baseline_hz from b),
d as (select *, dbfs - baseline_db as excess_db, coalesce(dbfs >= -45 and dbfs - baseline_db >= 9, false) as spike from c)
"""


@query("w2_centred_median", needs=("audio_windows",), sql=AUDIO + "select asset_id, ts_ms, round(baseline_db, 6) as baseline_db, round(pitch_baseline_hz, 6) as pitch_baseline_hz, round(rise_db, 6) as rise_db, spike from d")
def w2(t: Tables):
    return D.with_baselines(t("audio_windows")).select("asset_id", "ts_ms", r6(F.col("baseline_db")).alias("baseline_db"), r6(F.col("pitch_baseline_hz")).alias("pitch_baseline_hz"), r6(F.col("rise_db")).alias("rise_db"), "spike")


ISLANDS = AUDIO + """, rn as (select *, row_number() over (partition by asset_id order by ts_ms) as r from d), isl as (select *, r - row_number() over (partition by asset_id order by ts_ms) as island from rn where spike),
runs as (select asset_id, island, (list(ts_ms order by excess_db desc, ts_ms))[1] as peak_ms, max(excess_db) as peak_db, max(ts_ms) - min(ts_ms) + 1000 as active_ms from isl group by asset_id, island)
"""


@query("w5_spike_islands", needs=("audio_windows",), sql=ISLANDS + "select asset_id, peak_ms, round(peak_db, 6) as peak_db, active_ms from runs")
def w5(t: Tables):
    return D.spike_islands(D.with_baselines(t("audio_windows"))).withColumn("peak_db", r6(F.col("peak_db")))


@query("d7_audio_signals", needs=("audio_windows",), sql=ISLANDS + """, pr as (select *, voiced and coalesce(median_pitch_hz / pitch_baseline_hz >= 1.25, false) as pitch_rise, voiced and pitch_variance_hz / median_pitch_hz >= 0.18e0 as variance, peak_dbfs - baseline_db as above from d),
own as (select asset_id, ts_ms, 'AUDIO_ENERGY_RISE' as signal_type, least(0.88, 0.58 + (rise_db - 9) / 35) as confidence from pr where rise_db >= 9 and excess_db >= 4.5 and dbfs >= -45
union all select asset_id, ts_ms, 'PITCH_RISE', least(0.94, 0.62 + (median_pitch_hz / pitch_baseline_hz - 1.25) * 0.35) from pr where pitch_rise
union all select asset_id, ts_ms, 'PITCH_VARIANCE', least(0.90, 0.58 + pitch_variance_hz / median_pitch_hz * 0.35) from pr where variance
union all select asset_id, ts_ms, 'VOICE_EXCITEMENT', least(0.95, 0.55 + greatest(0, coalesce(above, 0)) / 45 + case when pitch_rise then 0.12 else 0 end) from pr where pitch_rise or variance or (voiced and spike and above >= 9)
union all select asset_id, ts_ms, 'CROWD_REACTION_PROXY', least(0.86, 0.55 + excess_db / 50) from pr where spike and zero_crossing_rate >= 0.12),
v as (select *, case when ts_ms - lag(ts_ms) over (partition by asset_id order by ts_ms) > 2000 then 1 else 0 end as nw from own where signal_type = 'VOICE_EXCITEMENT'), vc as (select *, sum(nw) over (partition by asset_id order by ts_ms) as cl from v),
hi as (select asset_id, min(ts_ms) as ts_ms, max(ts_ms) - min(ts_ms) + 1000 as span, max(confidence) as confidence from vc group by asset_id, cl)
select asset_id, ts_ms, signal_type, round(confidence, 6) as confidence from own union all select asset_id, peak_ms, 'AUDIO_SPIKE', round(least(0.99, 0.55 + greatest(0, peak_db - 9) / 25), 6) from runs
union all select asset_id, peak_ms, 'AUDIO_SUSTAINED', round(least(0.97, 0.55 + active_ms / 40000), 6) from runs where active_ms >= 1500
union all select asset_id, ts_ms, 'HIGH_EXCITEMENT', round(confidence, 6) from hi where span >= 3000 and confidence >= 0.72""")  # fmt: skip
def d7(t: Tables):
    return D.detect_audio(t("audio_windows")).withColumn("confidence", r6(F.col("confidence")))


PARSED = r""", p as (select asset_id, ts_ms, confidence, translate(regexp_extract(raw_text, '([0-9OIl]{1,2})\s*[-:–—]\s*([0-9OIl]{1,2})', 1), 'OIl', '011') as h, translate(regexp_extract(raw_text, '([0-9OIl]{1,2})\s*[-:–—]\s*([0-9OIl]{1,2})', 2), 'OIl', '011') as a from ocr_readings),
q as (select asset_id, ts_ms, confidence, h::int * 100 + a::int as sc from p where h <> '' and h::int <= 15 and a::int <= 15),
nw as (select *, case when lag(sc) over (partition by asset_id order by ts_ms) <> sc then 1 else 0 end as n from q), r as (select *, sum(n) over (partition by asset_id order by ts_ms) as run from nw)
"""
STATES = PARSED + """, l as (select *, lag(ts_ms) over (partition by asset_id, run order by ts_ms) as bt, lag(confidence) over (partition by asset_id, run order by ts_ms) as bc from r),
fs as (select asset_id, run, sc, bt as ts_ms, (confidence + bc) / 2 as confidence from (select *, row_number() over (partition by asset_id, run order by ts_ms) as k from l where ts_ms - bt <= 12000) where k = 1),
st as (select *, lag(sc) over (partition by asset_id order by run) as pv from fs), states as (select * from st where pv is null or pv <> sc)
"""
BACK = """, ru as (select asset_id, run, count(*) as n, min(sc) as sc, min(ts_ms) as ts_ms, min(confidence) as least_c, arg_max(confidence, ts_ms) as last_c, arg_min(confidence, ts_ms) as first_c from r group by asset_id, run),
ne as (select *, lag(sc) over o as ps, lag(last_c) over o as pc, lead(sc) over o as ns, lead(first_c) over o as nc from ru window o as (partition by asset_id order by run)), back as (select * from ne where n < 2 and ps = ns)
"""


@query("w13_stable_scores", needs=("ocr_readings",), sql=STATES + "select asset_id, ts_ms, sc // 100 as home, sc % 100 as away, pv // 100 as previous_home, pv % 100 as previous_away, round(confidence, 6) as confidence from states")
def w13(t: Tables):
    return B.scoreboard_states(t("ocr_readings")).withColumn("confidence", r6(F.col("confidence")))


@query("w14_score_reversals", needs=("ocr_readings",), sql=PARSED + BACK + "select asset_id, ts_ms, round(least(pc, least_c, nc), 6) as confidence from back")
def w14(t: Tables):
    return B.score_reversals(t("ocr_readings")).withColumn("confidence", r6(F.col("confidence")))


@query("a15_scoreboard_counters", needs=("ocr_readings",), sql=STATES + BACK + """select o.asset_id, count(*) as sampled, (select count(*) from q where q.asset_id = o.asset_id) as parsed, round(avg(confidence), 6) as mean_confidence,
  (select count(*) from states s where s.asset_id = o.asset_id) as states, (select count(pv) from states s where s.asset_id = o.asset_id) as transitions, (select count(*) from back b where b.asset_id = o.asset_id) as reversals from ocr_readings o group by o.asset_id""")  # fmt: skip
def a15(t: Tables):
    return B.scoreboard_counters(t("ocr_readings"))


DISCOVER = """, sh as (select asset_id, run_id, id, ts_ms as s from signals where signal_type = 'TRANSCRIPT_SHOT' and event_type = 'SHOT'),
pa as (select sh.*, g.ts_ms, g.signal_type, g.confidence from sh join signals g on g.asset_id = sh.asset_id and g.run_id = sh.run_id and g.ts_ms between greatest(0, s - 45000) and s + 8000),
go as (select asset_id, run_id, id, s, (list(confidence order by ts_ms desc, confidence desc) filter (where signal_type = 'ATTACK_BUILDUP' and ts_ms < s))[1] as led, max(confidence) filter (where signal_type = 'AUDIO_SPIKE' and ts_ms >= s) as audio from pa group by all)
"""


@query("d8_discovered_goals", needs=("signals",), sql=DISCOVER + "select asset_id, run_id, id, s as ts_ms, round(least(0.88, 0.76 + 0.12 * least(audio, led)), 6) as confidence from go where audio >= 0.45 and led is not null")
def d8(t: Tables):
    return E.discover_goals(t("signals")).withColumn("confidence", r6(F.col("confidence")))


ASSEMBLE = """, an as (select asset_id, run_id, event_type, ts_ms as trigger_ms, min(id) as anchor_id, max(confidence) as direct from signals where event_type is not null group by all),
am as (select distinct asset_id, run_id, trigger_ms as a from an),
su as (select an.*, g.ts_ms, g.signal_type, g.confidence from an join signals g on g.asset_id = an.asset_id and g.run_id = an.run_id and g.event_type is null where
  (g.signal_type = 'REPLAY_CONTEXT' and g.ts_ms between trigger_ms - 120000 and trigger_ms) or (g.signal_type = 'AUDIO_SPIKE' and g.ts_ms between trigger_ms - 8000 and trigger_ms + 8000)
  or (g.signal_type = 'ATTACK_BUILDUP' and g.ts_ms between trigger_ms - 45000 and trigger_ms and not exists (select 1 from am where am.asset_id = an.asset_id and am.run_id = an.run_id and am.a > g.ts_ms and am.a < an.trigger_ms))),
fa as (select anchor_id, event_type, coalesce(max(confidence) filter (where signal_type = 'AUDIO_SPIKE'), 0) * 0.6 as audio, coalesce(max(confidence) filter (where signal_type = 'ATTACK_BUILDUP'), 0) as buildup,
  coalesce(max(confidence) filter (where signal_type = 'REPLAY_CONTEXT'), 0) as replay, coalesce(max(confidence) filter (where signal_type = 'REPLAY_CONTEXT' and trigger_ms - ts_ms <= 8000 and confidence >= 0.68), 0) as negative, count(*) as supporting from su group by all),
al as (select an.*, coalesce(audio, 0) as audio, coalesce(buildup, 0) as buildup, coalesce(replay, 0) as replay, case when an.event_type = 'GOAL' then coalesce(negative, 0) else 0 end as negative, coalesce(supporting, 0) as supporting from an left join fa using (anchor_id, event_type)),
re as (select *, case when event_type = 'GOAL' and replay >= 0.68 then replay else 0 end as ru from al),
sc as (select *, floor(greatest(0, least(1, 0.20 + 0.45 * direct + 0.25 * audio + 0.07 * buildup - 0.40 * ru - 0.45 * negative)) * 1e4 + 0.500001e0) / 1e4 as live,
  floor(greatest(0, least(0.98, 0.70 * direct + 0.30 * audio + case when direct > 0 and audio > 0 then 0.025 else 0 end + 0.05 * buildup - 0.20 * ru - 0.45 * negative)) * 1e4 + 0.500001e0) / 1e4 as score from re)
"""


@query("j11_attached_support", needs=("signals",), sql=ASSEMBLE + "select anchor_id, event_type, count(*) as n, min(ts_ms) as first_ms from su group by all")
def j11(t: Tables):
    return E.attach_support(E.anchors(t("signals")), t("signals")).groupBy("anchor_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ms"))


def scored(t: Tables):
    a = E.anchors(t("signals"))
    return E.score_candidates(E.family_confidences(a, E.attach_support(a, t("signals"))))


@query("a11_family_confidences", needs=("signals",), sql=ASSEMBLE + "select anchor_id, event_type, round(audio, 6) as audio, round(buildup, 6) as buildup, round(replay, 6) as replay, round(negative, 6) as negative, supporting from al")
def a11(t: Tables):
    return scored(t).select("anchor_id", "event_type", *(r6(F.col(c)).alias(c) for c in ("audio", "buildup", "replay", "negative")), "supporting")


@query("e7_scores", needs=("signals",), sql=ASSEMBLE + "select anchor_id, event_type, trigger_ms, live, score from sc")
def e7(t: Tables):
    return scored(t).select("anchor_id", "event_type", "trigger_ms", "live", "score")


@query("a12_score_components", needs=("signals",), sql=ASSEMBLE + """, pc as (select anchor_id, event_type, score, 0.7 * direct as a, 0.3 * audio as b, case when direct > 0 and audio > 0 then 0.025 else 0 end as c, 0.05 * buildup as d, -0.2 * ru as e, -0.45 * negative as f from sc)
select anchor_id, event_type, floor((score - (a + b + c + d + e + f)) * 1e3 + 0.501e0) / 1e3 as clamp, floor(a * 1e4 + 0.51e0) / 1e4 as evidence from pc""")  # fmt: skip
def a12(t: Tables):
    rows = E.score_components(scored(t))
    pick = lambda name: F.max(F.when(F.col("component") == name, F.col("contribution")))
    clamp, evidence = F.floor(pick("CLAMP") * 1e3 + 0.501) / 1e3, F.floor(pick("EVENT_EVIDENCE") * 1e4 + 0.51) / 1e4
    return rows.groupBy("anchor_id", "event_type").agg(clamp.alias("clamp"), evidence.alias("evidence"))


@query("e8_rejection_reasons", needs=("signals",), sql=ASSEMBLE + """, rr as (select anchor_id, event_type, list_filter([case when ru > 0 then 'REPLAY_OF_EXISTING_GOAL' end, case when negative > 0 then 'REPLAY_COMMENTARY_REFERENCE' end, case when direct < 0.8 then 'INSUFFICIENT_EVENT_SPECIFIC_EVIDENCE' end,
  case when event_type = 'GOAL' and audio < 0.45 then 'GOAL_WITHOUT_REACTION_CORROBORATION' end, case when live < 0.55 then 'LOW_LIVE_EVENT_PROBABILITY' end, case when score < 0.52 then 'LOW_CANDIDATE_SCORE' end], lambda x : x is not null) as l from sc)
select anchor_id, event_type, array_to_string(l, ',') as reasons, case when len(l) = 0 then 'DETECTED' else 'REJECTED' end as status from rr""")  # fmt: skip
def e8(t: Tables):
    return E.rejection_reasons(scored(t)).select("anchor_id", "event_type", F.array_join("reasons", ",").alias("reasons"), "status")


@query("e4_triggers", needs=("candidates", "signals"), sql="""select candidate_id, arg_min(g.ts_ms, (-g.confidence, g.ts_ms)) as trigger_ms from candidates c join signals g on g.asset_id = c.asset_id and g.run_id = c.run_id
  and g.ts_ms between c.start_ms and c.end_ms and g.event_type is not null group by candidate_id""")  # fmt: skip
def e4(t: Tables):
    c = t("candidates").select("candidate_id", "asset_id", "run_id", "start_ms", "end_ms")
    s = t("signals").select("asset_id", "run_id", "ts_ms", "signal_type", "event_type", "confidence").withColumn("confirms", F.lit(False))
    return E.choose_trigger(T.range_join(c, s, ["asset_id", "run_id"], F.col("start_ms"), F.col("end_ms"), "ts_ms", 30_000), ["candidate_id"])


@query("e1_assembled_candidates")
def e1(t: Tables):
    return E.assemble(t("signals")).select("anchor_id", "event_type", "status", "score", "rank")


@query("e12_event_end", needs=("candidates", "signals"), sql=""", nr as (select c.candidate_id, c.event_type, c.start_ms, c.trigger_ms, g.ts_ms, g.signal_type from candidates c join signals g on g.asset_id = c.asset_id and g.run_id = c.run_id and g.ts_ms between c.trigger_ms and c.trigger_ms + 30000),
sp as (select candidate_id, min(ts_ms) as stop from nr where signal_type = 'REPLAY_CONTEXT' and ts_ms > trigger_ms group by 1),
gl as (select candidate_id, max(ts_ms) as glow from nr left join sp using (candidate_id) where signal_type = 'AUDIO_SPIKE' and ts_ms <= trigger_ms + case when event_type = 'GOAL' then 20000 else 8000 end and (stop is null or ts_ms < stop) group by 1)
select candidate_id, greatest(trigger_ms, least(coalesce(glow, trigger_ms) + 8000, coalesce(stop, coalesce(glow, trigger_ms) + 8000), start_ms + 60000)) as end_ms from candidates left join sp using (candidate_id) left join gl using (candidate_id)""")  # fmt: skip
def e12(t: Tables):
    return E.event_end(t("candidates"), t("signals"))


@query("w17_back_chain", needs=("signals",), sql=""", g as (select id, asset_id, run_id, ts_ms as a from signals where event_type = 'GOAL'), x as (select g.id, g.a, s.ts_ms, coalesce(lag(s.ts_ms) over (partition by g.id order by s.ts_ms desc), g.a) - s.ts_ms > 4000 as far from g join signals s on s.asset_id = g.asset_id and s.run_id = g.run_id
  and s.signal_type = 'ATTACK_BUILDUP' and s.ts_ms between g.a - 45000 and g.a), y as (select *, max(far::int) over (partition by id order by ts_ms desc rows unbounded preceding) as b from x)
select id, min(ts_ms) as earliest from y where b = 0 group by id""")  # fmt: skip
def w17(t: Tables):
    goals = t("signals").where("event_type = 'GOAL'").select("id", "asset_id", "run_id", F.col("ts_ms").alias("goal_ms"))
    cues = t("signals").where("signal_type = 'ATTACK_BUILDUP'").select("asset_id", "run_id", "ts_ms")
    near = T.range_join(goals, cues, ["asset_id", "run_id"], F.col("goal_ms") - 45_000, F.col("goal_ms"), "ts_ms", 45_000)
    return S.back_chain(near, ["id"], "goal_ms", "ts_ms", 4000).select("id", "earliest")


ATOMS = """, am as (select candidate_id, g.ts_ms, case signal_type when 'ATTACK_BUILDUP' then 'ATTACK_BUILDUP' when 'TRANSCRIPT_SHOT' then 'SHOT' when 'TRANSCRIPT_GOAL' then 'GOAL' when 'AUDIO_SPIKE' then 'AUDIO_REACTION' else 'REPLAY_EVENT' end as atom, g.confidence
  from candidates c join signals g on g.asset_id = c.asset_id and g.run_id = c.run_id and g.ts_ms between c.start_ms and c.end_ms),
ag as (select candidate_id, ts_ms, atom, max(confidence) as confidence from am group by all), ao as (select *, row_number() over (partition by candidate_id order by ts_ms, atom) - 1 as ordinal from ag)
"""


def candidate_atoms(t: Tables):
    c = t("candidates").select("candidate_id", "asset_id", "run_id", "start_ms", "end_ms")
    s = t("signals").select("asset_id", "run_id", "ts_ms", "signal_type", "confidence")
    return E.atoms(T.range_join(c, s, ["asset_id", "run_id"], F.col("start_ms"), F.col("end_ms"), "ts_ms", 30_000))


@query("g1_atoms", needs=("candidates", "signals"), sql=ATOMS + "select candidate_id, ordinal, ts_ms, atom, confidence from ao")
def g1(t: Tables):
    return candidate_atoms(t).select("candidate_id", "ordinal", "ts_ms", "atom", "confidence")


@query("g3_edges", needs=("candidates", "signals"), sql=ATOMS + """, ed as (select *, lead(ordinal) over o as nx, last_value(case when atom in ('SHOT', 'GOAL') then ordinal end ignore nulls) over p as ac, last_value(case when atom in ('SHOT', 'GOAL') then ts_ms end ignore nulls) over p as act,
  last_value(case when atom = 'GOAL' then ordinal end ignore nulls) over p as gg from ao window o as (partition by candidate_id order by ordinal), p as (partition by candidate_id order by ordinal rows between unbounded preceding and 1 preceding))
select candidate_id, ordinal as from_ordinal, nx as to_ordinal, 'PRECEDES' as relation from ed where nx is not null union all select candidate_id, ordinal, ac, 'SUPPORTS' from ed where atom = 'AUDIO_REACTION' and ts_ms - act <= 45000
union all select candidate_id, ordinal, gg, 'REPLAY_OF' from ed where atom = 'REPLAY_EVENT' and gg is not null""")  # fmt: skip
def g3(t: Tables):
    return E.edges(candidate_atoms(t))


@query("g4_assessment", needs=("candidates", "signals"), sql=ATOMS + """select c.candidate_id, case when status = 'REJECTED' then case when coalesce(rp, false) then 'REPLAY_OR_DUPLICATE' else 'REJECTED_HYPOTHESIS' end when status <> 'DETECTED' then 'UNRESOLVED_HYPOTHESIS'
  when event_type = 'GOAL' then 'CANONICAL_GOAL' else 'DETECTED_EVENT' end as label from candidates c left join (select candidate_id, bool_or(atom = 'REPLAY_EVENT') as rp from ao group by 1) using (candidate_id)""")  # fmt: skip
def g4(t: Tables):
    return E.assessment(t("candidates"), candidate_atoms(t))


@query("m1_run_comparison")
def m1(t: Tables):
    c = t("candidates")
    return M.compare_runs(c.where("run_id = 0"), c.where("run_id = 1"))


@query("m2_ground_truth_evaluation")
def m2(t: Tables):
    return M.evaluate(t("gt_events"), t("gt_reviews"), t("candidates"))


@query("m3_clusters")
def m3(t: Tables):
    return M.cluster_candidates(t("candidates"))


@query("m6_canonical_events")
def m6(t: Tables):
    return M.canonicalize(t("candidates"), M.cluster_candidates(t("candidates")))
