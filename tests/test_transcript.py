"""Signals of phrases and of what is said around them, on hand-written segments."""

import pytest

from touchline.operators import transcript as P

SEGMENTS = "asset_id long, language string, seq int, start_ms long, end_ms long, text string"
EVENTS = [("en", "GOAL", "goal"), ("en", "GOAL", "scores"), ("en", "SHOT", "shoots"), ("en", "RED_CARD", "red card"), ("fr", "GOAL", "but")]
MARKS = [("en", "STRONG", "scores"), ("en", "SCORING", "scores"), ("en", "OWN_GOAL", "own net"), ("en", "GOAL_KICK", "goal kick"), ("fr", "GOAL_KICK", "renvoi aux six metres")]
KINDS = [("en", "REPLAY", "slow motion replay"), ("en", "RETROSPECTIVE", "last week"), ("en", "BUILDUP", "through on goal"), ("en", "BUILDUP", "drives on"), ("en", "RESTART", "kick off"), ("en", "SCORING", "finds the net")]
NAMES = "lang string, event_type string, phrase string"


def said(spark, *texts, language="en", step=10_000):
    """Each text in a recording of its own, unless it is a list."""
    rows = []
    for asset, own in enumerate(texts):
        rows += [(asset, language, k, k * step, k * step + 1000, text) for k, text in enumerate([own] if isinstance(own, str) else own)]
    return spark.createDataFrame(rows, SEGMENTS)


@pytest.fixture(scope="module")
def phrases(spark):
    texts = ["A goal", "Goal!!!", "He scores a goal", "goooool", "goal kick now", "The score was one, a goal", "the score was one and he scores", "goal number ten", "into his own net, goal",
             ["goal", "x", "goal"], ["goal"] + ["x"] * 9 + ["goal"], "he shoots, red card", "revoir le but"]
    found = {}
    for r in P.detect_phrase_signals(said(spark, *texts), spark.createDataFrame(EVENTS, NAMES), spark.createDataFrame(MARKS, NAMES)).collect():
        found.setdefault(r.asset_id, []).append((r.signal_type, r.event_type, round(r.confidence, 2), r.seq))
    return {k: sorted(v) for k, v in found.items()}


def test_goals_by_their_words(phrases):
    sure = lambda a: {c for kind, _, c, _ in phrases.get(a, []) if kind == "TRANSCRIPT_GOAL"}
    assert sure(0) == {0.68}  # a bare goal
    assert sure(1) == {0.88}  # a shout
    assert sure(2) == {0.95} and sure(3) == {0.88}  # two phrases, a drawn-out call
    assert sure(4) == set() and ("GOAL_KICK_CONTEXT", "GOAL", 0.96, 0) in phrases[4]
    assert sure(5) == set() and sure(6) == {0.88} and sure(7) == set() and sure(12) == set()
    assert ("OWN_GOAL", "GOAL", 0.68, 0) in phrases[8]
    assert [s for kind, _, _, s in phrases[9] if kind == "TRANSCRIPT_GOAL"] == [0] and [s for kind, _, _, s in phrases[10] if kind == "TRANSCRIPT_GOAL"] == [0, 10]
    assert {(k, e) for k, e, _, _ in phrases[11]} == {("TRANSCRIPT_KEYWORD", "SHOT"), ("TRANSCRIPT_SHOT", "SHOT"), ("TRANSCRIPT_KEYWORD", "RED_CARD"), ("TRANSCRIPT_CARD", "RED_CARD")}


def test_comebacks_in_french(spark):
    rows = P.detect_phrase_signals(said(spark, "Il relance son équipe dans ce match", "une occasion, il relance dans le match", language="fr"), spark.createDataFrame(EVENTS, NAMES), spark.createDataFrame(MARKS, NAMES)).collect()
    assert sorted((r.asset_id, r.signal_type, r.confidence) for r in rows) == [(0, "TRANSCRIPT_GOAL", 0.84), (0, "TRANSCRIPT_KEYWORD", 0.84)]


def test_context_signals(spark):
    texts = [["It is 1-0", "now 2-0", "and 2-2"], ["It is 1-0", "The score was 2-0.", "now 1-1"], ["through on goal he drives on", "drives on"], ["last week", "x", "last week he finds the net"], ["kick off", "kick off"]]
    found = {}
    for r in P.detect_context_signals(said(spark, *texts), spark.createDataFrame(KINDS, NAMES)).collect():
        found.setdefault(r.asset_id, []).append((r.seq, r.signal_type, round(r.confidence, 2)))
    assert sorted(found[0]) == [(0, "SCORE_STATE", 0.72), (1, "SCORE_STATE", 0.72), (1, "SCORE_STATE_TRANSITION", 0.82), (2, "SCORE_STATE", 0.72)]
    # a score told of the past neither moves the score nor is moved from
    assert (2, "SCORE_STATE_TRANSITION", 0.82) in found[1] and (1, "SCORE_STATE_TRANSITION", 0.82) not in found[1]
    assert sorted(found[2]) == [(0, "ATTACK_BUILDUP", 0.72), (1, "ATTACK_BUILDUP", 0.7)]
    assert (0, "RETROSPECTIVE_CONTEXT", 0.8) in found[3] and (2, "RETROSPECTIVE_CONTEXT", 0.2) in found[3]
    close = P.detect_context_signals(said(spark, ["kick off", "kick off", "kick off"], step=2500), spark.createDataFrame(KINDS, NAMES)).where("signal_type = 'RESTART_CONTEXT'").collect()
    assert sorted(r.seq for r in close) == [0, 2]  # four seconds apart at least


def test_context_is_searched_as_in_sql(spark, monkeypatch):
    """A segment without a word parts those around it, so no phrase reaches across; letters beyond ASCII don't make a word longer."""
    from touchline.operators import phrases as R

    texts = [["a kick", "|", "off then"], ["a kick", "off then"], ["kick off", "***", "kick"], ["ßno goal", "x"], ["noß goal", "x"], ["nox goal", "x"], ["***", "&"]]
    for most, few in ((R.MOST_PHRASES, R.FEW_PHRASES), (R.MOST_PHRASES, 0), (2, 0)):
        monkeypatch.setattr(R, "MOST_PHRASES", most)
        monkeypatch.setattr(R, "FEW_PHRASES", few)
        rows = P.detect_context_signals(said(spark, *texts, step=2000), spark.createDataFrame(KINDS, NAMES)).collect()
        assert sorted((r.asset_id, r.seq, r.signal_type) for r in rows if r.signal_type == "RESTART_CONTEXT") == [(1, 0, "RESTART_CONTEXT"), (2, 0, "RESTART_CONTEXT"), (2, 2, "RESTART_CONTEXT")]
        assert sorted((r.asset_id, r.seq) for r in rows if r.signal_type == "NEGATION_CONTEXT") == [(3, 0), (3, 1), (4, 0), (4, 1)]


def test_larger_lexicons_go_through_an_automaton_or_a_join(spark, monkeypatch):
    from touchline.operators import phrases as R

    texts = ["A goal, he scores", "Goal!!!", "goooool, he shoots", "goal kick now", "into his own net, goal", "|", ["goal", "x", "goal"], "Il relance dans le match, but"]
    events, marks = spark.createDataFrame(EVENTS, NAMES), spark.createDataFrame(MARKS, NAMES)
    rows = lambda: sorted(tuple(r) for code in ("en", "fr", None) for r in P.detect_phrase_signals(said(spark, *texts, language=code), events, marks).collect())
    want = rows()
    monkeypatch.setattr(R, "FEW_PHRASES", 0)
    assert rows() == want
    monkeypatch.setattr(R, "MOST_PHRASES", 1)
    assert rows() == want and {r[3] for r in want} == {"GOAL", "SHOT", "GOAL_KICK", "COMEBACK"}


def test_phrase_signals_read_each_text_once(spark):
    """One order of segments, one search of texts, one order of what is found, without texts."""
    plan = P.detect_phrase_signals(said(spark, "a goal"), spark.createDataFrame(EVENTS, NAMES), spark.createDataFrame(MARKS, NAMES))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "Join" not in plan and "InArrow" not in plan and "EvalPython" not in plan


def test_context_signals_read_each_text_once(spark):
    plan = P.detect_context_signals(said(spark, "kick off"), spark.createDataFrame(KINDS, NAMES))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and plan.count("MapInArrow") == 1 and "Join" not in plan and "EvalPython" not in plan


def test_flags_thin_as_rows_do(spark):
    """Kinds as bits of one column: as each kind by itself, a row a kind."""
    import random

    from touchline.operators import sequence as S

    draw = random.Random(3)
    rows = [(asset, ts, draw.randrange(8)) for asset in range(9) for ts in sorted(draw.sample(range(400), 60))]
    frame = spark.createDataFrame(rows, "asset_id long, ts long, bits int")
    got = S.thin_flags(frame.repartition("asset_id").sortWithinPartitions("asset_id", "ts"), ["asset_id"], "ts", "bits", 10).collect()
    each = spark.createDataFrame([(asset, ts, bit) for asset, ts, bits in rows for bit in (1, 2, 4) if bits & bit], "asset_id long, ts long, bit int")
    want = S.thin_by_last_kept(each, ["asset_id", "bit"], "ts", 10, True).collect()
    assert len(got) == len(rows) and sorted((r.asset_id, r.ts, bit) for r in got for bit in (1, 2, 4) if r.bits & bit) == sorted(map(tuple, want))


def test_cues_and_plain_searches_lose_no_text(spark):
    """Texts are searched by an expression only if they have one of its words, and texts of one byte a letter are normalised without tables: the same is found as by the expressions alone."""
    import random
    import re

    from pyspark.sql import functions as F

    from touchline.functions import text as X

    draw = random.Random(5)
    words = """not never no didn t goal goals score scored scoring net count disallowed ruled out corrected correction revised reversal scorer credited had has already earlier before first gol of the this
      season temporada de la da scoreline final was 2 11 resultado final endstand gooool gol remet dans ce le match ramene, VISITÉ Égalité ÇA x\u0301y K İ ß ﬁ -- !? \t""".split(" ")
    rows = [(k, " ".join(draw.choice(words) for _ in range(draw.randint(0, 14)))) for k in range(4000)]
    rows += [(4000 + k, t) for k, t in enumerate(["", "\x00a\x7fB", "the score was 2 1", "second goal of the season", "le but remet tout dans le match", "it was not a goal", "GOAL\nnet", "had already scored", "ruled out the goal"])]
    frame = spark.createDataFrame(rows, "k int, text string")
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower("text"), *X.accents()), r"\p{M}", ""), r"[^\p{L}\p{N}]+", " "))
    got = frame.withColumns({"norm": X.normalize_text(F.col("text")), "plain": plain})
    got = got.select("*", *(X.tells(F.col("norm"), p).alias(f"a{i}") for i, p in enumerate(X.CUES)), *(F.col("norm").rlike(p).alias(f"b{i}") for i, p in enumerate(X.CUES)), X.contains_any(F.col("norm"), X.SCORE_TOLD).alias("c"))
    found = got.collect()
    assert all(r.norm == r.plain for r in found)
    for i in range(len(X.CUES)):
        assert all(r[f"a{i}"] == r[f"b{i}"] for r in found) and any(r[f"a{i}"] for r in found), i
    assert all(r.c == bool(re.search("|".join(map(re.escape, X.SCORE_TOLD)), r.norm)) for r in found)
    # a text is searched by an expression behind its cues alone
    assert "Contains" in got.select("a0")._jdf.queryExecution().optimizedPlan().toString()
