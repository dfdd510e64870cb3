"""Candidates from hand-written signals: reasons against goals, and the choice of a trigger."""

from pyspark.sql import functions as F

from touchline.operators import assemble as E

NAMES = "asset_id long, run_id int, id long, ts_ms long, signal_type string, event_type string, confidence double, evidence string"


def signals(spark, *rows):
    return spark.createDataFrame([(a, 0, k, ts, kind, event, sure, "") for k, (a, ts, kind, event, sure) in enumerate(rows)], NAMES)


def goal(asset, keyword=True):
    rows = [(asset, 100_000, "TRANSCRIPT_GOAL", "GOAL", 0.88)]
    return rows + [(asset, 100_000, "TRANSCRIPT_KEYWORD", "GOAL", 0.88)] * keyword


def test_reasons_against_a_goal(spark):
    against = lambda a, *kinds: [(a, 98_000, k, None, 0.9) for k in kinds]
    rows = [
        *goal(1), (1, 101_000, "AUDIO_SPIKE", None, 0.9),
        *goal(2), *against(2, "NEGATION_CONTEXT"),
        *goal(3), *against(3, "CORRECTION_CONTEXT", "HISTORICAL_REFERENCE"),
        *goal(4), *against(4, "REPLAY_CONTEXT", "RESTART_CONTEXT"), (4, 50_000, "INJURY_CONTEXT", None, 0.86),
        *goal(5), *against(5, "RETROSPECTIVE_CONTEXT", "RESTART_CONTEXT"), (5, 110_000, "SCORE_STATE_TRANSITION", None, 0.82),
        *goal(6), *goal(7, keyword=False),
        *goal(8), (8, 91_000, "NEGATION_CONTEXT", None, 0.9), (8, 99_000, "NEGATION_CONTEXT", None, 0.5),
    ]
    found = {r.asset_id: (set(r.reasons) - {"LOW_LIVE_EVENT_PROBABILITY", "LOW_CANDIDATE_SCORE", "GOAL_WITHOUT_REACTION_CORROBORATION"}, r.status) for r in E.assemble(signals(spark, *rows)).collect()}
    assert found[1] == (set(), "DETECTED")
    assert found[2][0] == {"NEGATED_GOAL_REFERENCE"}
    assert found[3][0] == {"CORRECTED_GOAL_REFERENCE", "HISTORICAL_GOAL_REFERENCE", "RETROSPECTIVE_GOAL_REFERENCE"}
    assert found[4][0] == {"REPLAY_OF_EXISTING_GOAL", "REPLAY_COMMENTARY_REFERENCE", "INJURY_THEN_REPLAY", "POST_RESTART", "NO_NEW_SCORE_TRANSITION"}
    # a new score speaks for the goal; the replay penalty itself stays
    assert found[5][0] == {"REPLAY_OF_EXISTING_GOAL"}
    assert found[8][0] == set()


def test_a_named_goal_needs_no_reaction(spark):
    rows = E.assemble(signals(spark, *goal(1), *goal(2, keyword=False))).collect()
    assert {r.asset_id: "GOAL_WITHOUT_REACTION_CORROBORATION" in r.reasons for r in rows} == {1: False, 2: True}


def test_no_signals(spark):
    assert E.assemble(signals(spark, (1, 5, "AUDIO_SPIKE", None, 0.9)).where("false")).count() == 0


def test_trigger_is_the_surest_then_earliest_unless_confirmed(spark):
    rows = signals(spark, (1, 30, "TRANSCRIPT_GOAL", "GOAL", 0.9), (1, 20, "TRANSCRIPT_GOAL", "GOAL", 0.9), (1, 10, "TRANSCRIPT_SHOT", "SHOT", 0.5), (1, 5, "AUDIO_SPIKE", None, 1.0), (2, 40, "TRANSCRIPT_GOAL", "GOAL", 0.9), (2, 7, "EVENT_RECONSTRUCTION", "GOAL", 0.1))
    told = rows.withColumn("confirms", F.col("signal_type") == "EVENT_RECONSTRUCTION")
    assert {r.asset_id: r.trigger_ms for r in E.choose_trigger(told, ["asset_id"]).collect()} == {1: 20, 2: 7}


def test_outcomes_belong_to_the_nearest_shot(spark):
    atoms = spark.createDataFrame([(1, 0, 1000, "SHOT"), (1, 1, 2000, "SHOT"), (1, 2, 9000, "OUTCOME"), (1, 3, 30_000, "OUTCOME")], "candidate_id long, ordinal int, ts_ms long, atom string")
    assert [(r.from_ordinal, r.to_ordinal) for r in E.edges(atoms).where("relation = 'OUTCOME_OF'").collect()] == [(1, 2)]


def test_replay_and_reasons_of_stored_signals(spark):
    from touchline.functions import evidence as V

    kinds = "array<struct<signal_type string, confidence double, evidence string>>"
    rows = [([("RETROSPECTIVE_CONTEXT", 0.8, ""), ("REPLAY_CONTEXT", 0.7, ""), ("REJECTION_REASON", 1.0, "A"), ("REJECTION_REASON", 1.0, "B"), ("REJECTION_REASON", 1.0, "A")],), ([],)]
    df = spark.createDataFrame(rows, f"signals {kinds}")
    assert [tuple(r) for r in df.select(V.replay_probability(F.col("signals")), V.rejection_codes(F.col("signals"))).collect()] == [(0.8, ["A", "B"]), (0.0, [])]


def test_lexicon_of_other_languages_counts_only_where_there_is_none_of_ones_own(spark):
    from touchline.operators import transcript as P

    segments = spark.createDataFrame([(1, "it", 0, 0, 1, "goal del goal"), (2, "en", 0, 0, 1, "goal but"), (3, None, 0, 0, 1, "but")], "asset_id long, language string, seq int, start_ms long, end_ms long, text string")
    words = [("en", "GOAL", "goal"), ("fr", "GOAL", "but")]
    found = lambda rows: sorted((r.asset_id, r.phrase) for r in P.match_lexicon(P.normalized(segments), spark.createDataFrame(rows, "lang string, event_type string, phrase string"), 2).collect())
    assert found(words) == [(1, "goal"), (2, "goal"), (3, "but")]
    assert found([*words, ("und", "VAR", "del")]) == [(1, "del"), (2, "goal")]


def test_support_at_the_time_of_its_anchor_has_nothing_between(spark):
    rows = [*goal(1), (1, 100_000, "ATTACK_BUILDUP", None, 0.4), (1, 90_000, "TRANSCRIPT_SHOT", "SHOT", 0.9), (1, 89_000, "ATTACK_BUILDUP", None, 0.9)]
    made = signals(spark, *rows)
    a = E.anchors(made)
    support = E.attach_support(a, made)
    assert {(r.event_type, r.ts_ms) for r in support.collect()} == {("GOAL", 100_000), ("SHOT", 89_000)}
    assert {r.event_type: r.buildup for r in E.family_confidences(a, support).collect()} == {"GOAL": 0.4, "SHOT": 0.9}
