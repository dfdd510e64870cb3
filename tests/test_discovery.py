"""Goals that nobody called, on hand-written signals."""

from touchline.operators import discovery as G

NAMES = "asset_id long, run_id int, id long, ts_ms long, signal_type string, event_type string, confidence double, evidence string"


def found(spark, *assets):
    rows = [(a, 0, a * 100 + k, *row, text) for a, own in enumerate(assets) for k, (*row, text) in enumerate((*r, "") if len(r) == 4 else r for r in own)]
    return {(r.asset_id, r.source): r for r in G.discover(spark.createDataFrame(rows, NAMES)).collect()}


def test_goals_from_voices_and_shots(spark):
    voice, pitch = (60_000, "VOICE_EXCITEMENT", None, 0.8), (61_000, "PITCH_RISE", None, 0.7)
    attack, score = (50_000, "ATTACK_BUILDUP", None, 0.7), (80_000, "SCORE_STATE_TRANSITION", None, 0.8)
    shot = (58_000, "TRANSCRIPT_SHOT", "SHOT", 0.8)
    got = found(
        spark,
        [voice, pitch, attack],  # an action near voices that rise
        [voice, pitch],  # no action and no score
        [voice, pitch, score],  # a score after them
        [(60_000, "VOICE_EXCITEMENT", None, 0.75), score, attack],  # a strong voice, a score and an action
        [voice, pitch, attack, (66_000, "GOAL_KICK_CONTEXT", None, 0.7)],  # a goal kick follows
        [voice, pitch, attack, (64_000, "SHOT_OUTCOME_CONTEXT", None, 0.7, "OUTCOME=SAVE; held")],  # it was saved
        [shot, voice, pitch, attack],  # the shot's goal takes the place of those of voices
        [shot, voice],  # a shot and a voice, nothing else
        [shot, (59_000, "TRANSCRIPT_EMPHASIS", None, 0.8), voice],  # words after it
    )
    assert {k for k, _ in got} == {0, 2, 3, 6, 8}
    assert {k for k in got if k[0] in (6, 8)} == {(6, "SHOT"), (8, "SHOT")}
    assert got[0, "AUDIO"].action_ms == 50_000 and got[2, "AUDIO"].action_ms in (60_000, 61_000) and got[3, "AUDIO"].led == "typed football-action evidence"
    assert abs(got[8, "SHOT"].confidence - 0.856) < 1e-9 and got[8, "SHOT"].led == "post-action commentary"


def test_signals_of_discovered_goals(spark):
    rows = [(0, 0, 1, 58_000, "TRANSCRIPT_SHOT", "SHOT", 0.8, ""), (0, 0, 2, 60_000, "AUDIO_SPIKE", None, 0.9, ""), (0, 0, 3, 50_000, "ATTACK_BUILDUP", None, 0.7, "")]
    out = G.as_signals(G.discover(spark.createDataFrame(rows, NAMES))).collect()
    assert sorted((r.signal_type, r.ts_ms, r.obs_id) for r in out) == [("TRANSCRIPT_GOAL", 58_000, 1), ("TRANSCRIPT_KEYWORD", 58_000, 1)]
    assert all(r.evidence.startswith("Inferred goal hypothesis from a shot") for r in out)
