"""Clusters of candidates against a plain version that compares with every cluster; merged events; rules that forbid a merge."""

import random
import re

import pytest

from touchline.functions.text import STOP_WORDS
from touchline.operators import clustering as C

CANDIDATES = "asset_id long, run_id int, candidate_id long, event_type string, trigger_ms long, start_ms long, end_ms long, score double, status string, context string"
SIGNALS = "candidate_id long, signal_type string, event_type string, confidence double, ts_ms long, evidence string"
W = C.Windows()


def words_of(text):
    return {w for w in re.findall(r"\w+", (text or "").lower()) if len(w) > 2 and w not in STOP_WORDS}


def alike(a, b):
    x, y = words_of(a), words_of(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def names_of(text):
    return {w for w in words_of(text) if len(w) >= 4 and w not in C.IDENTITY_STOP_WORDS}


def plain(candidates, signals):
    own = {}
    for s in signals:
        own.setdefault(s[0], []).append(s[1:])
    of = lambda c: own.get(c[2], [])
    found = lambda c, *kinds: [s for s in of(c) if s[0] in kinds]

    def action(c):
        built = [s[3] for s in found(c, "EVENT_RECONSTRUCTION") if s[1] == "GOAL"]
        if built:
            return min(built)
        inferred = any(s[1] == "GOAL" and (s[0] == "AUDIO_GOAL_HYPOTHESIS" or s[0] == "TRANSCRIPT_GOAL" and C.LIVE_HYPOTHESIS in s[4]) for s in of(c))
        shots = [s[3] for s in found(c, "TRANSCRIPT_SHOT") if s[1] == "SHOT"]
        return min(shots) if inferred and shots else None

    results = lambda c: {m for s in found(c, "SCORE_STATE_TRANSITION") for m in re.findall(r"\bto\s+(\d{1,2}-\d{1,2})\b", s[4])}
    scores = lambda c: {m for s in found(c, "SCORE_STATE_TRANSITION", "SCORE_STATE") for m in re.findall(r"\b\d{1,2}-\d{1,2}\b", s[4])}
    phrases = lambda c: {s[4][len(C.PHRASE) :] for s in found(c, "TRANSCRIPT_KEYWORD") if s[4].startswith(C.PHRASE)}

    def same_action(a, b):
        x, y = action(a), action(b)
        if x is not None and y is not None and abs(x - y) <= 3000:
            return True
        moves = lambda c: {(s[3], s[4]) for s in found(c, "SCORE_STATE_TRANSITION")}
        return bool(moves(a) & moves(b)) and alike(a[9], b[9]) >= 0.65

    def same_event(a, b):
        gap = abs(a[4] - b[4])
        if a[3] == "GOAL":
            if results(a) and results(b) and not results(a) & results(b):
                return False
            return same_action(a, b) or gap == 0
        if gap > W.of(a[3]) or a[6] < b[5] or b[6] < a[5]:
            return False
        s, shared = alike(a[9], b[9]), bool(phrases(a) & phrases(b))
        near = any(abs(x[3] - y[3]) <= 1500 for x in found(a, *C.BURSTS) for y in found(b, *C.BURSTS))
        return gap == 0 or gap <= 3000 and s >= 0.48 or gap <= 5000 and shared and s >= 0.48 * 0.55 or shared and s >= 0.8 or a[3] in C.CARDS and near and s >= 0.48 * 0.7

    clusters = []
    for c in sorted(candidates, key=lambda c: (c[4], c[3], c[2])):
        home = None
        mine = [k for k in clusters if k[0][:2] == c[:2] and k[0][8] == "DETECTED"]
        if c[8] == "DETECTED":
            for k in reversed(mine):
                if k[0][3] == c[3] and (c[4] - min(m[4] for m in k) <= W.of(c[3]) or c[3] == "GOAL" and any(same_action(c, m) for m in k)) and all(same_event(c, m) for m in k):
                    home = k
                    break
        elif c[3] == "GOAL" and any(s[2] >= 0.68 for s in found(c, "REPLAY_CONTEXT", "RETROSPECTIVE_CONTEXT")) and not any(0 <= s[3] - c[4] <= 30_000 for s in found(c, "SCORE_STATE_TRANSITION")):
            ranks = []
            for n, k in enumerate(mine):
                live = [m for m in k if m[8] == "DETECTED" and m[3] == "GOAL" and m[7] >= 0.7]
                if not live or max(m[4] for m in live) >= c[4]:
                    continue
                goal = max(live, key=lambda m: (m[4], m[2]))
                x, y = names_of(goal[9]), names_of(c[9])
                if len(x & y) >= 3 and max(alike(goal[9], c[9]), len(x & y) / min(len(x), len(y))) >= 0.7:
                    ranks.append((alike(goal[9], c[9]), bool(scores(goal) & scores(c)), goal[4], n))
            if ranks:
                home = mine[max(ranks)[-1]]
        if home is None:
            clusters.append([c])
        else:
            home.append(c)
    return sorted((m[2], k[0][2]) for k in clusters for m in k)


def drawn(seed):
    draw = random.Random(seed)
    words = ["raphinha", "scores", "barcelona", "crossing", "striker", "keeper", "corner", "header", "messi", "the", "goal"]
    candidates, signals = [], []
    for k in range(260):
        kind = draw.choice(["GOAL", "GOAL", "SHOT", "YELLOW_CARD", "FOUL"])
        at = draw.randrange(0, 120) * 1000
        candidates.append((k % 2, k % 3 // 2, k, kind, at, max(0, at - draw.randrange(0, 9000)), at + draw.randrange(0, 9000), draw.choice([0.6, 0.7, 0.8, 0.9]), draw.choice(["DETECTED", "DETECTED", "REJECTED"]), " ".join(draw.sample(words, draw.randint(0, 7))) or None))
        for _ in range(draw.randrange(0, 6)):
            which = draw.choice(["EVENT_RECONSTRUCTION", "TRANSCRIPT_SHOT", "AUDIO_GOAL_HYPOTHESIS", "SCORE_STATE_TRANSITION", "TRANSCRIPT_KEYWORD", "AUDIO_SPIKE", "REPLAY_CONTEXT"])
            event = {"EVENT_RECONSTRUCTION": "GOAL", "TRANSCRIPT_SHOT": "SHOT", "AUDIO_GOAL_HYPOTHESIS": "GOAL", "TRANSCRIPT_KEYWORD": kind}.get(which)
            text = {"SCORE_STATE_TRANSITION": f"Score changed from 0-0 to {draw.randrange(3)}-1", "TRANSCRIPT_KEYWORD": C.PHRASE + draw.choice(["goal", "card"])}.get(which, "")
            signals.append((k, which, event, draw.choice([0.5, 0.7, 0.9]), max(0, at + draw.randrange(-4, 5) * 1000), text))
    return candidates, signals


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_plain(spark, seed):
    candidates, signals = drawn(seed)
    c, s = spark.createDataFrame(candidates, CANDIDATES), spark.createDataFrame(signals, SIGNALS)
    got = sorted(map(tuple, C.cluster_events(c, s).collect()))
    assert got == plain(candidates, signals)
    assert len({k for _, k in got}) < len(got)


def goal(n, at, score=0.84, status="DETECTED", context="raphinha scores barcelona crossing box", start=None, end=None):
    return (1, 0, n, "GOAL", at, at - 15_000 if start is None else start, at + 15_000 if end is None else end, score, status, context)


def test_merged_events(spark):
    candidates = [
        goal(1, 60_000), goal(2, 62_000, 0.9), goal(3, 64_000, 0.8, "REJECTED"),  # one action, and a replay of it
        goal(4, 200_000), goal(5, 201_000),  # one action, other scores: two events
        goal(6, 400_000, start=395_000, end=404_000), goal(7, 401_000, 0.7, start=380_000, end=440_000, context="messi heads it home"),
        goal(8, 600_000, context=None),
    ]
    built = lambda n, at: (n, "EVENT_RECONSTRUCTION", "GOAL", 0.8, at, "")
    signals = [
        built(1, 58_000), built(2, 59_000), (3, "REPLAY_CONTEXT", None, 0.9, 63_000, ""), (2, "AUDIO_SPIKE", None, 0.9, 62_000, ""), (1, "AUDIO_SPIKE", None, 0.9, 62_000, ""), (1, "AUDIO_SPIKE", None, 0.9, 10_000, ""),
        built(4, 199_000), built(5, 199_000), (4, "SCORE_STATE_TRANSITION", None, 0.8, 202_000, "to 1-0"), (5, "SCORE_STATE_TRANSITION", None, 0.8, 203_000, "to 2-0"),
        built(6, 399_000), built(7, 400_000), (6, "EVENT_BOUNDARY", "GOAL", 0.5, 395_000, "START=DECISIVE_ACTION"), (7, "EVENT_BOUNDARY", "GOAL", 0.5, 380_000, "START=PENALTY_SETUP"),
        (6, "EVENT_AFTERGLOW", "GOAL", 0.5, 404_000, "END=GOAL_REACTION"), (7, "EVENT_AFTERGLOW", "GOAL", 0.5, 440_000, "END=IMMEDIATE_RESTART; POST_RESTART"),
    ]
    c, s = spark.createDataFrame(candidates, CANDIDATES), spark.createDataFrame(signals, SIGNALS)
    clusters = C.cluster_events(c, s)
    assert dict(map(tuple, clusters.collect())) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8}
    events, stored = C.merge_events(c, s, clusters)
    by = {r.cluster_id: r for r in events.collect()}
    one = by[1]
    assert (one.candidate_id, one.sources, one.start_ms, one.end_ms, one.score) == (2, [2, 1, 3], 47_000, 77_000, 0.9)
    assert one.context == "raphinha scores barcelona crossing box" and one.merge_reason == "Merged 2 GOAL detections, 2000 ms trigger spread; associated 1 replay-only detection(s)"
    assert (by[6].start_ms, by[6].end_ms, by[6].context) == (380_000, 440_000, "raphinha scores barcelona crossing box | messi heads it home")
    assert by[4].merge_reason is None and by[8].context is None and by[8].sources == [8]
    kinds = sorted((r.signal_type, r.ts_ms) for r in stored.where("cluster_id = 1").collect())
    assert kinds == [("AUDIO_SPIKE", 62_000), ("EVENT_ASSOCIATION", 62_000), ("EVENT_MERGE", 62_000), ("EVENT_RECONSTRUCTION", 58_000), ("EVENT_RECONSTRUCTION", 59_000)]


def test_long_merged_events_are_cut(spark):
    candidates = [goal(1, 100_000, 0.9, start=60_000, end=110_000), goal(2, 102_000, 0.8, start=90_000, end=150_000, context="other words")]
    signals = [(n, "EVENT_RECONSTRUCTION", "GOAL", 0.8, 99_000, "") for n in (1, 2)] + [(1, "EVENT_BOUNDARY", "GOAL", 0.5, 0, "START=DECISIVE_ACTION"), (2, "EVENT_AFTERGLOW", "GOAL", 0.5, 0, "END=GOAL_REACTION")]
    c, s = spark.createDataFrame(candidates, CANDIDATES), spark.createDataFrame(signals, SIGNALS)
    (one,) = C.merge_events(c, s, C.cluster_events(c, s))[0].collect()
    assert one.end_ms - one.start_ms <= 60_000 and one.start_ms <= one.trigger_ms <= one.end_ms


def test_no_candidates(spark):
    c, s = spark.createDataFrame([], CANDIDATES), spark.createDataFrame([], SIGNALS)
    assert C.cluster_events(c, s).count() == 0
