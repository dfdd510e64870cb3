"""Phrases by trie and automaton: equal to looking at each phrase, and to the join of a large lexicon."""

import random

import pytest

from touchline.operators import phrases as R
from touchline.operators import transcript as P

WORDS = ["a", "goal", "kick", "off", "the", "box", "é"]


def rows(seed):
    draw = random.Random(seed)
    said = lambda n: " ".join(draw.choice(WORDS) for _ in range(n))
    segments = [(k, draw.choice(["en", "fr", "it", None]), k, k, k + 1, draw.choice([said(draw.randrange(0, 9)), said(3).upper(), None, ""])) for k in range(150)]
    lexicon = [(draw.choice(["en", "fr", "und"] if seed % 2 else ["en", "fr"]), draw.choice(["X", "Y"]), said(draw.randint(1, 4))) for _ in range(25)]
    return segments, [*lexicon, lexicon[0]]


@pytest.mark.parametrize("seed", range(4))
def test_trie_equals_every_phrase_by_itself(spark, seed, monkeypatch):
    segments, lexicon = rows(seed)
    frame = P.normalized(spark.createDataFrame(segments, "asset_id long, language string, seq int, start_ms long, end_ms long, text string"))
    plain = [(of, kind, phrase.replace("é", "e")) for of, kind, phrase in lexicon]  # normalised, as lexicons are
    known = {lang for lang, _, _ in plain}
    want = set()
    for asset, lang, _, _, _, text in segments:
        norm = f" {(text or '').lower().replace('é', 'e')} "
        want |= {(asset, kind, phrase) for of, kind, phrase in plain if (of in (lang, "und") or not known & {lang, "und"}) and f" {phrase} " in norm}
    table = spark.createDataFrame(plain, "lang string, event_type string, phrase string")
    got = [tuple(r) for r in P.match_lexicon(frame, table, 4).select("asset_id", "event_type", "phrase").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.setattr(R, "MOST_PHRASES", 3)
    assert {tuple(r) for r in P.match_lexicon(frame, table, 4).select("asset_id", "event_type", "phrase").collect()} == want


def test_parts_of_words(spark, monkeypatch):
    segments = spark.createDataFrame([(1, "en", 0, 0, 1, "Off the crossbar, saved!"), (2, "fr", 0, 0, 1, "saved"), (3, "en", 0, 0, 1, None), (4, None, 0, 0, 1, "saved")], "asset_id long, language string, seq int, start_ms long, end_ms long, text string")
    table = [("en", "SAVE", 1, "save"), ("en", "SAVE", 0, "saved"), ("en", "POST", 0, "cross"), ("en", "PENALTY_MISSED", 0, "bar s")]
    outcomes = spark.createDataFrame(table, "lang string, outcome string, phrase_rank int, phrase string")
    want = [("PENALTY_MISSED", "bar s", 0.72), ("POST", "cross", 0.78), ("SAVE", "saved", 0.78)]
    for most in (R.MOST_PHRASES, 2):
        monkeypatch.setattr(R, "MOST_PHRASES", most)
        assert sorted((r.outcome, r.phrase, r.confidence) for r in P.detect_outcomes(segments, outcomes).collect()) == want
