"""Thresholds of the detectors."""

from __future__ import annotations

from dataclasses import dataclass

# How sure a phrase makes its event.
EVENT_CONFIDENCE = {
    "GOAL": 0.88, "BIG_CHANCE": 0.78, "SHOT": 0.82, "SAVE": 0.76, "PENALTY": 0.84, "MISSED_PENALTY": 0.86, "RED_CARD": 0.86, "YELLOW_CARD": 0.83, "VAR": 0.76, "FOUL": 0.65,
    "COUNTER_ATTACK": 0.70, "ATTACK": 0.62, "NEAR_MISS": 0.77, "CELEBRATION": 0.72, "CROWD_REACTION": 0.75, "COMMENTATOR_REACTION": 0.68, "CONTROVERSIAL_DECISION": 0.78, "DRAMATIC_MOMENT": 0.74, "UNKNOWN": 0.60,
}


@dataclass(frozen=True)
class Settings:
    audio_window_ms: int = 1000
    audio_baseline_ms: int = 30_000
    spike_db: float = 9.0
    minimum_db: float = -45.0
    sustained_ms: int = 1500
    minimum_score: float = 0.52
    single_signal: float = 0.80
    maximum_candidates: int = 100
    repeat_window_ms: int = 20_000
    repeat_minimum: int = 2
    emphasis_letters: int = 8
    emphasis_ratio: float = 0.65
    transcript_weight: float = 0.70
    audio_weight: float = 0.30
    agreement_bonus: float = 0.10
    speech_window_ms: int = 10_000
    speech_ratio: float = 1.8
    speech_words: int = 8
    pitch_rise: float = 1.25
    pitch_variance: float = 0.18
    voiced_ratio: float = 0.34
    minimum_live: float = 0.55
    replay_probability: float = 0.68
    replay_window_ms: int = 120_000
    attach_ms: int = 8_000
    search_back_ms: int = 90_000
    buildup_lead_ms: int = 45_000
    crowd_zcr: float = 0.12
    minimum_reaction: float = 0.45
    replay_penalty: float = 0.40
    negative_penalty: float = 0.45
    match_tolerance_ms: int = 15_000
    context_similarity: float = 0.48
    maximum_event_ms: int = 60_000


DEFAULTS = Settings()
