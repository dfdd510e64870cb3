"""Functions of the signals of an event: an array of structs with a field signal_type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns over signal types, the tag and the sentence each stands for.
TAGS = (
    ("AUDIO_SPIKE|AUDIO_SUSTAINED|AUDIO_ENERGY_RISE|CROWD_REACTION_PROXY", "Audio reaction", "Audio or crowd-reaction signal"),
    ("PITCH_RISE|PITCH_VARIANCE", "Pitch change", "Pitch rise or variation"),
    ("SPEECH_RATE_SPIKE", "Speech-rate change", "Speech-rate spike"),
    ("TRANSCRIPT_", "Transcript", "Football transcript evidence"),
    ("ATTACK_BUILDUP|LIVE_EVENT_CONTEXT|SCORE_STATE", "Live context", "Live-event or attacking context"),
)
AUDIO, REPLAY = "AUDIO|CROWD|PITCH|SPEECH_RATE", "REPLAY|RETROSPECTIVE|EVENT_ASSOCIATION"
FAMILY = (
    ("^TRANSCRIPT_", "TRANSCRIPT"), ("^(ATTACK_BUILDUP|LIVE_EVENT_CONTEXT)$", "ATTACK_BUILDUP"), ("^SPEECH_RATE_SPIKE$", "SPEECH_RATE"), ("^(PITCH_RISE|PITCH_VARIANCE|VOICE_EXCITEMENT|HIGH_EXCITEMENT)$", "PITCH"),
    ("^(AUDIO_SPIKE|AUDIO_SUSTAINED|AUDIO_ENERGY_RISE|WHISTLE_LIKE_AUDIO)$", "AUDIO_ENERGY"), ("^CROWD_REACTION_PROXY$", "CROWD_REACTION"), ("^(REPLAY_CONTEXT|EVENT_ASSOCIATION)$", "REPLAY"),
    ("^(RETROSPECTIVE_CONTEXT|POST_EVENT_COMMENTARY|UNRELATED_ACTION_CONTEXT)$", "RETROSPECTIVE"), ("^(RESTART_CONTEXT|GOAL_KICK_CONTEXT)$", "RESTART"), ("^SHOT_OUTCOME_CONTEXT$", "SHOT_ACTION"),
)


def _any(signals: Column, pattern: str) -> Column:
    return F.exists(signals, lambda s: s.signal_type.rlike(pattern))


def evidence_tags(signals: Column, has_text: Column) -> Column:
    """Tags of an event's evidence; one that says so if there are none."""
    found = F.array_compact(F.array(*(F.when(_any(signals, p) | (has_text if tag == "Transcript" else F.lit(False)), F.lit(tag)) for p, tag, _ in TAGS)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Evidence details available")))


def evidence_summary(signals: Column) -> Column:
    """Sentences for the patterns that an event's signals have, else its signal types in words."""
    found = F.array_compact(F.array(*(F.when(_any(signals, p), F.lit(text)) for p, _, text in TAGS)))
    words = F.array_distinct(F.transform(signals, lambda s: F.lower(F.replace(s.signal_type, F.lit("_"), F.lit(" ")))))
    return F.when(F.size(found) > 0, found).otherwise(words)


def signals_of_family(signals: Column, pattern: str) -> Column:
    return F.filter(signals, lambda s: s.signal_type.rlike(pattern))


def family(signal_type: Column) -> Column:
    """The family a signal type is evidence of."""
    out = F.lit("OTHER")
    for pattern, name in reversed(FAMILY):
        out = F.when(signal_type.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def live_probability(signals: Column) -> Column:
    """The surest LIVE_EVENT_CONTEXT of an event, 0 without one."""
    return F.coalesce(F.array_max(F.transform(F.filter(signals, lambda s: s.signal_type == "LIVE_EVENT_CONTEXT"), lambda s: s.confidence)), F.lit(0.0))


def replay_probability(signals: Column) -> Column:
    """The surest cue of an event that it is shown again or looked back on, 0 without one."""
    return F.coalesce(F.array_max(F.transform(F.filter(signals, lambda s: s.signal_type.isin("REPLAY_CONTEXT", "RETROSPECTIVE_CONTEXT")), lambda s: s.confidence)), F.lit(0.0))


def rejection_codes(signals: Column) -> Column:
    """Reasons against an event, each once: the evidence of its signals of that type."""
    return F.array_distinct(F.transform(F.filter(signals, lambda s: s.signal_type == "REJECTION_REASON"), lambda s: s.evidence))


def outcome_of(evidence: Column) -> Column:
    """The outcome that evidence text names, or null."""
    found = F.regexp_extract(evidence, "OUTCOME=([A-Z_]+)", 1)
    return F.when(found != "", found)


def readable(code: Column) -> Column:
    return F.replace(code, F.lit("_"), F.lit(" "))


def safe_name(name: Column) -> Column:
    """The last part of a path without control characters; the tail of a long one; null if nothing is left."""
    base = F.trim(F.regexp_replace(F.regexp_replace(F.translate(name, "\\", "/"), "^.*/", ""), r"\p{Cntrl}", ""))
    return F.when(~base.isin("", ".", ".."), F.right(base, F.lit(500)))


def extension_of(name: Column) -> Column:
    found = F.lower(F.regexp_extract(safe_name(name), r"^.+\.([^.]+)$", 1))
    return F.when(found != "", found)
