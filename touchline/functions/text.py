"""Text functions on columns."""

from __future__ import annotations

import re
import unicodedata
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SEASON_GOAL = r"\b(?:first|second|third|fourth|fifth|1st|2nd|3rd|4th|5th|primero|segundo|tercero|tercer|cuarto|quinto|premier|premiere|deuxieme|troisieme|quatrieme|cinquieme|primo|secondo|terzo|erste|zweite|dritte)\s+(?:goal|gol|but|golo|rete|tor)\s+(?:of|this|da|de|della|der)\s+(?:the\s+)?(?:season|temporada|saison|stagione)\b"
SCORE_REPORT = r"\b(?:the score was|the scoreline|final score|el marcador era|resultado final|le score etait|score final|o placar era|il punteggio era|der spielstand war|endstand)\s+\d{1,2}\s+\d{1,2}\b"
ELONGATED_CALL = r"\bg(?:o){2,}l+\b"
COMEBACK_CALL = r"\b(?:remet|remettre|ramene|ramener|relance|relancer)\b.*\bdans (?:ce|le) match\b"
COMEBACK_VETOES = ("occasion", "chance", "essaie", "tente")
NEGATED = r"\b(?:not|never|wasn t|isn t|hasn t|hadn t|didn t|no)\b.{0,45}\b(?:score|scored|scoring|goal|net|count)\b|\b(?:goal|scored|scoring|net)\b.{0,35}\b(?:not|never|wasn t|isn t|hasn t|hadn t|didn t|disallowed|overturned|ruled out)\b|\b(?:disallowed|overturned|ruled out|chalked off|waved off)\b.{0,35}\b(?:goal|scoring)\b"
CORRECTED = r"\b(?:corrected|correction|correcting|revised|reversal)\b.{0,70}\b(?:goal|score|scorer|attribution|credited)\b|\b(?:goal|score|scorer|attribution|credited)\b.{0,70}\b(?:corrected|correction|correcting|revised|reversal)\b"
PAST_SCORING = r"\b(?:had|has)\s+(?:already\s+)?scored\b|\bscored\s+(?:earlier|before|previously)\b"
PAST_PHRASES = ("earlier in the match", "the previous goal", "had scored earlier", "as we mentioned earlier", "as mentioned earlier", "that goal came earlier", "the score was", "the scoreline", "final score")
NO_GOAL_TOLD = ("avant cette egalisation", "avant l egalisation", "revoir le but", "au match alle", "but de la saison", "face au but", "pres du but", "a cote du but")
AFTER_GOAL, JUST_SCORED = "juste apres le but", ("but qu on vient de marquer", "but que l on vient de marquer")
SCORE_TOLD = ("the score was", "the scoreline", "final score", "el marcador era", "resultado final", "le score etait", "score final", "o placar era", "il punteggio era", "der spielstand war", "endstand")
GOAL_NUMBERS = ("goal number", "gol numero", "but numero")
BARE_GOAL = "(?:goal|gol|but|golo|rete|tor)"
REPLAY_PHRASES = ("in the replay", "the replay shows", "watch the replay", "slow motion")
MARKS = "ÃÂâ"
STOP_WORDS = (
    "a", "al", "an", "and", "are", "as", "at", "au", "avec", "been", "but", "by", "com", "da", "de", "del", "des", "do", "dos", "du",
    "el", "en", "est", "et", "for", "from", "il", "in", "is", "it", "la", "le", "les", "los", "mais", "na", "no", "nos", "of", "on",
    "or", "os", "ou", "para", "por", "que", "se", "son", "the", "to", "un", "une", "was", "with", "y",
)
LANGUAGES = {"english": "en", "portuguese": "pt", "spanish": "es", "french": "fr", "italian": "it", "german": "de"}


@cache
def accents() -> tuple[str, str]:
    """Letters with marks of the Latin blocks, and what is left of each without them."""
    have, bare = [], []
    for c in map(chr, [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]):
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c:
            have.append(c)
            bare.append(plain)
    return "".join(have), "".join(bare)


def normalize_text(text: Column) -> Column:
    """Lower case without marks; runs of letters and digits with one blank between.

    Most texts have one byte a character, or do without the marks of Latin letters (which come off capitals as well): those need no classes of Unicode.
    """
    plain = lambda t: F.octet_length(t) == F.char_length(t)
    bare = F.when(plain(text), text).otherwise(F.translate(text, *accents()))
    out = F.regexp_replace(F.translate(F.lower(text), *accents()), r"\p{M}", "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")
    return F.trim(F.when(plain(bare), F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " ")).otherwise(out))


def _repaired(text: str | None) -> str | None:
    marks = lambda s: sum(s.count(m) for m in MARKS)
    if not text or not marks(text):
        return text
    try:
        fixed = text.encode("cp1252").decode("utf-8")
    except UnicodeError:
        return text
    return fixed if marks(fixed) < marks(text) else text


def repair_mojibake(text: Column) -> Column:
    """Text that was read as windows-1252 and is UTF-8; only what looks like it goes through Python."""

    @F.pandas_udf("string")
    def repair(texts: pd.Series) -> pd.Series:
        return texts.map(_repaired, na_action="ignore")

    odd = text.rlike(f"[{MARKS}]")
    return F.when(odd, repair(F.when(odd, text))).otherwise(text)


def contains_phrase(text: Column, phrase: str) -> Column:
    """Whole words of normalised text."""
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(f" {phrase} ") if phrase.strip() else F.lit(False)


def contains_any(text: Column, phrases) -> Column:
    """Plain searches; an expression of alternatives would try each of them at each letter."""
    return reduce(lambda a, b: a | b, (text.contains(p) for p in phrases))


def says(text: Column, test) -> Column:
    """test of the normalised text, which is normalised once: a filter would put the whole expression in the place of each mention."""
    return F.exists(F.array(normalize_text(text)), test)


def says_any(text: Column, phrases) -> Column:
    return says(text, lambda norm: contains_any(norm, phrases))


#: Of each alternative of an expression, groups of words: a text that it finds has one of each group. Most texts don't, and needn't be searched by it.
CUES = {
    NEGATED: (
        (("score", "scoring", "goal", "net", "count"), ("no", "never", "n t")),
        (("goal", "scored", "scoring", "net"), ("not", "never", "n t", "disallowed", "overturned", "ruled out")),
        (("disallowed", "overturned", "ruled out", "chalked off", "waved off"), ("goal", "scoring")),
    ),
    CORRECTED: ((("correct", "revised", "reversal"), ("goal", "score", "attribution", "credited")),) * 2,
    PAST_SCORING: ((("scored",), ("had", "has")), (("scored",), ("earlier", "before", "previously"))),
    SEASON_GOAL: ((("season", "temporada", "saison", "stagione"),),),
    SCORE_REPORT: ((SCORE_TOLD,),),
    ELONGATED_CALL: ((("goo",),),),
    COMEBACK_CALL: ((("dans ce match", "dans le match"),),),
}


def finds(text: Column, pattern: str) -> Column:
    r"""Does text match one of the expressions above? Their \b come before or after an ASCII letter or digit and are read as edges of words of those (\w): what
    \b means beside other letters depends on the version of Java, and looking to one side alone is faster."""
    return text.rlike(re.sub(r"\\b(?=\(\?:|\w)", r"(?<!\\w)", pattern).replace(r"\b", r"(?!\w)"))


def alternatives(pattern: str) -> list[str]:
    """The expressions between the outermost bars."""
    found, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            found.append("")
        else:
            found[-1] += c
    return found


def tells(text: Column, pattern: str) -> Column:
    """Does normalised text match an expression of CUES?"""
    some = [reduce(lambda a, b: a & b, (contains_any(text, cues) for cues in groups)) & finds(text, one) for one, groups in zip(alternatives(pattern), CUES[pattern], strict=True)]
    return reduce(lambda a, b: a | b, some)


def letters(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"\P{L}", ""))


def emphasis_confidence(text: Column, least_letters: int, ratio: float) -> Column:
    """How sure capitals and exclamation marks make emphasis; null if there are too few."""
    capitals = F.char_length(F.regexp_replace(text, r"\P{Lu}", "")) / F.greatest(letters(text), F.lit(1))
    marks = F.char_length(F.regexp_replace(text, "[^!]", ""))
    sure = 0.48 + F.least(marks, F.lit(4)) * 0.08 + F.greatest(F.lit(0.0), capitals - ratio) * 0.6
    return F.when((marks > 0) | ((letters(text) >= least_letters) & (capitals >= ratio)), F.least(sure, F.lit(0.98)))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def repeated_words(text: Column) -> Column:
    """Tokens that equal the one before."""
    t = tokens(text)
    return F.size(F.filter(F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: a == b), lambda x: x))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def token_set(text: Column, kind: str) -> Column:
    """all: normalised tokens; content: those over two letters that are no stop words; raw: lower-case words, marks kept."""
    if kind == "raw":
        return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    own = F.array_distinct(tokens(normalize_text(text)))
    return own if kind == "all" else F.filter(own, lambda x: (F.char_length(x) > 2) & ~x.isin(*STOP_WORDS))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(F.lit(0.0))


def parse_score_text(text: Column, most: int = 20) -> Column:
    """(home, away) if the text names one plausible score, and no other."""
    pairs = F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{1,2}\s*[-–—:]\s*\d{1,2})(?!\d)"), F.lit(1))
    scores = F.array_distinct(F.transform(pairs, lambda p: F.struct(F.split(p, r"\s*[-–—:]\s*")[0].cast("int").alias("home"), F.split(p, r"\s*[-–—:]\s*")[1].cast("int").alias("away"))))

    def only(found: Column) -> Column:
        one = F.try_element_at(found, F.lit(1))
        return F.when((F.size(found) == 1) & (one.home <= most) & (one.away <= most), one)

    return F.element_at(F.transform(F.array(scores), only), 1)  # the text is searched once


OCR_SCORE = r"(?<!\d)([0-9OIl]{1,2})\s*[-:–—−]\s*([0-9OIl]{1,2})(?!\d)"


def parse_score_ocr(text: Column, most: int = 15) -> Column:
    """(home, away) of the first score in a reading; letters that look like digits are read as such."""
    # the expression is looked for once; what it finds holds one separator
    found = F.regexp_extract(F.coalesce(text, F.lit("")), OCR_SCORE, 0)
    plain = F.translate(found, ":–—−OoIl \t\n\x0b\f\r", "----0011")

    def score(t: Column) -> Column:
        home, away = F.substring_index(t, "-", 1).try_cast("int"), F.substring_index(t, "-", -1).try_cast("int")
        return F.when((home <= most) & (away <= most), F.struct(home.alias("home"), away.alias("away")))

    return F.element_at(F.transform(F.array(plain), score), 1)


def goal_flags(text: Column) -> dict[str, Column]:
    """What normalised words around a goal say against it: is it denied, corrected, seen again, past?"""
    return {"negated": tells(text, NEGATED), "corrected": tells(text, CORRECTED), "replayed": contains_any(text, REPLAY_PHRASES), "past": tells(text, PAST_SCORING) | contains_any(text, PAST_PHRASES)}


#: Flag, type and confidence.
AROUND_GOALS = (("negated", "NEGATION_CONTEXT", 0.94), ("corrected", "CORRECTION_CONTEXT", 0.92), ("replayed", "REPLAY_CONTEXT", 0.90), ("past", "RETROSPECTIVE_CONTEXT", 0.90), ("past", "HISTORICAL_REFERENCE", 0.90))


def goal_context(text: Column) -> Column:
    """As above, as an array of (type, confidence)."""
    flags = goal_flags(text)
    return F.array_compact(F.array(*(F.when(flags[flag], F.struct(F.lit(name).alias("type"), F.lit(sure).alias("confidence"))) for flag, name, sure in AROUND_GOALS)))


def comeback_goal(text: Column) -> Column:
    return tells(text, COMEBACK_CALL) & ~contains_any(text, COMEBACK_VETOES)


def no_goal_told(text: Column) -> Column:
    """Does a normalised text name a goal that isn't being scored?"""
    return contains_any(text, NO_GOAL_TOLD) | (text.contains(AFTER_GOAL) & ~contains_any(text, JUST_SCORED))


def counts_goals(text: Column) -> Column:
    """Does a normalised text speak of goals as statistics: of a season, of a score, by number?"""
    return tells(text, SEASON_GOAL) | contains_any(text, SCORE_TOLD) | contains_any(text, GOAL_NUMBERS)


def shouted_goal(text: Column, norm: Column) -> Column:
    """Is the text nothing but the word, with exclamation marks?"""
    return norm.rlike(f"^{BARE_GOAL}$") & F.trim(text).rlike(rf"(?iu)^{BARE_GOAL}\s*!+$")


def primary_language(tag: Column) -> Column:
    """en of en-GB, en_us or English."""
    low = F.split(F.lower(tag), "[-_]")[0]
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.element_at(names, low), low)


def failure_text(text: Column, most: int, fallback: str) -> Column:
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Cntrl}+", " "))
    return F.when(clean == "", F.lit(fallback)).otherwise(F.left(clean, F.lit(most)))
