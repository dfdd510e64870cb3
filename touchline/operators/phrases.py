"""Many phrases looked up in one pass over a text: whole words by a trie, parts of words by an automaton."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that are sent to the tasks; beyond, matching is a join. Up to a few, a plain search for each is faster than Python.
MOST_PHRASES, FEW_PHRASES = 50_000, 100
END = None  # no word: what ends here


def trie_of(rows: list[tuple[str, str]]) -> dict:
    """(kind, phrase) as a trie of words; a phrase's kinds stand where it ends."""
    root: dict = {}
    for kind, phrase in rows:
        node = root
        for word in phrase.split():
            node = node.setdefault(word, {})
        if node is not root:
            node.setdefault(END, []).append((kind, phrase))
    return root


def matches(words: list[str], root: dict) -> Iterator[tuple[str, str]]:
    """(kind, phrase) of phrases that words have in a row; an empty word, where a text between two others has none, is in no phrase. Most words begin no
    phrase, so most steps are one look-up."""
    for start, word in enumerate(words):
        node, at = root.get(word), start + 1
        while node is not None:
            yield from node.get(END, ())
            node, at = node.get(words[at]) if at < len(words) else None, at + 1


class Lexicon:
    """Phrases by language, each with those of "und". A language that the lexicon doesn't have gets those of "und", or all if there are none."""

    def __init__(self, rows: list[tuple[str, str, str]], build: Callable[[list], object]):
        """rows: (language, kind, phrase)."""
        known = {lang for lang, _, _ in rows}
        common = [r[1:] for r in rows if r[0] == "und"]
        self.by = {lang: build([r[1:] for r in rows if r[0] == lang] + (common if lang != "und" else [])) for lang in known}
        self.other = self.by["und"] if "und" in known else build([r[1:] for r in rows])

    def of(self, lang: str | None):
        return self.by.get(lang, self.other)


def _found(cast, carried: int):
    """Rows of (carried columns, lang, text) to a row for each kind and phrase in the text."""

    def run(batches):
        lexicon = Lexicon(cast.value, trie_of)
        for batch in batches:
            at, kinds, phrases = [], [], []
            langs, texts = batch.column(carried).to_pylist(), batch.column(carried + 1).to_pylist()
            for k, (lang, text) in enumerate(zip(langs, texts, strict=True)):
                for kind, phrase in dict.fromkeys(matches((text or "").split(" "), lexicon.of(lang))):
                    at.append(k)
                    kinds.append(kind)
                    phrases.append(phrase)
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(carried)), pa.array(kinds, pa.string()), pa.array(phrases, pa.string())], names=[*batch.schema.names[:carried], "event_type", "phrase"])

    return run


def small(lexicon: DataFrame, columns: list[str]) -> list[tuple] | None:
    """The distinct rows of a lexicon if there are at most MOST_PHRASES, else None."""
    rows = lexicon.select(*columns).distinct().limit(MOST_PHRASES + 1).collect()
    return None if len(rows) > MOST_PHRASES else sorted(map(tuple, rows), key=str)


def match_words(texts: DataFrame, lexicon: list[tuple], carry: list[str]) -> DataFrame:
    """carry, event_type, phrase for rows of carry, lang and norm. lexicon: (lang, event_type, phrase), see small()."""
    cast = texts.sparkSession.sparkContext.broadcast(lexicon)
    kinds = dict(texts.dtypes)
    return texts.select(*carry, "lang", "norm").mapInArrow(_found(cast, len(carry)), ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "event_type string", "phrase string"]))


def plain(phrase: str) -> str:
    """As whole words of a text between blanks."""
    return f" {' '.join(phrase.split())} "


def _maps(cast):
    """An array of languages and one of texts to an array of, by lexicon, a map of kind to its phrases in the text."""

    def run(langs: pa.Array, texts: pa.Array) -> pa.Array:
        if not made:
            made.extend(_by_language(cast.value))
        by, other = made
        n = len(cast.value)
        map_ends, key_ends, keys, found = [0], [0], [], []
        for lang, text in zip(langs.to_pylist(), texts.to_pylist(), strict=True):
            automaton, own = by.get(lang, other), {}
            if automaton is not None and text:
                for (k, kind), phrase in {x for _, some in automaton.iter(f" {text} ") for x in some}:
                    own.setdefault(k, {}).setdefault(kind, []).append(phrase)
            for k in range(n):
                for kind, phrases in sorted(own.get(k, {}).items()):
                    keys.append(kind)
                    found.extend(sorted(phrases))
                    key_ends.append(len(found))
                map_ends.append(len(keys))
        phrases = pa.ListArray.from_arrays(pa.array(key_ends, pa.int32()), pa.array(found, pa.string()))
        maps = pa.MapArray.from_arrays(pa.array(map_ends, pa.int32()), pa.array(keys, pa.string()), phrases)
        return pa.ListArray.from_arrays(pa.array(range(0, len(langs) * n + 1, n), pa.int32()), maps)

    made: list = []  # once a task
    return run


def _by_language(lexicons: list[list[tuple]]) -> tuple[dict, object]:
    """An automaton by language, and that of others, of ((number of the lexicon, kind), phrase)."""
    each = [Lexicon(rows, list) for rows in lexicons]
    made = lambda own: _automata([((k, kind), phrase) for k, one in enumerate(each) for kind, phrase in own(one)], plain)
    return {lang: made(lambda one, lang=lang: one.of(lang)) for lang in {x for one in each for x in one.by}}, made(lambda one: one.other)


def _searches(lexicons: list[list[tuple]], lang: Column, padded: Column) -> Column:
    """The same by a plain search for each phrase of the text's language. padded: the text between blanks."""
    each = [Lexicon(rows, list) for rows in lexicons]

    def maps(own) -> Column:
        out = []
        for one in each:
            kinds: dict[str, set] = {}
            for kind, phrase in own(one):
                if phrase.strip():
                    kinds.setdefault(kind, set()).add(phrase)
            phrases = lambda own: F.array_compact(F.array(*(F.when(padded.contains(plain(p)), F.lit(p)) for p in sorted(own))))
            entries = [F.struct(F.lit(kind).alias("kind"), phrases(own).alias("phrases")) for kind, own in sorted(kinds.items())]
            out.append(F.map_from_entries(F.filter(F.array(*entries), lambda x: F.size(x["phrases"]) > 0)) if entries else F.expr("cast(map() as map<string,array<string>>)"))
        return F.array(*out)

    found = maps(lambda one: one.other)
    for code in sorted({x for one in each for x in one.by}):
        found = F.when(lang == code, maps(lambda one, code=code: one.of(code))).otherwise(found)
    return found


def phrase_maps(texts: DataFrame, lexicons: list[list[tuple]], text: str, name: str) -> DataFrame:
    """texts (with lang) and as name, by lexicon, a map of event_type to its phrases in a normalised text, each once and in order. One pass over the text, and no
    row leaves its place: a few phrases are searched for by Spark, more by an automaton. lexicons: (lang, event_type, phrase) each, see small()."""
    if sum(map(len, lexicons)) > FEW_PHRASES:
        found = F.arrow_udf(_maps(texts.sparkSession.sparkContext.broadcast(lexicons)), "array<map<string,array<string>>>")
        return texts.withColumn(name, found(F.col("lang"), F.col(text)))
    padded = texts.withColumn("p_text", F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")))
    return padded.withColumn(name, _searches(lexicons, F.col("lang"), F.col("p_text"))).drop("p_text")


def _automata(rows: list[tuple], shown: Callable[[str], str] = str):
    """Of (kind, phrase). shown: what stands in the text for a phrase."""
    import ahocorasick

    found = ahocorasick.Automaton()
    by: dict[str, list] = {}
    for kind, phrase in rows:
        by.setdefault(phrase, []).append((kind, phrase))
    for phrase, kinds in by.items():
        if phrase.strip():
            found.add_word(shown(phrase), kinds)
    found.make_automaton()
    return found if len(found) else None


def _parts(cast, carried: int):
    def run(batches):
        by = {}
        for lang, kind, phrase in cast.value:
            by.setdefault(lang, []).append((kind, phrase))
        by = {lang: _automata(rows) for lang, rows in by.items()}
        for batch in batches:
            at, kinds, phrases = [], [], []
            for k, (lang, text) in enumerate(zip(batch.column(carried).to_pylist(), batch.column(carried + 1).to_pylist(), strict=True)):
                automaton = by.get(lang)
                if automaton is not None and text:
                    for kind, phrase in dict.fromkeys(x for _, found in automaton.iter(text) for x in found):
                        at.append(k)
                        kinds.append(kind)
                        phrases.append(phrase)
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(carried)), pa.array(kinds, pa.string()), pa.array(phrases, pa.string())], names=[*batch.schema.names[:carried], "kind", "phrase"])

    return run


def match_parts(texts: DataFrame, phrases: list[tuple], carry: list[str]) -> DataFrame:
    """carry, kind, phrase for rows of carry, lang and norm that contain a phrase anywhere, of their own language alone. phrases: (lang, kind, phrase)."""
    cast = texts.sparkSession.sparkContext.broadcast(phrases)
    kinds = dict(texts.dtypes)
    return texts.select(*carry, "lang", "norm").mapInArrow(_parts(cast, len(carry)), ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "kind string", "phrase string"]))


def as_rows(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    """A constant table."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, names, strict=True))) for r in rows))))
