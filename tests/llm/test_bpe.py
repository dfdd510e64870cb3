"""Operator 7 against the tokenizers library."""

import hashlib
import random
import sys
import unicodedata

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from touchline.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
VOCABULARY = bpe.Vocabulary(PATH)
PIECES = ["th", "e", "a", "in", "ing", " ", "\n", "'s", "9", "é", "ß", "İ", "Σ", "ΣΣ ", "\x1c", "　", "<|endoftext|>", "<|", "</w>", "ab" * 30, "\U0001f600", "é", "!", "?!"]


def both(text, encoder, decoder):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    parts = list(encoder.encode(text))
    assert b"".join(parts) == bpe.packed(ids), text[:80]
    assert "".join(map(decoder.feed, parts)) + decoder.finish() == LIBRARY.decode(ids, skip_special_tokens=False)


def test_texts_of_odd_pieces():
    rng, encoder, decoder = random.Random(1), bpe.Encoder(VOCABULARY), bpe.Decoder(VOCABULARY)
    for _ in range(3000):
        both("".join(rng.choice(PIECES) for _ in range(rng.randrange(25))), encoder, decoder)


def test_long_words_stream_in_constant_memory():
    rng = random.Random(2)
    for alphabet in ("abcdeinotrhs", "a", "ab", "e t", "hat"):
        word = "".join(rng.choice(alphabet.replace(" ", "")) for _ in range(6000))
        t, held, out = bpe.Transducer(VOCABULARY), 0, []
        for c in word[:-1]:
            out += t.feed(c)
            held = max(held, len(t.chars))
        out += t.finish(word[-1])
        assert VOCABULARY.lookahead < held <= 2 * VOCABULARY.lookahead
        assert [VOCABULARY.ids[x] for x in out] == LIBRARY.encode(word, add_special_tokens=False).ids


def test_text_mode_undoes_words():
    encoder, decoder = bpe.Encoder(VOCABULARY), bpe.Decoder(VOCABULARY, as_text=True)
    ids = b"".join(encoder.encode("The café, 12\nGarden \U0001f600"))
    assert "".join(decoder.feed(ids[k : k + 4]) for k in range(0, len(ids), 4)) + decoder.finish() == "the café , 1 2 garden \U0001f600 "


def test_small_caches_change_nothing():
    encoder = bpe.Encoder(VOCABULARY)
    encoder.word.most = 600
    for _ in range(3):
        assert encoder.word.held <= 300 + 400 and len(encoder.word.older) < 5
        both("one two three four five six one two three " * 20, encoder, bpe.Decoder(VOCABULARY))


def test_every_character_is_cut_into_words_as_the_library_does():
    """Letters, numbers of all kinds, marks and other characters, alone and between letters."""
    encoder = bpe.Encoder(VOCABULARY)
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co", "Lo")]
    points += range(0x4E00, 0x4F00)
    wrong = [c for c in points if b"".join(encoder.encode(f"a{chr(c)}b 1{chr(c)}")) != bpe.packed(LIBRARY.encode(f"a{chr(c)}b 1{chr(c)}", add_special_tokens=False).ids)]
    assert not wrong, [hex(c) for c in wrong[:20]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES) | st.text(max_size=5), max_size=30).map("".join))
def test_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    both(text, bpe.Encoder(VOCABULARY), bpe.Decoder(VOCABULARY))
    assert packing.library_encoder(PATH).encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {}
    for r in docs.collect():
        ids = LIBRARY.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(bpe.packed(ids)).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in bpe.encode_documents(docs, PATH).collect()}
    assert got == want


@pytest.mark.parametrize("text", [None, "", " \n"])
def test_odd_rows(spark, text):
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, "word " * 200_000, "x")], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in bpe.encode_documents(docs, PATH).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (got[1].n_tokens, got[1].ids_sha256, got[1].decoded_sha256) == (0, empty, empty) and got[None].n_tokens == 200_000
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0
