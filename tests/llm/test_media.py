"""Operator 1: exact round trips through every transform and both decoders, streams written by hand, and the rows of the query."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from touchline.llm import media, webp

RNG = np.random.default_rng(7)


def image(kind, height, width):
    if kind == "noise":
        x = RNG.integers(0, 256, (height, width, 4))
    elif kind == "smooth":
        x = np.add.outer(np.arange(height) * 2, np.arange(width))[..., None] + RNG.integers(0, 3, (height, width, 4))
    elif kind == "few":
        x = RNG.integers(0, 256, (5, 4))[RNG.integers(0, 5, (height, width))]
    elif kind == "some":
        x = RNG.integers(0, 256, (60, 4))[RNG.integers(0, 60, (height, width))]
    else:
        x = np.tile(RNG.integers(0, 256, (1, 7, 4)), (height, -(-width // 7), 1))[:, :width]
    return (x & 255).astype(np.uint8)


@pytest.mark.parametrize("kind", ["noise", "smooth", "few", "some", "periodic"])
@pytest.mark.parametrize(("height", "width"), [(1, 1), (1, 9), (7, 1), (13, 37), (40, 64)])
def test_round_trips(kind, height, width):
    x = image(kind, height, width)
    tiles = lambda b, top, *more: RNG.integers(0, top, (-(-height >> b) * -(-width >> b), *more))
    ways = [
        {},
        {"palette": False},
        {"palette": False, "subtract_green": True, "cache_bits": 5},
        {"palette": False, "predictor": (2, tiles(2, 16)), "shortest": None},
        {"palette": False, "predictor": None, "cross_color": (3, tiles(3, 256, 3))},
        {"palette": False, "predictor": (3, tiles(3, 14)), "cross_color": (2, tiles(2, 256, 3)), "subtract_green": True, "cache_bits": 11},
        {"palette": False, "predictor": None, "meta": (2, tiles(2, 3)), "cache_bits": 3},
    ]
    for how in ways:
        assert np.array_equal(webp.decode_image(webp.encode_image(x, **how)), x), how


def test_both_decoders_agree(monkeypatch):
    for kind in ("noise", "some", "periodic"):
        x = image(kind, 30, 50)
        for how in ({"palette": False, "cache_bits": 4}, {"palette": False, "cache_bits": 0}):
            stream = webp.encode_image(x, **how)
            fast = webp.decode_image(stream)
            with monkeypatch.context() as m:
                m.setattr(webp, "_read_together", lambda bits, width, total, cache_bits, codes: webp._read_one_by_one(bits, width, total, cache_bits, [codes], None, 0))
                assert np.array_equal(webp.decode_image(stream), fast) and np.array_equal(fast, x)
            with monkeypatch.context() as m:
                m.setattr(webp, "BLOCK", 1 << 9)
                assert np.array_equal(webp.decode_image(stream), x)


def test_overlapping_reference_and_cache_written_by_hand():
    """Two literals, a reference of length 3 two pixels back, a cache code: fields put down one by one."""
    out = webp.Writer()
    a, b = 0xFF010203, 0xFF040203
    bits = 11
    slot = int(webp.cache_hash(np.array([a], np.uint32), bits)[0])
    out.put_all([webp.SIGNATURE, 5, 0, 0, 0], [8, 14, 14, 1, 3])
    out.put_all([0, 1, bits, 0], [1, 1, 4, 1])  # no transforms, a cache, no meta codes
    counts = np.zeros(256 + 24 + (1 << bits), int)
    counts[[2, 256 + 2, 280 + slot]] = 4, 2, 2  # green 2; length 3; the cache's slot
    prefix, extra, rest = (int(x[0]) for x in webp.to_prefix(np.array([122])))
    codes = [webp.write_code(out, counts), *(webp.write_code(out, np.bincount(s, minlength=256)) for s in ([1, 4], [3], [255])), webp.write_code(out, np.bincount([prefix], minlength=40))]
    put = lambda c, s: out.put(int(codes[c][1][s]), int(codes[c][0][s]))
    for red in (1, 4):
        put(0, 2), put(1, red), put(2, 3), put(3, 255)
    put(0, 258), put(4, prefix)
    out.put(rest, extra)
    put(0, 280 + slot)
    assert webp.join(webp.decode_image(out.bytes())).tolist() == [a, b, a, b, a, a]


def test_near_distances():
    assert webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and webp.NEAR[-3:] == [(-7, 7), (8, 6), (8, 7)] and len(webp.NEAR) == 120


def test_damaged_streams_are_refused():
    stream = webp.encode_image(image("noise", 20, 20))
    for cut in (1, 4, 30, len(stream) // 2):
        with pytest.raises(webp.WebPError):
            webp.decode_image(stream[:cut])
    with pytest.raises(webp.WebPError):
        webp.decode_image(b"\x00" + stream[1:])


@pytest.mark.parametrize("most", [2, 7, 15])
def test_code_lengths_are_complete_and_bounded(most):
    rng = random.Random(most)
    for _ in range(100):
        counts = [rng.choice([0, 1, 2, 5, 10**6]) for _ in range(min(19, 1 << most))]
        lengths = webp.code_lengths(counts, most) if any(counts) else [0]
        assert max(lengths) <= most and (sum(n > 0 for n in lengths) < 2 or sum(2.0**-n for n in lengths if n) == 1)


TEXTS = [None, "", "a", "short text", "é" * 288, "x" * 576, "word " * 400, "ab\n" * 3000]


def test_payloads():
    rng = random.Random(1)
    for text in [*TEXTS, "".join(rng.choice(["the ", "of ", "house ", "garden, ", "\n"]) for _ in range(300_000))]:
        n, payload = media.padded(text)
        stored = media.write_media(payload)
        back = b"".join(np.ascontiguousarray(x).tobytes() for x in media.read_media(stored))
        data = (text or "").encode()
        assert n == len(data) and back == payload and len(back) % 576 == 0 and len(back) >= 576 and back[:n] == data and set(back[n:]) <= {255}


def test_rows(spark, sf_dir):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a", "x"), (2, "a", "x")], "doc_id long, text string, media string")
    got = media.describe_media(media.store_documents(docs)).collect()
    assert len(got) == len(TEXTS) + 2 and len({tuple(r)[1:] for r in got if r.doc_id in (None, 2)}) == 1
    assert media.describe_media(media.store_documents(docs.limit(0))).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: r.text for r in docs.collect()}
    for r in media.describe_media(media.store_documents(docs)).collect():
        n, payload = media.padded(want[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
