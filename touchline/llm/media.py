"""Media columns: texts as lossless WebP, and back (operator 1).

A text's UTF-8 bytes, filled up with 255 to a positive multiple of 576, are the samples of grey images 576 pixels wide (red and blue equal
green, and are stored as differences from it); a payload of more than MOST_ROWS rows becomes several files, one after the other, so a task
holds one image at a time. Features are computed from the pixels that were read back.

A null text counts as empty (one row of 255). Equal texts have equal values; every row gives one row, repeated rows too.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from touchline.llm import webp
from touchline.llm.common import per_row, spark_schema

UNIT = 576
MOST_ROWS = 1024
#: Bytes in the shortest repeat that is stored as a reference.
SHORTEST = 16


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the payload."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def write_media(payload: bytes) -> bytes:
    """WebP files of a payload."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    files = []
    for begin in range(0, len(samples), MOST_ROWS):
        files.append(webp.to_riff(webp.encode_grey(samples[begin : begin + MOST_ROWS], SHORTEST)))
    return b"".join(files)


def read_media(media: bytes) -> Iterator[np.ndarray]:
    """Pixel arrays (rows, columns) of grey WebP files."""
    for stream in webp.from_riff(media):
        channels = webp.decode_image(stream)
        if not ((channels[..., 1] == channels[..., 2]).all() and (channels[..., 3] == channels[..., 2]).all()):
            raise webp.WebPError("the image is not grey")
        yield channels[..., 2]


def store_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the stored form) of every row of docs(doc_id, text, ...). No shuffle."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def make():
        def row(doc_id, text):
            n, payload = padded(text)
            return doc_id, n, write_media(payload)

        return row

    return docs.select("doc_id", "text").mapInArrow(per_row(["doc_id", "text"], out, make), spark_schema(out))


def describe_media(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (rows, sum and a histogram of eight bins
    over the pixels) of stored media. No shuffle."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def make():
        def row(doc_id, n_bytes, media):
            size, rows, digest, tail = 0, 0, hashlib.sha256(), b""
            total, bins = 0, np.zeros(8, np.int64)
            for pixels in read_media(media):
                part = np.ascontiguousarray(pixels).tobytes()
                digest.update(part)
                size, rows, tail = size + len(part), rows + len(pixels), part[-32:]
                total += int(pixels.sum(dtype=np.int64))
                bins += np.bincount((pixels >> 5).ravel(), minlength=8)
            feature = f"rows={rows};sum={total};bins={','.join(map(str, bins))}"
            return doc_id, n_bytes, size, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature

        return row

    return stored.mapInArrow(per_row(["doc_id", "n_bytes", "media"], out, make), spark_schema(out))
