"""Operator 10: media columns of lossless WebP.

A text's UTF-8 bytes, filled with zeros up to a positive multiple of 64, become 8-bit samples of
one or more images end to end, four samples to a pixel.  The stored form is a binary column that
is written to the shared folder; features come from the pixels that are decoded from what is read
back: prefix codes, back-references and the colour cache, then the inverse of the palette, or of
the cross-colour and predictor transforms.

Defined cases: a null text is the empty text, 64 zero bytes; a very long text is many images;
equal texts give equal values; rows with equal or null ids are rows like any others; columns
besides the id and the text are left out, whatever they are called; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .webp_batch import BLOCK, decode_many, encode_many, split_files

UNIT = 64
#: Rows and bytes whose images are coded together.
SLICE_ROWS, SLICE_BYTES = 3000, 6 << 20


def padded(body: bytes) -> bytes:
    return body + b"\0" * (max(UNIT, -(-len(body) // UNIT) * UNIT) - len(body))


def stored(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each padded payload."""
    blocks = [p[at : at + BLOCK] for p in payloads for at in range(0, len(p), BLOCK)]
    files = iter([f for at in range(0, len(blocks), 2 * SLICE_ROWS) for f in encode_many(blocks[at : at + 2 * SLICE_ROWS])])
    return [b"".join(next(files) for _ in range(0, len(p), BLOCK)) for p in payloads]


def pixels(media: list[bytes]) -> list[list[np.ndarray]]:
    """The images of each stored form."""
    files = [split_files(m) for m in media]
    flat = [f for own in files for f in own]
    images = iter([x for at in range(0, len(flat), 2 * SLICE_ROWS) for x in decode_many(flat[at : at + 2 * SLICE_ROWS])])
    return [[next(images) for _ in own] for own in files]


def _store(batches):
    for batch in batches:
        at = 0
        for texts in slices(batch.column("text"), SLICE_ROWS, SLICE_BYTES):
            bodies = [(t or "").encode("utf-8", "replace") for t in texts.to_pylist()]
            ids = batch.column("id").slice(at, len(texts))
            at += len(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(b) for b in bodies], pa.int64()), pa.array(stored([padded(b) for b in bodies]), pa.binary())], ["id", "n_bytes", "media"])


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_bytes and the media column."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_store, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def feature(images: list[np.ndarray]) -> str:
    """Size, mean of each channel and a histogram of all samples in sixteen classes."""
    samples = np.concatenate([x.reshape(-1, 4) for x in images])
    mean = samples.mean(0)
    hist = np.bincount(samples.ravel() >> 4, minlength=16)
    return f"{images[0].shape[1]}x{sum(x.shape[0] for x in images)};" + ",".join(f"{x:.4f}" for x in mean) + ";" + ",".join(map(str, hist.tolist()))


def _read(batches):
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        at = 0
        for part in slices(batch.column("media"), SLICE_ROWS, SLICE_BYTES):
            ids, sizes = (batch.column(c).slice(at, len(part)).to_pylist() for c in ("id", "n_bytes"))
            at += len(part)
            rows, media = [], part.to_pylist()
            for i, n, m, images in zip(ids, sizes, media, pixels(media)):
                payload = b"".join(x.tobytes() for x in images)
                rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature(images)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decode a media column: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature."""
    rows = media.select(F.col(id_col).cast("long").alias("id"), "n_bytes", "media")
    return rows.mapInArrow(_read, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("id", id_col)
