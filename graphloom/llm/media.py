"""Media columns: lossless WebP images decoded to pixel arrays, and bytes stored as such images.

`decoded` is the operator: from a column of WebP files (one or several, one after another) to arrays of pixels. A pixel has one
sample where the whole image is opaque grey, else four (alpha, red, green, blue).

A payload is the text's bytes, with zeros up to a positive multiple of 64. Its images are WIDTH samples wide and as high as
the format allows, one file after another, so that a text of any length is stored in bounded pieces.

Defined results: a null text is empty; equal texts have equal images; repeated rows, ties and further columns don't matter;
no rows give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import documents, small_batches, written
from .webp import MAX_SIDE, decode, encode_grey

WIDTH = 64
#: Files that are decoded before their pixels are handed on.
DECODED = 100


def payload_of(data: bytes) -> bytes:
    return data + bytes(WIDTH - len(data) if not data else -len(data) % WIDTH)


def images_of(payload: bytes) -> bytes:
    step = WIDTH * MAX_SIDE
    b = np.frombuffer(payload, np.uint8)
    return b"".join(encode_grey(b[i : i + step].reshape(-1, WIDTH)) for i in range(0, len(b), step))


def files_of(media: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        yield media[at : at + size]
        at += size


def pixels_of(media: bytes) -> list[np.ndarray]:
    """The ARGB pixel arrays of the images of a media column."""
    return [decode(f) for f in files_of(media)]


def image_row(argb: np.ndarray) -> dict:
    """An image as a row: its sides, how many samples a pixel has, and the samples row by row."""
    height, width = argb.shape
    grey = argb & np.uint32(255)
    if ((argb & np.uint32(0xFFFFFF00)) == (np.uint32(0xFF000000) | grey << np.uint32(16) | grey << np.uint32(8))).all():
        return {"width": width, "height": height, "samples": 1, "pixels": grey.astype(np.uint8).tobytes()}
    return {"width": width, "height": height, "samples": 4, "pixels": argb.astype(">u4").tobytes()}


def feature_of(samples: np.ndarray) -> str:
    """Mean, entropy of the samples, and for each of 8 by 8 fields whether it is lighter than the mean field."""
    count = np.bincount(samples.ravel(), minlength=256)
    p = count[count > 0] / samples.size
    rows = samples.reshape(len(samples), 8, -1).mean(2)
    starts = np.arange(8) * len(rows) // 8
    field = np.stack([rows[a : max(z, a + 1)].mean(0) for a, z in zip(starts, [*starts[1:], len(rows)], strict=True)])
    lighter = np.packbits(np.round(field, 6) > round(float(field.mean()), 6)).tobytes().hex()
    return f"{(count @ np.arange(256)) / samples.size:.4f}:{max(0.0, float(-(p * np.log2(p)).sum())):.4f}:{lighter}"


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of each row of docs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [(x or "").encode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([images_of(payload_of(x)) for x in data], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


IMAGES = "array<struct<width:int,height:int,samples:int,pixels:binary>>"
_IMAGES = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("pixels", pa.binary())]))


def decoded(media: DataFrame, column: str = "media", to: str = "images") -> DataFrame:
    """media with the pixel arrays of the WebP files in a binary column; a null has none (null), and what isn't lossless WebP is an error."""
    small_batches(media.sparkSession)
    media = media.drop(to)
    at = media.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, DECODED):  # pixels are many times the files' size
                part = b.slice(lo, DECODED)
                found = [None if m is None else [image_row(x) for x in pixels_of(m)] for m in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, _IMAGES)], names=[*part.schema.names, to])

    return media.mapInArrow(run, T.StructType([*media.schema.fields, T.StructField(to, T.DataType.fromDDL(IMAGES))]))


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(media: DataFrame) -> DataFrame:
    """What the stored images hold, from their pixel arrays: digests of the payload and of the files, and a feature of the samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, n, m, images in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                m = m.as_py()
                payload = b"".join(i["pixels"] for i in images.as_py())
                samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
                out.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature_of(samples)))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = [c.split()[0] for c in READ.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return decoded(media).select("doc_id", "n_bytes", "media", "images").mapInArrow(run, READ)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(written(stored(documents(spark, sf_dir)), "media"))
