"""Packing along a space-filling curve.

The distinct words of a document, hashed to signs, project it to a few dimensions; the cell in that space has a number along
a Hilbert curve. Documents are range-sorted by that number, so neighbours on the curve meet in a sequence, and each range is
cut into sequences of `capacity` tokens while it streams by. What is left at a range's end is cut into powers of two, which
take no padding. Sequences are numbered through by the ranges' counts.

A range holds the state of one open sequence only; equal keys are split by document, so copies don't meet in one range.
Defined results: null and empty texts are the end token alone; repeated rows are packed each by itself; no rows give no rows;
further columns don't matter. With `segment`, ranges follow that column first: each segment is packed by itself in its order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, partitions, small_batches, written
from .textvec import TERM_BITS, WORDS, distinct, word_batches
from .tokens import default_path, encoder

CAPACITY = 2048
END = 1
DIMENSIONS, CURVE_BITS = 3, 10
#: Standard deviations of a projection that the cells cover to either side.
SPREAD = 3.0


def hilbert(axes: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of points with integer coordinates below 2**bits, one row a dimension."""
    x = axes.astype(np.uint64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low, bit = np.uint64(q - 1), np.uint64(q)
        for i in range(n):
            inverted = (x[i] & bit) != 0
            swap = np.where(inverted, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverted, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key


def curve_keys(texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts), np.int64)
    for lo, hi, h, ptr in word_batches(texts, WORDS):
        row, value, _ = distinct(h, ptr)
        n = np.maximum(np.bincount(row, minlength=hi - lo), 1)
        cells = []
        for d in range(DIMENSIONS):
            sign = ((value >> np.uint64(TERM_BITS - 1 - d)) & np.uint64(1)).astype(np.float64) * 2 - 1
            at = np.bincount(row, weights=sign, minlength=hi - lo) / np.sqrt(n)
            cells.append(np.clip((at + SPREAD) / (2 * SPREAD) * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1).astype(np.uint64))
        out[lo:hi] = hilbert(np.stack(cells), CURVE_BITS).astype(np.int64)
    return out


def with_curve_keys(docs: DataFrame) -> DataFrame:
    """(segment, doc_id, text) with the position along the curve."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(curve_keys(b.column("text")))], names=[*b.schema.names, "curve"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(add, f"{schema}, curve long")


class Cutter:
    """Cuts documents into pieces of sequences, in order."""

    def __init__(self, capacity: int):
        self.capacity, self.sequence, self.fill, self.open, self.rows = capacity, 0, 0, [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            take = min(self.capacity - self.fill, len(ids) - at)
            self.open.append((doc_id, at, ids[at : at + take], len(ids)))
            at, self.fill = at + take, self.fill + take
            if self.fill == self.capacity:
                self._close()

    def _close(self) -> None:
        offset = 0
        for doc_id, start, ids, whole in self.open:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), whole, self.sequence, offset))
            offset += len(ids)
        self.sequence, self.fill, self.open = self.sequence + 1, 0, []

    def finish(self) -> None:
        """The open sequence, as sequences whose lengths are powers of two."""
        rest, self.open, left = self.open, [], self.fill
        for doc_id, start, ids, whole in rest:
            at = 0
            while at < len(ids):
                room = (1 << (left.bit_length() - 1)) - sum(len(x[2]) for x in self.open)
                take = min(room, len(ids) - at)
                self.open.append((doc_id, start + at, ids[at : at + take], whole))
                at += take
                if take == room:
                    left -= sum(len(x[2]) for x in self.open)
                    self._close()


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("in_range", pa.int64()), ("offset", pa.int64()), ("range", pa.int32())])


def packed(docs: DataFrame, segment: Column | None = None, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): the pieces of all documents."""
    spark, path = docs.sparkSession, tokenizer or default_path()
    small_batches(spark)
    rows = docs.select((segment if segment is not None else F.lit("")).cast("string").alias("segment"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = ["segment", "curve", "salt", "doc_id"]
    keyed = with_curve_keys(rows).withColumn("salt", F.xxhash64("doc_id"))
    ranged = keyed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, cutter, here = encoder(path), Cutter(capacity), TaskContext.get().partitionId()

        def flush() -> Iterator[pa.RecordBatch]:
            if cutter.rows:
                columns = list(zip(*cutter.rows, strict=True))
                cutter.rows = []
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array([here] * len(columns[0]), pa.int32())], schema=PIECES)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                cutter.add(doc_id, np.append(ids_of(text.as_py() or ""), np.uint32(END)))
            yield from flush()
        cutter.finish()
        yield from flush()

    pieces = written(ranged.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, in_range long, offset long, range int"), "pieces")
    counts = pieces.groupBy("range").agg((F.max("in_range") + 1).alias("n"))  # a row for each range
    base = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    out = pieces.join(F.broadcast(base), "range")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("in_range")).alias("sequence_id"), "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
