"""Document fingerprints by I-Match over randomised lexicons.

Document frequencies of all terms of all documents give the lexicon: terms whose frequency lies within a band. A document's
distinct lexicon terms, in order, are hashed once whole and once for each of several random subsets of the lexicon; subsets
of several rates make the fingerprint tell degrees for short texts and long ones. Two fingerprints are as alike as the share
of equal hashes among the subsets that either text has terms of.

The lexicon is broadcast: a document has a mean number of distinct terms, and each lexicon term is in LOW of the documents
at least, so it has at most mean / LOW terms. Defined results: null text counts as empty; texts without a lexicon term are
hashed over all their terms; two such are alike (1) if that hash is equal, else 0; equal texts have equal fingerprints.
Documents with one doc_id follow one another by their texts' MD5; a null doc_id is the smallest; no rows give no rows;
a single document follows itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import documents, partitions, small_batches, written
from .textvec import WORDS, distinct, mix, word_batches

#: The band: shares of all documents that a lexicon term is in, at least and at most, and in how many documents at least.
LOW, HIGH, LEAST_DOCS = 1 / 500, 1 / 4, 2
#: Rates of the random subsets of the lexicon, and how many there are of each.
RATES, EACH = (1 / 32, 1 / 128, 1 / 512, 1 / 2048), 16
SUBSETS = len(RATES) * EACH
#: Terms that a task counts in memory before it hands counts on.
HELD = 2_000_000

_U = np.uint64


def term_frequencies(docs: DataFrame) -> DataFrame:
    """(term, n_docs) over all whole texts."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            term, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(term.astype(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

        for b in batches:
            for _, _, h, ptr in word_batches(b.column(0), WORDS):
                held.append(distinct(h, ptr)[1])
                size += len(held[-1])
            if size > HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_docs"))


def lexicon(docs: DataFrame) -> np.ndarray:
    """The terms within the band, sorted."""
    n = docs.count()
    band = (F.col("n_docs") >= max(LEAST_DOCS, LOW * n)) & (F.col("n_docs") <= HIGH * n)
    terms = term_frequencies(docs).where(band).select("term").toArrow()
    return np.sort(terms.column(0).to_numpy().astype(_U))


class Fingerprints:
    """Fingerprints of texts: 32-bit hashes, one row a text; column 0 is the whole lexicon's, 0 elsewhere means no term."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        keep = np.empty((SUBSETS, len(terms)), bool)
        for j in range(SUBSETS):
            keep[j] = mix(terms + _U((j + 1) << 48)) < _U(int(RATES[j // EACH] * 2.0**64) - 1)
        self.keep = keep

    def of(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), SUBSETS + 1), np.uint32)
        for lo, hi, h, ptr in word_batches(column, WORDS):
            row, value, _ = distinct(h, ptr)
            at = np.minimum(np.searchsorted(self.terms, value), max(len(self.terms) - 1, 0))
            known = self.terms[at] == value if len(self.terms) else np.zeros(len(value), bool)
            has = np.bincount(row[known], minlength=hi - lo) > 0
            self._hash(out[lo:hi], 0, row[known], value[known])
            none = ~has[row]
            self._hash(out[lo:hi], 0, row[none], value[none])
            row, value, at = row[known], value[known], at[known]
            for j in range(SUBSETS):
                k = self.keep[j, at]
                self._hash(out[lo:hi], j + 1, row[k], value[k])
        return out

    @staticmethod
    def _hash(out: np.ndarray, j: int, row: np.ndarray, value: np.ndarray) -> None:
        """Hashes of each row's sorted values, each weighed by its place."""
        if len(row):
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
            total = np.add.reduceat(mix(value + (place.astype(_U) << _U(46))), first)
            out[row[first], j] = np.maximum(mix(total) >> _U(32), _U(1)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    either = (a[:, 1:] != 0) | (b[:, 1:] != 0)
    n = either.sum(1)
    same = ((a[:, 1:] == b[:, 1:]) & either).sum(1)
    return np.where(n > 0, same / np.maximum(n, 1), (a[:, 0] == b[:, 0]).astype(float))


def as_text(prints: np.ndarray) -> list[str]:
    return [r.astype(">u4").tobytes().hex() for r in prints]


def fingerprints(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """docs with the column fingerprint, which replaces one so named: the general form, for any number of further uses."""
    docs = docs.drop("fingerprint")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Fingerprints(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(as_text(f.of(b.column(at))), pa.string())], names=[*b.schema.names, "fingerprint"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.StringType())]))


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
EDGE = "kind int, range int, text string, "
EDGE_SCHEMA = EDGE + ROW


def edited(text: str, after: str) -> str:
    """text with its last half replaced by the first as many characters of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _compared(f: Fingerprints, ids: list, texts: list[str], after: list[str]) -> list[pa.Array]:
    changed = [edited(t, a) for t, a in zip(texts, after, strict=True)]
    own, new, following = (f.of(pa.array(x, pa.large_string())) for x in (texts, changed, after))
    shas = [hashlib.sha256(x.encode()).hexdigest() for x in changed]
    return [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(shas), pa.array(as_text(own)), pa.array(as_text(new)), pa.array(likeness(own, new)), pa.array(likeness(own, following))]


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stream by in ranges of descending doc_id, each met with the next; only a range's first and last document
    wait for a second step, in which the last meets the first of the next range that has rows."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    terms = lexicon(docs)
    shared = spark.sparkContext.broadcast(terms)
    order = [F.col("doc_id").desc_nulls_last(), F.md5(F.coalesce("text", F.lit("")))]
    ranged = docs.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, here, last = Fingerprints(shared.value), TaskContext.get().partitionId(), None

        def edge(kind: int, doc_id: int | None, text: str) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([kind, here, text, doc_id, *[None] * 6], kinds, strict=True)], names=["kind", "range", "text", *_COLUMNS])

        for b in batches:
            ids, texts = b.column(0).to_pylist(), [x or "" for x in b.column(1).to_pylist()]
            if not ids:
                continue
            if last is None:
                yield edge(1, ids[0], texts[0])
            else:
                ids, texts = [last[0], *ids], [last[1], *texts]
            last = ids[-1], texts[-1]
            if len(ids) > 1:
                columns = _compared(f, ids[:-1], texts[:-1], texts[1:])
                n = len(ids) - 1
                yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([here] * n, pa.int32()), pa.nulls(n, pa.string()), *columns], names=["kind", "range", "text", *_COLUMNS])
        if last is not None:
            yield edge(2, *last)

    met = written(ranged.mapInArrow(run, EDGE_SCHEMA), "fingerprints")
    heads = met.where("kind = 1").select(F.col("range").alias("next"), F.col("text").alias("after"))  # a row for each range, as are the lasts
    numbers = met.where("kind = 1").select("range")
    follows = F.lead("range").over(Window.orderBy("range"))
    after = numbers.select("range", F.coalesce(follows, F.min("range").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next")).join(heads, "next").select("range", "after")
    lasts = met.where("kind = 2").select("range", "doc_id", "text").join(after, "range").select("doc_id", "text", "after")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Fingerprints(shared.value)
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(_compared(f, b.column(0).to_pylist(), [x or "" for x in b.column(1).to_pylist()], [x or "" for x in b.column(2).to_pylist()]), names=_COLUMNS)

    return met.where("kind = 0").select(*_COLUMNS).unionByName(lasts.mapInArrow(finish, ROW))
