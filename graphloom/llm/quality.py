"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A rated document's grade is 0 (toxic), 1 (poor) or 2 (good). One weight a hashed term, shared by all grades, gives a score s;
ordered thresholds turn it into P(grade <= k) = sigmoid(t_k - s), hence the expected grade and the tail probability of the
best grade, by which documents are kept. Weights are fitted on a sample of rated documents that is bounded in rows and in
characters (TRAIN_ROWS, TRAIN_CHARS: what passes the second bound is left out); a fifth of it is kept
apart and sets the tail probability from which documents are kept.

Defined results: null and empty texts have no terms and the score of the thresholds alone; several ratings of a document
count once, the worst; of several texts with one doc_id the least is learnt from; ratings that are null count as not toxic and good; without ratings, or with one grade only, every
document is kept with a tail of 1; repeated rows have equal results; no rows give no rows; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, small_batches
from .textvec import TERM_BITS, TERMS, distinct, mix, word_batches

HASH_BITS = 20
GRADES = 3
#: Rated documents to learn from, at most: a bound on the labelled sample.
TRAIN_ROWS = 8000
TRAIN_CHARS = 64_000_000
CALIBRATION = 5
ROUNDS, RATE, L2, MIN_DOCS = 200, 0.3, 1e-4, 5
#: A feature gets a weight if its share among some grade's documents is so many standard errors from its share among the others,
#: with TRAIN_ROWS ratings; with fewer, so much the less, but LEAST_SCREEN at least.
SCREEN, LEAST_SCREEN = 10.0, 5.0
PREFIXES = (4, 5, 6)
#: Texts of so many terms have levels, whose bounds follow.
SHAPED = 20
#: Bounds of the levels by which a share becomes a feature.
STEPS = (0.001, 0.01, 0.03, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8)

_U = np.uint64


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, row, feature): the distinct terms of whole texts, their beginnings, and how the text repeats itself."""
    each = 1 + len(PREFIXES)
    for lo, hi, h, ptr in word_batches(column, TERMS, PREFIXES):
        row, value, _ = distinct(h, ptr)
        n = np.maximum(np.diff(ptr) // each, 1)
        own = h[::each]
        again = np.append(False, own[1:] == own[:-1])
        of = np.repeat(np.arange(hi - lo), np.diff(ptr) // each)
        shape = [np.bincount(of, weights=again, minlength=hi - lo) / n, np.bincount(row, minlength=hi - lo) / (n * each)]
        level = [np.searchsorted(STEPS, x) for x in shape]
        long = np.flatnonzero(np.diff(ptr) // each >= SHAPED)
        more = [mix((x[long] + 1 + 100 * k).astype(_U)) >> _U(64 - HASH_BITS) for k, x in enumerate(level)]
        yield lo, hi, np.concatenate([row, *[long] * len(more)]), np.concatenate([value >> _U(TERM_BITS - HASH_BITS), *more]).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.0

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for lo, hi, row, feature in features(column):
            out[lo:hi] = np.bincount(row, weights=self.weights[feature], minlength=hi - lo)
        return out

    def tails(self, s: np.ndarray) -> np.ndarray:
        """P(grade > k), one row a k."""
        return 1 - _sigmoid(self.thresholds[:, None] - s[None, :])

    def decide(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(expected grade, tail probability of the best grade, kept)"""
        t = self.tails(self.scores(column))
        return t.sum(0), t[-1], t[-1] >= self.cut


def thresholds_of(t: np.ndarray) -> np.ndarray:
    """Ordered thresholds from the first one and the logs of the steps between them."""
    return np.append(t[0], t[0] + np.cumsum(np.exp(t[1:])))


def loss_and_gradient(w: np.ndarray, t: np.ndarray, rows: np.ndarray, features_: np.ndarray, y: np.ndarray, train: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean of -log P(grade) over the rows to learn from, with half of L2 times the weights' squares, and its gradients by w and t."""
    n, i = train.sum(), np.arange(len(y))
    s = np.bincount(rows, weights=w[features_], minlength=len(y))
    below = np.vstack([np.zeros(len(y)), _sigmoid(thresholds_of(t)[:, None] - s), np.ones(len(y))])
    slope = below * (1 - below)
    p = np.maximum(below[y + 1, i] - below[y, i], 1e-9)
    up, down = slope[y + 1, i] / p, slope[y, i] / p  # of -log p against the upper and the lower threshold
    g = np.where(train, up - down, 0) / n
    by_edge = np.array([(np.where(y == k + 1, down, 0) - np.where(y == k, up, 0))[train].sum() / n for k in range(len(t))])
    by_t = np.append(by_edge.sum(), [by_edge[k:].sum() * np.exp(t[k]) for k in range(1, len(t))])
    return float(-np.log(p[train]).mean() + L2 / 2 * (w @ w)), np.bincount(features_, weights=g[rows], minlength=len(w)) + L2 * w, by_t


def fit(texts: list[str], grades: list[int]) -> Ordinal:
    y = np.array(grades, np.int64)
    flat = Ordinal(np.zeros(1 << HASH_BITS, np.float32), np.full(GRADES - 1, -40.0))
    if len(np.unique(y)) < 2:
        return flat
    row, feature = [], []
    for lo, _, r, f in features(pa.array(texts, pa.large_string())):
        row.append(r + lo)
        feature.append(f)
    row, feature = np.concatenate(row), np.concatenate(feature)
    held = mix(np.arange(len(y), dtype=_U)) % _U(CALIBRATION) == 0
    fitted = ~held[row]
    total = np.bincount(feature[fitted], minlength=1 << HASH_BITS)
    often = np.zeros(1 << HASH_BITS, bool)
    for g in range(GRADES):
        n, all_ = (y[~held] == g).sum(), (~held).sum()
        if 0 < n < all_:
            mine = np.bincount(feature[fitted & (y[row] == g)], minlength=1 << HASH_BITS)
            p = total / all_
            apart = np.abs(mine / n - (total - mine) / (all_ - n)) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n + 1 / (all_ - n)))
            often |= (apart > max(LEAST_SCREEN, SCREEN * np.sqrt(all_ / (TRAIN_ROWS * (1 - 1 / CALIBRATION))))) & (total >= MIN_DOCS)
    use = fitted & often[feature]
    r = row[use]
    known, f = np.unique(feature[use], return_inverse=True)
    train = ~held
    share = np.cumsum(np.bincount(y[train], minlength=GRADES))[:-1] / train.sum()
    at = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    # the first threshold and the logs of the steps between them: they stay in order
    t = np.append(at[0], np.log(np.maximum(np.diff(at), 1e-2)))
    w = np.zeros(len(known))
    sum_w, sum_t = np.full(len(known), 1e-8), np.full(len(t), 1e-8)
    for _ in range(ROUNDS):
        _, grad, g_t = loss_and_gradient(w, t, r, f, y, train)
        sum_w += grad**2
        sum_t += g_t**2
        w -= RATE * grad / np.sqrt(sum_w)
        t -= RATE * 0.3 * g_t / np.sqrt(sum_t)
    weights = np.zeros(1 << HASH_BITS, np.float32)
    weights[known] = w
    out = Ordinal(weights, thresholds_of(t))
    s = np.bincount(row, weights=weights[feature], minlength=len(y))
    tail, good = out.tails(s)[-1][held], y[held] == GRADES - 1
    if good.any() and not good.all():
        cuts = np.unique(tail)
        kept = 1 - np.searchsorted(np.sort(tail[good]), cuts) / good.sum()
        dropped = np.searchsorted(np.sort(tail[~good]), cuts) / (~good).sum()
        best = int(np.argmax(kept + dropped))
        # half way to the next lower value seen, so that what is like the kept ones stays
        out.cut = float((cuts[best] + cuts[max(best - 1, 0)]) / 2)
    return out


def learned(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Ordinal:
    grade = F.when(F.coalesce("toxic", F.lit(0)) == 1, 0).when(F.coalesce("quality", F.lit(1)) == 0, 1).otherwise(2)
    rated = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(grade).alias("grade"))
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    # by hash, as far as the characters go: all that reaches the driver is bounded by rows and chars
    texts = texts.withColumn("upto", F.sum(F.char_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    picked = texts.where(F.col("upto") <= chars).collect()
    picked = sorted(((r["doc_id"], r["text"], r["grade"]) for r in picked), key=lambda r: hash((r[0] * 2654435761) % (1 << 32)))
    return fit([t for _, t, _ in picked], [g for _, _, g in picked])


def rated(docs: DataFrame, model: Ordinal, columns: list[str] | None = None) -> DataFrame:
    """The named columns of docs (all of them) with expected_grade, tail and keep, which replace columns so named."""
    small_batches(docs.sparkSession)
    columns = [c for c in (docs.columns if columns is None else columns) if c not in ("expected_grade", "tail", "keep")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of 2**HASH_BITS weights
    at, places = docs.columns.index("text"), [docs.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            grade, tail, keep = m.decide(b.column(at))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in places], pa.array(grade), pa.array(tail), pa.array(keep)], names=[*columns, "expected_grade", "tail", "keep"])

    schema = docs.select(*[f"`{c}`" for c in columns]).schema
    return docs.mapInArrow(run, schema.add("expected_grade", "double").add("tail", "double").add("keep", "boolean"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rated(docs.select("doc_id", "text"), model, ["doc_id"])
