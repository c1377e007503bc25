"""Language identification by interpolated Kneser-Ney character models.

For each language the n-grams of letters up to ORDER, seen in a bounded sample of labelled texts, have log probabilities and
back-off weights in arrays sorted by the n-grams' hashes. A text is whole, in lower case, runs of other characters as one
space; its language is the one of lowest cross-entropy per character. A tenth of each language's sample is kept from the
counts: it sets the temperature of the score and, cut into windows of bounded length, by language the entropy beyond which a
text is rejected as none of them. A language with few windows has the bound of all languages together.

Defined results: a text that is null or has no letter is `und`, with score 0, and is rejected; without labelled texts all
are; equal texts have equal results; repeated rows and further columns don't matter; no rows give no rows. Labels only
serve to learn.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, small_batches
from .textvec import SEGMENT, mix, raw

ORDER = 5
#: Letters have codes of so many bits, so that ORDER of them fit a 64-bit n-gram: the 2 ** CODE_BITS - 2 most frequent letters of
#: the sample have one each, all others share one. Scripts of up to 4,094 letters are told apart letter by letter.
CODE_BITS = 12
#: Characters of text to learn from, for each language: a bound on the labelled sample.
TRAIN_CHARS = 1_000_000
CALIBRATION = 10
#: Characters of a window of held-back text, and how many windows a language needs for a bound of its own.
WINDOW, WINDOWS = 256, 20
#: Share of a language's own texts that rejection may cost.
REJECT = 0.0005
#: A text is rejected only if its entropy is so many nats a character above the language's own, too: mixed texts stay.
EXCESS = 1.0
UND = "und"

_U = np.uint64
_LETTER = None


def _letters() -> np.ndarray:
    """For each code point below 0x10000: its lower-case code point if it is a letter, else 0."""
    global _LETTER
    if _LETTER is None:
        t = np.zeros(0x10000, np.uint32)
        for i in range(0x10000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else i
        _LETTER = t
    return _LETTER


def pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, code points of lower-case letters and 0 for runs of others, offsets of rows into them), in bounded pieces."""
    data, off = raw(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + SEGMENT, "right")) - 1))
        a, z = int(off[lo]), int(off[hi])
        while True:
            cut = z
            if z - a > SEGMENT:  # one long text, cut between characters
                cut = a + SEGMENT
                while data[cut] & 0xC0 == 0x80:
                    cut -= 1
            b = data[a:cut]
            points = np.frombuffer(b.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            begins = np.append(0, np.cumsum((b & 0xC0) != 0x80))
            starts = begins[np.clip(off[lo : hi + 1] - a, 0, cut - a)]
            code = _letters()[np.minimum(points, 0xFFFF)]
            for p in np.unique(points[points > 0xFFFF]):
                code = np.where(points == p, p if unicodedata.category(chr(p))[0] == "L" else 0, code)
            before = np.append(0, code[:-1]) if len(code) else code
            before[starts[:-1][starts[:-1] < len(code)]] = 0
            keep = (code > 0) | (before > 0)
            yield np.arange(lo, hi), code[keep], np.append(0, np.cumsum(keep))[starts]
            a = cut
            if a >= z:
                break
        lo = hi


def grams(code: np.ndarray, ptr: np.ndarray, order: int) -> np.ndarray:
    """The last `order` codes at each place, packed, the latest lowest; before a row's start there are spaces."""
    place = np.arange(len(code)) - np.repeat(ptr[:-1], np.diff(ptr))
    out = code.astype(_U)
    for k in range(1, order):
        older = np.zeros(len(code), _U)
        older[k:] = code[:-k].astype(_U) if len(code) > k else older[k:]
        older[place < k] = 0
        out |= older << _U(CODE_BITS * k)
    return out


def _low(g: np.ndarray, n: int) -> np.ndarray:
    return g & _U((1 << (CODE_BITS * n)) - 1)


@dataclass
class KneserNey:
    """log p of seen n-grams and log back-off of seen contexts, by order, in arrays sorted by hash."""

    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    floor: float = 0.0

    @staticmethod
    def fit(all_grams: np.ndarray, n_codes: int) -> KneserNey:
        keys, counts = np.unique(all_grams, return_counts=True)
        tables = [(keys, counts.astype(np.float64))]
        for n in range(ORDER - 1, 0, -1):  # how many different letters stand before each shorter n-gram
            k, c = np.unique(_low(tables[0][0], n), return_counts=True)
            tables.insert(0, (k, c.astype(np.float64)))
        model = KneserNey(floor=-math.log(n_codes))
        lower = None
        for n, (k, c) in enumerate(tables, 1):
            one, two = np.count_nonzero(c == 1), np.count_nonzero(c == 2)
            off = one / (one + 2 * two) if one and two else 0.5
            ctx = k >> _U(CODE_BITS)
            heads, at = np.unique(ctx, return_inverse=True)
            total, kinds = np.bincount(at, weights=c), np.bincount(at)
            back = off * kinds / total
            if lower is None:
                less = np.full(len(k), 1 / n_codes)
            else:
                less = lower[1][np.searchsorted(lower[0], _low(k, n - 1))]
            p = (c - off) / total[at] + back[at] * less
            lower = (k, p)
            for keys_, values, to in ((k, np.log(p), model.grams), (heads, np.log(back), model.contexts)):
                h = mix(keys_ + _U(n))
                order = np.argsort(h)
                to.append((h[order], values[order].astype(np.float32)))
        return model

    def log_p(self, g: np.ndarray) -> np.ndarray:
        out, rest = np.zeros(len(g), np.float32), np.arange(len(g))
        for n in range(ORDER, 0, -1):
            k = _low(g[rest], n)
            hit, value = _find(self.grams[n - 1], mix(k + _U(n)))
            out[rest[hit]] += value[hit]
            rest, k = rest[~hit], k[~hit]
            hit, value = _find(self.contexts[n - 1], mix((k >> _U(CODE_BITS)) + _U(n)))
            out[rest[hit]] += value[hit]
        out[rest] += self.floor
        return out


def _find(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
    return table[0][at] == h, table[1][at]


@dataclass
class LanguageModel:
    languages: list[str]
    alphabet: np.ndarray
    models: list[KneserNey]
    temperature: float = 1.0
    center: np.ndarray | None = None
    spread: np.ndarray | None = None
    limit: np.ndarray | None = None

    @cached_property
    def codes(self) -> np.ndarray:
        """Code of each code point: 0 none, 1 unknown letter."""
        t = np.ones(0x110000, np.uint32)
        t[0] = 0
        t[self.alphabet] = np.arange(2, len(self.alphabet) + 2)
        return t

    @cached_property
    def memory(self) -> tuple[np.ndarray, np.ndarray]:
        """n-grams met and their log p in each language, each at the place that its hash gives; later ones take earlier ones' places."""
        slots = 1 << min(20, max(10, (1 << 23) // max(1, len(self.models)))).bit_length() - 1 if len(self.models) > 8 else 1 << 20
        return np.full(slots, np.iinfo(np.uint64).max, _U), np.zeros((len(self.models), slots), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("codes", "memory")}

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(characters, letters, cross-entropy in nats a character by language) of each text."""
        n, letters, total = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64), np.zeros((len(self.models), len(column)))
        keys, values = self.memory
        for rows, points, ptr in pieces(column):
            sizes = np.diff(ptr)
            n[rows] += sizes
            if not len(points):
                continue
            full = sizes > 0
            begin = ptr[:-1][full]
            letters[rows[full]] += np.add.reduceat((points > 0).astype(np.int64), begin)
            g = grams(self.codes[points], ptr, ORDER)
            slot = (mix(g) & _U(len(keys) - 1)).astype(np.int64)
            miss = np.flatnonzero(keys[slot] != g)
            if len(miss):
                new = np.unique(g[miss])
                at = (mix(new) & _U(len(keys) - 1)).astype(np.int64)
                found = np.stack([m.log_p(new) for m in self.models])
                keys[at] = new
                # of new n-grams for one place the last stays; the others are looked up below
                stays = keys[at] == new
                values[:, at[stays]] = found[:, stays]
            lost = np.flatnonzero(keys[slot] != g)
            for i, m in enumerate(self.models):
                p = values[i, slot]
                if len(lost):
                    at = np.searchsorted(new, g[lost])
                    known = new[np.minimum(at, len(new) - 1)] == g[lost]
                    p[lost[known]] = found[i, at[known]]
                    if not known.all():
                        p[lost[~known]] = m.log_p(g[lost[~known]])
                total[i, rows[full]] += np.add.reduceat(p.astype(np.float64), begin)
        return n, letters, -total / np.maximum(n, 1)

    def decide(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language or -1, score, rejected, entropy) of each text."""
        if not self.models:
            k = len(column)
            return np.full(k, -1), np.zeros(k), np.ones(k, bool), np.zeros(k)
        n, letters, h = self.entropies(column)
        best = h.argmin(0)
        least = h.min(0)
        p = np.exp(-np.clip((h - least) * n / self.temperature, 0, 700)).sum(0)
        away = (least - self.center[best]) * np.sqrt(np.maximum(n, 1)) / self.spread[best]
        none = letters == 0
        return np.where(none, -1, best), np.where(none, 0.0, 1 / p), none | ((away > self.limit[best]) & (least - self.center[best] > EXCESS)), least


def _windows(texts: list[str]) -> list[str]:
    return [t[i : i + WINDOW] for t in texts for i in range(0, len(t), WINDOW)]


def _calibrate(model: LanguageModel, windows: list[list[str]]) -> None:
    """center, spread and limit of each language from windows of its held-back texts."""
    k = len(windows)
    n, letters, h = model.entropies(pa.array([w for own in windows for w in own], pa.large_string()))
    truth = np.repeat(np.arange(k), [len(own) for own in windows])
    right = (letters > 0) & (h.argmin(0) == truth)
    model.center, model.spread, model.limit = np.zeros(k), np.ones(k), np.full(k, np.inf)
    away, some = np.zeros(len(n)), []
    for j in range(k):
        # a language that loses its windows to others counts with all that it has
        mine = right & (truth == j)
        mine = mine if mine.any() else (letters > 0) & (truth == j)
        if mine.any():
            some.append(j)
            model.center[j] = np.average(h[j, mine], weights=n[mine])
            away[mine] = (h[j, mine] - model.center[j]) * np.sqrt(n[mine])
    if not some:
        return
    # without a window of its own a language is taken for the least predictable one
    model.center[[j for j in range(k) if j not in some]] = model.center[some].max()

    def bound(of: np.ndarray) -> tuple[float, float]:
        spread = max(float(np.sqrt(np.mean(away[of] ** 2))), 1e-6)
        # a bound well beyond what the language's own texts show: their quantile, carried on
        return spread, max(8.0, 2 * float(np.quantile(away[of] / spread, 1 - REJECT)))

    # a language's few windows may lack what others' show, such as names and codes: no spread is below that of all
    spread, limit = bound(right if right.any() else letters > 0)
    model.spread[:], model.limit[:] = spread, limit
    for j in range(k):
        mine = right & (truth == j)
        if mine.sum() >= WINDOWS:
            own, model.limit[j] = bound(mine)
            model.spread[j] = max(own, spread)


def fit(texts: list[str], labels: list[str]) -> LanguageModel:
    """The model of labelled texts. Texts without letters teach nothing; a label that only such texts have is never predicted."""
    seen, lettered = [np.zeros(0, np.uint32)], np.zeros(len(texts), bool)
    for rows, p, ptr in pieces(pa.array(texts, pa.large_string())):
        seen.append(p[p > 0])
        lettered[rows] |= np.diff(np.append(0, np.cumsum(p > 0))[ptr]) > 0
    texts, labels = ([x for x, k in zip(of, lettered, strict=True) if k] for of in (texts, labels))
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros(0, np.int64), [])
    seen = np.concatenate(seen)
    found, counts = np.unique(seen, return_counts=True)
    alphabet = np.sort(found[np.argsort(-counts, kind="stable")[: (1 << CODE_BITS) - 2]]).astype(np.int64)
    out, held = LanguageModel(languages, alphabet, []), []
    for name in languages:
        own = [t for t, x in zip(texts, labels, strict=True) if x == name]
        own = own if len(own) > 1 else _windows(own)
        kept = own[::CALIBRATION] if len(own) > 1 else []
        held.append(kept)
        fitted = [t for i, t in enumerate(own) if i % CALIBRATION] if kept else own
        g = np.concatenate([np.zeros(0, _U)] + [grams(out.codes[p], ptr, ORDER) for _, p, ptr in pieces(pa.array(fitted, pa.large_string()))])
        out.models.append(KneserNey.fit(g if len(g) else np.zeros(1, _U), len(alphabet) + 2))
    _calibrate(out, [_windows(kept) for kept in held])
    if not any(held):
        held = [[t for t, x in zip(texts, labels, strict=True) if x == name] for name in languages]
    n, letters, h = out.entropies(pa.array([t for kept in held for t in kept], pa.large_string()))
    truth = np.repeat(np.arange(len(languages)), [len(kept) for kept in held])
    full = letters > 0
    right = [(t, -np.log(np.maximum(1e-12, np.exp(-np.clip((h[truth, np.arange(len(n))] - h.min(0)) * n / t, 0, 700)) / np.exp(-np.clip((h - h.min(0)) * n / t, 0, 700)).sum(0)))[full].mean()) for t in 2.0 ** np.arange(0, 9)] if full.any() else [(1.0, 0)]
    out.temperature = float(min(right, key=lambda x: x[1])[0])
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learned(docs: DataFrame, train_chars: int = TRAIN_CHARS) -> LanguageModel:
    """Learns from labelled rows that are not held out: about train_chars characters of each language, of whole texts picked by
    hash; of a text that is longer than train_chars by itself, no more than that. Languages are as many as there are labels."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.char_length("text")).alias("n")).collect()}
    if not totals:
        return fit([], [])
    share = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, min(1.0, train_chars / max(n, 1)))])
    picked = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    sample = sorted((r["doc_id"], r["lang"], r["text"]) for r in picked.withColumn("text", F.left("text", F.lit(train_chars))).collect())
    return fit([t for _, _, t in sample], [x for _, x, _ in sample])


NAMES = ("lang_pred", "lang_score", "lang_rejected", "lang_entropy")


def identified(docs: DataFrame, model: LanguageModel, columns: list[str] | None = None, names: tuple[str, ...] = NAMES) -> DataFrame:
    """The named columns of docs (all of them) with predicted language, score, whether rejected, and entropy, under `names`.

    A column of docs that has one of these names gives way; other names avoid that."""
    spark = docs.sparkSession
    small_batches(spark)
    columns = [c for c in (docs.columns if columns is None else columns) if c not in names]
    shared = spark.sparkContext.broadcast(model)  # bounded by train_chars and the number of languages
    at = docs.columns.index("text")
    places = [docs.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        languages = np.array([*m.languages, UND], object)
        for b in batches:
            best, score, rejected, entropy = m.decide(b.column(at))
            more = [pa.array(languages[best], pa.string()), pa.array(score, pa.float64()), pa.array(rejected), pa.array(entropy, pa.float64())]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in places], *more], names=[*columns, *names])

    schema = docs.select(*[f"`{c}`" for c in columns]).schema
    for name, kind in zip(names, ("string", "double", "boolean", "double"), strict=True):
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identified(docs.select("doc_id", "text"), learned(docs), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"), F.col("lang_entropy").alias("entropy"))
