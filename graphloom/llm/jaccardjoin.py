"""N-gram Jaccard join in the metric space of shingle sets: exact, with the links of every document.

1. Sites. Jaccard distances between texts that share little are all close to 1, so pivots that are documents would leave
   every document in every region. Sets are therefore brought together first by parts that linked sets must share: shingles
   are dealt by hash to more parts than a linked pair can differ in, so linked sets agree on a whole part that isn't empty.
   A site holds the sets that have one such part alike; sets that meet nobody are done. Large sites that overlap are one.
2. Sketches. A set's sketch is the parity of its shingles in 2 to 4 n cells. Differing cells never outnumber differing
   shingles, so pairs of a site whose sketches differ by more than links allow are dropped. Large sites are cut into rings
   around the empty set (its distance to a set is the set's size; linked sets lie in one ring or in neighbours) and blocks.
   What remains of a site's pairs joins sets to clusters; linked documents never lie in two clusters.
3. Voronoi regions. Every cluster of more than LEAF sets is split by pivots: a set's region is that of its nearest pivot,
   and by the triangle inequality, d(x, q) <= d(x, p) + 2 r, it is also given to each region q where a partner may live.
   Regions are split again until they are leaves, large clusters over many tasks, others within one. Where pivots don't
   part a large region (all distances alike), its sets are handed over as their differences from one pivot, which give the
   same distances between them: a bit for each shingle of the pivot, and the other shingles but those that no second set of
   the region has, of which the number is enough. So near copies are few bytes, and are joined block against block.
4. Leaves are joined exactly: intersection sizes of all their pairs. A pair counts only where its smaller set lives.

Copies are one set throughout and are only counted. Defined results: a text without words, or null, has the empty set and no
link; with fewer words than a shingle its whole sequence is one; repeated rows are copies of one another; a null doc_id is
ignored for the smallest of a component unless there is no other; no rows give no rows; further columns don't matter. Sets
are told apart by 128 bits of hashes, their shingles by 64.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import checked_broadcast, discard, documents, kept, scratch, small_batches, written
from .textvec import SPACE_WORDS, mix, word_batches

WORDS, PERCENT = 5, 80
#: Sites of more sets than this are joined to clusters first, so that overlapping ones aren't compared over and over.
SITE_SETS = 64
#: A ring of at most so many sets and so many bytes of sketches is compared in one task; larger ones are cut into blocks.
RING_SETS, RING_BYTES = 4096, 16 << 20
#: A region of at most so many sets and so many shingles is joined in one task; larger ones are split over tasks.
REGION_SETS, REGION_SHINGLES = 2048, 4_000_000
#: Within a task, regions of more sets than this are split by pivots.
LEAF = 8
PIVOTS = 8
#: Pivots part a region if its children have at most this share of its pairs; else all its pairs are looked at.
PARTED = 0.5
#: A task deals out the parts of a set once, as far as it remembers so many sets: copies meet by their node alone.
REMEMBERED = 500_000
DEALS = 256
#: Tables of pairs of sets, and shingles of a region, are worked on so many numbers at a time.
STEP = 1 << 18

_U = np.uint64
_ONE = mix(np.arange(1, 65, dtype=_U)) | _U(1)


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order of rows."""
    for lo, hi, w, ptr in word_batches(column, SPACE_WORDS):
        n = len(w) - words + 1
        s = np.zeros(max(n, 0), _U)
        for k in range(words):
            if n > 0:
                s += w[k : k + n] * _ONE[k]
        s = mix(s)
        for r in range(hi - lo):
            a, z = ptr[r], ptr[r + 1]
            if z - a >= words:
                yield np.unique(s[a : z - words + 1])
            elif z > a:
                yield mix(np.array([sum(int(x) * int(m) for x, m in zip(w[a:z], _ONE[8:], strict=False)) + int(z - a) & (1 << 64) - 1], _U))
            else:
                yield s[:0]


class Parts:
    """How sets of each size are dealt to parts, so that linked sets share one."""

    def __init__(self, percent: int):
        self.percent, self.lows, self.table = percent, [1], []
        while self.lows[-1] < 1 << 40:
            self.lows.append(100 * self.lows[-1] // percent + 1)
        for low, after in zip(self.lows, self.lows[1:], strict=False):
            most = after - 1
            differ = (100 - percent) * (most + 100 * most // percent) // (100 + percent)
            spare = 0
            if differ:  # parts that may be empty in both: so many that few sets need a second deal
                while spare < low and self._empty(differ + 1 + spare, low) >= 1 + spare:
                    spare = max(spare + 1, int(self._empty(differ + 1 + spare, low)))
                if spare >= low:  # short texts: no number is enough for most, take the best
                    spare = min(range(65), key=lambda e: self._empty(differ + 1 + e, low) - e)
            self.table.append((differ, differ + 1 + spare))

    @staticmethod
    def _empty(parts: int, size: int) -> float:
        """How many parts are empty, with two standard errors."""
        m = parts * np.exp(-size / parts)
        return m + 2 * np.sqrt(m)

    def of(self, s: np.ndarray) -> np.ndarray:
        """Signatures of the parts that aren't empty, for pairs with sets of the same class, the next and the one before."""
        if not len(s):
            return s
        own = int(np.searchsorted(self.lows, len(s), "right")) - 1
        out = []
        for c in (own, own - 1):
            if c < 0 or not self.table[c][0]:
                continue  # linked sets would be equal
            differ, k = self.table[c]
            for deal in range(DEALS):
                seed = mix(np.array([c * DEALS + deal + 1], _U))
                h = mix(s ^ seed)
                part = (h >> _U(24)) % _U(k)
                order = np.argsort(part, kind="stable")
                part, h = part[order], h[order]
                first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                out.append(mix(np.add.reduceat(mix(h), first) + mix(part[first] + seed)))
                if len(first) > differ:  # of two linked sets, the first to get here shares a part of this deal with the other
                    break
            else:  # neither may ever get here: then they meet by a shingle
                out.append(mix(s + mix(np.array([~c & (1 << 64) - 1], _U))))
        return np.concatenate(out) if out else s[:0]


@dataclass
class Names:
    """Numbers that stand for sets: hashes, and other numbers for the few sets whose hash another set has, too.

    other: (hash, second hash) -> number; it is filled with the sets that were found to share a hash."""

    bits: int = 64
    other: dict[tuple[int, int], int] = field(default_factory=dict)

    def of(self, s: np.ndarray) -> int:
        total = mix(np.array([int(np.add.reduce(mix(s + _U(0x5BD1E995)))) + len(s) & (1 << 64) - 1], _U))
        node = int((total >> _U(64 - self.bits)).astype(np.int64)[0])
        return self.other.get((node, self.second(s)), node) if self.other else node

    @staticmethod
    def second(s: np.ndarray) -> int:
        return int(mix(np.array([int(np.add.reduce(mix(s ^ _U(0x9FB21C651E98DF25)))) & (1 << 64) - 1], _U)).astype(np.int64)[0])

    def renamed(self, node: int, second: int) -> int:
        return int(mix(np.array([node * 0x9E3779B97F4A7C15 + second & (1 << 64) - 1], _U)).astype(np.int64)[0])


def _sketch(s: np.ndarray) -> bytes:
    """The parity of the set's shingles in each of its cells; the number of cells is a power of two."""
    cells = 1 << max(6, int(2 * len(s) - 1).bit_length())
    odd = np.bincount((mix(s + _U(0x2545F4914F6CDD1D)) & _U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def with_nodes(docs: DataFrame, words: int, percent: int, names: Names) -> DataFrame:
    """docs with, instead of text: node (stands for the set), second (a second hash), n (its size), ring (of sizes) and sketch."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = Parts(percent).lows
        for b in batches:
            found = [(names.of(s), names.second(s), len(s), int(np.searchsorted(lows, len(s), "right")), _sketch(s) if len(s) else b"") for s in shingle_sets(b.column("text"), words)]
            node, second, n, ring, sketch = ([f[k] for f in found] for k in range(5))
            new = [pa.array(node, pa.int64()), pa.array(second, pa.int64()), pa.array(n, pa.int64()), pa.array(ring, pa.int32()), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], *new], names=[*rest, "node", "second", "n", "ring", "sketch"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, own + ", node long, second long, n long, ring int, sketch binary")


def with_parts(docs: DataFrame, words: int, percent: int, site_sets: int, names: Names) -> DataFrame:
    """(node, part, sets) of the texts with words: the signatures of their sets' parts, most copies left out; sets is 1.

    Where more than site_sets sets of a batch share a part, one has it for all (their number is sets) and each of the others
    shares one with that one, which counts as large, too: so hot parts are few rows a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, seen = Parts(percent), set()
        for b in batches:
            nodes, dealt = [], []
            for s in shingle_sets(b.column(0), words):
                if len(s) and (node := names.of(s)) not in seen:
                    seen.add(node)
                    nodes.append(node)
                    dealt.append(parts.of(s))
            if len(seen) > REMEMBERED:
                seen.clear()
            node = np.repeat(np.array(nodes, np.int64), [len(d) for d in dealt])
            part = np.concatenate([np.zeros(0, _U), *dealt])
            sets = np.ones(len(part), np.int32)
            _, at, of, many = np.unique(part, return_index=True, return_inverse=True, return_counts=True)
            if (many > site_sets).any():
                hot = many[of] > site_sets
                first = at[of] == np.arange(len(part))
                other = hot & ~first
                pairs = np.unique(np.column_stack([node[at[of[other]]], node[other]]), axis=0)
                pairs = pairs[pairs[:, 0] != pairs[:, 1]]
                met = mix(mix(pairs[:, 0].astype(_U)) ^ pairs[:, 1].astype(_U))
                sets[hot] = many[of[hot]]
                node = np.concatenate([node[~other], pairs[:, 0], pairs[:, 1]])
                part = np.concatenate([part[~other], met, met])
                sets = np.concatenate([sets[~other], np.full(2 * len(pairs), site_sets + 1, np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(part.astype(np.int64)), pa.array(sets)], names=["node", "part", "sets"])

    return docs.select("text").mapInArrow(run, "node long, part long, sets int")


def _fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch in fewer cells: size bytes."""
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _least_met(met: np.ndarray) -> np.ndarray:
    """For each row of a symmetric table of meetings the least row that it is joined to, over any number of meetings."""
    n = len(met)
    label = np.arange(n, dtype=np.int32)
    step = max(1, STEP // max(n, 1))
    while True:
        least = label.copy()
        for a in range(0, n, step):
            np.minimum(least[a : a + step], np.where(met[a : a + step], label[None, :], np.int32(n)).min(1, initial=n), out=least[a : a + step])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _close(n: list[int], sketches: list[bytes], percent: int) -> np.ndarray:
    """For each set of a site the least set that it may be linked to over sets of the site, by their sketches."""
    k, size = len(n), min(map(len, sketches))
    sketch = np.stack([_fold(np.frombuffer(x, np.uint8), size) for x in sketches]).view(_U)
    sizes = np.array(n)
    met = np.zeros((k, k), bool)
    step = max(1, STEP // (k * sketch.shape[1]))
    for a in range(0, k, step):
        differ = np.bitwise_count(sketch[a : a + step, None, :] ^ sketch[None, :, :]).sum(2, dtype=np.int64)
        met[a : a + step] = differ * (100 + percent) <= (100 - percent) * (sizes[a : a + step, None] + sizes[None, :])
    return _least_met(met)


def close_sets(sites: DataFrame, percent: int) -> DataFrame:
    """(a, b): sets of sites (region, node, n, sketch) that may be linked, each with one set of its site it is joined to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined_sets(region: list[tuple]) -> list[tuple]:
            region = sorted({r[1]: r for r in region}.values(), key=lambda r: r[1])
            if len(region) < 2:
                return []
            label = _close([r[2] for r in region], [r[3] for r in region], percent)
            return [(region[i][1], region[j][1]) for j, i in enumerate(label.tolist()) if i != j]

        now: list[tuple] = []
        for b in batches:
            out = []
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if now and now[0][0] != r[0]:
                    out += joined_sets(now)
                    now = []
                now.append(r)
            yield _edges(out)
        yield _edges(joined_sets(now))

    def _edges(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])

    rows = sites.select("region", "node", "n", "sketch").repartition("region").sortWithinPartitions("region")
    return rows.mapInArrow(run, "a long, b long")


def sites_of(docs: DataFrame, words: int, percent: int, site_sets: int, names: Names) -> tuple[DataFrame, DataFrame]:
    """(region, node): the sites with several sets, each list of sets once; and the large ones, as clusters where they overlap.

    Copies in several tasks give a part the same node several times: a list's name is of sums (of 32 bits each, so none overflows),
    in which, unlike in an exclusive or, no even number of copies cancels out; and copies of one set alone are no site."""
    deal = with_parts(docs, words, percent, site_sets, names).withColumn("hash", F.xxhash64("node"))
    over = "over (partition by part)"
    sums = (f"sum(hash & 4294967295) {over} AS x", f"sum(shiftrightunsigned(hash, 32)) {over} AS y")
    met = deal.selectExpr("node", f"sum(sets) {over} AS sets", f"min(node) {over} AS low", f"max(node) {over} AS high", *sums).where("low <> high")
    small = F.col("sets") <= site_sets
    sites = written(met.select("node", F.when(small, F.xxhash64("x", "y")).alias("region"), F.when(~small, F.col("low")).alias("low")).distinct(), "sites")
    large = components(sites.where("low IS NOT NULL").select(F.col("low").alias("a"), F.col("node").alias("b")))
    return sites.where("region IS NOT NULL").select("region", "node"), large.select(F.col("component").alias("region"), "node")


def clusters(docs: DataFrame, nodes: DataFrame, words: int, percent: int, names: Names, site_sets: int = SITE_SETS, ring_sets: int = RING_SETS) -> DataFrame:
    """(node, component): linked sets are in one cluster; sets that can't have links have none."""
    small, large = sites_of(docs, words, percent, site_sets, names)
    about = nodes.select("node", "n", "ring", "sketch")
    rings = large.join(about, "node").select(F.explode(F.array("ring", F.col("ring") - 1)).alias("ring"), "region", "node", "n", "sketch")
    rings = written(rings.select(F.xxhash64("region", "ring").alias("region"), "node", "n", "sketch"), "rings")
    blocks = F.greatest(F.ceil(2 * F.count("node") / ring_sets), F.ceil(2 * F.sum(F.length("sketch")) / RING_BYTES))
    sizes = written(rings.groupBy("region").agg(F.count("node").alias("sets"), F.sum(F.length("sketch")).alias("bytes"), blocks.alias("n_blocks")), "ring_sizes")
    too = (F.col("sets") > ring_sets) | (F.col("bytes") > RING_BYTES)
    whole = rings.join(sizes.where(~too).select("region"), "region")
    cut = _in_blocks(rings, sizes.where(too).select("region", "n_blocks"))
    columns = ["region", "node", "n", "sketch"]
    sites = small.join(about, "node").select(*columns).unionByName(whole.select(*columns)).unionByName(cut.select(*columns))
    return components(close_sets(sites, percent))


def _in_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows of regions (region, n_blocks) as pairs of blocks: region is that of the pair; side 0 and 1 are different blocks, -1 is one with itself."""
    rows = rows.join(blocks, "region").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), (F.col("n_blocks") - 1).cast("int")), lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j")))
    rows = rows.withColumn("pair", F.explode(others))
    side = F.when(F.col("pair.i") == F.col("pair.j"), -1).when(F.col("block") == F.col("pair.i"), 0).otherwise(1)
    return rows.withColumn("side", side.cast("int")).withColumn("region", F.xxhash64("region", "pair.i", "pair.j")).drop("block", "pair", "n_blocks")


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int, names: Names) -> DataFrame:
    """The wanted nodes as rows of regions, from the text of one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column(1).to_pylist()
            keep, sets = [], []
            for i, s in enumerate(shingle_sets(b.column(3), words)):
                if names.of(s) == node[i]:
                    keep.append(i)
                    sets.append(s.tobytes())
            t = b.take(pa.array(keep, pa.int64()))
            n = pa.array([len(s) // 8 for s in sets], pa.int64())
            no, none = pa.array([-1] * len(keep), pa.int32()), pa.array([0] * len(keep), pa.int32())
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), t.column(2), pa.array([True] * len(keep), pa.bool_()), no, n, n, none, pa.array(sets, pa.binary())], names=REGION_COLUMNS)

    d = docs.select(F.col("doc_id").cast("long").alias("own_id"), "text")
    rows = d.join(wanted, F.col("doc_id").eqNullSafe(F.col("own_id"))).select("region", "node", "copies", "text")
    return rows.mapInArrow(run, REGION)


#: A set in a region: home says whether the region is its own, n is its size, shingles are its shingles. In blocks, size is that
#: of its difference from a pivot of `bits` shingles; shingles are the pivot's that it lacks, as bits, and its further ones.
REGION_ARROW = pa.schema(
    [("region", pa.int64()), ("node", pa.int64()), ("copies", pa.int64()), ("home", pa.bool_()), ("side", pa.int32()), ("n", pa.int64()), ("size", pa.int64()), ("bits", pa.int32()), ("shingles", pa.binary())]
)
REGION = "region long, node long, copies long, home boolean, side int, n long, size long, bits int, shingles binary"
REGION_COLUMNS = REGION_ARROW.names
CHILD_ARROW = pa.schema([("region", pa.int64()), ("child", pa.int64()), ("node", pa.int64())])


def _windows(d: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """From distances of sets (rows) to pivots: each set's nearest pivot, and the pivots in whose regions it may have partners."""
    near = d.argmin(1)
    return near, d <= d.min(1)[:, None] + 2 * (100 - percent) / 100 + 1e-9


def _to_pivots(regions: DataFrame, percent: int, sets: bool) -> DataFrame:
    """Each set of regions for its nearest pivot's region and for those where a partner may be at home: as REGION with its
    shingles, or (sets=False) only as (region, child, node)."""
    pivots = regions.groupBy("region", F.pmod("node", F.lit(PIVOTS)).alias("slot")).agg(F.min_by("shingles", "node").alias("pivot"))
    rows = regions.join(pivots.groupBy("region").agg(F.collect_list("pivot").alias("pivots")), "region")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for region, node, copies, home, side, n, size, bits, shingles, found in zip(*[c.to_pylist() for c in b.columns], strict=True):
                s = np.frombuffer(shingles, _U)
                shared = np.array([len(np.intersect1d(s, np.frombuffer(p, _U), assume_unique=True)) for p in found])
                d = 1 - shared / (n + np.array([len(p) // 8 for p in found]) - shared)
                near, may = _windows(d[None, :], percent)
                for q in np.flatnonzero(may[0]).tolist():
                    to = int(mix(np.array([(region * 31 + q * 0x9E3779B97F4A7C15 + 7) & (1 << 64) - 1], _U)).astype(np.int64)[0])
                    out.append((to, node, copies, home and q == near[0], side, n, size, bits, shingles) if sets else (region, to, node))
            schema = REGION_ARROW if sets else CHILD_ARROW
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    return rows.select(*REGION_COLUMNS, "pivots").mapInArrow(run, REGION if sets else "region long, child long, node long")


def _from_pivot(regions: DataFrame) -> DataFrame:
    """Sets as their differences from the region's least set, without the shingles that one set of the region alone has:
    differences of differences are those of the sets."""
    pivots = regions.groupBy("region").agg(F.min_by("shingles", "node").alias("pivot"))
    kept = REGION_COLUMNS[:6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, bits, lacks, more = [], [], [], []
            for s, p in zip(b.column("shingles").to_pylist(), b.column("pivot").to_pylist(), strict=True):
                s, p = np.frombuffer(s, _U), np.frombuffer(p, _U)
                missing = ~np.isin(p, s, assume_unique=True)
                further = np.setdiff1d(s, p, assume_unique=True)
                size.append(int(missing.sum()) + len(further))
                bits.append(len(p))
                lacks.append(np.packbits(missing).tobytes())
                more.append(further.astype(np.int64).tolist())
            new = [pa.array(size, pa.int64()), pa.array(bits, pa.int32()), pa.array(lacks, pa.binary()), pa.array(more, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *new], names=[*kept, "size", "bits", "lacks", "more"])

    types = REGION.split(", ")[:6]
    found = regions.join(pivots, "region").select(*REGION_COLUMNS, "pivot").mapInArrow(run, ", ".join(types) + ", size long, bits int, lacks binary, more array<long>")
    found = written(found, "differences")
    each = found.select("region", "node", F.explode("more").alias("shingle"))
    shared = written(each.groupBy("region", "shingle").agg(F.countDistinct("node").alias("sets")).where("sets > 1").select("region", "shingle"), "shared")
    of = each.join(shared, ["region", "shingle"]).groupBy("region", "node").agg(F.collect_set("shingle").alias("shared"))
    both = found.drop("more").join(of, ["region", "node"], "left").select(*kept, "size", "bits", "lacks", F.coalesce("shared", F.array().cast("array<long>")).alias("shared"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x + np.array(more, np.int64).tobytes() for x, more in zip(b.column("lacks").to_pylist(), b.column("shared").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in REGION_COLUMNS[:-1]], pa.array(raw, pa.binary())], names=REGION_COLUMNS)

    return both.mapInArrow(packed, REGION)


def _sets_in(table: pa.Table, pick: np.ndarray) -> list[np.ndarray]:
    """The shingles of the picked rows; in blocks, those that their difference holds, with the pivot's by their places.

    Where a difference has no places, they are read where they lie in the table."""
    bits, out, starts, chunks = table["bits"].to_numpy(), [], [0], []
    for c in table["shingles"].chunks:
        at = np.frombuffer(c.buffers()[1], np.int64 if pa.types.is_large_binary(c.type) else np.int32)[c.offset : c.offset + len(c) + 1]
        chunks.append((at, c.buffers()[2]))
        starts.append(starts[-1] + len(c))
    for i in pick.tolist():
        k = bisect_right(starts, i) - 1
        at, data = chunks[k]
        a, z = at[i - starts[k] : i - starts[k] + 2].tolist()
        whole = (int(bits[i]) + 7) // 8
        if data is None or a == z:
            out.append(np.zeros(0, _U))
            continue
        raw = np.frombuffer(data, np.uint8)
        further = raw[a + whole : z]
        further = further.view(_U) if (a + whole) % 8 == 0 else further.copy().view(_U)
        places = np.flatnonzero(np.unpackbits(raw[a : a + whole], count=int(bits[i]))) if whole else []
        out.append(np.concatenate([np.asarray(places, _U), further]) if whole else further)
    return out


def _sizes(regions: DataFrame) -> DataFrame:
    return regions.groupBy("region").agg(F.countDistinct("node").alias("sets"), F.sum(F.length("shingles") / 8).alias("shingle_count"))


class Region:
    """The sets of a region by numbers of shingles: sets at[i] to at[i + 1] of columns."""

    def __init__(self, n: np.ndarray, shingles: list[np.ndarray], percent: int, size: np.ndarray | None = None):
        self.n, self.percent, self.splits = n, percent, 0
        self.size = n if size is None else size
        self.at = np.append(0, np.cumsum([len(s) for s in shingles]))
        distinct = np.concatenate(shingles)
        distinct.sort()
        distinct = distinct[np.append(True, distinct[1:] != distinct[:-1])[: len(distinct)]]
        self.width = len(distinct)
        self.columns = np.empty(self.at[-1], np.int32)
        for s, a in zip(shingles, self.at.tolist(), strict=False):
            self.columns[a : a + len(s)] = np.searchsorted(distinct, s)

    def of(self, i: int) -> np.ndarray:
        return self.columns[self.at[i] : self.at[i + 1]]

    def leaves(self, rows: np.ndarray, home: np.ndarray, leaf: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The sets (and which are at home) of the regions that pivots part rows into, recursively."""
        if len(rows) > leaf:
            sets = [self.of(i) for i in rows]
            starts = np.cumsum([0, *[len(s) for s in sets]])
            columns, mark = np.concatenate(sets), np.zeros(self.width, bool)
            before = np.zeros(len(columns) + 1, np.int32)
            d: list[np.ndarray] = []
            pivot = 0
            while len(d) < PIVOTS and (not d or np.min(d, axis=0)[pivot] > 0):  # the next pivot is the set farthest from all
                mark[sets[pivot]] = True
                np.cumsum(mark[columns], out=before[1:])
                shared = np.diff(before[starts])
                mark[sets[pivot]] = False
                d.append(1 - shared / (self.n[rows] + self.n[rows[pivot]] - shared))
                pivot = int(np.argmax(np.min(d, axis=0)))
            near, may = _windows(np.column_stack(d), self.percent)
            del sets, columns, mark, before  # its children have their own
            self.splits += 1
            if (may.sum(0).astype(float) ** 2).sum() <= PARTED * len(rows) ** 2:
                for q in range(len(d)):
                    yield from self.leaves(rows[may[:, q]], home[may[:, q]] & (near[may[:, q]] == q), leaf)
                return
        yield rows, home

    def common(self, rows: np.ndarray) -> np.ndarray:
        """How many shingles each two of the rows share."""
        sets = [self.of(i) for i in rows]
        ends = np.cumsum([0, *[len(s) for s in sets]])
        keys = np.empty(ends[-1], np.int64)  # a column's rows lie together, in one array that is sorted in its place
        for i, s in enumerate(sets):
            keys[ends[i] : ends[i + 1]] = (s.astype(np.int64) << 32) | i
        keys.sort()
        common = np.zeros((len(rows), len(rows)), np.float32)
        width = max(64, min(4096, 8 * STEP // max(len(rows), 1)))
        a = 0
        while a < len(keys):
            z = a + STEP
            z = int(np.searchsorted(keys, (keys[z - 1] >> 32) + 1 << 32)) if z < len(keys) else len(keys)  # whole columns
            column, row = keys[a:z] >> 32, keys[a:z] & 0xFFFFFFFF
            number = np.cumsum(np.append(False, column[1:] != column[:-1]))
            often = np.bincount(number)
            shared = often[number] > 1
            column, row = (np.cumsum(often > 1) - 1)[number[shared]], row[shared]
            for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
                i, j = np.searchsorted(column, [c, c + width])
                present, local = np.unique(row[i:j], return_inverse=True)
                dense = np.zeros((len(present), width), np.float32)
                dense[local, column[i:j] - c] = 1
                if len(present) == len(rows):
                    common += dense @ dense.T
                else:
                    common[np.ix_(present, present)] += dense @ dense.T
            a = z
        return common

    def linked(self, rows: np.ndarray) -> np.ndarray:
        """Whether each two of the rows are alike enough, each of them with itself too."""
        common, size, n = self.common(rows), self.size[rows], self.n[rows]
        linked = np.empty(common.shape, bool)
        step = max(1, STEP // max(len(rows), 1))
        for a in range(0, len(rows), step):
            few = slice(a, a + step)
            differ = size[few, None] + size[None, :] - 2 * common[few].astype(np.int64)
            linked[few] = differ * (100 + self.percent) <= (100 - self.percent) * (n[few, None] + n[None, :])
        return linked


def joined_region(table: pa.Table, percent: int, leaf: int = LEAF) -> pa.Table:
    """(node, peer, links): the least set that each is linked to, over links within the region, and the documents linked to it."""
    node, pick = np.unique(table["node"].to_numpy(), return_index=True)
    copies, home, side, n, size = (table[c].to_numpy()[pick] for c in ("copies", "home", "side", "n", "size"))
    region = Region(n, _sets_in(table, pick), percent, size)
    found = []
    blocks = (side >= 0).any()
    every = np.arange(len(node))
    for rows, own in [(every, home)] if blocks else region.leaves(every, home, leaf):
        linked = region.linked(rows)
        np.fill_diagonal(linked, False)
        if blocks:
            linked &= side[:, None] != side[None, :]
        linked &= np.where(rows[:, None] < rows[None, :], own[:, None], own[None, :])  # rows are in the order of nodes
        found.append((node[rows], node[rows[_least_met(linked)]], linked @ copies[rows]))
    return pa.table({c: np.concatenate([f[k] for f in found]).astype(np.int64) for k, c in enumerate(("node", "peer", "links"))})


def linked_sets(regions: DataFrame, percent: int, region_sets: int = REGION_SETS, region_shingles: int = REGION_SHINGLES, leaf: int = LEAF) -> DataFrame:
    """(node, peer, links) of all regions, of any size."""
    small = []
    sizes = written(_sizes(regions), "sizes")
    too = ((F.col("sets") > region_sets) | (F.col("shingle_count") > region_shingles)) & (F.col("sets") > 1)
    while True:
        large = sizes.where(too)
        if not large.limit(1).count():
            small.append(regions)
            break
        small.append(regions.join(large.select("region"), "region", "left_anti").select(*REGION_COLUMNS))
        rest = regions.join(large.select("region"), "region").select(*REGION_COLUMNS)
        children = _to_pivots(rest, percent, sets=False).groupBy("region", "child").agg(F.countDistinct("node").cast("double").alias("n"))
        pairs = children.groupBy("region").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
        tried = written(large.join(pairs, "region").withColumn("parted", F.col("pairs") <= F.col("sets") * F.col("sets") * PARTED), "tried")
        # regions that pivots would only copy are joined block against block
        whole = tried.where("NOT parted").select("region")
        if whole.limit(1).count():
            alike = written(_from_pivot(rest.join(whole, "region").select(*REGION_COLUMNS)), "alike")
            held = alike.groupBy("region").agg(F.countDistinct("node").alias("sets"), F.sum("size").alias("shingle_count"))
            blocks = F.greatest(F.ceil(2 * F.col("sets") / region_sets), F.ceil(2 * F.col("shingle_count") / region_shingles), F.lit(2))
            small.append(_in_blocks(alike, written(held.select("region", blocks.alias("n_blocks")), "blocks")).select(*REGION_COLUMNS))
        parted = tried.where("parted").select("region")
        if not parted.limit(1).count():
            break
        regions = written(_to_pivots(rest.join(parted, "region").select(*REGION_COLUMNS), percent, sets=True), "regions")
        sizes = written(_sizes(regions), "sizes")
    out = small[0]
    for more in small[1:]:
        out = out.unionByName(more)
    return out.groupBy("region").applyInArrow(lambda t: joined_region(t, percent, leaf), "node long, peer long, links long")


def joined(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    site_sets: int = SITE_SETS,
    ring_sets: int = RING_SETS,
    region_sets: int = REGION_SETS,
    region_shingles: int = REGION_SHINGLES,
    leaf: int = LEAF,
    key: str | None = None,
    node_bits: int = 64,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, component) for every row of docs, with key, if it names a column of docs;
    component is a name of the component, null for the empty set."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.col(f"`{key}`").alias("key")] if key else []))
    names = Names(node_bits)
    while True:
        # sets are computed anew in each pass over the texts: that costs less than to keep them
        sets = written(with_nodes(docs, words, percent, names), "sets")
        about = [F.any_value(c).alias(c) for c in ("n", "ring", "sketch")]
        nodes = written(sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), *about, (F.min("second") != F.max("second")).alias("shared")), "nodes")
        # different sets with one hash get other names: of 64-bit hashes a handful among 10^10 sets
        shared = sets.join(nodes.where("shared").select("node"), "node", "left_semi").select("node", "second").distinct().collect()
        if not shared:
            break
        names.other.update({(r["node"], r["second"]): names.renamed(r["node"], r["second"]) for r in shared})
        discard(sets, nodes)
    with scratch(docs.sparkSession):
        met = clusters(docs, nodes, words, percent, names, site_sets, ring_sets)
        wanted = written(nodes.join(met, "node").select(F.col("component").alias("region"), "node", "copies", "doc_id"), "wanted")
        regions = written(_sets_of(docs, checked_broadcast(wanted, 48), words, names), "regions")
        links = kept(written(linked_sets(regions, percent, region_sets, region_shingles, leaf), "links"))
    label = components(links.select(F.col("peer").alias("a"), F.col("node").alias("b")))
    count = links.groupBy("node").agg(F.sum("links").alias("links"))
    of = nodes.select("node", "doc_id", "copies").join(label, "node", "left").join(count, "node", "left")
    named = of.select("node", "doc_id", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_node = named.join(least, "component").select("node", "component", "component_id", "n_links")
    empty = F.col("n") == 0
    return sets.drop("sketch", "ring", "second").join(by_node, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(empty, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        "component",
        *([F.col("key").alias(key)] if key else []),
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joined(documents(spark, sf_dir).select("doc_id", "text"), words=4, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "n_links")
