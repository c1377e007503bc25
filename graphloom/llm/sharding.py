"""Sharding by extendible hashing, DataFrame functions only.

A row's hash is 60 bits. The directory is a trie over hash prefixes: the root holds everything, and only a bucket over the
byte limit splits on one more bit. It is built from sums over fine cells, a few for each shard, so its size follows the
number of shards, not of rows; rows then meet their bucket in one join on their cell.

Defined results: null and empty texts have 0 bytes; rows with equal doc_id and text have one hash, and where their bucket is
still too large at 60 bits they go to numbered overflow pages; a row over the limit by itself is alone on a page and the only
case beyond the limit; no rows give no rows; further columns don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, written

BITS = 60
LIMIT = 1 << 20
#: Parts in which the rows of one hash are summed.
SALTS = 256
#: Further bits of the cells beyond those that even shards would need, and the bits by which cells that are too large go on.
FINE, STEP = 3, 8


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_bytes)"""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce("text", F.lit("")))))
    return docs.select("doc_id", F.conv(F.substring(key, 1, BITS // 4), 16, 10).cast("long").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))


def _leaves(cells: DataFrame, bits: int, top: int, limit: int) -> DataFrame:
    """For each cell of `bits` bits its bucket: the shortest prefix, of `top` bits at least, whose bytes fit; null depth: none does."""
    steps = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(top), F.lit(bits))).alias("depth"))
    prefix = F.expr(f"shiftright(cell, {bits} - depth)")
    sums = steps.groupBy("depth", prefix.alias("prefix")).agg(F.sum("bytes").alias("shard_bytes")).where((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS))
    found = steps.select("cell", "depth", prefix.alias("prefix")).join(sums, ["depth", "prefix"])
    first = F.min_by(F.struct("depth", "prefix", "shard_bytes"), "depth")
    return cells.select("cell").join(found.groupBy("cell").agg(first.alias("leaf")), "cell", "left").select("cell", "leaf.*")


def shards(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """rows (doc_id, h, n_bytes) with shard_depth, shard_prefix, shard_page and the bytes of the bucket."""
    total = rows.agg(F.sum("n_bytes").alias("b")).first()["b"] or 0
    bits, top, done, rest = min(BITS, max(1, math.ceil(math.log2(max(total, 1) / limit + 1)) + FINE)), 0, [], rows
    while True:
        cell = F.shiftright(F.col("h"), BITS - bits)
        cells = rest.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("bytes"))
        directory = written(_leaves(cells, bits, top, limit), "directory")
        met = rest.withColumn("cell", cell).join(directory, "cell").drop("cell")
        done.append(met.where(F.col("depth").isNotNull()))
        if bits == BITS or not directory.where(F.col("depth").isNull()).limit(1).count():
            break
        rest, top, bits = met.where(F.col("depth").isNull()).select(*rows.columns), bits + 1, min(BITS, bits + STEP)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    fits = out.where(F.col("shard_bytes") <= limit).withColumn("shard_page", F.lit(0).cast("long"))
    over = out.where(F.col("shard_bytes") > limit)
    # only rows of one hash are left: those that cross no multiple of the limit fill page 2k, those that do have page 2k+1;
    # their running bytes are summed in two steps, as one hash may have any number of rows
    over = written(over.withColumn("salt", F.floor(F.rand(7) * SALTS)), "overflow")
    w = Window.partitionBy("h", "salt").orderBy("n_bytes").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("h").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = over.groupBy("h", "salt").agg(F.sum("n_bytes").alias("b")).select("h", "salt", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("before"))
    over = over.join(before, ["h", "salt"]).withColumn("upto", F.col("before") + F.sum("n_bytes").over(w)).drop("before", "salt")
    first, last = F.floor((F.col("upto") - F.col("n_bytes")) / limit), F.floor((F.greatest("upto", F.lit(1)) - 1) / limit)
    over = over.withColumn("shard_page", F.when(first >= last, 2 * first).otherwise(2 * last - 1).cast("long")).drop("upto")
    return fits.unionByName(over).withColumnsRenamed({"depth": "shard_depth", "prefix": "shard_prefix"})


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(hashed(documents(spark, sf_dir)), "hashed")
    return shards(rows).select("doc_id", "n_bytes", F.col("shard_depth").cast("int").alias("shard_depth"), "shard_prefix", "shard_page", "shard_bytes")


OP5_SQL = f"""
WITH r AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents
), d AS (
  SELECT r.*, depth, h >> (60 - depth) AS prefix FROM r, (SELECT unnest(range(0, 61))::INTEGER AS depth)
), s AS (
  SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes FROM d GROUP BY ALL
), f AS (
  SELECT d.doc_id, d.n_bytes, d.depth, d.prefix, s.shard_bytes, row_number() OVER (PARTITION BY d.doc_id ORDER BY d.depth) AS k
  FROM d JOIN s ON d.depth = s.depth AND d.prefix = s.prefix WHERE s.shard_bytes <= {LIMIT} OR d.depth = 60
)
SELECT doc_id, n_bytes, depth AS shard_depth, prefix AS shard_prefix, 0::BIGINT AS shard_page, shard_bytes FROM f WHERE k = 1
"""
