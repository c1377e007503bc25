"""Mixing sources to target weights by Pfair scheduling, DataFrame functions only.

Each source is cut into blocks of equal length. With quanta q of Q in all, a source's k-th block (from 0) is released in slot
floor(k Q / q) and due before slot ceil((k + 1) Q / q); the earliest deadline among the released blocks takes each slot.
Windows repeat after Q slots, so one period of Q slots is scheduled, in one row, and every block finds its slot by its
number: nothing is sequential over the data. In every prefix a source that still has blocks is less than one block from
its share. A source that has run out leaves its slots empty; every document is kept, once.

Target weights are the sources' shares of characters to the power TEMPER, made even, as whole quanta of at least one; or
those given; a source with a given weight of 0, or none, has one quantum, as every document is kept. Defined results: a null source is a source of its own, null and empty texts have length 0, equal rows follow one
another, no rows give no rows, further columns are kept whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, partitions, written

BLOCK_CHARS = 1 << 15
QUANTA = 1000
TEMPER = 0.5
NO_SOURCE = "(none)"
#: Characters that a bucket of a source may hold before buckets are made finer; a bucket's lengths are summed in one task.
BUCKET_CHARS = 1 << 28
DIGITS = 3


def quanta_of(totals: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(source_key, q) from (source_key, chars)."""
    if weights is None:
        share = F.pow(F.greatest("chars", F.lit(1)).cast("double"), F.lit(TEMPER))
    else:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map()
        share = F.coalesce(F.try_element_at(table, F.col("source_key")).cast("double"), F.lit(0.0))
    shared = totals.withColumn("share", share)
    total = shared.agg(F.sum("share").alias("all"))
    return shared.join(F.broadcast(total)).select("source_key", F.greatest(F.lit(1), F.round(F.col("share") * QUANTA / F.greatest("all", F.lit(1e-300)))).cast("long").alias("q"))


def period(quanta: DataFrame) -> DataFrame:
    """(source_key, q, quanta, j, slot): the slot of each source's j-th block in one period of `quanta` slots, by earliest deadline first."""
    one = quanta.agg(F.sort_array(F.collect_list(F.struct("source_key", "q"))).alias("s"), F.sum("q").alias("quanta")).where("quanta > 0")
    fold = """
    aggregate(
      sequence(0L, quanta - 1),
      named_struct('k', transform(s, x -> 0L), 'out', cast(array() as array<bigint>)),
      (acc, t) -> aggregate(
        array(array_min(filter(
          transform(s, (x, i) -> if(acc.k[i] < x.q and acc.k[i] * quanta div x.q <= t,
            named_struct('due', ((acc.k[i] + 1) * quanta + x.q - 1) div x.q, 'i', cast(i as bigint)), null)),
          x -> x is not null)).i),
        acc,
        (a, pick) -> named_struct('k', transform(a.k, (n, i) -> if(i = pick, n + 1, n)), 'out', concat(a.out, array(pick)))
      )).out
    """
    slots = one.select("quanta", "s", F.posexplode(F.expr(fold)).alias("slot", "i")).select("quanta", F.expr("s[int(i)]").alias("x"), "slot")
    j = F.row_number().over(Window.partitionBy("x.source_key").orderBy("slot")) - 1
    return slots.select("x.source_key", "x.q", "quanta", j.cast("long").alias("j"), F.col("slot").cast("long").alias("slot"))


def _order(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """docs as a struct column d, with source_key, ord, start, block, release, deadline and slot."""
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.coalesce("source", F.lit(NO_SOURCE)).alias("source_key"), _order(F.col("doc_id")).alias("ord"), n.alias("n"))
    # a source's running length in two steps: over its buckets by the order's first digits, then within each, so that no
    # source meets in one task; there are as many buckets as their sizes need
    for digits in range(DIGITS, DIGITS + 4):
        bucket = F.substring("ord", 1, digits)
        buckets = written(rows.groupBy("source_key", bucket.alias("bucket")).agg(F.sum("n").alias("chars")), "buckets")
        if not buckets.where(F.col("chars") > bucket_chars).limit(1).count():
            break
    rows = rows.withColumn("bucket", bucket)
    totals = buckets.groupBy("source_key").agg(F.sum("chars").alias("chars"))
    slots = written(period(quanta_of(totals, weights)), "slots")
    upto = F.sum("chars").over(Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    before = buckets.select("source_key", "bucket", F.coalesce(upto, F.lit(0)).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("source_key", "bucket").orderBy("ord", "d.doc_id", "n").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(before, ["source_key", "bucket"]).withColumn("start", F.col("before") + F.col("inside"))
    placed = placed.withColumn("block", F.floor(F.col("start") / block_chars))
    q = slots.select("source_key", "q", "quanta").distinct()
    placed = placed.join(written(q, "quanta"), "source_key").withColumn("j", F.col("block") % F.col("q"))
    out = placed.join(slots.select("source_key", "j", F.col("slot").alias("in_period")), ["source_key", "j"])
    k, w, all_ = F.col("block"), F.col("q"), F.col("quanta")
    return out.select(
        "d", "source_key", "ord", "n", "start", "block",
        F.expr("block * quanta div q").alias("release"),
        F.expr("((block + 1) * quanta + q - 1) div q").alias("deadline"),
        (F.expr("block div q") * all_ + F.col("in_period")).alias("slot"),
    )


def in_mixed_order(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """docs, sorted by slot over the partitions: files written from it hold consecutive stretches of the mixture."""
    out = mixed(docs, weights).repartitionByRange(partitions(docs.sparkSession), "slot", "ord").sortWithinPartitions("slot", "start", "ord")
    return out.select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("d.doc_id", "source_key", "n", "start", "block", "release", "deadline", "slot")


OP6_SQL = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, coalesce(source, '{NO_SOURCE}') AS source_key, md5(coalesce(doc_id::VARCHAR, '')) AS ord, coalesce(length(text), 0)::BIGINT AS n FROM documents
), p AS (
  SELECT doc_id, source_key, n, (coalesce(sum(n) OVER (PARTITION BY source_key ORDER BY ord, doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM r
), t AS (
  SELECT source_key, pow(greatest(sum(n), 1)::DOUBLE, {TEMPER}::DOUBLE) AS share FROM r GROUP BY 1
), w AS (
  SELECT source_key, greatest(1, round(share * {QUANTA} / (SELECT sum(share) FROM t)))::BIGINT AS q FROM t
), s AS (
  SELECT list(struct_pack(source_key := source_key, q := q) ORDER BY source_key) AS s, sum(q)::BIGINT AS quanta FROM w
), sim AS (
  SELECT -1::BIGINT AS t, [0::BIGINT for x in s] AS k, 0::BIGINT AS pick FROM s
  UNION ALL
  SELECT t + 1, [k[i] + CASE WHEN i = p THEN 1 ELSE 0 END for i in range(1, len(k) + 1)], p
  FROM (SELECT sim.t, sim.k, list_min([{{'due': ((k[i] + 1) * quanta + s[i].q - 1) // s[i].q, 'i': i}} for i in range(1, len(s) + 1) if k[i] < s[i].q AND k[i] * quanta // s[i].q <= sim.t + 1]).i AS p
        FROM sim, s WHERE sim.t < quanta - 1)
), slots AS (
  SELECT s[pick].source_key AS source_key, s[pick].q AS q, quanta, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM sim, s WHERE t >= 0
)
SELECT p.doc_id, p.source_key, p.n, p.start, p.start // {BLOCK_CHARS} AS block,
       (p.start // {BLOCK_CHARS}) * quanta // q AS release, ((p.start // {BLOCK_CHARS} + 1) * quanta + q - 1) // q AS deadline,
       (p.start // {BLOCK_CHARS}) // q * quanta + slot AS slot
FROM p JOIN slots ON p.source_key = slots.source_key AND (p.start // {BLOCK_CHARS}) % q = j
"""
