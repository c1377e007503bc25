"""A property graph derived from the trade tables: people, companies, places, groups and sectors, and what joins them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, type, confidence, aliases)"""
    c, s = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier")
    people = c.select(F.col("c_name").alias("name"), F.lit("Person").alias("type"), (F.lit(0.5) + (F.col("c_custkey") % 50) / 100.0).alias("confidence"), F.array(F.concat(F.lit("P"), F.col("c_custkey"))).alias("aliases"))
    firms = s.select(F.col("s_name").alias("name"), F.lit("Company").alias("type"), (F.lit(0.6) + (F.col("s_suppkey") % 40) / 100.0).alias("confidence"), F.array(F.concat(F.lit("C"), F.col("s_suppkey"))).alias("aliases"))
    none = F.array().cast("array<string>").alias("aliases")
    places = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("Location").alias("type"), F.lit(0.9).alias("confidence"), none)
    groups = _t(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("Group").alias("type"), F.lit(1.0).alias("confidence"), none)
    sectors = c.select(F.col("c_mktsegment").alias("name")).distinct().select("name", F.lit("Sector").alias("type"), F.lit(0.95).alias("confidence"), none)
    return people.unionByName(firms).unionByName(places).unionByName(groups).unionByName(sectors)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_custkey, l_suppkey, n): how often a customer bought of a supplier."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    line = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, rel_type, dst, confidence, evidence); one aggregation of the trades makes three relation types."""
    c, s = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier")
    often = pairs(spark, sf_dir).where("n >= 2").join(c.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    kinds = F.filter(F.array(*[F.struct(F.lit(k).alias("rel_type"), F.lit(least).alias("least")) for k, least in (("OWNS_SHARES", 2), ("DIRECTOR_OF", 3), ("OWNS", 4))]), lambda x: x["least"] <= F.col("n"))
    trade = often.select("c_name", "s_name", "n", F.explode(kinds).alias("k")).select(
        F.col("c_name").alias("src"), F.col("k.rel_type").alias("rel_type"), F.col("s_name").alias("dst"), F.least(F.lit(1.0), F.lit(0.5) + F.col("n") / 10.0).alias("confidence"), F.concat(F.col("n"), F.lit(" trades")).alias("evidence")
    )
    no = F.lit(None).cast("string").alias("evidence")
    nation = _t(spark, sf_dir, "nation")
    place = s.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("src"), F.lit("OPERATES_IN").alias("rel_type"), F.col("n_name").alias("dst"), F.lit(1.0).alias("confidence"), no)
    sector = c.select(F.col("c_name").alias("src"), F.lit("OPERATES_IN").alias("rel_type"), F.col("c_mktsegment").alias("dst"), F.lit(0.9).alias("confidence"), no)
    group = nation.join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.lit("PART_OF_GROUP").alias("rel_type"), F.col("r_name").alias("dst"), F.lit(1.0).alias("confidence"), no)
    up = s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("up_name"))
    chain = s.where("s_suppkey % 10 <> 0").join(up, F.col("s_suppkey") - 1 == F.col("k")).select(F.col("s_name").alias("src"), F.lit("SUBSIDIARY_OF").alias("rel_type"), F.col("up_name").alias("dst"), F.lit(0.8).alias("confidence"), no)
    return trade.unionByName(place).unionByName(sector).unionByName(group).unionByName(chain)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_name, doc_path): each order is a document that names its customer and its suppliers."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    doc = F.concat(F.lit("order_"), F.col("o_orderkey")).alias("doc_path")
    who = o.join(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("entity_name"), doc)
    line = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").distinct()
    of = line.join(_t(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")).join(o.select("o_orderkey"), "o_orderkey").select(F.col("s_name").alias("entity_name"), doc)
    return who.unionByName(of)


GRAPH_SQL = """
entities AS (
  SELECT c_name AS name, 'Person' AS type, 0.5e0 + (c_custkey % 50) / 100e0 AS confidence, ['P' || c_custkey] AS aliases FROM customer
  UNION ALL SELECT s_name, 'Company', 0.6e0 + (s_suppkey % 40) / 100e0, ['C' || s_suppkey] FROM supplier
  UNION ALL SELECT n_name, 'Location', 0.9e0, [] FROM nation
  UNION ALL SELECT r_name, 'Group', 1e0, [] FROM region
  UNION ALL SELECT DISTINCT c_mktsegment, 'Sector', 0.95e0, CAST([] AS VARCHAR[]) FROM customer
), pairs AS MATERIALIZED (
  SELECT o_custkey, l_suppkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL
), edges AS MATERIALIZED (
  SELECT c_name AS src, rel_type, s_name AS dst, least(1e0, 0.5e0 + n / 10e0) AS confidence, n || ' trades' AS evidence
  FROM pairs JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN (VALUES ('OWNS_SHARES', 2), ('DIRECTOR_OF', 3), ('OWNS', 4)) k(rel_type, least_n) ON n >= least_n
  UNION ALL SELECT s_name, 'OPERATES_IN', n_name, 1e0, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT c_name, 'OPERATES_IN', c_mktsegment, 0.9e0, NULL FROM customer
  UNION ALL SELECT n_name, 'PART_OF_GROUP', r_name, 1e0, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT a.s_name, 'SUBSIDIARY_OF', b.s_name, 0.8e0, NULL FROM supplier a JOIN supplier b ON a.s_suppkey - 1 = b.s_suppkey WHERE a.s_suppkey % 10 <> 0
), mentions AS MATERIALIZED (
  SELECT c_name AS entity_name, 'order_' || o_orderkey AS doc_path FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT DISTINCT s_name, 'order_' || o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey
)
"""
