"""Finding and repairing what is wrong with a graph's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import issue_of
from .upserts import absorb_duplicates, redirect_edges

#: Types that one entity may have been given in turn.
COMPATIBLE = (("Company", "Sector"), ("Bank", "Company"), ("Organization", "Company"), ("Group", "Company"))


def issues(entities: DataFrame) -> DataFrame:
    """(name, issue) of the entities that have one."""
    return entities.select("name", issue_of(F.col("name")).alias("issue")).where("issue IS NOT NULL")


def issue_report(entities: DataFrame) -> DataFrame:
    """(issue, n): how many entities have each issue, and under `total` how many there are."""
    found = issues(entities).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))
    return found.unionByName(entities.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("issue"), "n"))


def variant_groups(entities: DataFrame) -> DataFrame:
    """(key, size, types): names that differ by case alone."""
    return entities.groupBy(F.lower("name").alias("key")).agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_set("type")).alias("types")).where("size > 1")


def case_variants(entities: DataFrame) -> DataFrame:
    """(canonical, duplicate) of entities (name, type, connections): of a group with one type, or types that go together, the
    best connected stays; of equal ones the one in title case, then the first by name."""
    groups = variant_groups(entities)
    fits = F.size("types") == 1
    for pair in COMPATIBLE:
        fits = fits | (F.size(F.array_except("types", F.array(*map(F.lit, pair)))) == 0)
    w = Window.partitionBy("key").orderBy(F.desc("connections"), F.desc((F.initcap("name") == F.col("name")).cast("int")), "name")
    rows = entities.withColumn("key", F.lower("name")).join(groups.where(fits).select("key"), "key", "left_semi")
    ranked = rows.withColumns({"k": F.row_number().over(w), "canonical": F.first("name").over(w)})
    return ranked.where("k > 1").select("canonical", F.col("name").alias("duplicate"))


def merge_report(entities: DataFrame) -> DataFrame:
    """Groups to merge, entities that go, and the connections that move."""
    m = case_variants(entities)
    moved = m.join(entities, m["duplicate"] == entities["name"])
    return moved.agg(F.countDistinct("canonical").alias("groups"), F.count(F.lit(1)).alias("entities_to_merge"), F.coalesce(F.sum("connections"), F.lit(0)).alias("total_connections"))


def merge(entities: DataFrame, edges: DataFrame, mapping: DataFrame, parity: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) with duplicates merged into their canonical names. parity moves RELATED_TO edges alone, once each,
    and loses the others of duplicates, as published."""
    out = redirect_edges(edges, mapping)
    if parity:
        dup = mapping.select(F.col("duplicate").alias("n"))
        touched = edges.join(dup, (edges["src"] == dup["n"]) | (edges["dst"] == dup["n"]), "left_semi")
        kept = edges.join(dup.withColumnRenamed("n", "src"), "src", "left_anti").join(dup.withColumnRenamed("n", "dst"), "dst", "left_anti").select(*edges.columns)
        out = kept.unionByName(redirect_edges(touched.where("rel_type = 'RELATED_TO'"), mapping)).dropDuplicates(["src", "rel_type", "dst"])
    return absorb_duplicates(entities, mapping), out


def manual_merge(entities: DataFrame, edges: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merges by hand: rules (canonical, duplicate, new_type); those whose canonical entity is missing do nothing, and edges
    that the canonical entity already has aren't made twice."""
    known = rules.join(entities.select(F.col("name").alias("canonical")), "canonical", "left_semi")
    mapping = known.select("canonical", "duplicate")
    merged, out = merge(entities, edges, mapping)
    types = known.groupBy("canonical").agg(F.first("new_type", ignorenulls=True).alias("new_type")).withColumnRenamed("canonical", "name")
    typed = merged.join(types, "name", "left").withColumn("type", F.coalesce("new_type", "type")).select(*entities.columns)
    return typed, out.dropDuplicates(["src", "rel_type", "dst"])
