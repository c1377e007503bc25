"""Merging batches into graph tables, and deleting and redirecting parts of them.

A table and a batch are one union whose rows have an order (`ord`); each merge is one aggregation by key, so merging is
idempotent in its counts, and a batch may hold a key many times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVIDENCE_BREAK = "\n---\n"


def in_order(value: str, order: str = "ord") -> Column:
    """The values of a group in order, as an array without nulls."""
    return F.transform(F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))), lambda x: x["v"])


def upsert_entities(rows: DataFrame) -> DataFrame:
    """rows (ord, name, type, aliases, confidence, properties): the first type, the highest confidence, aliases joined in order,
    the later value of each property.

    A name's aliases and properties are first made distinct, so what meets in its row is what the row then holds."""
    text = "struct<kind:int,key:string,value:string,at:int>"
    own = F.array(F.struct(F.lit(0).alias("kind"), F.lit("").alias("key"), F.lit(None).cast("string").alias("value"), F.lit(0).alias("at")))
    aliases = F.transform("aliases", lambda a, i: F.struct(F.lit(1).alias("kind"), a.alias("key"), F.lit(None).cast("string").alias("value"), i.alias("at")))
    properties = F.transform(F.map_entries("properties"), lambda e: F.struct(F.lit(2).alias("kind"), e["key"].alias("key"), e["value"].alias("value"), F.lit(0).alias("at")))
    none = F.array().cast(f"array<{text}>")
    parts = rows.select("ord", "name", "type", "confidence", F.explode(F.concat(own, F.coalesce(aliases, none), F.coalesce(properties, none))).alias("p"))
    once = parts.groupBy("name", "p.kind", "p.key").agg(F.min_by("type", "ord").alias("type"), F.max("confidence").alias("confidence"), F.max_by("p.value", "ord").alias("value"), F.min(F.struct("ord", "p.at")).alias("first"))
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    return once.groupBy("name").agg(
        F.max(of(0, F.col("type"))).alias("type"),
        F.max(of(0, F.col("confidence"))).alias("confidence"),
        F.transform(F.array_sort(F.collect_list(of(1, F.struct("first", "key")))), lambda x: x["key"]).alias("aliases"),
        F.map_from_entries(F.collect_list(of(2, F.struct("key", "value")))).alias("properties"),
        F.max(of(0, F.col("first.ord"))).alias("ord"),
    )


def upsert_edges(rows: DataFrame) -> DataFrame:
    """rows (ord, src, rel_type, dst, confidence, evidence, source_document): evidence is appended, the first document stays."""
    evidence = F.array_join(in_order("evidence"), EVIDENCE_BREAK)
    return rows.groupBy("src", "rel_type", "dst").agg(F.max("confidence").alias("confidence"), evidence.alias("evidence"), F.min_by("source_document", "ord").alias("source_document"), F.min("ord").alias("ord"))


def upsert_documents(rows: DataFrame) -> DataFrame:
    """rows (ord, path, chunk_id): a document keeps its first chunk."""
    return rows.groupBy("path").agg(F.min_by("chunk_id", "ord").alias("chunk_id"))


def upsert_mentions(rows: DataFrame) -> DataFrame:
    return rows.select("entity_name", "doc_path").dropDuplicates()


def with_known_ends(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """The relations of which both ends are entities."""
    names = entities.select("name").distinct()
    out = relations
    for end in ("src", "dst"):
        out = out.join(names.withColumnRenamed("name", end), end, "left_semi")
    return out


def remapped(relations: DataFrame, renamed: DataFrame) -> DataFrame:
    """Relation ends by the names that resolution gave: renamed (old_name, name), one row an old name."""
    out = relations
    for end in ("src", "dst"):
        to = renamed.select(F.col("old_name").alias(end), F.col("name").alias("to"))
        out = out.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return out.select(*relations.columns)


def detach_delete(entities: DataFrame, edges: DataFrame, mentions: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three without the doomed (name) and what touches them."""
    gone = doomed.select("name").distinct()
    left = entities.join(gone, "name", "left_anti")
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("name", end), end, "left_anti")
    return left, edges, mentions.join(gone.withColumnRenamed("name", "entity_name"), "entity_name", "left_anti")


def redirect_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with duplicate ends replaced by their canonical names; those that became loops go, none are merged."""
    out = edges.withColumns({"old_src": F.col("src"), "old_dst": F.col("dst")})
    for end in ("src", "dst"):
        m = mapping.select(F.col("duplicate").alias(end), F.col("canonical").alias("to"))
        out = out.join(m, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    moved = (F.col("src") != F.col("old_src")) | (F.col("dst") != F.col("old_dst"))
    return out.where((F.col("src") != F.col("dst")) | ~moved).select(*edges.columns)


def absorb_duplicates(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Canonical entities with the names and aliases of their duplicates, which go."""
    dup = entities.join(mapping, entities["name"] == mapping["duplicate"]).select("canonical", F.concat(F.array("duplicate"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("more"))
    gained = dup.groupBy("canonical").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("more")))).alias("more"))
    kept = entities.join(mapping.select(F.col("duplicate").alias("name")), "name", "left_anti")
    out = kept.join(gained, kept["name"] == gained["canonical"], "left")
    both = F.array_except(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>"))), F.array("name"))
    return out.select(*[F.when(F.col("more").isNull(), F.col("aliases")).otherwise(both).alias("aliases") if c == "aliases" else F.col(c) for c in entities.columns])


def cleared(entities: DataFrame, edges: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Empty tables, and how much was in them."""
    counts = entities.agg(F.count(F.lit(1)).alias("entities")).join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges")))).join(F.broadcast(mentions.agg(F.count(F.lit(1)).alias("mentions"))))
    return entities.where("false"), edges.where("false"), mentions.where("false"), counts


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """The keys that several rows have."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)


def save(entities: DataFrame, edges: DataFrame, mentions: DataFrame, path: str) -> None:
    """The graph's tables as Parquet: entities by type, edges by relation type, so that typed queries read their part alone.
    A name that several entities have is an error."""
    twice = repeated(entities, "name").first()
    if twice is not None:
        raise ValueError(f"several entities are named {twice['name']!r}")
    entities.write.mode("overwrite").partitionBy("type").parquet(f"{path}/entities")
    edges.write.mode("overwrite").partitionBy("rel_type").parquet(f"{path}/edges")
    mentions.write.mode("overwrite").parquet(f"{path}/mentions")
