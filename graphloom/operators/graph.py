"""Queries over a property graph: entities (name, type, confidence, aliases), edges (src, rel_type, dst, confidence, evidence)
and mentions (entity_name, doc_path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_VIEW, MIN_TYPE = 0.6, 0.7
LIKE_COMPANIES = ("Company", "Group", "Bank")


def seen_name(name: Column) -> Column:
    """Names that views show: 3 to 99 characters on one line."""
    return (F.length(name) > 2) & (F.length(name) < 100) & ~name.contains("\n")


def all_edges(edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """(src, rel_type, dst, confidence) with the mentions as edges to documents."""
    m = mentions.select(F.col("entity_name").alias("src"), F.lit("MENTIONED_IN").alias("rel_type"), F.concat(F.lit("doc:"), F.col("doc_path")).alias("dst"), F.lit(None).cast("double").alias("confidence"))
    return edges.select("src", "rel_type", "dst", "confidence").unionByName(m)


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge from both ends: (a, b, ...); loops once."""
    cols = [c for c in edges.columns if c not in ("src", "dst")]
    there = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), *cols, F.lit(True).alias("forward"))
    return there.unionByName(edges.where("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), *cols, F.lit(False).alias("forward")))


def search(entities: DataFrame, text: str, kind: str | None = None, limit: int = 10) -> DataFrame:
    """Entities whose name holds the text, the most certain first; equal ones by name."""
    if len(text) < 2 or not 1 <= limit <= 100:
        raise ValueError("a search takes two characters and a limit from 1 to 100")
    found = entities.where(F.lower("name").contains(text.lower()))
    found = found.where(F.col("type") == kind) if kind else found
    return found.select("name", "type", "confidence").orderBy(F.col("confidence").desc_nulls_first(), "name").limit(limit)


def detail(entities: DataFrame, mentions: DataFrame, name: str) -> DataFrame:
    """The entity with the sorted paths of the documents that mention it."""
    docs = mentions.where(F.col("entity_name") == name).groupBy("entity_name").agg(F.array_sort(F.collect_list("doc_path")).alias("documents"))
    one = entities.where(F.col("name") == name)
    return one.join(docs, one["name"] == docs["entity_name"], "left").select("name", "type", "confidence", F.coalesce("documents", F.array().cast("array<string>")).alias("documents"))


def relationships(entities: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """What leaves and what reaches an entity; of source and target the one that isn't the entity is set."""
    kinds = entities.select(F.col("name").alias("other"), F.col("type").alias("other_type"))
    out = edges.where(F.col("src") == name).select("rel_type", F.col("dst").alias("other"), "confidence", "evidence").join(kinds, "other").select("rel_type", F.col("other").alias("target"), F.col("other_type").alias("target_type"), "confidence", "evidence")
    into = edges.where(F.col("dst") == name).select("rel_type", F.col("src").alias("other"), "confidence", "evidence").join(kinds, "other").select("rel_type", F.col("other").alias("source"), F.col("other_type").alias("source_type"), "confidence", "evidence")
    return out.unionByName(into, allowMissingColumns=True).distinct()


def stats(entities: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """Numbers of entities and of edges, mentions too; 0 where there are none."""
    e = entities.agg(F.count(F.lit(1)).alias("entity_count"))
    r = all_edges(edges, mentions).agg(F.count(F.lit(1)).alias("relationship_count"))
    return e.join(F.broadcast(r))  # one row each


def degree(edges: DataFrame) -> DataFrame:
    """(name, degree): incident edges, a loop once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("name"))
    return ends.groupBy("name").agg(F.count(F.lit(1)).alias("degree"))


def overview(entities: DataFrame, edges: DataFrame, mentions: DataFrame, limit: int = 100, min_confidence: float = MIN_VIEW) -> DataFrame:
    """The best connected entities and the edges that leave them to certain ones; entities without such edges have nulls."""
    shown = entities.where((F.col("confidence") >= min_confidence) & seen_name(F.col("name")))
    ranked = shown.join(degree(all_edges(edges, mentions)), "name").where("degree > 0")
    top = ranked.orderBy(F.col("degree").desc(), F.col("confidence").desc_nulls_first(), "name").limit(limit).select("name", "type", "confidence", "degree")
    other = entities.where(F.col("confidence") >= min_confidence).select(F.col("name").alias("target"), F.col("type").alias("target_type"), F.col("confidence").alias("target_confidence"))
    leave = edges.select(F.col("src").alias("name"), "rel_type", F.col("dst").alias("target"), F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(0.8)).alias("edge_confidence")).join(other, "target")
    return top.join(leave, "name", "left").select("name", "type", "confidence", "degree", "rel_type", "target", "target_type", "target_confidence", "edge_confidence")


def overview_nodes(view: DataFrame) -> DataFrame:
    """(id, type, confidence) of all entities in a view, once each."""
    both = view.select(F.col("name").alias("id"), "type", "confidence").unionByName(view.where(F.col("target").isNotNull()).select(F.col("target").alias("id"), F.col("target_type").alias("type"), F.col("target_confidence").alias("confidence")))
    return both.dropDuplicates(["id"])


def view_stats(view: DataFrame) -> DataFrame:
    return view.agg(F.count("target").alias("edge_count")).join(F.broadcast(overview_nodes(view).agg(F.count(F.lit(1)).alias("node_count"))))


def by_type(entities: DataFrame, edges: DataFrame, kind: str, limit: int = 50, min_confidence: float = MIN_TYPE) -> DataFrame:
    """The most certain entities of a type and their certain neighbours; those without keep a row with nulls."""
    top = entities.where((F.col("type") == kind) & (F.col("confidence") >= min_confidence) & seen_name(F.col("name"))).orderBy(F.col("confidence").desc_nulls_first(), "name").limit(limit).select("name", "type", "confidence")
    other = entities.where(F.col("confidence") >= min_confidence).select(F.col("name").alias("b"), F.col("type").alias("neighbour_type"))
    near = undirected(edges).join(other, "b").select(F.col("a").alias("name"), "rel_type", F.col("b").alias("neighbour"), "neighbour_type", F.col("confidence").alias("edge_confidence"))
    return top.join(near, "name", "left")


def named(entities: DataFrame, text: str) -> DataFrame:
    """Entities that a question names: by name or alias, whatever the case."""
    t = text.lower()
    return entities.where((F.lower("name") == t) | F.exists("aliases", lambda a: F.lower(a) == t))


def owners(entities: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    of = named(entities, text).select(F.col("name").alias("dst"))
    return edges.where("rel_type = 'OWNS'").join(of, "dst", "left_semi").select(F.col("src").alias("owner"), "confidence").orderBy(F.col("confidence").desc_nulls_first(), "owner")


def linked_companies(entities: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    of = named(entities, text).select(F.col("name").alias("a"))
    firms = entities.where(F.col("type").isin(*LIKE_COMPANIES)).select(F.col("name").alias("b"), "type")
    return undirected(edges).join(of, "a", "left_semi").join(firms, "b").select(F.col("b").alias("name"), "type", "rel_type").distinct()


def operating_in(entities: DataFrame, edges: DataFrame, text: str, parity: bool = False) -> DataFrame:
    """What operates in a sector or place; parity also lets every sector through, as published."""
    hit = F.lower("name").contains(text.lower())
    hit = hit | (F.col("type") == "Sector") if parity else hit
    of = entities.where(hit).select(F.col("name").alias("dst"))
    return edges.where("rel_type = 'OPERATES_IN'").join(of, "dst").join(entities.select(F.col("name").alias("src"), "type"), "src").select(F.col("src").alias("name"), "type", F.col("dst").alias("sector"))


def shared_directors(edges: DataFrame, limit: int | None = 50) -> DataFrame:
    """Pairs of companies with a common director, in both orders."""
    d = edges.where("rel_type = 'DIRECTOR_OF'").select("src", "dst")
    both = d.withColumnRenamed("dst", "company1").join(d.withColumnRenamed("dst", "company2"), "src").where("company1 <> company2")
    out = both.select("company1", "company2", F.col("src").alias("person")).distinct()
    return out.orderBy("company1", "company2", "person").limit(limit) if limit else out


def register_views(entities: DataFrame, edges: DataFrame, mentions: DataFrame) -> None:
    """Names for spark.sql: the raw query surface takes SQL with parameters over these views."""
    entities.createOrReplaceTempView("entities")
    edges.createOrReplaceTempView("edges")
    mentions.createOrReplaceTempView("mentions")
    mentions.select("doc_path").distinct().createOrReplaceTempView("graph_documents")
