"""The registry of canonical entities: entities (id, canonical_name, entity_type, confidence, mention_count, relation_count,
validated, first_doc, last_doc, metadata) and aliases (entity_id, alias_name, alias_type, confidence, source)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import REGISTRY_SUFFIXES, alias_kind, cache_key, normalized
from ..functions.scores import confidence_after
from ..storage import numbered, written
from .resolution import FUZZY, scored_pairs

NEW_CONFIDENCE, ALIAS_CONFIDENCE = 0.5, 0.7


def lookup(queries: DataFrame, entities: DataFrame, aliases: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """queries (qid, name, entity_type) with entity_id and tier, within the type: 1 name, 2 alias, 3 normal form, 4 score; null: none.

    Whatever the case of names; each tier sees what the ones before left."""
    names = entities.select(F.col("id").alias("entity_id"), F.lower("canonical_name").alias("key"), "entity_type", F.lit(0).alias("kind"))
    others = aliases.join(entities.select(F.col("id").alias("entity_id"), "entity_type"), "entity_id").select("entity_id", F.lower("alias_name").alias("key"), "entity_type", F.lit(1).alias("kind"))
    keys = names.unionByName(others)
    q = queries.select("qid", "name", "entity_type")
    on = ["name", "entity_type"]
    first = F.min(F.struct("kind", "entity_id")).alias("m")
    asked = q.select(*on).distinct().withColumns({"key": F.lower("name"), "norm": normalized(F.col("name"), REGISTRY_SUFFIXES)})
    exact = keys.groupBy("key", "entity_type").agg(first.alias("exact"))
    normal = keys.withColumn("norm", normalized(F.col("key"), REGISTRY_SUFFIXES)).where("norm <> ''").groupBy("norm", "entity_type").agg(first.alias("normal"))
    by = asked.join(exact, ["key", "entity_type"], "left").join(normal, ["norm", "entity_type"], "left")
    tier = F.when(F.col("exact").isNotNull(), F.col("exact.kind") + 1).when(F.col("normal").isNotNull(), 3)
    found = written(by.select(*on, F.coalesce("exact.entity_id", "normal.entity_id").alias("entity_id"), tier.alias("tier")), "tiers")
    # only what the other tiers left is scored, each name of a type once
    alike = scored_pairs(found.where("tier IS NULL").select(*on), keys.withColumnRenamed("key", "name"), ["entity_type"], threshold)
    best = alike.groupBy(*on).agg(F.min(F.struct(-F.col("score"), "other_kind", "other_entity_id")).alias("m")).select(*on, F.col("m.other_entity_id").alias("alike"))
    hits = found.join(best, on, "left").select(*on, F.coalesce("entity_id", "alike").alias("entity_id"), F.coalesce("tier", F.when(F.col("alike").isNotNull(), 4)).alias("tier"))
    return q.join(hits, on, "left").select("qid", "name", "entity_type", "entity_id", "tier")


def registered(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """entities after mentions (canonical_name, entity_type, document, ord): known ones grow by count, new ones begin with 0.5.

    Ids of new entities follow the largest, in order of their first mention. Where entities have metadata (JSON), known ones
    keep theirs and new ones have that of the first mention, if mentions have any."""
    keeps = "metadata" in entities.columns
    given = F.min_by("metadata", "ord") if "metadata" in mentions.columns else F.lit(None).cast("string")
    m = mentions.groupBy(F.lower("canonical_name").alias("key"), "entity_type").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("canonical_name", "ord").alias("new_name"), F.min_by("document", "ord").alias("new_first"), F.max_by("document", "ord").alias("new_last"), F.min("ord").alias("first_ord"), given.alias("new_metadata")
    )
    e = entities.withColumn("key", F.lower("canonical_name"))
    both = e.join(m, ["key", "entity_type"], "full_outer")
    known = F.col("id").isNotNull()
    grown = confidence_after_more(F.col("confidence"), F.col("mention_count"), F.coalesce("n", F.lit(0)), F.col("relation_count"), F.col("validated"))
    old = both.where(known).select("id", "canonical_name", "entity_type", grown.alias("confidence"), (F.col("mention_count") + F.coalesce("n", F.lit(0))).alias("mention_count"), "relation_count", "validated", "first_doc", F.coalesce("new_last", "last_doc").alias("last_doc"), *(["metadata"] if keeps else []))
    top = entities.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = both.where(~known).select("entity_type", "n", "new_name", "new_first", "new_last", "first_ord", "new_metadata")
    new = numbered(fresh, "first_ord", "new_name", "entity_type").join(F.broadcast(top)).select(
        (F.col("top") + F.col("number")).alias("id"), F.col("new_name").alias("canonical_name"), "entity_type",
        confidence_after(F.lit(NEW_CONFIDENCE), F.col("n"), F.lit(0), F.lit(False)).alias("confidence"), F.col("n").alias("mention_count"), F.lit(0).cast("long").alias("relation_count"), F.lit(False).alias("validated"), F.col("new_first").alias("first_doc"), F.col("new_last").alias("last_doc"),
        *([F.col("new_metadata").alias("metadata")] if keeps else []),
    )
    return old.unionByName(new)


def confidence_after_more(base, mentions, more, relations, validated):
    """The confidence after `more` further mentions of one that had `mentions`."""
    from ..functions.scores import confidence

    steps = F.when(more >= 1, F.sequence((mentions + 1).cast("int"), (mentions + more).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, base.cast("double"), lambda c, n: confidence(c, n, relations, validated))


def with_aliases(entities: DataFrame, aliases: DataFrame, new: DataFrame) -> DataFrame:
    """aliases with new ones (entity_id, alias_name, ord): not an entity's own name, once for each entity whatever the case."""
    named = new.join(entities.select(F.col("id").alias("entity_id"), "canonical_name"), "entity_id").where(F.lower("alias_name") != F.lower("canonical_name"))
    known = aliases.select("entity_id", F.lower("alias_name").alias("key"))
    left = named.withColumn("key", F.lower("alias_name")).join(known, ["entity_id", "key"], "left_anti")
    once = left.groupBy("entity_id", "key").agg(F.min_by("alias_name", "ord").alias("alias_name"))
    return aliases.unionByName(once.select("entity_id", "alias_name", alias_kind(F.col("alias_name")).alias("alias_type"), F.lit(ALIAS_CONFIDENCE).alias("confidence"), F.lit("learned").alias("source")))


def top(entities: DataFrame, min_confidence: float = 0.0, kind: str | None = None, limit: int = 1000) -> DataFrame:
    rows = entities.where(F.col("confidence") >= min_confidence)
    rows = rows.where(F.col("entity_type") == kind) if kind else rows
    return rows.orderBy(F.desc("mention_count"), F.desc("confidence"), "canonical_name").limit(limit)


def warm(entities: DataFrame, aliases: DataFrame, limit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """What a session keeps at hand: (cache_key, id, canonical_name) of the `limit` most mentioned entities, and of all aliases
    (cache_key, canonical_name), marked so that Spark caches them on first use."""
    kept = top(entities, limit=limit).select(cache_key(F.col("canonical_name"), F.col("entity_type")).alias("cache_key"), "id", "canonical_name")
    e = entities.select(F.col("id").alias("entity_id"), "canonical_name", "entity_type")
    names = aliases.join(e, "entity_id").select(cache_key(F.col("alias_name"), F.col("entity_type")).alias("cache_key"), "canonical_name")
    return kept.persist(), names.persist()


def save(entities: DataFrame, aliases: DataFrame, path: str) -> None:
    """The registry's tables as Parquet."""
    entities.write.mode("overwrite").parquet(f"{path}/entities")
    aliases.write.mode("overwrite").parquet(f"{path}/aliases")


def load(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/aliases")


def stats(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row a type with its count, and on each the totals and the mean confidence."""
    by = entities.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
    all_ = entities.agg(F.count(F.lit(1)).alias("total_entities"), F.coalesce(F.round(F.avg("confidence"), 3), F.lit(0.0)).alias("avg_confidence"))
    return by.join(F.broadcast(all_)).join(F.broadcast(aliases.agg(F.count(F.lit(1)).alias("total_aliases"))))


def from_graph(graph: DataFrame, degrees: DataFrame, types: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(entities, aliases) from a graph's entities: known types, missing and zero confidence as 0.5, degree as relation count."""
    e = graph.where(F.col("type").isin(*types)).join(degrees, "name", "left")
    number = F.xxhash64("name", "type")  # an id that needs no order
    rows = e.select(number.alias("id"), F.col("name").alias("canonical_name"), F.col("type").alias("entity_type"), F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(NEW_CONFIDENCE)).alias("confidence"), F.lit(1).cast("long").alias("mention_count"), F.coalesce("degree", F.lit(0)).cast("long").alias("relation_count"), F.lit(False).alias("validated"), "aliases")
    more = rows.select(F.col("id").alias("entity_id"), "canonical_name", F.explode("aliases").alias("alias_name")).where((F.trim("alias_name") != "") & (F.col("alias_name") != F.col("canonical_name")))
    return rows.drop("aliases"), more.select("entity_id", "alias_name", alias_kind(F.col("alias_name")).alias("alias_type"), F.lit(ALIAS_CONFIDENCE).alias("confidence"), F.lit("graph").alias("source"))


def violations(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(rule, key) of rows that break the registry's constraints."""
    range_ = entities.where(~F.col("confidence").between(0, 1)).select(F.lit("confidence_range").alias("rule"), F.col("id").cast("string").alias("key"))
    twice = entities.groupBy("canonical_name", "entity_type").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("unique_name").alias("rule"), F.concat_ws(":", "canonical_name", "entity_type").alias("key"))
    orphan = aliases.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_anti").select(F.lit("alias_without_entity").alias("rule"), F.col("entity_id").cast("string").alias("key"))
    double = aliases.groupBy("entity_id", "alias_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("unique_alias").alias("rule"), F.concat_ws(":", F.col("entity_id").cast("string"), "alias_name").alias("key"))
    return range_.unionByName(twice).unionByName(orphan).unionByName(double)


def full_text(entities: DataFrame, words: str) -> DataFrame:
    """Entities whose name and type together hold all the words."""
    have = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "canonical_name", "entity_type")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    wanted = [w for w in words.lower().split() if w]
    rows = entities
    for w in wanted:
        rows = rows.where(F.array_contains(have, w))
    return rows


#: Entities that a registry begins with (name, type, aliases).
SEED = (
    ("Poulina Group Holding", "Group", ("PGH", "Poulina", "Groupe Poulina", "بولينا")),
    ("BIAT", "Bank", ("Banque Internationale Arabe de Tunisie", "البنك العربي الدولي لتونس", "Arab International Bank of Tunisia", "International Arab Bank of Tunisia")),
    ("Banque de Tunisie", "Bank", ("BT", "Bank of Tunisia", "بنك تونس")),
    ("Banque Nationale Agricole", "Bank", ("BNA", "National Agricultural Bank", "البنك الوطني الفلاحي")),
    ("Société Tunisienne de Banque", "Bank", ("STB", "Tunisian Banking Company", "الشركة التونسية للبنك")),
    ("Union Internationale de Banques", "Bank", ("UIB", "International Union of Banks", "الاتحاد الدولي للبنوك")),
    ("Banque de l'Habitat", "Bank", ("BH", "Housing Bank", "بنك الإسكان")),
    ("Amen Bank", "Bank", ("Amen", "أمين بنك")),
    ("Attijari Bank", "Bank", ("Attijari", "التجاري بنك", "Attijariwafa Bank Tunisia")),
    ("Central Bank of Tunisia", "Bank", ("Banque Centrale de Tunisie", "BCT", "البنك المركزي التونسي", "The Central Bank")),
    ("Tunisie Telecom", "Company", ("TT", "اتصالات تونس")),
    ("Ooredoo Tunisia", "Company", ("Ooredoo", "Tunisiana", "أوريدو تونس")),
    ("Orange Tunisia", "Company", ("Orange", "أورانج تونس")),
)


def seed(spark) -> tuple[DataFrame, DataFrame]:
    """(entities, aliases) of SEED: validated, certain."""
    rows = spark.createDataFrame([(i + 1, n, t, list(a)) for i, (n, t, a) in enumerate(SEED)], "id long, canonical_name string, entity_type string, aliases array<string>")
    entities = rows.select("id", "canonical_name", "entity_type", F.lit(1.0).alias("confidence"), F.lit(1).cast("long").alias("mention_count"), F.lit(0).cast("long").alias("relation_count"), F.lit(True).alias("validated"))
    more = rows.select(F.col("id").alias("entity_id"), F.explode("aliases").alias("alias_name"))
    return entities, more.select("entity_id", "alias_name", alias_kind(F.col("alias_name")).alias("alias_type"), F.lit(1.0).alias("confidence"), F.lit("seed").alias("source"))
