"""Documents to graph rows: chunks, extraction, resolution within chunks, linking to the graph, and merged rows to store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import chunks, extraction, resolution, upserts
from ..storage import written


@dataclass(frozen=True)
class Ingested:
    entities: DataFrame
    edges: DataFrame
    mentions: DataFrame
    documents: DataFrame
    totals: DataFrame


def ingest(
    pages: DataFrame,
    graph: DataFrame,
    mentions: extraction.MentionProvider,
    relations: extraction.RelationProvider,
    fallback: extraction.RelationProvider | None = None,
    paragraphs: Column | None = None,
    remap: bool = True,
    known: dict[str, str] | None = None,
    embed: resolution.Embedding | None = None,
    by_document: bool = False,
) -> Ingested:
    """pages (doc_id, page_number, text) and the entities of a graph (name, aliases, ord) -> rows to merge into the graph.

    Relation providers get each chunk with its neighbours' edges and the names recognized in it. Entities of a chunk are
    resolved in the order of the text (known and embed: see resolution.resolved), compound names are split, and the parts are
    linked. by_document resolves over whole documents in place of chunks. Relation ends follow the renaming of their entities, unless remap is false or the entity was split; relations
    without both ends are left out."""
    paras = chunks.paragraphs(F.col("text")) if paragraphs is None else paragraphs
    cut = chunks.chunked(pages, paras).withColumn("chunk_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))
    cut = written(chunks.with_context(cut), "chunks")
    found, told = extraction.extracted(cut, mentions, relations, fallback)
    place = cut.select("chunk_id", "doc_id", "chunk_index")
    if by_document:  # a document is one chunk to what follows, its places in the order of its chunks
        at = F.col("chunk_index") * F.lit(2 * extraction.GIVEN_AFTER) + F.col("pos")
        found, told = (of.join(place, "chunk_id").withColumns({"pos": at, "chunk_id": F.col("doc_id").cast("string")}).drop("doc_id", "chunk_index") for of in (found, told))
        place = cut.select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", F.lit(0).alias("chunk_index")).distinct()
    told = written(told, "told")
    resolved = written(resolution.resolved(found, known=known, embed=embed), "resolved")
    # ends of relations are found whatever their case, as entities are
    names = resolved.select("chunk_id", "name", F.explode(F.concat(F.array("name"), "aliases")).alias("old")).groupBy("chunk_id", F.lower("old").alias("old")).agg(F.min("name").alias("name"))
    single = written(resolution.split_compounds(resolved.withColumn("whole", F.col("name"))), "single")
    to_graph = resolution.linked(single.select(F.col("name").alias("id"), "name").distinct(), graph).select("name", F.coalesce("canonical", "name").alias("final"))
    to_graph = written(to_graph, "linked")
    rows = written(single.join(to_graph, "name").join(place, "chunk_id"), "placed")
    ord_ = F.struct("doc_id", "chunk_index", "name").alias("ord")
    aliases = F.when(F.col("final") != F.col("name"), F.array_union("aliases", F.array("name"))).otherwise(F.col("aliases"))
    entities = upserts.upsert_entities(rows.select(ord_, F.col("final").alias("name"), "type", aliases.alias("aliases"), "confidence", F.create_map().cast("map<string,string>").alias("properties")))
    if remap:
        whole = single.where("whole = name").select("chunk_id", "name").distinct()
        renamed = names.join(whole, ["chunk_id", "name"], "left_semi").join(to_graph, "name").select("chunk_id", "old", "final")
        for end in ("source", "target"):
            to = renamed.withColumnsRenamed({"old": f"old_{end}", "final": f"new_{end}"})
            told = told.withColumn(f"old_{end}", F.lower(end)).join(to, ["chunk_id", f"old_{end}"], "left").withColumn(end, F.coalesce(f"new_{end}", end))
    edge_rows = told.join(place, "chunk_id").select(F.struct("doc_id", "chunk_index", "pos").alias("ord"), F.col("source").alias("src"), F.col("relation").alias("rel_type"), F.col("target").alias("dst"), "confidence", "evidence", F.col("doc_id").cast("string").alias("source_document"))
    known = graph.select("name").unionByName(rows.select(F.col("final").alias("name")))
    edges = upserts.upsert_edges(upserts.with_known_ends(edge_rows, known))
    mention_rows = upserts.upsert_mentions(rows.select(F.col("final").alias("entity_name"), F.col("doc_id").cast("string").alias("doc_path")))
    documents = upserts.upsert_documents(cut.select(F.struct("chunk_index").alias("ord"), F.col("doc_id").cast("string").alias("path"), "chunk_id"))
    totals = cut.agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("chunks"))
    for name, df in (("entities", resolved), ("relations", told)):
        totals = totals.join(F.broadcast(df.agg(F.count(F.lit(1)).alias(name))))
    return Ingested(entities, edges, mention_rows, documents, totals)


def reprocess(pages: DataFrame, mentions: extraction.MentionProvider, relations: extraction.RelationProvider, **more) -> Ingested:
    """All documents anew, into an empty graph: entities are resolved over each document, and linked to none."""
    none = pages.sparkSession.createDataFrame([], "name string, aliases array<string>, ord long")
    return ingest(pages, none, mentions, relations, by_document=True, **more)
