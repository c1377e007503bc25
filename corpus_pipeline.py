"""From raw documents to packed training sequences, in five stages.

Language identification drops the documents that it rejects, line dedup cuts repeated lines out of texts, the n-gram Jaccard
join leaves one document of each group of near copies, Pfair mixing puts the documents in the order of the mixture, and
packing cuts them into sequences: along the curve within each stretch of the mixture, stretches in order.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import jaccardjoin, langid, linededup, mixing, packing
from graphloom.llm.shared import checked_broadcast, discard, documents, fresh, kept, scratch, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known; null and empty texts and texts without letters are rejected, and so is every
    document where none has a label to learn from. Repeated rows and ties go alike; columns of any name are kept."""
    names = tuple(fresh(docs, n) for n in langid.NAMES)
    return langid.identified(docs, langid.learned(docs), names=names).where(~F.col(names[2])).select(*_all(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated lines; n_chars follows the text, where there is such a column.

    Null and empty texts stay as they are; repeated rows of a document lose the same lines; of documents that hold a line the
    largest doc_id keeps it, a null doc_id counting as the smallest; columns of any name are kept."""
    out = linededup.drop_repeated_lines(docs, counts=False)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles join at a similarity of 0.8: the smallest doc_id's (a null one's
    only where there is no other), of texts with the same doc_id that with the least MD5.

    Documents without words stay, all of them. Of repeated rows (doc_id and text) with words one stays: the first as JSON."""
    key = fresh(docs, "text_key")
    rows = docs.withColumn(key, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    groups = jaccardjoin.joined(rows, key=key).where("n_shingles > 0")
    own = groups.groupBy("component", "doc_id", key).agg(F.count(F.lit(1)).alias("rows"))
    first = own.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(key).alias("k"), "rows")).alias("s"))
    # the few rows that go are looked for, not the many that stay
    gone = written(own.join(first, "component").where(~(F.col("doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col(key) == F.col("s.k")))).select(F.col("doc_id").alias("own"), F.col(key).alias("k"), F.lit(True).alias("gone"))
        .unionByName(first.where("s.rows > 1").select(F.col("s.doc_id").alias("own"), "s.k", F.lit(False).alias("gone"))), "gone")
    r, s = rows.alias("r"), checked_broadcast(gone, 48).alias("s")
    met = r.join(s, F.col("r.doc_id").cast("long").eqNullSafe(F.col("s.own")) & (F.col(f"r.{key}") == F.col("s.k")), "left")
    stays = met.where("s.gone IS NULL").select(*[F.col(f"r.`{c}`").alias(c) for c in docs.columns])
    once = met.where("NOT s.gone").select("s.own", "s.k", F.struct(*[F.col(f"r.`{c}`").alias(c) for c in docs.columns]).alias("d"))
    once = once.groupBy("own", "k").agg(F.min_by("d", F.to_json("d")).alias("d"))
    return stays.unionByName(once.select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns]))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: each file written from the result is a stretch of it.

    A null source is one of its own, null and empty texts have length 0, repeated rows follow one another, columns of any
    name are kept."""
    return mixing.in_mixed_order(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents. Documents read from files are packed file by file, so that sequences follow the mixture.

    A null text is empty, an empty one is its end token alone; repeated rows are packed each; only doc_id and text are read."""
    if "text" not in docs.columns:
        raise ValueError("documents have a text")
    try:
        files = docs.select("*", F.col("_metadata.file_name").alias(name := fresh(docs, "file_name")))
    except AnalysisException:  # not from files: one stretch
        return packing.packed(docs)
    return packing.packed(files, segment=F.col(name))


def _all(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_copies", near_copy_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The first, third and last stage are not expressible in SQL: tests compare the stages with the operators' results by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch(spark):  # what a stage writes on its way goes with it
            docs = kept(written(stage(spark, before, sf_dir), name))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
