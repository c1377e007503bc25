"""Document files: listing, decoding with a pluggable decoder, metadata and the OCR rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OCR_BELOW = 50
METADATA = ("title", "author", "subject", "creator", "producer")
PAGES = "array<struct<page_number:int,text:string>>"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, size, path) of the PDF files of a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"), "path")


def accepted(files: DataFrame) -> DataFrame:
    """Uploads are PDF files, by a lower-case suffix; others are an error."""
    return files.withColumn("filename", F.when(F.col("filename").endswith(".pdf"), F.col("filename")).otherwise(F.raise_error(F.concat(F.lit("not a PDF: "), "filename"))))


def pages(files: DataFrame, decode: Callable[[Column], Column], ocr: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(path, page_number, text, char_count) of files (path, content). decode gives an array of PAGES; a page with fewer than
    OCR_BELOW characters goes to ocr(content, page_number), and stays empty where that fails."""
    one = files.select("path", "content", F.inline(decode(F.col("content"))))
    text = F.coalesce("text", F.lit(""))
    if ocr is not None:
        text = F.when(F.length(F.trim(text)) < OCR_BELOW, F.coalesce(ocr(F.col("content"), F.col("page_number")), F.lit(""))).otherwise(text)
    return one.select("path", "page_number", text.alias("text")).withColumn("char_count", F.length("text"))


def document_totals(pages_: DataFrame) -> DataFrame:
    return pages_.groupBy("path").agg(F.count(F.lit(1)).alias("page_count"), F.sum("char_count").alias("total_chars"))


def metadata(found: Column) -> Column:
    """The five kept keys of a metadata map, missing ones empty."""
    return F.map_from_arrays(F.array(*map(F.lit, METADATA)), F.array(*[F.coalesce(F.try_element_at(found, F.lit(k)), F.lit("")) for k in METADATA]))
