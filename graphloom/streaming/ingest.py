"""Incremental ingest: extracted entities arrive as files, each micro-batch is merged into the entity table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.upserts import upsert_entities

ROWS = "ord long, name string, type string, aliases array<string>, confidence double, properties map<string,string>"


def upsert_batch(path: str):
    """A sink for foreachBatch: version k of the table is the merge of version k-1 and batch k, so a batch that is run again
    after a failure writes the same version again."""

    def run(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("ord", "name", "type", "aliases", "confidence", "properties")
        if k > 0:
            rows = spark.read.parquet(f"{path}/version={k - 1}").select(*rows.columns).unionByName(rows)
        upsert_entities(rows).write.mode("overwrite").parquet(f"{path}/version={k}")

    return run


def ingest(spark: SparkSession, source: str, path: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Merges all files that are there and stops; files_per_batch bounds a micro-batch."""
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(upsert_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of events (ts, event_type, value) in tumbling windows; batch or stream."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
