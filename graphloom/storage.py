"""Written tables between the steps of an iteration, in the folder that driver and executors share, and row numbers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, in local sessions, a folder of our own that is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a written table: the lineage ends here, and the next step's plan begins with a scan."""
    spark = df.sparkSession
    path = f"{folder(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with `number`: 1, 2, 3 ... in the given total order. Rows are sorted by ranges; only a count a range meets in one task."""
    at = F.monotonically_increasing_id()  # the upper bits are the range, the lower 33 the place in it
    rows = written(df.orderBy(*order).withColumns({"range": F.shiftright(at, 33), "place": at.bitwiseAND((1 << 33) - 1)}), "numbered")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("range").agg(F.count("*").alias("rows")).select("range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    return rows.join(F.broadcast(starts), "range").withColumn("number", F.col("start") + F.col("place") + 1).select(*df.columns, "number")
