"""Written tables in the folder that driver and executors share, and Arrow batch bounds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Scans of buckets that are one sorted file each are taken as sorted.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset (tests), a folder of our own that is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session (dots as double underscores) while the block runs."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str = "table", by: tuple[str, ...] = ()) -> DataFrame:
    """df as a written table: its lineage ends here and a lost executor costs nothing that came before. by: columns that part its files.

    The shuffle files of the write go with its end; else they would stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    with settings(spark, **{CLEANUP.replace(".", "__"): "true"}):
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    if _scopes:
        _scopes[-1].append(path)
    return out


#: Where written tables lie, for as long as their DataFrames are referred to; and those of the scopes that are open.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within are removed at its end, but those that were kept: nothing outside may read the others."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)


def kept(table: DataFrame) -> DataFrame:
    """A written table that outlives the scope that it was written in; it belongs to the scope around that."""
    path = _paths[table]
    for k, scope in enumerate(_scopes):
        if path in scope:
            scope.remove(path)
            if k:
                _scopes[k - 1].append(path)
    return table


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more; other DataFrames are left alone."""
    for table in tables:
        path = _paths.pop(table, None)
        if path is not None:
            _remove(table.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bucketed(df: DataFrame, key: str, name: str = "run") -> tuple[DataFrame, str]:
    """df as a written table, and the name that the session knows it by: in buckets by key, each one file sorted by key: such tables are joined and merged bucket by bucket,
    without shuffling or sorting them again."""
    spark = df.sparkSession
    n, table = partitions(spark), f"graphloom_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/graphloom/{table}"
    if _scopes:
        _scopes[-1].append(path)
    with settings(spark, **{CLEANUP.replace(".", "__"): "true", ORDERED.replace(".", "__"): "true"}):
        df.repartition(n, key).sortWithinPartitions(key).write.bucketBy(n, key).sortBy(key).option("compression", "zstd").option("path", path).saveAsTable(table)
    return spark.table(table), table


def checked_broadcast(table: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, to be broadcast if its rows are counted to fit BROADCAST_BYTES; beyond that it is joined by shuffling."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers get: whole texts are long, and two workers share an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name
