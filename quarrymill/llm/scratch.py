"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Where the tables that save() gave lie.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: The names of those in buckets.
_TABLES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset, one temporary folder of this process, if the master is local, as in tests; else an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "root" not in _OWN:
            _OWN["root"] = tempfile.mkdtemp(prefix="quarrymill-")
        root = "file://" + _OWN["root"]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet and reads it back: the lineage ends in files that outlive any executor."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def save_buckets(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """Like save(), in n buckets by key: tables with as many buckets by the same key are joined on it without a shuffle."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{folder(spark)}/{table}"
    df.repartition(n, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(table)
    out = spark.table(table)
    _PATHS[out], _TABLES[out] = path, table
    return out


def drop(*saved: DataFrame) -> None:
    """Removes the files of tables that save() or save_buckets() gave and that nothing reads any more."""
    for df in saved:
        if table := _TABLES.pop(df, None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished jobs now; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for the small tables of iterative operators; Spark removes its files with the frame."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)
