"""Tables that a job writes once and reads again, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset and the master is local, as in tests, one temporary folder of this process; else an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + _OWN.setdefault("root", tempfile.mkdtemp(prefix="quarrymill-"))


def fresh(spark: SparkSession, name: str) -> str:
    """A path below the folder that nothing lies at."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet, read back: what made it isn't run again, whatever executors are lost."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """df as a table in buckets by key, sorted by it within: tables with as many buckets by keys of one kind are joined, and summed by key, without a shuffle. Rows are shuffled once, here. The session's catalog knows it until it ends; its files stay in the folder."""
    spark = df.sparkSession
    path = fresh(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    df.repartition(buckets, key).sortWithinPartitions(key).write.option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in files.listStatus(at) if x.isDirectory()) if files.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def finished(spark: SparkSession, path: str) -> list[int]:
    """Numbers N of the tables name=N in a folder that were written to their end."""
    return sorted(int(n.partition("=")[2]) for n in children(spark, path) if "=" in n and exists(spark, f"{path}/{n}/_SUCCESS"))
