"""Keyed state as a table of files: batches of changes, and snapshots that fold the batches up to a number.

    log/batch=N/       the changes of batch N: keys, seq, value (null deletes)
    snapshots/upto=N/  one row for each key that is alive after batch N: keys, value, ord, seq

A read folds the newest whole snapshot and the batches after it; nothing is written. A batch is written once, under its number, so writing it again, as a restarted
stream does, changes nothing. Snapshots are made from the one before and the batches since.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared


def fold(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, value, ord, seq) to those alive: (keys, value at the last seq, least ord after the last deletion, last seq). A row whose value is null deletes its key. Null keys are keys.

    Deletions are one row a key. Values and orders are summed by key before they are shuffled; only rows of keys that were deleted meet their deletion first.
    """
    packed = F.struct(*keys)
    seen = rows.select(packed.alias("k"), F.col("value").alias("v"), F.col("ord").alias("o"), F.col("seq").alias("s"))
    gone = seen.where("v IS NULL").groupBy("k").agg(F.max("s").alias("g"))
    left = seen.join(gone, "k", "left").where("v IS NOT NULL AND (g IS NULL OR s > g)")
    out = left.groupBy("k").agg(F.max_by("v", "s").alias("value"), F.min("o").alias("ord"), F.max("s").alias("seq"))
    return out.select(*(F.col("k")[c].alias(c) for c in keys), "value", "ord", "seq")


class StateTable:
    """State under a path: keys and the kinds of keys, value and seq are those of `schema`.

    seq orders the changes of a key. Changes of one batch, and of batches that aren't in a snapshot yet, may come in any order; a change older than the newest seq of the snapshot can't be folded any more: compact() then raises.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], value: str = "value", seq: str = "seq") -> None:
        fields = {f.name: f.dataType for f in T._parse_datatype_string(schema).fields}
        self.spark, self.path, self.keys, self.value, self.seq = spark, path.rstrip("/"), keys, value, seq
        own = [T.StructField(k, fields[k]) for k in keys]
        self._log = T.StructType([*own, T.StructField("value", fields[value]), T.StructField("seq", fields[seq])])
        self._snapshot = T.StructType([*own, T.StructField("value", fields[value]), T.StructField("ord", fields[seq]), T.StructField("seq", fields[seq])])

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the batches or snapshots that were written to their end."""
        names = shared.children(self.spark, f"{self.path}/{kind}")
        return sorted(int(n.partition("=")[2]) for n in names if "=" in n and shared.exists(self.spark, f"{self.path}/{kind}/{n}/_SUCCESS"))

    def append(self, changes: DataFrame, batch: int) -> bool:
        """Writes the changes as batch number `batch`; False, and nothing is done, if it was written before or is part of a snapshot."""
        if batch < 0:
            raise ValueError("batches are numbered from 0")
        if batch in self._numbers("log") or batch <= max(self._numbers("snapshots"), default=-1):
            return False
        row = changes.select(*(F.col(f"`{k}`") for k in self.keys), F.col(f"`{self.value}`").alias("value"), F.col(f"`{self.seq}`").alias("seq"))
        row.write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")
        return True

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: a batch that a restarted stream sends again is written once."""
        return lambda changes, batch: (self.append(changes, batch), None)[1]

    def _parts(self, upto: int | None = None) -> tuple[DataFrame, int, list[int]]:
        """Rows of the newest snapshot and the batches after it, the snapshot's number, the batches."""
        snapshot = max(self._numbers("snapshots"), default=-1)
        batches = [n for n in self._numbers("log") if n > snapshot and (upto is None or n <= upto)]
        rows = self.spark.createDataFrame([], self._snapshot)
        if snapshot >= 0:
            rows = self.spark.read.schema(self._snapshot).parquet(f"{self.path}/snapshots/upto={snapshot}")
        if batches:
            tail = self.spark.read.schema(self._log).parquet(*(f"{self.path}/log/batch={n}" for n in batches))
            rows = (rows if snapshot >= 0 else rows.where("false")).unionByName(tail.withColumn("ord", F.col("seq")))
        return rows, snapshot, batches

    def read(self) -> DataFrame:
        """(keys, value, ord) of what is alive now."""
        return fold(self._parts()[0], self.keys).select(*self.keys, F.col("value").alias(self.value), "ord")

    def compact(self, upto: int | None = None) -> int:
        """Folds the batches up to a number into a new snapshot; its number (-1: there is nothing yet)."""
        rows, snapshot, batches = self._parts(upto)
        if not batches:
            return snapshot
        if snapshot >= 0:
            newest = self.spark.read.schema(self._snapshot).parquet(f"{self.path}/snapshots/upto={snapshot}").agg(F.max("seq")).first()[0]
            oldest = self.spark.read.schema(self._log).parquet(*(f"{self.path}/log/batch={n}" for n in batches)).agg(F.min("seq")).first()[0]
            if newest is not None and oldest is not None and oldest <= newest:
                raise ValueError(f"a change at {oldest} is older than the snapshot, which ends at {newest}")
        fold(rows, self.keys).write.mode("overwrite").parquet(f"{self.path}/snapshots/upto={batches[-1]}")
        return batches[-1]

    def vacuum(self) -> list[str]:
        """Removes older snapshots and the batches that the newest one has; what was removed. Readers that began before must have ended."""
        snapshot = max(self._numbers("snapshots"), default=-1)
        gone = [f"log/batch={n}" for n in self._numbers("log") if n <= snapshot] + [f"snapshots/upto={n}" for n in self._numbers("snapshots") if n < snapshot]
        for name in gone:
            shared.remove(self.spark, f"{self.path}/{name}")
        return gone
