"""Consensus of reviewers' scores as a table of files that batches keep up to date: counts by group and score, which add up, and the places of scores, which stay.

    rows/batch=N/   group, place, score of batch N
    sums/batch=N/   group, score, n of batch N
    sums/upto=N/    the same of all batches up to N

Means, the consensus and the deviations of a group come from its counts; only outliers' rows are joined to them. No read sorts rows or counts places anew. A batch is written once under
its number, the sums last. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.operators.neighbours import ranges

from . import shared


class ConsensusTable:
    """Scores under a path: group, score and order are of the kinds in `schema`.

    Places count from 0 in a group, in order; a batch's rows follow those of earlier batches of their group, whatever their order says, and rows of one order in a batch come in no fixed order.
    Null is a group like any other; null scores have a place and count in n_scores alone; of NaN all places are outliers; rows without order come first in their batch.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, group: str, score: str, order: str) -> None:
        kinds = {f.name: f.dataType for f in T._parse_datatype_string(schema).fields}
        self.spark, self.path, self.group, self.score, self.order = spark, path.rstrip("/"), group, score, order
        own = [T.StructField("g", kinds[group]), T.StructField("s", kinds[score])]
        self._sums_schema = T.StructType([*own, T.StructField("n", T.LongType())])
        self._rows_schema = T.StructType([own[0], T.StructField("place", T.LongType()), own[1]])

    def _numbers(self) -> tuple[int, list[int]]:
        """The number of the newest whole sums (-1: none), and of the batches after it."""
        every = [n for n in shared.children(self.spark, f"{self.path}/sums") if shared.exists(self.spark, f"{self.path}/sums/{n}/_SUCCESS")]
        upto = max((int(n[5:]) for n in every if n.startswith("upto=")), default=-1)
        return upto, sorted(int(n[6:]) for n in every if n.startswith("batch=") and int(n[6:]) > upto)

    def _sums(self) -> DataFrame:
        """(g, s, n), several rows for a score of several batches."""
        upto, batches = self._numbers()
        paths = [f"{self.path}/sums/{x}" for x in ([f"upto={upto}"] if upto >= 0 else []) + [f"batch={n}" for n in batches]]
        return self.spark.read.schema(self._sums_schema).parquet(*paths) if paths else self.spark.createDataFrame([], self._sums_schema)

    def append(self, scores: DataFrame, batch: int) -> bool:
        """Adds a batch; False, and nothing is done, if this batch or a later one was added before.

        Places in the batch come from counts by group and range of order, so a group of any size is spread over the ranges.
        """
        if batch < 0:
            raise ValueError("batches are numbered from 0")
        upto, batches = self._numbers()
        if batch <= max([upto, *batches]):
            return False
        given = scores.select(*(F.col(f"`{c}`").alias(x) for c, x in ((self.group, "g"), (self.order, "at"), (self.score, "s"))))
        given.write.mode("overwrite").parquet(f"{self.path}/stage/batch={batch}")
        given = self.spark.read.schema(given.schema).parquet(f"{self.path}/stage/batch={batch}")
        rows = given.select(F.struct("g").alias("g"), "at", "s", ranges(given, "at")[0].alias("part"))
        before = self._sums().groupBy(F.struct("g").alias("g")).agg(F.sum("n").alias("base"))
        counts = rows.groupBy("g", "part").agg(F.count("*").alias("n"))
        earlier = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        lifts = counts.select("g", "part", earlier.alias("lift")).join(before, "g", "left").select("g", "part", (F.col("lift") + F.coalesce("base", F.lit(0))).alias("lift"))
        inside = F.row_number().over(Window.partitionBy("g", "part").orderBy("at")) - 1
        placed = rows.withColumn("inside", inside).join(lifts, ["g", "part"]).select(F.col("g.g").alias("g"), (F.col("inside") + F.col("lift")).cast("long").alias("place"), "s")
        placed.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        given.groupBy("g", "s").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.path}/sums/batch={batch}")
        shared.remove(self.spark, f"{self.path}/stage/batch={batch}")
        return True

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: a batch that a restarted stream sends again is added once."""
        return lambda scores, batch: (self.append(scores, batch), None)[1]

    def compact(self) -> int:
        """Adds up the sums of all batches into one table and removes those that it has; its number (-1: there is nothing yet). Readers that began before must have ended."""
        upto, batches = self._numbers()
        if batches:
            self._sums().groupBy("g", "s").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{self.path}/sums/upto={batches[-1]}")
            for name in ([f"upto={upto}"] if upto >= 0 else []) + [f"batch={n}" for n in batches]:
                shared.remove(self.spark, f"{self.path}/sums/{name}")
        return max([upto, *batches])

    def read(self, limit: float = 0.2) -> DataFrame:
        """One row for each group: final_score, agreement, n_scores, outliers, as `consensus` gives over all rows (sums in another order, so to rounding)."""
        sums = self._sums().groupBy(F.struct("g").alias("g"), "s").agg(F.sum("n").alias("n"))
        valid, total = F.sum(F.when(F.col("s").isNotNull(), F.col("n"))), F.sum(F.col("s") * F.col("n"))
        means = sums.groupBy("g").agg((total / F.nullif(valid, F.lit(0))).alias("mean"))
        far = F.abs(F.col("s") - F.col("mean"))
        near = F.when(far <= limit, F.col("n"))
        merged = sums.join(means, "g").groupBy("g").agg(
            F.coalesce(F.sum(F.col("s") * near) / F.nullif(F.sum(near), F.lit(0)), F.first("mean")).alias("final_score"), (1 - F.least(F.max(far) / limit, F.lit(1.0))).alias("agreement"), F.sum("n").alias("n_scores"),
        )
        upto, batches = self._numbers()
        numbers = [n for n in shared.finished(self.spark, f"{self.path}/rows") if n <= max([upto, *batches])]
        rows = self.spark.read.schema(self._rows_schema).parquet(*(f"{self.path}/rows/batch={n}" for n in numbers)) if numbers else self.spark.createDataFrame([], self._rows_schema)
        places = rows.where(F.col("s").isNotNull()).withColumn("g", F.struct("g")).join(means, "g").where(far > limit).groupBy("g").agg(F.array_sort(F.collect_list(F.col("place").cast("int"))).alias("outliers"))
        out = merged.join(places, "g", "left")
        return out.select(F.col("g.g").alias(self.group), "final_score", "agreement", "n_scores", F.coalesce("outliers", F.array().cast("array<int>")).alias("outliers"))
