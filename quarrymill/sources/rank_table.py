"""A leaderboard as a table of files that batches of scores keep up to date: rows in ranges of their order, of which a batch rewrites those that it touches.

    ranges/batch=N/part=P/  rows that batch N placed in a range: keys, score, ord, seq, and their place in the range
    manifests/batch=N/      the ranges after batch N, in order: first score and ord, number of rows, and which batch wrote them under which part

A row's rank is its place in its range and the rows of the ranges before it, so reading ranks neither sorts nor shuffles. The manifest is written last: a batch that was cut off is
done anew, one that was done does nothing. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cmp_to_key
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions.scalars import free

from . import shared
from .state_table import fold

#: Ranges at most, and rows of the sample for each new one.
RANGES, SAMPLE = 512, 40


def _earlier(a: tuple, b: tuple) -> int:
    """Order of (score, ord): highest score first, NaN above all, then ord."""
    number = lambda x: (x != x, 0 if x != x else x)
    if number(a[0]) != number(b[0]):
        return -1 if number(a[0]) > number(b[0]) else 1
    return (a[1] > b[1]) - (a[1] < b[1])


def _place(bounds: list[tuple]) -> Column:
    """How many of the sorted bounds (score, ord) a row's lie at or after, as a tree of comparisons."""

    def part(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        score, at = (F.lit(x) for x in bounds[middle])
        reached = (F.col("score") < score) | ((F.col("score") == score) & (F.col("ord") >= at))
        return F.when(reached, part(middle + 1, high)).otherwise(part(low, middle))

    return part(0, len(bounds))


class RankTable:
    """Ranks under a path: keys, score and seq are of the kinds in `schema`; other names than score, ord, seq, place, part, batch and rank for the keys.

    A change gives a key a score; a null score deletes the key. A key keeps the seq of its first change since its last deletion as ord, and ranks go by score, highest first (NaN above
    all), then ord, then key: as `ranked` over the folded log. Null keys are keys, changes without seq are none; of changes of one key and seq a deletion counts, else the largest score.
    Each batch must be newer by seq than all before it, else append raises.

    Ranges of more than `most` rows are parted by a sample of their rows while there are fewer than 512; rows of one score and one ord stay together. Beyond 512 ranges grow.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], score: str = "score", seq: str = "seq", most: int = 1_000_000) -> None:
        kinds = {f.name: f.dataType for f in T._parse_datatype_string(schema).fields}
        self.spark, self.path, self.keys, self.score, self.seq, self.most = spark, path.rstrip("/"), keys, score, seq, most
        if taken := {k.lower() for k in keys} & {"score", "ord", "seq", "value", "place", "part", "batch", "rank"}:
            raise ValueError(f"keys can't be named {sorted(taken)}")
        own, at = [T.StructField(k, kinds[k]) for k in keys], kinds[seq]
        self._rows_schema = T.StructType([*own, T.StructField("score", kinds[score]), T.StructField("ord", at), T.StructField("seq", at), T.StructField("place", T.LongType()), T.StructField("batch", T.IntegerType()), T.StructField("part", T.IntegerType())])
        self._manifest_schema = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("score", kinds[score]), T.StructField("ord", at), T.StructField("n", T.LongType()), T.StructField("batch", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("newest", at)])

    def _manifest(self) -> tuple[int, Any, list[Row]]:
        """The last batch (-1: none), its newest seq, and the ranges in order (512 at most). A table without rows has one row with n = 0, which isn't a range."""
        batch = max(shared.finished(self.spark, f"{self.path}/manifests"), default=-1)
        if batch < 0:
            return -1, None, []
        found = sorted(self.spark.read.schema(self._manifest_schema).parquet(f"{self.path}/manifests/batch={batch}").collect(), key=lambda r: r["pos"])
        return batch, found[0]["newest"], [r for r in found if r["n"]]

    def _rows(self, parts: list[Row]) -> DataFrame:
        """The rows of some ranges, with batch and part."""
        if not parts:
            return self.spark.createDataFrame([], self._rows_schema)
        base = f"{self.path}/ranges"
        return self.spark.read.schema(self._rows_schema).option("basePath", base).parquet(*(f"{base}/batch={r['batch']}/part={r['part']}" for r in parts))

    def append(self, changes: DataFrame, batch: int) -> bool:
        """Folds a batch of changes (keys, score, seq) into the ranks; False, and nothing is done, if this batch or a later one was done before."""
        last, newest, parts = self._manifest()
        if batch < 0:
            raise ValueError("batches are numbered from 0")
        if batch <= last:
            return False
        stage, at = f"{self.path}/stage/batch={batch}", F.col(f"`{self.seq}`")
        score = F.col(f"`{self.score}`")
        # written once: what is read below can't change between two reads, and has a size that the planner knows
        once = changes.where(at.isNotNull()).groupBy(*(F.col(f"`{k}`") for k in self.keys), at.alias("seq")).agg(F.when(~F.bool_or(score.isNull()), F.max(score)).alias("value"))
        once.write.mode("overwrite").parquet(f"{stage}/changes")
        new = self.spark.read.schema(once.schema).parquet(f"{stage}/changes")
        span = new.agg(F.min("seq").alias("oldest"), F.max("seq").alias("newest")).first()
        if newest is not None and span["oldest"] is not None and span["oldest"] <= newest:
            raise ValueError(f"a change at {span['oldest']} is older than the table, which ends at {newest}")

        own = free(self.keys, "_key")
        packed, changed = F.struct(*self.keys), new.select(F.struct(*self.keys).alias(own)).distinct()
        old = self._rows(parts).withColumn(own, packed).join(changed, own, "left_semi").select(*self.keys, F.col("score").alias("value"), "ord", "seq", "batch", "part")
        old.write.mode("overwrite").parquet(f"{stage}/old")
        old = self.spark.read.schema(old.schema).parquet(f"{stage}/old")
        rows = fold(old.drop("batch", "part").unionByName(new.withColumn("ord", F.col("seq"))), self.keys).withColumnRenamed("value", "score")
        rows.write.mode("overwrite").parquet(f"{stage}/rows")
        rows = self.spark.read.schema(rows.schema).parquet(f"{stage}/rows")

        bounds = [(r["score"], r["ord"]) for r in parts[1:]]
        where = {(r["batch"], r["part"]): i for i, r in enumerate(parts)}
        left = {where[r["batch"], r["part"]]: r["count"] for r in old.groupBy("batch", "part").count().collect()}
        come = {r["pos"]: r["count"] for r in rows.groupBy(_place(bounds).alias("pos")).count().collect()}
        touched = sorted(left.keys() | come.keys())
        sizes = {i: (parts[i]["n"] if parts else 0) - left.get(i, 0) + come.get(i, 0) for i in touched}
        stay = self._rows([parts[i] for i in touched] if parts else []).withColumn(own, packed).join(changed, own, "left_anti")
        merged = stay.select(*rows.columns).unionByName(rows)
        bounds = sorted({*bounds, *self._new_bounds(merged, bounds, sizes, max(1, len(parts)))}, key=cmp_to_key(_earlier))

        order = [F.desc("score"), F.asc("ord"), *(F.asc(k) for k in self.keys)]
        placed = merged.withColumn("part", _place(bounds)).withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long"))
        target = f"{self.path}/ranges/batch={batch}"
        placed.write.mode("overwrite").partitionBy("part").parquet(target)
        counts = {}
        if any(sizes.values()):
            # named in full: the partition column isn't in the files
            wrote = self.spark.read.schema(T.StructType([f for f in self._rows_schema if f.name != "batch"])).parquet(target)
            counts = {r["part"]: r["count"] for r in wrote.groupBy("part").count().collect()}
        kept = [(r["score"] if i else None, r["ord"] if i else None, r["n"], r["batch"], r["part"]) for i, r in enumerate(parts) if i not in sizes]
        made = [(*(bounds[p - 1] if p else (None, None)), n, batch, p) for p, n in counts.items()]
        # a range without lower bound is the first; without rows it goes, and the first that has some takes its place
        whole = sorted(kept + made, key=cmp_to_key(lambda a, b: -1 if a[1] is None else 1 if b[1] is None else _earlier(a, b)))
        end = span["newest"] if span["newest"] is not None else newest
        manifest = [(i, *row, end) for i, row in enumerate(whole)] or [(0, None, None, 0, batch, 0, end)]
        self.spark.createDataFrame(manifest, self._manifest_schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/batch={batch}")
        shared.remove(self.spark, stage)
        return True

    def _new_bounds(self, merged: DataFrame, bounds: list[tuple], sizes: dict[int, int], n_parts: int) -> list[tuple]:
        """What parts the ranges that are too large: quantiles of a sample of about SAMPLE rows for each new range."""
        large = {i: n for i, n in sizes.items() if n > self.most}
        room = RANGES - n_parts
        if not large or room <= 0:
            return []
        total = sum(large.values())
        share = min(1.0, SAMPLE * min(room + 1, -(-2 * total // self.most)) / total)
        rows = merged.select(_place(bounds).alias("pos"), "score", "ord").where(F.col("pos").isin(*large))
        found: dict[int, list[tuple]] = {}
        for r in (rows if share == 1 else rows.sample(share, seed=1)).collect():
            found.setdefault(r["pos"], []).append((r["score"], r["ord"]))
        out = []
        for i, seen in found.items():
            seen.sort(key=cmp_to_key(_earlier))
            pieces = 1 + min(-(-2 * large[i] // self.most) - 1, room * large[i] // total)
            out += [seen[len(seen) * j // pieces] for j in range(1, pieces)]
        return out

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: a batch that a restarted stream sends again is folded once."""
        return lambda changes, batch: (self.append(changes, batch), None)[1]

    def _ranked(self, wanted: Callable[[int, int], bool]) -> DataFrame:
        """(keys, score, ord, rank) of the ranges that hold a wanted (first rank, last rank)."""
        above, chosen, lifts = 0, [], []
        for r in self._manifest()[2]:
            if wanted(above + 1, above + r["n"]):
                chosen.append(r)
                lifts.append((r["batch"], r["part"], above))
            above += r["n"]
        lifted = self.spark.createDataFrame(lifts, "batch int, part int, above long")
        rows = self._rows(chosen).join(F.broadcast(lifted), ["batch", "part"])  # 512 rows at most
        return rows.select(*self.keys, F.col("score").alias(self.score), "ord", (F.col("above") + F.col("place")).alias("rank"))

    def ranks(self) -> DataFrame:
        """All keys with score, ord and rank; no sort, no shuffle."""
        return self._ranked(lambda first, last: True)

    def top(self, n: int, offset: int = 0) -> DataFrame:
        """Ranks offset + 1 to offset + n, in order. Only ranges that hold them are read."""
        rows = self._ranked(lambda first, last: first <= offset + n and last > offset)
        return rows.where(F.col("rank").between(offset + 1, offset + n)).orderBy("rank")

    def vacuum(self) -> int:
        """Removes older manifests and ranges that the newest doesn't name; how many. Readers that began before must have ended."""
        batch, _, parts = self._manifest()
        if batch < 0:
            return 0
        live = {(r["batch"], r["part"]) for r in parts}
        gone = [f"manifests/batch={n}" for n in shared.finished(self.spark, f"{self.path}/manifests") if n < batch]
        for wrote in shared.children(self.spark, f"{self.path}/ranges"):
            n = int(wrote.partition("=")[2])
            held = [p for p in shared.children(self.spark, f"{self.path}/ranges/{wrote}") if p.startswith("part=")]
            dead = [p for p in held if (n, int(p.partition("=")[2])) not in live]
            if n <= batch:
                gone += [f"ranges/{wrote}"] if len(dead) == len(held) else [f"ranges/{wrote}/{p}" for p in dead]
        for name in gone:
            shared.remove(self.spark, f"{self.path}/{name}")
        return len(gone)
