"""Clusters around centroids: Lloyd's rounds over integer vectors, each vector's nearest centroid found by Exponion search.

A vector keeps its centroid, an upper bound of the distance to it and a lower bound of that to any other. Where the upper
bound is below the lower one, or below half the way from its centroid to the next one, the vector stays unseen. Else the
upper bound is made exact, and if that doesn't do, only centroids inside a ball around its own are measured: of radius twice the
bound plus the way to the next centroid, taken as a prefix of the list of the other centroids sorted by distance. The radius is inclusive and
widened by more than rounding can cost, and distances are compared as integers, so ties fall to the smaller number.

Vectors are written once, packed in blocks; bounds are a table of their own for each round, in the same buckets by block, so a
round reads both without a shuffle and writes 20 bytes a vector. Sums change by the vectors that moved. What goes through the
driver is k * dim numbers a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Rows of a block; bytes of vectors in a bucket at most, if blocks are full.
BLOCK, BUCKET_BYTES = 4096, 64 << 20
#: Components lie below this, so that 2**8 squares of differences fit in 64 bits.
MOST = 1 << 27
#: Bytes of centroids at most: they are sent to every task.
MOST_CENTROIDS = 256 << 20
#: Bounds are widened by more than any rounding of square roots and sums.
UP, DOWN = 1 + 1e-9, 1 - 1e-9


class Centroids:
    """k centroids (int64) and for each of them the others by distance, made when first asked for."""

    def __init__(self, values: np.ndarray) -> None:
        self.values, self._around = values, {}
        next_one = np.full(len(values), np.inf)
        for j in range(len(values) if len(values) > 1 else 0):
            next_one[j] = np.sqrt(np.delete(squares(values, values[j]), j).min())
        self.next_one = next_one

    def around(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, distances) of the other centroids, nearest first."""
        if j not in self._around:
            far = np.sqrt(squares(self.values, self.values[j]))
            order = np.argsort(far, kind="stable")
            order = order[order != j]
            self._around[j] = order, far[order]
        return self._around[j]


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x from y (one row, or one each)."""
    z = x - y
    return np.einsum("ij,ij->i", z, z)


def search(x: np.ndarray, of: Centroids, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(nearest centroid, upper bound, lower bound) of each row of x from those of the round before, and how many distances were measured."""
    near, upper, lower = near.copy(), upper.copy(), lower.copy()
    safe = lambda i: upper[i] * UP < np.maximum(lower[i], of.next_one[near[i]] / 2) * DOWN
    rows = np.flatnonzero(~safe(slice(None)))
    own = squares(x[rows], of.values[near[rows]])
    measured = len(rows)
    upper[rows] = np.sqrt(own)
    open_ = ~safe(rows)
    rows, least = rows[open_], own[open_]
    best, second = near[rows].copy(), np.full(len(rows), np.iinfo(np.int64).max)
    for c in np.unique(near[rows]).tolist():
        mine = np.flatnonzero(near[rows] == c)
        order, far = of.around(c)
        count = np.searchsorted(far, (2 * upper[rows[mine]] + of.next_one[c]) * UP, side="right") if len(order) else np.zeros(len(mine), int)
        for r in range(count.max(initial=0)):
            at, j = mine[count > r], int(order[r])
            d = squares(x[rows[at]], of.values[j])
            measured += len(at)
            closer = (d < least[at]) | (d == least[at]) & (j < best[at])
            second[at] = np.where(closer, least[at], np.minimum(second[at], d))
            least[at], best[at] = np.where(closer, d, least[at]), np.where(closer, j, best[at])
    near[rows], upper[rows] = best, np.sqrt(least)
    lower[rows] = np.where(second == np.iinfo(np.int64).max, np.inf, np.sqrt(second))
    return near, upper, lower, measured


def loosened(near: np.ndarray, upper: np.ndarray, lower: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds after the centroids went `moves` far: the vector's own centroid may be farther, any other nearer."""
    most = int(moves.argmax())
    others = np.where(near == most, np.delete(moves, most).max(initial=0), moves[most])
    return upper * UP + moves[near] * UP, lower * DOWN - others * UP


def _blocks(dim: int, scale: int, seed: int, k: int):
    """Rows (key, vector) into packed blocks of integer vectors, with the k rows whose hash is least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, list]] = []
        n = 0

        def block(rows: np.ndarray, keys: list, wide: list) -> pa.RecordBatch:
            nonlocal number
            hashes = sorted((hashlib.sha256(f"{seed}:{key}".encode()).hexdigest(), x.tobytes()) for key, x in zip(keys, rows, strict=True) if key is not None)[:k]
            number += 1
            columns = [pa.array([number], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([rows.astype("<i4").tobytes()], pa.binary()), pa.array([wide], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([[{"hash": h, "x": x} for h, x in hashes]], pa.list_(pa.struct([("hash", pa.string()), ("x", pa.binary())])))], names=["block", "keys", "xs", "wide", "starts"])

        wide: list = []
        for batch in batches:
            vectors = batch.column(1)
            whole = np.flatnonzero(np.asarray(vectors.value_lengths().fill_null(-1)) == dim)
            vectors, keys = vectors.take(pa.array(whole)), batch.column(0).take(pa.array(whole)).to_pylist()
            rows = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), dim))
            fine = np.isfinite(rows).all(axis=1)
            fits = (np.abs(np.where(np.isfinite(rows), rows, np.inf)) < MOST).all(axis=1)
            wide += [keys[i] for i in np.flatnonzero(fine & ~fits).tolist()]
            held.append((rows[fits].astype(np.int64), [keys[i] for i in np.flatnonzero(fits).tolist()]))
            n += int(fits.sum())
            if n >= BLOCK:
                rows, keys = np.concatenate([x for x, _ in held]), [key for _, of in held for key in of]
                full = n - n % BLOCK
                for i in range(0, full, BLOCK):
                    yield block(rows[i : i + BLOCK], keys[i : i + BLOCK], wide)
                    wide = []
                held, n = [(rows[full:], keys[full:])], n - full
        if n or wide:
            yield block(np.concatenate([x for x, _ in held]), [key for _, of in held for key in of], wide)

    return run


def _round(dim: int, values: np.ndarray, moves: np.ndarray | None, last: bool):
    """Blocks with their bounds (none in the first round) to the bounds after this round, or to rows (key, cluster, distance) after the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Centroids(values)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                x = np.frombuffer(row["xs"], "<i4").astype(np.int64).reshape(-1, dim)
                if moves is None:
                    before, near = np.full(len(x), -1), np.zeros(len(x), np.int64)
                    upper, lower = np.full(len(x), np.inf), np.zeros(len(x))
                else:
                    before = near = np.frombuffer(row["near"], "<i4").astype(np.int64)
                    upper, lower = loosened(near, np.frombuffer(row["upper"], "<f8"), np.frombuffer(row["lower"], "<f8"), moves)
                near, upper, lower, _ = search(x, of, near, upper, lower)
                if last:
                    own = squares(x, of.values[near])
                    yield pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.int64()), pa.array(near, pa.int32()), pa.array(own, pa.int64())], names=["key", "cluster", "distance"])
                    continue
                moved = before != near
                changes = []
                for c in np.union1d(before[moved], near[moved]).tolist():
                    came, went = moved & (near == c), moved & (before == c)
                    if c >= 0:
                        changes.append({"cluster": c, "total": [int(came.sum()) - int(went.sum()), *(x[came].sum(axis=0) - x[went].sum(axis=0)).tolist()]})
                columns = [pa.array([row["block"]], pa.int64()), *(pa.array([v.astype(t).tobytes()], pa.binary()) for v, t in ((near, "<i4"), (upper, "<f8"), (lower, "<f8")))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([changes], pa.list_(pa.struct([("cluster", pa.int32()), ("total", pa.list_(pa.int64()))])))], names=["block", "near", "upper", "lower", "moved"])

    return run


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256) for every vector that is kept.

    Kept are vectors with exactly dim components, none null or non-finite (also after the scale); each component x counts as floor(scale * x). Centroids start as the
    k vectors of least sha256 of "seed:key" (ties of repeated keys by their packed components; a null key starts none; fewer vectors give fewer centroids). `rounds` times all vectors
    are assigned, ties to the smaller number, and every centroid that has vectors becomes their componentwise floor of the mean, exactly; then they are assigned once more.
    distance is squared; inertias are sums of it over the cluster and over all, null beyond a long. A kept vector with a component of 2**27 or more, whose squares a long can't
    hold, is in no cluster (cluster to centroid_sha256 null, inertia given), as are all without a centroid. Null and repeated keys are rows of their own. Null vectors and those of other lengths give no row; an empty table gives none.
    Columns besides the two are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    if dim > 256 or k * dim * 8 > MOST_CENTROIDS:
        raise ValueError(f"at most 256 components and {MOST_CENTROIDS} bytes of centroids")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() * dim * 4 // BUCKET_BYTES))
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{vector}`").alias("vector"))
    blocks = scratch.save_buckets(rows.mapInArrow(_blocks(dim, scale, seed, k), "block bigint, keys array<bigint>, xs binary, wide array<bigint>, starts array<struct<hash:string,x:binary>>"), "vector_blocks", "block", buckets)
    starts = blocks.select(F.explode("starts").alias("s")).orderBy("s.hash", "s.x").limit(k).collect()
    values = np.array([np.frombuffer(r["s"]["x"], "<i8") for r in starts], np.int64).reshape(-1, dim)
    wide = blocks.select(F.explode("wide").alias("key"), F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    if not len(values):
        own = blocks.select(F.explode("keys").alias("key"), F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
        return _named(scratch.save(own.union(wide), "assigned"), [], key)
    packed, bounds, moves = blocks.select("block", "xs"), None, None
    totals = [[0] * (dim + 1) for _ in values]
    for _ in range(rounds):
        met = packed if bounds is None else packed.join(bounds.select("block", "near", "upper", "lower"), "block")
        new = scratch.save_buckets(met.mapInArrow(_round(dim, values, moves, False), "block bigint, near binary, upper binary, lower binary, moved array<struct<cluster:int,total:array<bigint>>>"), "vector_bounds", "block", buckets)
        if bounds is not None:
            scratch.drop(bounds)
        bounds = new
        # k * (dim + 1) rows at most
        changes = bounds.select(F.explode("moved").alias("m")).select("m.cluster", F.posexplode("m.total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        for r in changes.collect():
            totals[r["cluster"]][r["at"]] += int(r["x"])
        moved = np.array([[x // n for x in total] if n else old.tolist() for (n, *total), old in zip(totals, values, strict=True)], np.int64).reshape(-1, dim)
        moves, values = np.sqrt(squares(moved, values)), moved
    met = blocks.select("block", "xs", "keys") if bounds is None else blocks.select("block", "xs", "keys").join(bounds.select("block", "near", "upper", "lower"), "block")
    assigned = scratch.save(met.mapInArrow(_round(dim, values, moves, True), "key bigint, cluster int, distance bigint").union(wide), "assigned")
    scratch.drop(blocks, *([bounds] if bounds is not None else []))
    return _named(assigned, [",".join(map(str, x)) for x in values.tolist()], key)


def _named(assigned: DataFrame, centroids: list[str], key: str) -> DataFrame:
    """assigned with what is known of each cluster: one row for each of the k centroids, joined by broadcast."""
    sums = {r["cluster"]: int(r["x"]) for r in assigned.where("cluster IS NOT NULL").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    long = lambda x: x if x < 1 << 63 else None
    rows = [(c, long(sums.get(c, 0)), hashlib.sha256(text.encode()).hexdigest()) for c, text in enumerate(centroids)]
    of = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of), "cluster", "left").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", F.lit(long(sum(sums.values()))).cast("long").alias("inertia"), "centroid_sha256")
