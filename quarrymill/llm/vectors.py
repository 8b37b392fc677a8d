"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

A vector of unit length is rotated by three rounds of random signs and a Hadamard transform; its hash is the signed axis
that is nearest. A bucket is a pair of such hashes; TABLES of them, with the PROBES nearest pairs of each, give a vector's buckets. Vectors that
share a bucket are compared by their exact cosine in double precision. A pair counts in the smallest bucket that it shares,
so counts need no list of pairs.

Copies of a vector are collapsed first and enter as a number. What is dealt to buckets are sketches of 8 bits a component with a bound of their error; only vectors that a
sketch in the same bucket may be near to are then sent there whole, as they were read. Buckets are worked on in blocks of at most BLOCK vectors: a larger
bucket is dealt into groups, and each pair of groups is a task of its own, so every pair is compared and no task or
row of output grows with a bucket. A block gives, for each of its vectors, how many it links to and one link that joins it to its component
in the block: never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from . import components as cc
from . import scratch

TABLES, PROBES, BLOCK = 4, 6, 1024


def _kind(d: int) -> tuple[int, np.dtype]:
    """Bits of an axis in the number of a bucket, and how such numbers are packed."""
    size = max(2, 1 << (d - 1).bit_length())
    bits = (2 * size - 1).bit_length()
    return bits, np.dtype("<u4" if 2 * bits + (TABLES - 1).bit_length() <= 32 else "<i8")


def _unit(x: np.ndarray) -> np.ndarray:
    """The rows of x, none of them zero, at length 1."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _sketch(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(8-bit components, scale, length of the error) of each row."""
    scale = (np.abs(unit).max(axis=1) / 127).astype(np.float32)
    q = np.rint(unit / scale[:, None].astype(np.float64)).clip(-127, 127).astype(np.int8)
    error = unit - q * scale[:, None].astype(np.float64)
    return q, scale, np.nextafter(np.sqrt((error * error).sum(axis=1)).astype(np.float32), np.float32(1))


def _may_link(q: np.ndarray, scale: np.ndarray, error: np.ndarray, side: np.ndarray, across: bool, least: float) -> np.ndarray:
    """Which vectors of a block may have a cosine of `least` with another: none that has is left out. across: only pairs of different sides count."""
    x, e = q.astype(np.float32) * scale[:, None], error.astype(np.float64)
    most = x @ x.T + 1e-4 + e[:, None] * (1 + e) + e * (1 + e[:, None]) + e[:, None] * e
    near = most >= least
    np.fill_diagonal(near, False)
    if across:
        near &= side[:, None] != side
    return near.any(axis=1)


def _tasks(batches: Iterator[pa.RecordBatch], rows: int = 1 << 12) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole tasks, of about `rows` rows, from batches in order of task, with begin and end of each task of two rows or more."""

    def cut(held: list[pa.RecordBatch]) -> tuple[pa.Table, list[tuple[int, int]]]:
        t = pa.Table.from_batches(held)
        ids = t["task"].to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))).tolist()
        return t, [(a, b) for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True) if b - a > 1]

    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(batch.schema.get_field_index("task")).to_numpy()
        if held and size > rows:
            # what is held ends where the last task that it has ends
            stay = int(np.searchsorted(ids != last, True)) if ids[0] == last else 0
            if stay < len(ids):
                if stay:
                    held.append(batch.slice(0, stay))
                yield cut(held)
                held, size, batch = [], 0, batch.slice(stay)
        held.append(batch)
        size += batch.num_rows
        last = ids[-1]
    if held:
        yield cut(held)


def _signs(size: int, table: int, part: int) -> np.ndarray:
    return np.random.default_rng((size, table, part, 20)).choice(np.array([-1.0, 1.0]), (3, size))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, unit scale."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def buckets(x: np.ndarray) -> np.ndarray:
    """TABLES * PROBES buckets of each row of unit vectors, as numbers that name table and axes."""
    rows, d = x.shape
    size = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((rows, size))
    padded[:, :d] = x
    near, bits = min(size, 3), _kind(d)[0]
    out = []
    for table in range(TABLES):
        axes, loss = [], []
        for part in range(2):
            y = padded
            for s in _signs(size, table, part):
                y = _hadamard(y * s)
            big = np.abs(y)
            top = np.argsort(-big, axis=1, kind="stable")[:, :near]
            value = np.take_along_axis(big, top, 1)
            axes.append(2 * top + (np.take_along_axis(y, top, 1) < 0))
            loss.append((value[:, :1] - value) ** 2)
        total = (loss[0][:, :, None] + loss[1][:, None, :]).reshape(rows, -1)
        pick = np.argsort(total, axis=1, kind="stable")[:, :PROBES]
        a, b = np.take_along_axis(axes[0], pick // near, 1), np.take_along_axis(axes[1], pick % near, 1)
        out.append((np.int64(table) << 2 * bits) | (a.astype(np.int64) << bits) | b)
    return np.concatenate(out, axis=1)


def _block(x: np.ndarray, keys: np.ndarray, weight: np.ndarray, bucket: int, group: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each vector, least vector of its part of the block). group: 0 or 1 where two groups meet and only pairs across count, else 0 for all."""
    cos = x @ x.T
    across = bool(group.any())
    a, b = np.nonzero(np.triu(cos >= least, 1))
    if across:
        use = group[a] != group[b]
        a, b = a[use], b[use]
    links, root = np.zeros(len(x), np.int64), np.arange(len(x))
    step = 1 << 12
    keep_a, keep_b = [], []
    for i in range(0, a.size, step):
        ka, kb = keys[a[i : i + step]], keys[b[i : i + step]]
        shared = np.where((ka[:, :, None] == kb[:, None, :]).any(axis=2), ka, np.iinfo(np.int64).max).min(axis=1) == bucket
        keep_a.append(a[i : i + step][shared])
        keep_b.append(b[i : i + step][shared])
    if a.size:
        a, b = np.concatenate(keep_a), np.concatenate(keep_b)
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
    return links, root


def usable(vector: Column) -> Column:
    """Not null, not zero, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def near_duplicates(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """(key, n_links, component_id, kept) for every row: links are pairs of rows with equal labels and cosine >= least.

    Every link is verified, none below `least` is made; a pair that shares none of its buckets is missed (recall is measured in
    the tests). Rows whose vector is unusable (null, zero, null or non-finite components), whose label is null or whose key is
    null link with nothing: n_links 0, component_id the own key, kept true (null and false for a null key).
    Vectors of different lengths don't link. Repeated rows are other vectors; other columns are ignored, whatever their names. An empty table gives an empty one.
    """
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), F.col(label).alias("l"))
    good = usable(F.col("x")) & F.col("l").isNotNull() & F.col("id").isNotNull()
    # 0.0 + x turns -0.0 into 0.0; equal doubles have equal texts
    marked = rows.select("id", "l", F.when(good, F.transform("x", lambda v: v + F.lit(0.0))).alias("x")).withColumn("same", F.when(F.col("x").isNotNull(), F.sha2(F.concat_ws(",", F.col("x").cast("array<string>")), 256)))
    marked = scratch.save(marked, "vectors")
    copies = marked.where(F.col("x").isNotNull()).groupBy("l", "same").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.any_value("x").alias("x"))
    copies = scratch.save(copies, "copies")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(2)
            lengths = np.diff(np.asarray(x.offsets))
            flat = np.asarray(x.flatten())
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                whole = flat[starts[at][:, None] + np.arange(d)]
                own = _unit(whole)
                keys, (q, scale, error) = buckets(own), _sketch(own)
                carried = [batch.column(i).take(pa.array(at)) for i in (0, 1, 3)]
                made = [*(pa.array([r.tobytes() for r in m], pa.binary()) for m in (whole.astype(raw_kind), keys.astype(_kind(d)[1]), q)), pa.array(scale), pa.array(error), pa.array(list(keys), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(carried + made, names=["rep", "n", "l", "raw", "all", "q", "scale", "error", "keys"])

    # components are packed as they were read
    raw_kind = np.dtype("<f4" if isinstance(table.schema[vector].dataType.elementType, FloatType) else "<f8")
    schema = f"rep bigint, n bigint, l {copies.schema['l'].dataType.simpleString()}, raw binary, `all` binary, q binary, scale float, error float, keys array<bigint>"
    units = scratch.save(copies.select("rep", "n", "x", "l").mapInArrow(hashed, schema), "units")
    cells = units.select("rep", "l", F.octet_length("raw").alias("d"), F.explode("keys").alias("bucket"))
    sizes = cells.groupBy("l", "d", "bucket").agg(F.count("*").alias("size")).where("size > 1").withColumn("groups", F.ceil(F.col("size") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("rep", "bucket"), F.col("groups")).cast("int")
    tasks = cells.join(sizes, ["l", "d", "bucket"]).withColumn("own", own).select("rep", "l", "d", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("other"))
    task = F.xxhash64("l", "d", "bucket", F.least("own", "other"), F.greatest("own", "other"))
    tasks = tasks.select("rep", "bucket", task.alias("task"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), (F.col("own") != F.col("other")).alias("across"))
    sketched = tasks.join(units.select("rep", "q", "scale", "error"), "rep").repartition("task").sortWithinPartitions("task", "rep")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _tasks(batches):
            q, scale, error, side, across = t["q"].to_pylist(), *(t[k].to_numpy() for k in ("scale", "error", "side", "across"))
            use = np.zeros(len(t), bool)
            for a, b in cuts:
                x = np.frombuffer(b"".join(q[a:b]), np.int8).reshape(b - a, -1)
                use[a:b] = _may_link(x, scale[a:b], error[a:b], side[a:b], bool(across[a]), least)
            yield from t.select(["rep", "bucket", "task", "side", "across"]).filter(pa.array(use)).combine_chunks().to_batches()

    left = scratch.save(sketched.select("rep", "bucket", "task", "side", "across", "q", "scale", "error").mapInArrow(sift, "rep bigint, bucket bigint, task bigint, side int, across boolean"), "left")
    placed = left.join(units.select("rep", "n", "raw", "all"), "rep").repartition("task").sortWithinPartitions("task", "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _tasks(batches):
            rep, n, bucket, side, across = (t[k].to_numpy() for k in ("rep", "n", "bucket", "side", "across"))
            raw, keys = t["raw"].to_pylist(), t["all"].to_pylist()
            out: list[tuple[np.ndarray, ...]] = []
            for a, b in cuts:
                x = _unit(np.frombuffer(b"".join(raw[a:b]), raw_kind).reshape(b - a, -1).astype(np.float64))
                k = np.frombuffer(b"".join(keys[a:b]), _kind(x.shape[1])[1]).reshape(b - a, -1).astype(np.int64)
                links, root = _block(x, k, n[a:b], bucket[a], side[a:b] if across[a] else np.zeros(b - a, np.int32), least)
                hit = np.flatnonzero(links)
                if hit.size:
                    out.append((rep[a:b][hit], links[hit], rep[a:b][root[hit]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], names=["u", "links", "v"])

    found = scratch.save(placed.select("rep", "n", "bucket", "task", "side", "across", "raw", "all").mapInArrow(compare, "u bigint, links bigint, v bigint"), "links")
    roots = cc.components(found.select("u", "v"))
    counts = found.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    known = copies.select("l", "same", "rep", "n").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select(F.col("l").alias("kl"), F.col("same").alias("ks"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    return (
        marked.join(known, (F.col("l") == F.col("kl")) & (F.col("same") == F.col("ks")), "left")
        .select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
    )
