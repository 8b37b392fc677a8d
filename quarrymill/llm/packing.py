"""Documents packed into full windows of several sizes, without padding.

Windows are of the powers of two up to `window`; those from `least` on are the tiers. A document's whole windows of the largest
size are cut off first. What is left of it is routed to the smallest tier that holds it. Tiers are packed from the largest down: the longest piece
left opens a window of its tier, and the gap, less than half of the window, is filled with the longest pieces
of shorter tiers that fit; where none does, one longer piece is cut there and its rest routed anew. So a window is always full, and has at most one cut
of this kind. What is left in the end of a task, less than one window, goes to windows of the powers of two that add up to it.

Every task packs its own documents as they are read: ids are never shuffled, and a task holds HELD pending ids at most beside one document. Steps are groups of windows of
one size that have the same number of ids (all but the last of a size); steps of the sizes are spread evenly over one another, so any stretch of
steps has about the same mix of sizes.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, workers

#: Ids and pieces that a task packs at a time.
HELD, PIECES = 1 << 20, 1 << 14
#: Sequences in a batch of output, and parts (tasks that wrote) whose counts are broadcast; more are joined by a shuffle.
ROWS, BROADCAST = 256, 200_000

_PIECES = pa.list_(pa.struct([("key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64())]))


def tier_of(n: int, least: int) -> int:
    return max(least, 1 << (n - 1).bit_length())


def fill(lengths: list[int], least: int) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """Full windows (size, [(piece, from, n)]) of pieces of these lengths, none longer than the largest window, and the parts of pieces that are left, less than a window."""
    pool = sorted((n, -i, 0) for i, n in enumerate(lengths) if n)
    windows = []
    while pool:
        n, i, a = pool.pop()
        size = tier_of(n, least)
        parts, gap = [(-i, a, n)], size - n
        while gap and pool:
            n, i, a = pool.pop(max(0, bisect_right(pool, (gap, 1, 0)) - 1) if pool[0][0] <= gap else -1)
            m = min(n, gap)
            parts.append((-i, a, m))
            gap -= m
            if n > m:
                insort(pool, (n - m, i, a + m))
        if gap:
            return windows, parts
        windows.append((size, parts))
    return windows, []


def tail(parts: list[tuple[int, int, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows of the powers of two that the parts add up to, largest first."""
    windows, left = [], list(reversed(parts))
    total = sum(n for *_, n in parts)
    while total:
        gap = size = 1 << (total.bit_length() - 1)
        total -= size
        own = []
        while gap:
            i, a, n = left.pop()
            m = min(n, gap)
            own.append((i, a, m))
            gap -= m
            if n > m:
                left.append((i, a + m, n - m))
        windows.append((size, own))
    return windows


def pack(docs: DataFrame, make_encode: Callable, end_id: int | None, key: str = "doc_id", text: str = "text", window: int = 4096, least: int = 64) -> DataFrame:
    """The written table of sequences (part, size, at, ids binary, pieces array<struct<key,start,length,doc_tokens>>): at numbers those of a size in a part.

    make_encode(): on an executor, a function from a list of texts to an iterator of little-endian uint32 byte strings; end_id, if any, ends each document. window and least are powers of two.
    Null texts count as empty; a document without ids (empty, no end_id) has no piece. Documents of any length are encoded whole and cut. Repeated rows and null keys are documents of their own;
    columns besides the two are ignored, whatever their names; an empty table gives none.
    """
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = make_encode(), TaskContext.get().partitionId()
        numbers: dict[int, int] = {}
        pending: list[tuple[int | None, int, int, bytes]] = []  # key, start, ids of the document, ids of the piece
        out: list[tuple[int, int, bytes, list[dict]]] = []
        held = 0

        def put(size: int, pieces: list[tuple[int | None, int, int, bytes]]) -> None:
            at = numbers[size] = numbers.get(size, -1) + 1
            out.append((size, at, b"".join(x[3] for x in pieces), [{"key": k, "start": s, "length": len(raw) // 4, "doc_tokens": of} for k, s, of, raw in pieces]))

        def cut(parts: list[tuple[int, int, int]]) -> list[tuple[int | None, int, int, bytes]]:
            return [(k, s + a, of, raw[4 * a : 4 * (a + n)]) for i, a, n in parts for k, s, of, raw in (pending[i],)]

        def flush() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(out), ROWS):
                size, at, ids, pieces = zip(*out[i : i + ROWS], strict=True)
                columns = [pa.array([part] * len(at), pa.int32()), pa.array(size, pa.int32()), pa.array(at, pa.int64()), pa.array(ids, pa.binary()), pa.array(pieces, _PIECES)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "size", "at", "ids", "pieces"])
            out.clear()

        for batch in workers.slices(batches):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for name, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                ids += end
                of, whole = len(ids) // 4, len(ids) // 4 // window * window
                for a in range(0, whole, window):
                    put(window, [(name, a, of, ids[4 * a : 4 * (a + window)])])
                if of > whole:
                    pending.append((name, whole, of, ids[4 * whole :]))
                    held += of - whole
                if held >= HELD or len(pending) >= PIECES:
                    windows, left = fill([len(x[3]) // 4 for x in pending], least)
                    for size, parts in windows:
                        put(size, cut(parts))
                    pending = cut(left)
                    held = sum(len(x[3]) // 4 for x in pending)
                if len(out) >= ROWS:
                    yield from flush()
        windows, left = fill([len(x[3]) // 4 for x in pending], least)
        for size, parts in windows + tail(left):
            put(size, cut(parts))
        yield from flush()

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    return scratch.save(rows.mapInArrow(run, "part int, size int, at bigint, ids binary, pieces array<struct<key:bigint,start:bigint,length:bigint,doc_tokens:bigint>>"), "packed")


def numbered(sequences: DataFrame, step_ids: int = 1 << 16) -> DataFrame:
    """sequences with sequence_id (dense, larger sizes first) and step: step_ids // size windows of one size each, spread evenly. Counts come from one row for each part and size."""
    counts = sequences.groupBy("part", "size").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "size", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = sorted(((r["size"], r["n"]) for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()), reverse=True)
    if not totals:
        return sequences.withColumns({"sequence_id": F.lit(0).cast("long"), "step": F.lit(0).cast("long")})
    parts = bases.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("size", "base"))).alias("bases"))
    met = sequences.join(F.broadcast(parts) if parts.count() <= BROADCAST else parts, "part").withColumn("rank", F.col("at") + F.element_at("bases", F.col("size")))
    first, steps, start = {}, {}, 0
    for size, n in totals:
        first[size], steps[size] = start, -(-n // max(1, step_ids // size))
        start += n
    # step k of s stands at (2 k + 1) / (2 s) of the way; before it come the steps of other sizes that stand nearer, at equal places those of larger sizes
    of = lambda values: F.element_at(F.create_map(*(F.lit(x) for size, v in values.items() for x in (size, v))), F.col("size")).cast("long")
    met = met.withColumns({"sequence_id": F.col("rank") + of(first), "own": F.expr(f"rank div greatest(1, {step_ids} div size)"), "all": of(steps)})
    step = F.col("own")
    for size, s in steps.items():
        step = step + F.expr(f"CASE WHEN size = {size} THEN 0 ELSE (((2 * own + 1) * {s} - CASE WHEN size > {size} THEN 1 ELSE 0 END) div `all` + 1) div 2 END")
    return met.withColumn("step", step.cast("long")).drop("bases", "rank", "own", "all")


def read(sequences: DataFrame, key: str = "doc_id", step_ids: int = 1 << 16) -> DataFrame:
    """Per piece, from the written ids: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset, window int, step)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in workers.slices(batches):
            rows = []
            for number, step, raw, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                ids, offset = raw.as_buffer(), 0
                for p in pieces:
                    n = p["length"]
                    rows.append((p["key"], p["start"], n, zlib.crc32(ids[4 * offset : 4 * (offset + n)]), p["doc_tokens"], number, offset, ids.size // 4, step))
                    offset += n
                if 4 * offset != ids.size:
                    raise ValueError("pieces don't cover their sequence")
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step"])

    schema = f"`{key}` bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, window int, step bigint"
    return numbered(sequences, step_ids).select("sequence_id", "step", "ids", "pieces").mapInArrow(run, schema)
