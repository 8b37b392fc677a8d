"""Token-id files of patched frame-of-reference blocks.

A shard is one byte string:

    magic "PFOR1\\0\\0\\0"; header of 6 uint64: documents, ids, block size, exceptions, bytes of planes, bytes of all
    doc ids int64[documents]; doc lengths uint64[documents]
    block minima uint32[blocks]; widths uint8[blocks], padded to 8 bytes
    block starts uint64[blocks + 1] into the planes; exception starts uint64[blocks + 1] into the exceptions
    planes; exception places uint16[exceptions], padded to 8; exception high parts uint32[exceptions]

All numbers are little-endian. A block holds BLOCK ids (the last is padded with its minimum). From each id the
block's minimum is taken; `width` bits, enough for the given percentile of the block, are packed as bit planes, and what
lies above them goes to the block's exception list. Any block can be read alone through its start.
Shards are rows of a Parquet table, as that is what every Spark file system can write and read on executors;
their order is that of (part, seq), and within it documents ascend.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

MAGIC = b"PFOR2\0\0\0"
BLOCK = 512
_HEAD = struct.Struct("<8s6Q")


def _pad(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 8)


def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, percentile: float = 0.95, missing: np.ndarray | None = None) -> bytes:
    """One shard. ids: uint32, the documents' ids on end; missing: which documents have no doc id (theirs counts as 0)."""
    missing = np.zeros(doc_ids.size, bool) if missing is None else missing
    ids = np.ascontiguousarray(ids, np.uint32)
    blocks = -(-ids.size // BLOCK)
    table = np.zeros((blocks, BLOCK), np.uint32)
    table.reshape(-1)[: ids.size] = ids
    if blocks and ids.size % BLOCK:
        table[-1, ids.size % BLOCK :] = ids[(blocks - 1) * BLOCK :].min()
    low = table.min(axis=1) if blocks else np.zeros(0, np.uint32)
    table -= low[:, None]
    place = min(BLOCK - 1, int(percentile * BLOCK))
    at = np.partition(table, place, axis=1)[:, place] if blocks else low
    width = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.uint8)
    starts = np.concatenate(([0], np.cumsum(width.astype(np.uint64) * (BLOCK // 8)))).astype("<u8")
    planes = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        bits = np.stack([np.packbits((table[of] >> np.uint32(k)) & np.uint32(1) != 0, axis=1) for k in range(w)], axis=1)
        planes[(starts[of].astype(np.int64)[:, None] + np.arange(w * BLOCK // 8)).reshape(-1)] = bits.reshape(-1)
    high = table >> width.astype(np.uint32)[:, None]
    rows, places = np.nonzero(high)
    over = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=blocks)))).astype("<u8")
    body = b"".join(
        (doc_ids.astype("<i8").tobytes(), lengths.astype("<u8").tobytes(), _pad(missing.astype("u1").tobytes()), _pad(low.astype("<u4").tobytes()), _pad(width.tobytes()), starts.tobytes(), over.tobytes(), _pad(planes.tobytes()), _pad(places.astype("<u2").tobytes()), high[rows, places].astype("<u4").tobytes())
    )
    return _HEAD.pack(MAGIC, doc_ids.size, ids.size, BLOCK, rows.size, planes.size, _HEAD.size + len(body)) + body


class Shard:
    """A shard read back. Views into raw, without copies, but for the blocks that are asked for."""

    def __init__(self, raw: bytes) -> None:
        magic, docs, self.size, block, over, planes, total = _HEAD.unpack_from(raw)
        if magic != MAGIC or block != BLOCK or total != len(raw):
            raise ValueError("not a whole shard of this format")
        self.blocks, self._at, self._raw = -(-self.size // BLOCK), _HEAD.size, raw
        self.doc_ids, self.lengths = self._view("<i8", docs), self._view("<u8", docs).astype(np.int64)
        self.missing = self._view("u1", docs).astype(bool)
        self.low, self.width = self._view("<u4", self.blocks), self._view("u1", self.blocks)
        self.starts, self.over = self._view("<u8", self.blocks + 1).astype(np.int64), self._view("<u8", self.blocks + 1).astype(np.int64)
        self.planes, self.places, self.high = self._view("u1", planes), self._view("<u2", over), self._view("<u4", over)

    def _view(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self._raw, kind, n, self._at)
        self._at += out.nbytes + -out.nbytes % 8
        return out

    def read(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of blocks first..last-1."""
        last = self.blocks if last is None else last
        width = self.width[first:last]
        table = np.zeros((last - first, BLOCK), np.uint32)
        for w in np.unique(width[width > 0]).tolist():
            of = np.flatnonzero(width == w)
            packed = self.planes[self.starts[first + of][:, None] + np.arange(w * BLOCK // 8)].reshape(of.size, w, BLOCK // 8)
            part = np.zeros((of.size, BLOCK), np.uint32)
            for k in range(w):
                part |= np.unpackbits(packed[:, k], axis=1).astype(np.uint32) << np.uint32(k)
            table[of] = part
        a, b = self.over[first], self.over[last]
        rows = np.repeat(np.arange(last - first), np.diff(self.over[first : last + 1]))
        table[rows, self.places[a:b]] |= self.high[a:b] << width[rows].astype(np.uint32)
        table += self.low[first:last, None]
        return table.reshape(-1)[: self.size - first * BLOCK]


def write(docs: DataFrame, make_encode, end_id: int | None, key: str = "doc_id", text: str = "text", shard_ids: int = 1 << 19) -> DataFrame:
    """Encodes and writes all documents in ascending key order; the written table (part, seq, local_start, n_ids, shard).

    make_encode(): on an executor, a function from a list of texts to an iterator of little-endian
    uint32 byte strings. Null texts count as empty; end_id, if any, ends each document. Null keys come first
    and are marked in the shard, so any int64 may be a key. A shard closes after shard_ids ids, or with a document that is longer, which is
    encoded whole. Repeated rows are documents of their own; other columns are ignored, whatever their names; an empty table gives no shard.
    One range shuffle of (key, text); the texts of one key are in order, and tasks may part them by their first 64 characters.
    """
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = make_encode(), TaskContext.get().partitionId()
        seq, start, keys, lengths, held, size = 0, 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            raw = pack(np.array([k or 0 for k in keys], np.int64), np.array(lengths, np.uint64), ids, missing=np.array([k is None for k in keys]))
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in ((part, pa.int32()), (seq, pa.int64()), (start, pa.int64()), (ids.size, pa.int64()), (raw, pa.binary()))], names=["part", "seq", "local_start", "n_ids", "shard"])

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for name, ids in zip(names, encode(texts), strict=True):
                keys.append(name)
                held.append(ids + end)
                lengths.append(len(held[-1]) // 4)
                size += lengths[-1]
                if size >= shard_ids:
                    yield close()
                    seq, start, keys, lengths, held, size = seq + 1, start + size, [], [], [], 0
        if keys:
            yield close()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    # a prefix orders like the text, and what is sampled for the ranges stays small
    rows = rows.repartitionByRange("key", F.substring("text", 1, 64)).sortWithinPartitions("key", "text")
    return scratch.save(rows.mapInArrow(run, "part int, seq bigint, local_start bigint, n_ids bigint, shard binary"), "tokens")


def read(files: DataFrame, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per document, from the files alone: (key, start, n_tokens, ids_crc32[, ids binary]).

    start is the number of ids of all documents before it. Only the sizes of the parts go through the driver,
    one number for each task that wrote.
    """
    spark = files.sparkSession
    sizes = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases, total = [], 0
    for part, n in sizes:
        bases.append((part, total))
        total += n
    base = spark.createDataFrame(bases, "part int, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(raw.as_py())
                ids = shard.read()
                stops = np.cumsum(shard.lengths)
                cuts = [ids[a:b].tobytes() for a, b in zip((stops - shard.lengths).tolist(), stops.tolist(), strict=True)]
                columns = [pa.array(shard.doc_ids, pa.int64(), mask=shard.missing), pa.array(first + stops - shard.lengths), pa.array(shard.lengths), pa.array([zlib.crc32(x) for x in cuts], pa.int64())]
                if with_ids:
                    columns.append(pa.array(cuts, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[key, "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return files.join(F.broadcast(base), "part").select((F.col("base") + F.col("local_start")).alias("first"), "shard").mapInArrow(run, schema)
