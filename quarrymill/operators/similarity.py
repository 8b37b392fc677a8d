"""Similarity of conversations within a dataset."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.scalars import words
from quarrymill.sources.shared import written

#: Conversations of a block, in the mean, and of the sample for each; tokens of a chunk; frequent tokens of two chunks that are counted at once, meetings over rarer ones that are.
BLOCK, SAMPLE, HELD, TOKENS, MEETINGS = 32768, 256, 1 << 22, 4096, 1 << 21


def firsts(conversations: DataFrame, key: str, *more: str) -> DataFrame:
    """(row, id, n, w): a conversation's key, number of messages and tokens of its first message, and columns of its own."""
    first = words(F.coalesce(F.try_element_at("messages", F.lit(1))["content"], F.lit("")))
    return conversations.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.size("messages").alias("n"), first.alias("w"), *more)


def _dealt(kept: DataFrame, most: int) -> DataFrame:
    """(group, block, part, data): firsts() that were written, in chunks of at most `most` with their tokens as numbers, a row for each pair of blocks that a chunk's own is in. Tokens of one conversation alone have no number, they count in size.

    A chunk is sent as often as there are blocks, about the root of twice the shuffle partitions, more from BLOCK conversations a block on: what is shuffled doesn't grow with the pairs, what a group holds is bounded.
    """
    rows = kept.select("row", "id", "n", "w", F.size("w").alias("size")).where("id IS NOT NULL AND size > 0")
    tokens = rows.select("row", F.explode("w").alias("token"))
    shared = tokens.groupBy("token").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a < b")
    vocabulary = written(shared.select("token", F.monotonically_increasing_id().alias("number")), "tokens")
    told = tokens.join(vocabulary, "token").groupBy("row").agg(F.collect_list("number").alias("tokens"))
    tasks = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = rows.count()
    blocks = max(1, round((2 * tasks) ** 0.5), -(-total // BLOCK))
    numbered = rows.select("row", "id", "n", "size").join(told, "row").select(_ranged(rows, total, blocks).alias("block"), "id", "n", "size", "tokens")
    chunks = numbered.groupBy("block").applyInArrow(_chunks(most), "block int, part int, data binary")
    met = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: F.struct(F.least("block", x).alias("low"), F.greatest("block", x).alias("high")))
    # small rows are much work: tasks aren't merged by size
    return chunks.select(F.explode(met).alias("group"), "block", "part", "data").repartition(tasks, "group")


def _ranged(rows: DataFrame, total: int, blocks: int) -> Column:
    """A conversation's block: blocks are ranges of keys of about one size, told from a sorted sample, so that which key of a pair comes first is mostly known of the blocks. A key that is the bound of several ranges is dealt to all of these."""
    if blocks == 1:
        return F.lit(0)
    share = SAMPLE * blocks / max(1, total)
    seen = rows.select("id", F.xxhash64("row").alias("at"))
    # told by a hash of the row, not by chance: a run again has the same blocks
    seen = seen if share >= 1 else seen.where(F.pmod("at", F.lit(1 << 20)) < F.lit(max(1, round(share * (1 << 20)))))
    found = [r["id"] for r in seen.select("id").orderBy("id").collect()]
    bounds = [found[len(found) * i // blocks] for i in range(1, blocks)] if found else []
    bounds = [F.lit(x).cast(rows.schema["id"].dataType) for x in bounds]
    below, up_to = (sum((F.when(x < F.col("id") if strict else x <= F.col("id"), 1).otherwise(0) for x in bounds), F.lit(0)) for strict in (True, False))
    return (below + F.pmod(F.xxhash64("row"), up_to - below + 1)).cast("int")


def _chunks(most: int):
    """A block's conversations in order of keys, cut into chunks that don't hold too many tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).sort_by("id").combine_chunks()
        starts = np.r_[0, np.cumsum(pc.list_value_length(table.column("tokens")).to_numpy().astype(np.int64))]
        low = part = 0
        while low < table.num_rows:
            high = min(low + most, table.num_rows, max(low + 1, int(np.searchsorted(starts, starts[low] + HELD, "right")) - 1))
            data = _packed(table.slice(low, high - low), np.diff(starts[low : high + 1]))
            yield pa.RecordBatch.from_arrays([table.column("block").combine_chunks()[:1], pa.array([part], pa.int32()), pa.array([data], pa.binary())], names=["block", "part", "data"])
            low, part = high, part + 1

    return run


def _packed(rows: pa.Table, counts: np.ndarray) -> bytes:
    """Conversations as steps between the places that have a token, row by row; a chunk numbers its own tokens. Compressed, as it is sent many times."""
    tokens, place = np.unique(pc.list_flatten(rows.column("tokens")).to_numpy(), return_inverse=True)
    spots, times = np.unique(np.repeat(np.arange(counts.size), counts) * tokens.size + place, return_counts=True)
    steps, jumps = np.diff(spots, prepend=0), np.diff(tokens, prepend=0)
    lists = [rows.column(c).combine_chunks() for c in ("id", "n", "size")] + [pa.array(x.astype(np.min_scalar_type(x.max()))) for x in (jumps, steps, times)]
    batch = pa.RecordBatch.from_arrays([pa.LargeListArray.from_arrays(pa.array([0, len(x)], pa.int64()), x) for x in lists], names=["id", "n", "size", "jumps", "steps", "times"])
    with pa.BufferOutputStream() as out:
        with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(batch)
        return out.getvalue().to_pybytes()


class _Chunk:
    """What _packed() made: entries starts[k] to starts[k + 1] say that conversation `row` has token tokens[k] `times` times."""

    def __init__(self, data: pa.BinaryScalar) -> None:
        batch = pa.ipc.open_stream(data.as_buffer()).read_next_batch()
        self.ids, n, size, jumps, steps, times = (batch.column(c).flatten() for c in range(6))
        self.n, self.size, self.tokens, spots = (x.to_numpy().astype(np.int64) for x in (n, size, pc.cumulative_sum(jumps.cast("int64")), pc.cumulative_sum(steps.cast("int64"))))
        row, place = np.divmod(spots, self.tokens.size)
        order = np.argsort(place, kind="stable")
        self.row, self.times, self.counts = row[order], times.to_numpy()[order], np.bincount(place)
        self.starts = np.cumsum(self.counts) - self.counts


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


def _dense(chunk: _Chunk, tokens: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(times, there or not) of some tokens, a row for each conversation."""
    counts = chunk.counts[tokens]
    entries, column = _ranges(chunk.starts[tokens], counts), np.repeat(np.arange(tokens.size), counts)
    times = np.zeros((chunk.n.size, tokens.size), kind)
    times[chunk.row[entries], column] = chunk.times[entries]
    return times, (times > 0).astype(kind)


def _shared(a: _Chunk, b: _Chunk, before: np.ndarray | bool) -> np.ndarray:
    """Tokens of the one with repeats that the other has, for each of a's conversations and b's; the one is a's where `before` says so, else b's. True: it is a's for all.

    Tokens that many have are a product of their counts; where two conversations meet over a rarer one, that is added up.
    """
    _, own, its = np.intersect1d(a.tokens, b.tokens, assume_unique=True, return_indices=True)
    shape = a.n.size, b.n.size
    many = a.counts[own] * b.counts[its] * 256 > shape[0] * shape[1]
    # single precision counts to 2 ** 24
    kind = np.float32 if max(a.size.max(), b.size.max()) < 1 << 24 else np.float64
    out = np.zeros(shape, kind)
    often = own[many], its[many]
    for at in range(0, often[0].size, TOKENS):
        (times, has), (others_times, other_has) = (_dense(c, t[at : at + TOKENS], kind) for c, t in zip((a, b), often, strict=True))
        out += times @ other_has.T if before is True else np.where(before, times @ other_has.T, has @ others_times.T)
    own, its = own[~many], its[~many]
    work, low = np.cumsum(a.counts[own] * b.counts[its]), 0
    while low < own.size:
        high = max(low + 1, int(np.searchsorted(work, (work[low - 1] if low else 0) + MEETINGS, "right")))
        of_a, of_b = own[low:high], its[low:high]
        # each entry of a meets all of b's of its token
        met = np.repeat(b.counts[of_b], a.counts[of_a])
        entries = _ranges(a.starts[of_a], a.counts[of_a])
        j = _ranges(np.repeat(b.starts[of_b], a.counts[of_a]), met)
        spots = np.repeat(a.row[entries] * shape[1], met) + b.row[j]
        times = np.repeat(a.times[entries], met)
        out += np.bincount(spots, times if before is True else np.where(before.ravel()[spots], times, b.times[j]), out.size).reshape(shape)
        low = high
    return out


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]]:
    """The similar pairs of a group by two chunks at a time, (a, number of its pairs, b of all these, similarity)."""
    table = pa.Table.from_batches(batches).sort_by([("block", "ascending"), ("part", "ascending")])
    group, block = table.column("group")[0].as_py(), table.column("block").to_pylist()
    chunks = [_Chunk(data) for data in table.column("data")]
    places = pc.rank(pa.chunked_array([c.ids for c in chunks]), tiebreaker="dense").to_numpy().astype(np.int64)
    ranks = np.split(places, np.cumsum([c.n.size for c in chunks])[:-1])
    for i, x in enumerate(chunks):
        for j, y in enumerate(chunks):
            if block[i] != group["low"] or block[j] != group["high"] or (block[i] == block[j] and j < i):
                continue
            if ranks[i].max() < ranks[j].min():
                yield _near(x, y, _shared(x, y, True))
            elif ranks[j].max() < ranks[i].min():
                yield _near(y, x, _shared(y, x, True))
            else:
                before = ranks[i][:, None] < ranks[j]
                both = _shared(x, y, before)
                yield _near(x, y, both, before)
                # a chunk's pairs with itself are there both ways
                if i != j:
                    yield _near(y, x, both.T, (ranks[i][:, None] > ranks[j]).T)


def _near(a: _Chunk, b: _Chunk, shared: np.ndarray, before: np.ndarray | bool = True) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """What _met() has of the pairs of a's and b's conversations that share tokens and whose numbers of messages are near."""
    kind = np.min_scalar_type(max(2 * a.n.max(), b.n.max()))
    least, most, n = ((a.n + 1) // 2).astype(kind), (a.n * 2).astype(kind), b.n.astype(kind)
    near = (shared > 0) & (n >= least[:, None]) & (n <= most[:, None]) & before
    counts, spots = np.count_nonzero(near, axis=1), np.flatnonzero(near)
    m = spots - np.repeat(np.arange(a.n.size) * b.n.size, counts)
    both = shared.ravel()[spots].astype(np.float64)
    return a.ids, counts, b.ids.take(pa.array(m)), both / (np.repeat(a.size, counts) + b.size[m] - both)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for a, counts, b, similarity in _met(batches):
        starts = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
        yield pa.RecordBatch.from_arrays([a, *(pa.ListArray.from_arrays(starts, x) for x in (b, pa.array(similarity)))], names=["a", "b", "similarity"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, top = 0.0, 0.0
    for *_, similarity in _met(batches):
        total, top = total + float(similarity.sum()), max(top, float(similarity.max(initial=0.0)))
    yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([top])], names=["s", "m"])


def pairs(conversations: DataFrame, key: str = "conv_id", most: int = 1024) -> DataFrame:
    """(a, b, similarity), a before b in order of key, for the pairs whose similarity isn't 0.

    Only first messages count, and only where the numbers of messages are within a factor of 2. Tokens of a with repeats that occur in b, over
    the tokens of both less those: not symmetric. Each pair of blocks of conversations is a group that hands its pairs on by two chunks of at most `most` conversations: pairs are never shuffled. Equal and null keys make no pair.
    """
    kind = conversations.schema[key].dataType.simpleString()
    lists = _dealt(written(firsts(conversations, key), "first_messages"), most).groupBy("group").applyInArrow(_listed, f"a {kind}, b array<{kind}>, similarity array<double>")
    # a list for each conversation and chunk: Python hands on fewer rows, lists become pairs in compiled code
    return lists.select("a", F.posexplode("b").alias("at", "b"), "similarity").select("a", "b", F.get("similarity", F.col("at")).alias("similarity"))


def step_penalty(mean: Column) -> Column:
    return F.when(mean > 0.8, mean * 0.5).when(mean > 0.5, mean * 0.2).otherwise(F.lit(0.0))


def internal(conversations: DataFrame, key: str = "conv_id", most: int = 1024) -> DataFrame:
    """One row (n, n_pairs, mean_similarity, max_similarity, penalty) over all pairs; fewer than 2 conversations: 0."""
    return internal_of(written(firsts(conversations, key), "first_messages"), most)


def internal_of(kept: DataFrame, most: int = 1024) -> DataFrame:
    """internal() of firsts() that were written; each group of blocks adds up its own pairs."""
    groups = _dealt(kept, most).groupBy("group").applyInArrow(_summed, "s double, m double")
    sums = groups.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"), F.coalesce(F.max("m"), F.lit(0.0)).alias("max_similarity"))
    count = kept.agg(F.count("*").alias("n"))
    both = count.select("n", F.lit(1).alias("one")).join(sums.withColumn("one", F.lit(1)), "one")
    mean = F.when(F.col("n") < 2, 0.0).otherwise(F.col("s") / (F.col("n") * (F.col("n") - 1) / 2))
    return both.select("n", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n_pairs"), mean.alias("mean_similarity"), "max_similarity").withColumn("penalty", step_penalty(F.col("mean_similarity")))
