"""Similar programs of a corpus: a filtered join over an inverted index of their nodes, instead of all pairs.

Programs of one structure are one class, compared once. A class's nodes are a multiset, written as elements (node, how often it came before), so
two programs have as many elements in common as their multisets; their longest common subsequence is no longer than that. With elements ordered from the rarest to the most common, two programs that have
enough in common share one of the first few of each, so only classes that meet in such an element are looked at. There, lengths, then counts of
nodes in 64 groups and the elements that follow in either bound the score from above. A pair may be named by several elements and is compared once, exactly.

An element that many classes have is dealt into blocks within bands of length, and each pair of blocks of one band or of neighbouring ones is a group of its own, so no task grows with an element. What a class sends for an element has a
fixed size; its nodes go only where they are compared, as numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.scalars import PLAGIARIZED, TO_VERIFY
from quarrymill.sources.shared import written

from .programs import normalised, score_of, structure_hash

#: Classes of a block, and groups in which nodes are counted for the bound.
BLOCK, GROUPS = 1024, 64


def classes(programs: DataFrame, key: str = "ord", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The written tables of members (id, class) and classes (class, nodes, copies): class is the least id of a structure. Programs that don't parse, and null ones, have none."""
    rows = written(programs.select(F.col(key).alias("id"), normalised(F.col(source)).alias("nodes")).where("nodes IS NOT NULL").withColumn("hash", structure_hash(F.col("nodes"))), "programs")
    heads = written(rows.groupBy("hash").agg(F.min(F.struct("id", "nodes")).alias("head"), F.count("*").alias("copies")).select("hash", F.col("head.id").alias("class"), "head.nodes", "copies"), "classes")
    return rows.select("id", "hash").join(heads.select("hash", "class"), "hash").select("id", "class"), heads.select("class", "nodes", "copies")


def _band(n: int, least: int) -> int:
    """Lengths of two programs that may reach the score lie in one band or in neighbouring ones."""
    return 0 if least == 100 or n == 0 else int(math.log(n) / math.log(100 / least) + 1e-9)


def _sent(least: int, block: int):
    """Classes (class, nodes, elements by rarity) to one row for each element that may name them and each group that they are in: what the filters need, of a fixed size."""

    def places(name: int, band: int, sizes: dict[int, int]) -> Iterator[tuple[str, int]]:
        """(group, side in it) of a class in a band, given how many classes of each band have the element."""
        parts = lambda k: -(-sizes.get(k, 0) // block)
        own = name % parts(band)
        for other in range(parts(band)):
            yield f"{band}:{min(own, other)}:{band}:{max(own, other)}", int(own > other)
        if least < 100:
            for other in range(parts(band + 1)):
                yield f"{band}:{own}:{band + 1}:{other}", 0
            for other in range(parts(band - 1)):
                yield f"{band - 1}:{other}:{band}:{own}", 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            kinds = (batch.schema.field("class").type, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            for at in range(0, batch.num_rows, 20):
                rows: list[tuple] = []
                for r in batch.slice(at, 20).to_pylist():
                    n, own = len(r["nodes"]), np.zeros(GROUPS, "<u4")
                    for node in r["nodes"]:
                        own[node % GROUPS] += 1
                    first, counts = n - max(1, math.ceil(n * least / 100 - 1e-9)) + 1, own.tobytes()
                    for i, spot in enumerate(r["spots"][:first]):
                        if spot["classes"] > 1:  # what no other class has names no pair
                            sizes = {b["band"]: b["n"] for b in spot["bands"]}
                            rows += [(r["class"], spot["element"], group, side, n, n - i, counts) for group, side in places(crc32(f"{r['class']}{spot['element']}".encode()), _band(n, least), sizes)]
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["class", "element", "pair", "side", "n", "rest", "counts"])

    return run


def _meet(least: int):
    """The classes of two blocks that have an element to the pairs (a, b) that it names and that may reach the score."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("class").combine_chunks()
        names = table.column("pair")[0].as_py().split(":")
        n, rest, side = (table.column(c).to_numpy() for c in ("n", "rest", "side"))
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<u4").reshape(len(n), -1)
        same = names[:2] == names[2:]
        left, right = (np.arange(len(n)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        # a pair has no more in common than the rest of either from its first common element on
        may = np.minimum(rest[left][:, None], rest[right]) / np.maximum(n[left][:, None], n[right]) * 100.0 >= least
        i, j = np.nonzero(np.triu(may, 1) if same else may)
        i, j = left[i], right[j]
        kept = []
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            kept.append(np.minimum(counts[x], counts[y]).sum(axis=1) / np.maximum(n[x], n[y]) * 100.0 >= least)
        kept = np.concatenate(kept) if kept else np.zeros(0, bool)
        a, b = np.minimum(i, j)[kept], np.maximum(i, j)[kept]
        ids = table.column("class")
        return pa.table({"a": ids.take(pa.array(a, pa.int64())), "b": ids.take(pa.array(b, pa.int64()))})

    return run


def similar(heads: DataFrame, least: int = TO_VERIFY) -> DataFrame:
    """The written table (a, b, score) of all pairs of classes(), a < b, that score at least `least` (1 to 100). An empty program is like no other."""
    if not 1 <= least <= 100:
        raise ValueError("a score of 1 to 100")
    kind = heads.schema["class"].dataType.simpleString()
    vocabulary = written(heads.select(F.explode("nodes").alias("node")).distinct().withColumn("number", F.monotonically_increasing_id()), "vocabulary")
    places = heads.select("class", F.posexplode("nodes").alias("at", "node")).join(vocabulary, "node")
    numbered = written(places.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "number"))), lambda x: x["number"]).alias("nodes")), "numbered")
    counts = numbered.select("class", F.explode("nodes").alias("node")).groupBy("class", "node").agg(F.count("*").alias("n"))
    elements = counts.select("class", F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: F.concat_ws(":", F.col("node").cast("string"), k.cast("string")))).alias("element"))
    base = math.log(100 / least) if least < 100 else 1.0
    band = F.lit(0) if least == 100 else F.floor(F.log("n") / base + 1e-9).cast("int")
    sizes = elements.join(numbered.select("class", F.size("nodes").alias("n")), "class").groupBy("element", band.alias("band")).agg(F.count("*").cast("int").alias("n"))
    common = sizes.groupBy("element").agg(F.sum("n").alias("classes"), F.array_sort(F.collect_list(F.struct("band", "n"))).alias("bands"))
    spots = elements.join(common, "element").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("classes", "element", "bands"))).alias("spots"))
    sent = numbered.join(spots, "class").select("class", "nodes", "spots").mapInArrow(_sent(least, BLOCK), f"class {kind}, element string, pair string, side int, n int, rest int, counts binary")
    named = written(sent.groupBy("element", "pair").applyInArrow(_meet(least), f"a {kind}, b {kind}"), "named")
    pairs = named.select("a", "b").distinct()
    a, b = (numbered.select(F.col("class").alias(c), F.col("nodes").alias(f"nodes_{c}")) for c in "ab")
    scored = pairs.join(a, "a").join(b, "b").select("a", "b", score_of("nodes_a", "nodes_b").alias("score"))
    return written(scored.where(F.col("score") >= least), "similar")


def flags(programs: DataFrame, key: str = "ord", source: str = "source") -> DataFrame:
    """One row for each program that parses: (key, class, copies, n_plagiarized, n_to_verify, best_score, best): other programs that it is plagiarized from or to, and to verify, the best score (null without any of 30) and the least class that has it, its own if there are copies."""
    members, heads = classes(programs, key, source)
    pairs = similar(heads)
    both = pairs.select(F.col("a").alias("class"), F.col("b").alias("other"), "score").union(pairs.select(F.col("b").alias("class"), F.col("a").alias("other"), "score"))
    sized = both.join(heads.select(F.col("class").alias("other"), F.col("copies").alias("n")), "other")
    sums = sized.groupBy("class").agg(F.sum(F.when(F.col("score") >= PLAGIARIZED, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("score") < PLAGIARIZED, F.col("n")).otherwise(0)).alias("v"), F.max("score").alias("score"), F.min(F.struct((-F.col("score")).alias("s"), "other")).alias("top"))
    met = heads.select("class", "copies").join(sums, "class", "left")
    own = F.col("copies") > 1
    out = met.select(
        "class", "copies", (F.coalesce("p", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_plagiarized"), F.coalesce("v", F.lit(0)).cast("long").alias("n_to_verify"),
        F.when(own, 100).otherwise(F.col("score")).cast("int").alias("best_score"), F.when(own, F.col("class")).otherwise(F.col("top.other")).alias("best"),
    )
    return members.join(out, "class").select(F.col("id").alias(key), "class", "copies", "n_plagiarized", "n_to_verify", "best_score", "best")
