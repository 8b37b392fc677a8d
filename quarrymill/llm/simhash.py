"""SimHash near-duplicates by segment popcounts.

A 64-bit fingerprint is mapped to 32 counts of set bits, one for each 2-bit segment. The Manhattan distance of two such
vectors is a lower bound of the fingerprints' Hamming distance. The vectors are joined on a grid: the 32 dimensions
lie in GROUPS groups; two vectors at distance <= 3 differ in at most 3 groups, so they agree on all cells of
some GROUPS - 3 groups. Each fingerprint has one row for each such choice; rows that share a cell are kept where the distance of the counts,
then that of the bits, is at most 3. A pair counts only in the first choice of groups that it agrees on, so none is made twice.
The counts of all segments stay packed in one long; every step is long arithmetic within generated code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components as cc
from . import scratch
from .workers import slices, trim

DISTANCE, GROUPS = 3, 6
#: Classes of similar texts: BANDS keys of BAND_ROWS least shingle hashes each. Two texts of similarity s share a class with a chance of 1 - (1 - s ** BAND_ROWS) ** BANDS.
BANDS, BAND_ROWS = 16, 5
#: Texts, and shingles of all texts, of a block that is compared in full.
BLOCK, BLOCK_SHINGLES = 256, 1 << 21
#: Bits in which the fingerprints of similar texts may differ: at a similarity of 0.8, 9.7 of 64 do, with a deviation of 2.9. Texts of fewer than SMALL shingles aren't told apart by them.
APART, SMALL = 24, 32
#: Rows that are broadcast at most; a larger side is joined by a shuffle.
BROADCAST = 500_000
_LOW = 0x5555555555555555


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned; 0 for a text without words."""
    raw = b" ".join((text or "").encode().lower().split())
    if not raw:
        return 0
    gaps = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    stops = [*gaps.tolist(), len(raw)]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(raw[a:b], 42) for a, b in zip(starts, stops[width - 1 :], strict=False)] or [digest(raw, 42)]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * np.add.reduce(bits, axis=0, dtype=np.int64) > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, bits long): the fingerprint as a signed 64-bit number. Null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bits = np.array([fingerprint(x, width) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], names=[key, "bits"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, bits bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks() -> list[int]:
    """Bits of each group of segments."""
    cuts = [round(i * 32 / GROUPS) for i in range(GROUPS + 1)]
    return [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _counts(bits: Column) -> Column:
    """Set bits of each 2-bit segment, in place."""
    a, b = bits.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(_LOW))
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def _manhattan(a: Column, b: Column) -> Column:
    """Distance of two vectors of counts 0..2: 01 and 11 are steps of one, 10 is a step of two."""
    x = a.bitwiseXOR(b)
    low, high = x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(_LOW))
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def links(distinct: DataFrame) -> DataFrame:
    """(u, v), u < v: all pairs of distinct fingerprints (column bits) that differ in 1 to DISTANCE bits, each once."""
    masks = _masks()
    choices = list(combinations(range(GROUPS), GROUPS - DISTANCE))
    cells = F.array(*(F.struct(F.lit(k).alias("choice"), F.col("counts").bitwiseAND(F.lit(_signed(sum(masks[g] for g in c)))).alias("cell")) for k, c in enumerate(choices)))
    rows = distinct.select("bits", _counts(F.col("bits")).alias("counts")).select("bits", "counts", F.explode(cells).alias("x")).select("bits", "counts", "x.*")
    a, b = rows.alias("a"), rows.alias("b")
    # groups before the last of a choice that aren't in it: a pair that agrees on one of them counts elsewhere
    earlier = [[g for g in range(c[-1]) if g not in c] for c in choices]
    differ = F.col("a.counts").bitwiseXOR(F.col("b.counts"))
    first = F.lit(True)
    for j in range(DISTANCE):
        table = F.array(*(F.lit(_signed(masks[e[j]]) if j < len(e) else 0) for e in earlier))
        mask = F.element_at(table, F.col("a.choice") + 1)
        first = first & ((mask == 0) | (differ.bitwiseAND(mask) != 0))
    near = (
        (F.col("a.choice") == F.col("b.choice"))
        & (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.bits") < F.col("b.bits"))
        & (_manhattan(F.col("a.counts"), F.col("b.counts")) <= DISTANCE)
        & (F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))) <= DISTANCE)
        & first
    )
    return a.join(b, near).select(F.col("a.bits").alias("u"), F.col("b.bits").alias("v"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fingerprint, component_id) for every row: the smallest key that links of <= DISTANCE differing bits reach.

    Equal fingerprints link, those of texts without words (0) too. Rows with a null key belong to components, but
    never name one; a component of null keys only has component_id null. Fingerprints are collapsed first, so copies
    cost one row however many there are. Very long texts are hashed whole; other columns are ignored, whatever their names. An empty table gives an empty one.
    """
    prints = scratch.save(fingerprints(docs, key, text, width), "simhash")
    least = prints.groupBy("bits").agg(F.min(key).alias("least"))
    found = cc.components(links(least.select("bits"))).withColumnRenamed("node", "bits")
    roots = scratch.save(least.join(found, "bits", "left").select("bits", "least", F.coalesce("root", "bits").alias("root")), "roots")
    named = roots.join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("bits", "component_id")
    return prints.join(named, "bits").select(key, F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


class _Hashes(dict):
    """64-bit hashes of words, kept between texts. Bounded by `most`, and emptied when a task ends."""

    most = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


_hashes = _Hashes()
_MIX = 0x9E3779B97F4A7C15


def _seeded(h: np.ndarray, seed: int) -> np.ndarray:
    """The hashes dealt anew, for one of several independent fingerprints."""
    x = h * np.uint64(2 * seed + 1) + np.uint64(seed * _MIX % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(text: str | None) -> np.ndarray:
    words = (text or "").encode().lower().split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of the word sequences of a text, ascending; of fewer words the whole sequence, of none nothing."""
    if not words.size:
        return words
    n = max(1, words.size - width + 1)
    out = np.full(n, words.size if n == 1 else width, np.uint64)
    for j in range(min(width, words.size)):
        out = _seeded(out ^ words[j : j + n], j + 1)
    return np.unique(out)


_FACTORS, _TERMS = (_seeded(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64), seed) for seed in (201, 202))
_FACTORS = _FACTORS | np.uint64(1)


def bands(parts: np.ndarray) -> list[int]:
    """The keys of a set of shingle hashes, one for each band: equal where all least hashes of the band are."""
    least = np.full(_FACTORS.size, (1 << 64) - 1, np.uint64)
    for i in range(0, parts.size, 256):
        np.minimum(least, (parts[i : i + 256, None] * _FACTORS + _TERMS).min(axis=0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for j in range(BAND_ROWS):
        keys = _seeded(keys ^ least[j::BAND_ROWS], j + 1)
    return keys.view(np.int64).tolist()


def _print(parts: np.ndarray) -> int:
    """The fingerprint of a set of shingle hashes, signed."""
    ones = np.zeros(64, np.int64)
    for i in range(0, parts.size, 8192):
        ones += np.unpackbits(parts[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return _signed(int.from_bytes(np.packbits(2 * ones > parts.size).tobytes(), "big"))


def _marks(text: str | None, width: int) -> tuple[int, int, int, list[int]]:
    """(64 bits of the digest of the word sequence, number of shingles, fingerprint of the shingles, BANDS keys)."""
    words = _words(text)
    digest = int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little", signed=True)
    if not words.size:
        return digest, 0, 0, []
    parts = shingles(words, width)
    return digest, parts.size, _print(parts), bands(parts)


_SEGMENT = np.array([bin(i).count("1") for i in range(256)], np.int8)


def _near(prints: np.ndarray, counts: np.ndarray, sizes: np.ndarray, k: int, least: float) -> np.ndarray:
    """Which texts may be similar to text k: by their numbers of shingles; by the Manhattan distance of the popcounts of the fingerprints' eight segments, which is
    no more than that of the bits; then by the bits."""
    use = np.minimum(sizes, sizes[k]) >= least * np.maximum(sizes, sizes[k])
    tested = use & (sizes >= SMALL) if sizes[k] >= SMALL else np.zeros(use.size, bool)
    at = np.flatnonzero(tested)
    far = np.abs(counts[at] - counts[k]).sum(axis=1) > APART
    use[at[far]] = False
    at = at[~far]
    use[at[np.bitwise_count(prints[at] ^ prints[k]) > APART]] = False
    return use


def _join_within(table: pa.Table, least: float) -> pa.Table:
    """(u, v): links between the groups (column root) of a block, or of two blocks of a class, that verified pairs of texts make.

    Every pair is looked at, but those of one block of two and those whose groups are linked already; the sets of those that _near leaves are compared.
    """
    label = table.column("root").to_numpy().copy()
    block, (one, two) = table.column("block").to_numpy(), (table.column(c)[0].as_py() for c in ("one", "two"))
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("set")]
    prints = table.column("print").to_numpy().view(np.uint64)
    counts = _SEGMENT[prints.view(np.uint8).reshape(-1, 8)]
    size = np.array([x.size for x in sets])
    ends = np.cumsum(size)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    has, links = np.zeros(values.size, bool), []
    for k in range(len(sets)):
        other = np.flatnonzero((label != label[k]) & ((block != block[k]) | (one == two)) & _near(prints, counts, size, k, least))
        other = other[other > k]
        if not other.size:
            continue
        has[place[ends[k] - size[k] : ends[k]]] = True
        both = np.array([np.count_nonzero(has[place[ends[j] - size[j] : ends[j]]]) for j in other])
        has[place[ends[k] - size[k] : ends[k]]] = False
        for j in other[(both >= least * (size[k] + size[other] - both)) & (both > 0)]:
            if label[j] != label[k]:
                links.append((label[k], label[j]))
                label[label == label[j]] = label[k]
    return pa.table({"u": pa.array([int(u) for u, _ in links], pa.int64()), "v": pa.array([int(v) for _, v in links], pa.int64())})


def _candidates(table: pa.Table, least: float) -> pa.Table:
    """The texts of a block, or of two blocks of a class, that may be similar to another one in another group, by what is known without their sets."""
    root, block, (one, two) = table.column("root").to_numpy(), table.column("block").to_numpy(), (table.column(c)[0].as_py() for c in ("one", "two"))
    prints, size = table.column("print").to_numpy().view(np.uint64), table.column("size").to_numpy()
    counts, use = _SEGMENT[prints.view(np.uint8).reshape(-1, 8)], np.zeros(root.size, bool)
    for k in range(root.size):
        near = (root != root[k]) & ((block != block[k]) | (one == two)) & _near(prints, counts, size, k, least)
        use[k] = near.any()
    return table.filter(pa.array(use))


def _sent(small: DataFrame, most: int | None = None) -> DataFrame:
    """small, to be broadcast if it is counted to be small enough."""
    return F.broadcast(small) if small.count() <= (BROADCAST if most is None else most) else small


def _blocks(n: Column, size: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES), F.lit(1)).cast("int")


_LINK = "u bigint, v bigint"


def _dealt(grouped: DataFrame, heads: DataFrame, places: DataFrame) -> DataFrame:
    """What verified() compares of grouped (id, size, group): each group's texts in blocks, with its head (group, head) in each. places (id, print, file, row) may have the texts' roots; texts that have their head's root stay away, but for the head."""
    root = F.col("root" if "root" in places.columns else "id")
    named = grouped.join(heads, "group").join(places.select("id", root.alias("own")), "id").join(places.select(F.col("id").alias("head"), root.alias("top")), "head").where("own <> top")
    sizes = named.groupBy("group").agg(_blocks(F.count("*"), F.sum("size")).alias("blocks"))
    own = named.join(sizes, "group").select("group", "id", "head", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("one"))
    both = own.select("group", "id", "one").union(own.select("group", F.col("head").alias("id"), "one").distinct())
    return both.join(places, "id").select("file", "row", "group", root.alias("root"), "print", F.lit(0).alias("block"), "one", F.col("one").alias("two"))


def _joined(roots: DataFrame, tops: DataFrame) -> DataFrame:
    """(node, root) after two rounds: roots (node, root), then tops (node, root) among these roots and the nodes that had none."""
    tops = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
    named = roots.union(tops.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), "root"))
    return named.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def similar(texts: DataFrame, distinct: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """(id, root) for each id of distinct with another of its group: root is the group's smallest id.

    distinct (id, size, print, bands, file, row): a row for each distinct sequence of words, with the place of a text that has it; texts (file, row, text).
    Ids are linked where their sets of width-word shingles have a Jaccard similarity of at least `least`; every link is verified.

    First the SimHash fingerprints of the sets are joined on the grid of segment popcounts, as in near_duplicates: texts whose fingerprints links of <= DISTANCE bits join are
    candidates, dealt to blocks and compared there. Few texts of a similarity of 0.8 are that near (one bit in seven differs), so what the fingerprints leave apart follows by classes:
    texts are candidates if they share one of BANDS classes (by least hashes of shingles, so wherever they differ) and their
    fingerprints differ in at most APART bits, which the Manhattan distance of the segments' popcounts bounds from below.
    There each text goes to the most central one of all its classes, that which shares classes with the most texts, and is compared with it and with others that went there, in
    blocks: work grows with the texts, not with the square of a group. Then each class whose texts aren't one group yet is compared in full, in pairs of blocks, without
    a row for each pair: every two candidates of a class are compared or linked by others. Sets are made where the texts are and shuffled only for texts that have
    candidates. What is missed are texts that share no class: at a similarity of 0.8, 2 in 1,000 pairs are expected, at 0.85 1 in 10,000.
    """

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            sets = pa.array([shingles(_words(x), width).tobytes() for x in some.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*some.columns[1:], sets], names=[*some.schema.names[1:], "set"])
        _hashes.clear()
        trim()

    def verified(dealt: DataFrame) -> DataFrame:
        """Links of dealt (file, row, group, root, print, block, one, two), by groups of (group, one, two)."""
        wanted = dealt.select("file", "row", "group", "root", "print", "block", "one", "two")
        sets = texts.join(_sent(wanted), ["file", "row"]).select("text", "group", "root", "print", "block", "one", "two").mapInArrow(shingled, "group bigint, root bigint, print bigint, block int, one int, two int, set binary")
        return sets.groupBy("group", "one", "two").applyInArrow(lambda table: _join_within(table, least), _LINK)

    # texts that the grid of fingerprints joins
    places = distinct.select("id", "print", "file", "row")
    prints = distinct.where("size > 0").select(F.col("print").alias("bits"), "id", "size")
    linked = cc.components(links(prints.select("bits").distinct())).withColumnRenamed("node", "bits")
    near = scratch.save(prints.join(linked, "bits", "left").select("id", "size", F.coalesce("root", "bits").alias("group")), "grid")
    roots = cc.components(verified(scratch.save(_dealt(near, near.groupBy("group").agg(F.min("id").alias("head")), places), "near")))
    members = distinct.select("id", "size", "print", F.explode("bands").alias("class"))
    members = scratch.save(members.join(members.groupBy("class").agg(F.count("*").alias("n")).where("n > 1"), "class"), "members")
    # each text's centre, and the centres' texts dealt into blocks, each with the centre in it
    central = members.groupBy("id").agg(F.sum("n").alias("central"))
    middle = members.join(central, "id").groupBy("class").agg(F.max(F.struct("central", "id")).alias("middle"))
    best = members.join(middle, "class").groupBy("id").agg(F.max("middle").alias("m"), F.first("size").alias("size")).select("id", "size", F.col("m.id").alias("group"))
    best = scratch.save(best, "centres")
    labelled = places.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    dealt = _dealt(best, best.select("group", F.col("group").alias("head")).distinct(), labelled)
    roots = scratch.save(_joined(roots, cc.components(verified(scratch.save(dealt, "dealt")))), "joined")
    # classes of several groups yet, each set of texts once
    inside = members.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    left = inside.groupBy("class").agg(F.max("n").alias("n"), F.bit_xor(F.xxhash64("id")).alias("texts"), F.sum("size").alias("size"), F.min("root").alias("a"), F.max("root").alias("b")).where("a < b")
    left = left.groupBy("n", "texts", "size").agg(F.min("class").alias("class")).select("class", _blocks(F.col("n"), F.col("size")).alias("blocks"))
    cells = inside.select("class", "id", "root", "print", "size").join(left, "class").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), "blocks").cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(F.col("class").alias("group"), "id", "root", "print", "size", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    schema = "group bigint, id bigint, root bigint, print bigint, size bigint, block int, one int, two int"
    more = scratch.save(cells.groupBy("group", "one", "two").applyInArrow(lambda table: _candidates(table, least), schema).join(places.drop("print"), "id"), "more")
    return scratch.save(_joined(roots, cc.components(verified(more))).withColumnRenamed("node", "id"), "roots")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group of similar(), with all its columns: that of the smallest key, of rows with equal keys any one; a null key only if there is no other.

    Texts without words (null, empty, white space) are one group; very long texts are compared whole; columns may have any names. An empty table gives an empty one.
    Rows are told apart by their file and their place in it, which stay the same however the files are split between tasks and whichever executors are lost; docs that isn't
    the scan of a Parquet table is written first. Sequences of words are told apart by 64 bits of their digest.
    """
    try:
        place = docs.metadataColumn("_metadata")
        docs.select(place["row_index"]).schema  # noqa: B018
    except AnalysisException:
        docs = scratch.save(docs, "docs")
        place = docs.metadataColumn("_metadata")
    where = (F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row"))
    texts = docs.select(*where, F.col(f"`{text}`").alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            made = [_marks(x, width) for x in some.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*some.columns[:3], *(pa.array([m[k] for m in made], pa.int64()) for k in range(3)), pa.array([m[3] for m in made], pa.list_(pa.int64()))], names=["file", "row", "key", "id", "size", "print", "bands"])
        _hashes.clear()
        trim()

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(*where, F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    marked = scratch.save(rows.mapInArrow(mark, f"file bigint, row bigint, key {kind}, id bigint, size bigint, print bigint, bands array<bigint>"), "marks")
    order = F.struct(F.col("key").isNull().alias("none"), "key", "file", "row")
    distinct = marked.groupBy("id").agg(F.min(order).alias("best"), F.first("size").alias("size"), F.first("print").alias("print"), F.first("bands").alias("bands"))
    distinct = scratch.save(distinct.select("id", "size", "print", "bands", "best", "best.file", "best.row"), "distinct")
    roots = similar(texts, distinct, width, least)
    kept = distinct.join(roots, "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("best").alias("best")).select("best.file", "best.row")
    dropped = scratch.save(marked.select("file", "row").join(kept, ["file", "row"], "left_anti"), "dropped")
    # the columns that tell rows apart get names that docs doesn't have in any spelling
    file, row = "file", "row"
    while {file, row} & {c.lower() for c in docs.columns}:
        file, row = f"{file}_", f"{row}_"
    named = docs.select("*", F.xxhash64(place["file_path"]).alias(file), place["row_index"].alias(row))
    out = named.join(_sent(dropped.select(F.col("file").alias(file), F.col("row").alias(row))), [file, row], "left_anti")
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
