"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed hash of its key. A source takes the documents whose hash lies below its
threshold, the largest one that keeps the taken size within the source's budget. The threshold is found
without sorting: sizes are summed by source and the top 12 bits of the hash, the bucket in which the
running sum passes the budget is refined by the next 12 bits, and so on through the 48 bits; only that
bucket is read again. Rows of one key that don't fit together are refined likewise by a hash of their text, so that a key (or no key) that many rows
have is split. Thresholds are nested: a larger budget takes the same documents and more.
A source whose target exceeds its size takes every document floor(target / size) times, and the
documents under the threshold once more.

Sources are rows of a table throughout: one window over a row for each source gives their weights and targets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

LEVELS, BITS = 4, 12
_TOP = 1 << LEVELS * BITS
#: Sources whose rows are broadcast at most; more are joined by a shuffle.
BROADCAST = 100_000


def words(column: str):
    """The number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.expr(rf"regexp_count(`{column}`, '[^\\x20\\x09-\\x0D]+')"), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, limit: float) -> list[float]:
    """share * sum(sizes) dealt by weight, each at most limit * size, what is over reshared by weight.

    Sources are capped in order of size / weight; the first that needs no cap sets the rate of all after it.
    """
    out = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (limit * sizes[i] / weights[i], i))
    budget, capped, left = share * sum(sizes), 0.0, float(sum(weights))
    for place, i in enumerate(order):
        rate = (budget - capped) / left
        if limit * sizes[i] / weights[i] >= rate:
            for j in order[place:]:
                out[j] = min(limit * sizes[j], weights[j] * rate)
            break
        out[i] = limit * sizes[i]
        capped += limit * sizes[i]
        left -= weights[i]
    return out


def _hash(value: Column, seed: str) -> Column:
    """48 bits, the same for equal values; null counts as empty text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(value.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")


def _sent(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if sources.count() <= BROADCAST else sources


def _sources(rows: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """(own, source_size, target, whole): targets() as a plan, with a row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sums = rows.groupBy("source").agg(F.sum("size").alias("size")).withColumn("place", F.row_number().over(order) - 1)
    sums = sums.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))).withColumn("most", F.lit(limit) * F.col("size"))
    rise = Window.orderBy(F.col("most") / F.col("w"), "place")
    capped = F.coalesce(F.sum("most").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(rise.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    budget = F.lit(share) * F.sum("size").over(Window.partitionBy())
    rates = sums.select("source", "size", "w", "most", "place", ((budget - capped) / left).alias("rate"), F.row_number().over(rise).alias("rank"))
    rates = scratch.cut(rates)
    # the first source that needs no cap sets the rate of all after it
    rate = rates.where(F.col("most") / F.col("w") >= F.col("rate")).agg(F.min_by("rate", "rank")).first()[0]
    target = F.col("most") if rate is None else F.least("most", F.col("w") * F.lit(rate))
    return rates.select(F.col("source").alias("own"), F.col("size").alias("source_size"), target.alias("target")).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))


def thresholds(rows: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(own, source_size, target, whole, threshold, tie), one row for each source, from rows (source, size, hash, tie). tie is the threshold among the rows whose hash is the threshold.

    rows should be a written table: it is read once for the sources' sizes and once for each level.
    """
    found = scratch.cut(_sources(rows, weights, share, limit))
    #: The bits of the threshold so far, and the budget left within them; a source that takes all has none.
    now = found.select("own", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("prefix"), (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    out = None
    for column in ("hash", "tie"):
        for level in range(LEVELS):
            shift = BITS * (LEVELS - 1 - level)
            same = F.col("source").eqNullSafe(F.col("own")) & (F.shiftright(column, shift + BITS) == F.col("prefix"))
            inside = rows.join(_sent(now), same if column == "hash" else same & (F.col("hash") == F.col("at")))
            sums = inside.groupBy("own", F.shiftright(column, shift).alias("bucket")).agg(F.sum("size").alias("size"), F.first("budget").alias("budget"), F.first("at").alias("at"))
            run = sums.withColumn("sum", F.sum("size").over(Window.partitionBy("own").orderBy("bucket")))  # at most 2 ** BITS rows a source
            passed = run.where(F.col("sum") > F.col("budget")).groupBy("own").agg(F.min_by(F.struct("at", F.col("bucket").alias("prefix"), (F.col("budget") - F.col("sum") + F.col("size")).alias("budget")), "bucket").alias("x"))
            now = scratch.cut(passed.select("own", "x.*"))
        if column == "hash":
            out, now = now.select("own", F.col("prefix").alias("threshold")), scratch.cut(now.select("own", F.col("prefix").alias("at"), F.lit(0).cast("long").alias("prefix"), "budget"))
    ties = now.select(F.col("own").alias("_own"), F.col("prefix").alias("tie"))
    met = found.join(out.withColumnRenamed("own", "_own"), F.col("own").eqNullSafe(F.col("_own")), "left").drop("_own").join(ties, F.col("own").eqNullSafe(F.col("_own")), "left").drop("_own")
    return scratch.cut(met.select("own", "source_size", "target", "whole", F.coalesce("threshold", F.lit(_TOP)).alias("threshold"), F.coalesce("tie", F.lit(_TOP)).alias("tie")))


def _copies(whole: str, source_size: str, hash_: Column, threshold: str, tie: Column, most_tie: str) -> Column:
    """How often a row is taken."""
    under = (hash_ < F.col(threshold)) | ((hash_ == F.col(threshold)) & (tie < F.col(most_tie)))
    return F.when(F.col(source_size) == 0, 0).otherwise(F.col(whole) + under.cast("int"))


def mix(sized: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", tie: str | None = None, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: str = "mix") -> DataFrame:
    """(key, source, size, source_size, target, copies, taken) for every row of sized.

    Sources in order of code points, null last, have the weights in turn. A row's hash is that of its key, so reruns agree;
    rows with the same key (or a null key) are told apart by the hash of the column tie, if any, else by their size, and taken together if these are equal too. A source whose sizes
    sum to 0 has target 0 and takes nothing; rows of size 0 take 0. A null size counts as 0. Other columns are ignored, whatever their names. An empty
    table gives an empty one. Only (key, source, size, hash, tie) are written and read again; the input is read once.
    """
    rows = sized.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long").alias("size"), _hash(F.col(f"`{key}`"), seed).alias("hash"), _hash(F.col(f"`{tie or size}`"), f"{seed}-tie").alias("tie"))
    rows = scratch.save(rows, "mix")
    table = thresholds(rows, weights, share, limit).withColumnRenamed("tie", "most_tie")
    out = rows.join(_sent(table), F.col("source").eqNullSafe(F.col("own"))).withColumn("copies", _copies("whole", "source_size", F.col("hash"), "threshold", F.col("tie"), "most_tie"))
    return out.select(F.col("key").alias(key), F.col("source").alias(source), F.col("size").alias(size), "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of docs, with all their columns, whatever their names, each as often as it is taken; rows with the same key are told apart by their text. The texts aren't shuffled. Nulls, sizes and empty
    tables as in mix()."""
    hashes = _hash(F.col(f"`{key}`"), seed), _hash(F.col(f"`{text}`"), f"{seed}-tie")
    rows = scratch.save(docs.select(F.col(f"`{source}`").alias("source"), words(text).alias("size"), hashes[0].alias("hash"), hashes[1].alias("tie")), "mix")
    table = thresholds(rows, weights, share, limit)
    scratch.drop(rows)
    names = {c: c for c in (*table.columns, "copy")}
    while {n.lower() for n in names.values()} & {c.lower() for c in docs.columns}:
        names = {c: f"{n}_" for c, n in names.items()}
    met = docs.join(_sent(table.select(*(F.col(c).alias(names[c]) for c in table.columns))), F.col(f"`{source}`").eqNullSafe(F.col(names["own"])))
    copies = _copies(names["whole"], names["source_size"], hashes[0], names["threshold"], hashes[1], names["tie"])
    return met.where(copies > 0).withColumn(names["copy"], F.explode(F.array_repeat(F.lit(0), copies))).select(*(F.col(f"`{c}`") for c in docs.columns))
