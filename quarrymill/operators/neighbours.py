"""Order among all rows without sorting all rows in one task: ranges of keys, places and next rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions.scalars import free

#: Ranges at most: what one task may sort is a share of the rows, and the tables of ranges stay small enough for one task and a broadcast.
RANGES = 512


#: Strings in the sample for each range, and characters of each.
SAMPLE, CHARS = 40, 256


def _string_bounds(rows: DataFrame, key: str, n: int) -> list[str]:
    """What parts the strings of a key into about n ranges of one size: every SAMPLE-th of a sorted sample, as long as about SAMPLE * n strings."""
    total = rows.count()
    seen = rows.where(F.col(key).isNotNull()).select(F.substring(key, 1, CHARS).alias("x"))
    share = SAMPLE * n / max(1, total)
    found = sorted((r["x"] for r in (seen if share >= 1 else seen.sample(share, seed=1)).collect()), key=str.encode)
    return sorted({found[len(found) * i // n] for i in range(1, n)} if found else set(), key=str.encode)


def ranges(rows: DataFrame, *keys: str) -> list[Column]:
    """For each key the number of its range, rising with the key; nulls are in range 0. One job finds approximate quantiles of numbers, dates and times, two more a sample of each key of strings; ranges are as many as shuffle partitions, RANGES at most, and a value is never in two ranges."""
    n = min(RANGES, max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if n == 1:
        return [F.lit(0) for _ in keys]
    shares = [i / n for i in range(1, n)]
    texts = {k for k in keys if isinstance(rows.schema[k].dataType, T.StringType)}
    numbers = [k for k in keys if k not in texts]
    found = rows.agg(*(F.percentile_approx(k, shares, 10_000).alias(k) for k in numbers)).first() if numbers else {}
    bounds = {k: sorted({b for b in found[i] or [] if b == b}) for i, k in enumerate(numbers)} | {k: _string_bounds(rows, k, n) for k in texts}
    return [_place(F.col(k), bounds[k]) for k in keys]


def _place(key: Column, bounds: list) -> Column:
    """How many of the sorted bounds lie below key, as a tree of comparisons."""

    def part(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key > F.lit(bounds[middle]), part(middle + 1, high)).otherwise(part(low, middle))

    return part(0, len(bounds))


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with name: their place in order of key, from 0; equal keys follow one another in no fixed order. Rows of a range are sorted together, one row a range is sorted alone."""
    own, before, n = (free([*rows.columns, name], x) for x in ("_range", "_before", "_n"))
    placed = rows.withColumn(own, ranges(rows, key)[0])
    sizes = placed.groupBy(own).agg(F.count("*").alias(n))
    lower = sizes.select(own, F.coalesce(F.sum(n).over(Window.orderBy(own).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    inside = placed.withColumn(name, F.row_number().over(Window.partitionBy(own).orderBy(key)) - 1)
    return inside.join(F.broadcast(lower), own).withColumn(name, F.col(name) + F.col(before)).drop(own, before)


def as_of(rows: DataFrame, marks: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """rows with name: the value of the last of marks (order, value) at or before their order; null before the first, and for a null order. Of marks of one order the largest value counts; marks without order are none.

    Both sides are dealt by ranges of the rows' order. In a range a window carries the last mark on, and what reaches a range from those before it is one row a range, sorted alone.
    """
    part, is_mark, at, own, head = (free([*rows.columns, *marks.columns, name], x) for x in ("_part", "_mark", "_at", "_own", "_head"))
    place = lambda df, bounds: df.withColumn(part, bounds)
    of = ranges(rows, order)[0]
    told = place(marks.where(F.col(order).isNotNull()), of).groupBy(part, F.col(order).alias(at)).agg(F.max(value).alias(own)).withColumn(own, F.struct(own))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    heads = told.groupBy(part).agg(F.max_by(own, at).alias(own))
    parts = place(rows, of).select(part).distinct().join(heads, part, "full").select(part, F.last(own, ignorenulls=True).over(earlier).alias(head))
    mixed = place(rows, of).withColumns({at: F.col(order), is_mark: F.lit(1), own: F.lit(None).cast(told.schema[own].dataType)}).unionByName(told.withColumn(is_mark, F.lit(0)), allowMissingColumns=True)
    before = Window.partitionBy(part).orderBy(at, is_mark).rowsBetween(Window.unboundedPreceding, 0)
    met = mixed.withColumn(own, F.last(own, ignorenulls=True).over(before)).where(F.col(is_mark) == 1).join(F.broadcast(parts), part)
    found = F.when(F.col(at).isNotNull(), F.coalesce(own, head)[own])
    return met.select(*(F.col(f"`{c}`") for c in rows.columns if c != name), found.alias(name))


def with_next(rows: DataFrame, key: str, value: str, name: str = "next") -> DataFrame:
    """rows with name: struct<key, value> of the row with the next larger key, null for the last; equal keys follow one another in no fixed order. Null keys aren't allowed. Other columns keep any name; one called name is replaced.

    Within a range of keys a window gives the next row, and each range's last row gets the first row of the ranges after it: one row a range is sorted alone.
    """
    part, head, after, found = (free([*rows.columns, name], x) for x in ("_range", "_head", "_after", "_next"))
    placed = rows.withColumn(part, ranges(rows, key)[0])
    own = F.struct(F.col(key).alias("key"), F.col(value).alias("value"))
    heads = placed.groupBy(part).agg(F.min_by(own, key).alias(head)).withColumn(after, F.lead(head).over(Window.orderBy(part)))
    inside = placed.withColumn(found, F.lead(own).over(Window.partitionBy(part).orderBy(key)))
    met = inside.join(F.broadcast(heads.select(part, after)), part)
    return met.select(*(F.col(f"`{c}`") for c in rows.columns if c != name), F.coalesce(found, after).alias(name))
