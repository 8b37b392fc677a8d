"""A cache whose entries expire, over a log of inserts and gets. cache_stream has the same over a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.scalars import free
from quarrymill.operators.neighbours import ranges


def hits(events: DataFrame, key: str, at: str, order: str, insert: Column, ttl_s: float = 86_400.0) -> DataFrame:
    """The gets (events that aren't inserts) with hit: the key's last insert before is younger than ttl_s.

    Reading doesn't extend an entry, inserting starts it anew, and at exactly ttl_s it has expired. at: seconds as a number; an insert without one starts nothing.
    Null is a key like any other. Each key and range of time has one row with its last insert, and those before it in time reach the range's events: a key
    of any size is spread over the ranges. Other columns keep any name.
    """
    name, part, ins, last, here = (free([*events.columns, "hit"], x) for x in ("_key", "_part", "_insert", "_last", "_here"))
    rows = events.withColumns({name: F.struct(key), part: ranges(events, at)[0], ins: insert})
    started = F.when(F.col(ins), F.col(at))
    # inserts come in order of time, so the last one is the one of the greatest time
    sums = rows.groupBy(name, part).agg(F.max(started).alias(last))
    earlier = F.max(last).over(Window.partitionBy(name).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    met = rows.join(sums.select(name, part, earlier.alias(last)), [name, part])
    before = Window.partitionBy(name, part).orderBy(at, order).rowsBetween(Window.unboundedPreceding, -1)
    seen = met.withColumn(here, F.coalesce(F.max(started).over(before), F.col(last)))
    return seen.where(~F.col(ins)).select(*events.columns, F.coalesce(F.col(at) - F.col(here) < ttl_s, F.lit(False)).alias("hit"))


def alive(entries: DataFrame, inserted: str, now_s: float, ttl_s: float = 86_400.0) -> DataFrame:
    """Entries that haven't expired."""
    return entries.where(F.col(inserted) + ttl_s > now_s)
