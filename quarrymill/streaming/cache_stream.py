"""The cache whose entries expire, over a stream: event-time timers answer gets in order and let go of what has expired."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Added to all times inside: the watermark begins at 0, and what isn't after it is late.
SHIFT_S = 2_000_000_000


def _ms(at: float) -> int:
    """The millisecond in which a time lies, as Spark's watermark counts them."""
    return int((at + SHIFT_S) * 1_000_000) // 1000


class Cache(StatefulProcessor):
    """Per key: the time of the last insert, and the events that the watermark hasn't passed yet.

    One timer stands for the earliest such event. When it fires, all events up to the watermark are final; they are gone through in order of (at, order). Another stands for the time at
    which the last insert expires: then the key's state is gone.
    """

    def __init__(self, pending: T.StructType, ttl_s: float) -> None:
        self.schema, self.ttl = pending, ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.schema)
        self.last = handle.getValueState("last", "at double")

    def close(self) -> None:
        pass

    def _timer(self, ms: int) -> None:
        self.handle.registerTimer(ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for batch in rows:
            events = list(zip(batch["at"].tolist(), batch["order"].tolist(), batch["no_order"].tolist(), batch["insert"].tolist(), strict=True))
            self.pending.appendList(events)
            least = min((a for a, *_ in events), default=None)
            first = least if first is None else min(first, least)
        if first is not None:
            self._timer(_ms(first))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        held = [tuple(x) for x in self.pending.get()] if self.pending.exists() else []
        ready = sorted((x for x in held if _ms(x[0]) <= passed), key=lambda x: (x[0], not x[2], x[1]))  # nulls first
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for at, order, no_order, insert in ready:
            if insert:
                last = at
            else:
                out.append((key[0], key[1], at, order, no_order, last is not None and at - last < self.ttl))
        if ready:
            left = [x for x in held if _ms(x[0]) > passed]
            if left:
                self.pending.put(left)
                self._timer(_ms(min(x[0] for x in left)))
            else:
                self.pending.clear()
        # a get after the watermark can't find what has expired by it
        if last is None or _ms(last + self.ttl) <= passed:
            if self.last.exists():
                self.last.clear()
        elif not self.last.exists() or self.last.get()[0] != last:
            self.last.update((last,))
            self._timer(_ms(last + self.ttl))
        if out:
            yield pd.DataFrame(out, columns=["key", "no_key", "at", "order", "no_order", "hit"])


def hits(events: DataFrame, key: str, at: str, order: str, insert: str, ttl_s: float = 86_400.0, late_s: float = 0.0) -> DataFrame:
    """ttl_cache.hits() over a stream of events: (key, at, order, hit) for each get, once the watermark, late_s behind the latest event, has passed it.

    Within late_s, events of a key may come in any order and batch; the answers are those of the batch over all events (times of the years 1907 to 2198). Later ones are dropped: such a get has no answer, such an insert starts nothing. Keys and orders are numbers or strings. A get without a time
    misses at once, an insert without one starts nothing, a null insert is a get. Null is a key like any other. State is a key's last insert until the watermark passes its expiry, and events up to the watermark.
    The state store is set to RocksDB, which timers need.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kinds = {c: events.schema[c].dataType for c in (key, at, order)}
    # nulls travel as a flag beside a value: pandas would turn whole numbers beside a null into floating-point ones
    filled = lambda c: F.coalesce(F.col(c), F.lit("" if isinstance(kinds[c], T.StringType) else 0).cast(kinds[c]))
    rows = events.select(
        filled(key).alias("key"), F.col(key).isNull().alias("no_key"), F.when(~F.isnan(F.col(at).cast("double")), F.col(at).cast("double")).alias("at"), filled(order).alias("order"), F.col(order).isNull().alias("no_order"), F.coalesce(F.col(insert), F.lit(False)).alias("insert")
    )
    pending = T.StructType([T.StructField("at", T.DoubleType()), T.StructField("order", kinds[order]), T.StructField("no_order", T.BooleanType()), T.StructField("insert", T.BooleanType())])
    shown = T.StructType([T.StructField("key", kinds[key]), T.StructField("no_key", T.BooleanType()), T.StructField("at", T.DoubleType()), T.StructField("order", kinds[order]), T.StructField("no_order", T.BooleanType()), T.StructField("hit", T.BooleanType())])
    timed = rows.where("at IS NOT NULL").withColumn("time", F.timestamp_micros(((F.col("at") + SHIFT_S) * 1_000_000).cast("long"))).withWatermark("time", f"{late_s} seconds")
    answered = timed.groupBy("key", "no_key").transformWithStateInPandas(Cache(pending, ttl_s), shown, "Append", "eventTime")
    missed = rows.where("at IS NULL AND NOT insert").select("key", "no_key", "at", "order", "no_order", F.lit(False).alias("hit"))
    both = answered.unionByName(missed)
    return both.select(F.when(~F.col("no_key"), F.col("key")).alias(key), F.col("at").cast(kinds[at]).alias(at), F.when(~F.col("no_order"), F.col("order")).alias(order), "hit")


def replay(spark: SparkSession, events: DataFrame, answers: str, checkpoint: str) -> DataFrame:
    """Runs a stream of answers over what there is now, to its end, into Parquet files; the files' rows."""
    events.writeStream.format("parquet").option("path", answers).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(answers)
