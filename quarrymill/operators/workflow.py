"""Submissions from upload to score: a state machine for each key and epoch, as joins and sums.

Of the events of a key and epoch, in order, a submission meets the upload gate of its time; the first valid one that the gate lets through is accepted and
its hash recorded, later ones are duplicates. Evaluations and failures set the state whatever it was. A score goes to the hash that it names, else to the recorded one; without either it does nothing.
All that an event needs from those before it is when the key's first submission was accepted, so nothing is walked through in order: the acceptance is
one aggregated row for each key and epoch, and the state in the end is the last that was set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import as_of

#: What sets a state, and which.
STATES = {"queued": "queued", "accepted": "pending", "evaluating": "evaluating", "scored": "scored", "failed": "failed"}


def outcomes(events: DataFrame, gates: DataFrame, default: str = "enabled") -> DataFrame:
    """events (key, epoch, ord, kind, valid, hash, score, others) with gate and outcome and, for scores, target: the hash that is scored.

    kind: submit, evaluate, score or fail; other kinds, and null, do nothing (outcome ignored). gates (ord, gate): from its ord on, the upload gate is disabled, pending or enabled; before the first it is `default`. ord orders the events
    of a key and epoch and the gates (a number, date, time or string); an event at a gate's own ord meets that gate, rows of equal ord in a key and epoch come in order of hash. Null keys and epochs are like any other; a null valid is false, an empty hash none.
    Outcomes of submissions: forbidden, queued, invalid, duplicate, accepted; of the others: evaluating, scored, ignored (a score without a hash, or null), failed.
    """
    met = as_of(events, gates, "ord", "gate", "gate").withColumn("gate", F.coalesce("gate", F.lit(default)))
    given = F.when(F.col("hash") != "", F.col("hash"))
    kind = F.coalesce("kind", F.lit(""))
    good = (kind == "submit") & (F.col("gate") == "enabled") & F.coalesce("valid", F.lit(False)) & given.isNotNull()
    spot = F.struct(F.col("ord"), F.coalesce(given, F.lit("")).alias("hash"))
    rows = met.withColumn("_in", F.struct("key", "epoch"))
    # copies of the first row are duplicates of it: they are counted, and one of them is accepted
    first = rows.where(good).groupBy("_in").agg(F.min(spot).alias("_first"))
    met = rows.join(first, "_in", "left").withColumn("_known", F.when(F.col("_first.ord") < F.col("ord"), F.col("_first.hash")))
    target = F.when((kind == "score") & F.col("score").isNotNull(), F.coalesce(given, "_known"))
    submit = F.when(F.col("gate") == "disabled", "forbidden").when(F.col("gate") == "pending", "queued").when(~good, "invalid").when(spot == F.col("_first"), "accepted").otherwise("duplicate")
    outcome = F.when(kind == "submit", submit).when(kind == "evaluate", "evaluating").when(kind == "fail", "failed").when(target.isNotNull(), "scored").otherwise("ignored")
    return met.withColumn("target", target).withColumn("outcome", outcome).drop("_in", "_first", "_known")


def states(done: DataFrame) -> DataFrame:
    """outcomes() to one row for each key and epoch in which a state was set: state in the end, hash that was accepted, score (the last one), submissions, rejected."""
    state = F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))
    rows = done.withColumn("set", F.try_element_at(state, F.col("outcome")))
    at = F.struct("ord", F.coalesce("hash", F.lit("")), "set")
    out = rows.groupBy("key", "epoch").agg(
        F.max_by("set", F.when(F.col("set").isNotNull(), at)).alias("state"), F.min(F.when(F.col("outcome") == "accepted", F.col("hash"))).alias("hash"), F.max_by("score", F.when(F.col("outcome") == "scored", F.struct("ord", "hash", "score"))).alias("score"),
        F.sum((F.col("kind") == "submit").cast("long")).alias("submissions"), F.sum(F.col("outcome").isin("forbidden", "invalid", "duplicate").cast("long")).alias("rejected"),
    )
    return out.where("state IS NOT NULL")


def scores(done: DataFrame) -> DataFrame:
    """(hash, key, score, ord): the last score of each hash, whose key it was, and when it was first scored."""
    rows = done.where("outcome = 'scored'").select(F.col("target").alias("hash"), "key", "score", "ord")
    last = F.max(F.struct("ord", "key", "score")).alias("last")
    return rows.groupBy("hash").agg(last, F.min("ord").alias("first")).select("hash", "last.key", "last.score", F.col("first").alias("ord"))
