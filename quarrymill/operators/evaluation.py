"""Evaluation of a dataset of conversations, and the merging of reviewers' scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.scalars import clamp, free, weighted_score
from quarrymill.sources.shared import written

from . import quality, similarity
from .neighbours import ranges


def evaluate(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row: counts, format, quality, uniqueness, originality, score, passed. An empty dataset scores 0."""
    # texts are gathered once: what is told of a conversation and its first message are written
    told = quality.measures(conversations).withColumn("content", F.unhex("content_key"))
    seen = written(similarity.firsts(told, key, "n_messages", "valid_format", "quality", "penalty", "content"), "measures")
    sums = seen.agg(
        F.count("*").alias("n_conversations"), F.coalesce(F.sum("n_messages"), F.lit(0)).alias("n_messages"), F.coalesce(F.avg(F.col("valid_format").cast("double")), F.lit(0.0)).alias("format_score"),
        F.coalesce(F.avg("quality"), F.lit(0.0)).alias("quality_score"), F.coalesce(F.avg("penalty"), F.lit(1.0)).alias("pattern_penalty"), F.lit(1).alias("one"),
    )
    unique = seen.agg(F.countDistinct("content").alias("unique"), F.lit(1).alias("one"))
    both = sums.join(unique, "one").join(similarity.internal_of(seen).select("mean_similarity", "penalty", F.lit(1).alias("one")), "one")
    originality = F.when(F.col("n_conversations") == 0, 0.0).otherwise(clamp(F.col("unique") / F.greatest("n_conversations", F.lit(1)) * (1 - F.col("penalty"))))
    both = both.withColumn("originality_score", originality * clamp(1 - F.col("pattern_penalty")))
    both = both.withColumn("score", weighted_score(F.col("format_score"), F.col("quality_score"), F.col("originality_score")))
    return both.select("n_conversations", "n_messages", "format_score", "quality_score", "mean_similarity", "originality_score", "score", (F.col("score") >= 0.5).alias("passed"))


def consensus(scores: DataFrame, group: str, score: str, order: str, limit: float = 0.2) -> DataFrame:
    """One row for each group: final_score without outliers, agreement, n_scores, outliers (places from 0 in order).

    An outlier is further than `limit` from the mean of all; the mean isn't taken anew. Without others the mean is final. agreement: 1 less
    the largest deviation over limit, at least 0. Null scores count in n_scores alone, of NaN all places are outliers; null is a group like any other.

    Sums and places come from partial counts by group and range of order (a number, date, time or string), so a group of any size is spread over the
    ranges; only outliers' places are listed.
    """
    rows = scores.select(F.struct(group).alias("g"), F.col(order).alias("at"), F.col(score).alias("s"), ranges(scores, order)[0].alias("part"))
    whole = Window.partitionBy("g")
    sums = rows.groupBy("g", "part").agg(F.count("*").alias("n"), F.sum("s").alias("sum"), F.count("s").alias("valid"))
    mean = F.sum("sum").over(whole) / F.nullif(F.sum("valid").over(whole), F.lit(0))
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = rows.join(sums.select("g", "part", mean.alias("mean"), before.alias("before")), ["g", "part"])
    place = F.col("before") + F.row_number().over(Window.partitionBy("g", "part").orderBy("at")) - 1
    far = F.abs(F.col("s") - F.col("mean"))
    out = met.withColumn("place", place.cast("int")).groupBy("g").agg(
        F.coalesce(F.avg(F.when(far <= limit, F.col("s"))), F.first("mean")).alias("final_score"), (1 - F.least(F.max(far) / limit, F.lit(1.0))).alias("agreement"), F.count("*").alias("n_scores"), F.array_sort(F.collect_list(F.when(far > limit, F.col("place")))).alias("outliers"),
    )
    return out.select(F.col("g")[group].alias(group), "final_score", "agreement", "n_scores", "outliers")


def sum_normalise(rows: DataFrame, value: str, name: str = "weight") -> DataFrame:
    """value over the sum of all values, clamped; equal shares if the sum isn't positive. The sum is one aggregate, joined back. Other columns keep any name but that of the weight."""
    total, n, one = (free([*rows.columns, name], x) for x in ("_sum", "_n", "_one"))
    sums = rows.agg(F.sum(value).alias(total), F.count("*").alias(n)).withColumn(one, F.lit(1))
    met = rows.withColumn(one, F.lit(1)).join(F.broadcast(sums), one)
    return met.withColumn(name, F.when(F.col(total) > 0, clamp(F.col(value) / F.col(total))).otherwise(1 / F.col(n))).drop(one, total, n)


def mean_or(default: float | None, value: Column, clamped: bool = True) -> Column:
    """Mean, `default` for none; clamped for dataset scores of validators, not for datasets' own."""
    mean = F.avg(value)
    mean = clamp(mean) if clamped else mean
    return mean if default is None else F.coalesce(mean, F.lit(default))
