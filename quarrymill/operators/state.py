"""Keyed state as an append-only log, the leaderboard and the read queries over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.scalars import clamp, free

from .evaluation import sum_normalise
from .neighbours import ranges


def latest(log: DataFrame, keys: list[str], seq: str = "seq", value: str = "value") -> DataFrame:
    """The last value of each key and ord, the first seq since its last deletion; keys whose last value is null (deleted) are gone. Deletions are one row a key; the log is joined to them and aggregated by the same key, so it is shuffled once."""
    own = free(log.columns, "_gone")
    gone = log.where(F.col(value).isNull()).groupBy(*keys).agg(F.max(seq).alias(own))
    met = log.join(gone, keys, "left").where(F.col(own).isNull() | (F.col(seq) > F.col(own)))
    return met.groupBy(*keys).agg(F.max_by(value, seq).alias(value), F.min(seq).alias("ord"))


def first_only(submissions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every submission with accepted: the first of its key in order; of rows that are equal in all of order any one. Null keys are keys, null orders come first. Other columns keep any name; one called accepted is replaced.

    Submissions are dealt by key and range of the first of order (a number, date, time or string), so a key that a third of them have is spread over the ranges; a key's first range comes from partial counts.
    """
    whole, part, first, n = (free([*submissions.columns, "accepted"], x) for x in ("_key", "_part", "_first", "_n"))
    rows = submissions.withColumns({whole: F.struct(*(F.col(f"`{k}`") for k in keys)), part: ranges(submissions, order[0])[0]})
    firsts = rows.groupBy(whole, part).agg(F.count("*").alias(n)).select(whole, part, (F.col(part) == F.min(part).over(Window.partitionBy(whole))).alias(first))
    inside = F.row_number().over(Window.partitionBy(whole, part).orderBy(*(F.col(f"`{c}`") for c in order)))
    met = rows.join(firsts, [whole, part]).withColumn(first, F.col(first) & (inside == 1))
    return met.select(*(F.col(f"`{c}`") for c in submissions.columns if c != "accepted"), F.col(first).alias("accepted"))


def ranked(scores: DataFrame, score: str = "score", order: str = "ord") -> DataFrame:
    """rank by score, highest first (NaN above all), ties in order (a number, date, time or string), equal rows in no fixed order; rows whose score is null have no rank.

    Rows are counted by score and range of order before they are shuffled; a row's rank is its place among those of its score and range, lifted
    by the counts before it. So neither all rows nor a score that a third of them share is sorted by one task. Other columns keep any name.
    """
    rows = scores.where(F.col(score).isNotNull())
    level, part, n, above, inside, over = (free([*scores.columns, "rank"], x) for x in ("_level", "_part", "_n", "_above", "_inside", "_over"))
    of_score, of_order = ranges(rows, score, order)
    rows = rows.withColumn(part, of_order)
    sums = rows.groupBy(score, part).agg(F.count("*").alias(n)).withColumn(level, of_score)
    earlier = lambda w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = sums.groupBy(level).agg(F.sum(n).alias(n)).select(level, earlier(Window.orderBy(F.desc(level))).alias(over))  # one row a range
    lifts = sums.withColumn(above, earlier(Window.partitionBy(level).orderBy(F.desc(score), part))).join(F.broadcast(tops), level)
    met = rows.join(lifts.select(score, part, (F.col(above) + F.col(over)).alias(above)), [score, part])
    met = met.withColumn(inside, F.row_number().over(Window.partitionBy(score, part).orderBy(F.asc(order))))
    return met.select(*scores.columns, (F.col(above) + F.col(inside)).cast("long").alias("rank"))


def leaderboard(scores: DataFrame, hotkeys: DataFrame, epochs: DataFrame) -> DataFrame:
    """scores (hash, score, ord) with their hotkey (hash, hotkey), empty ones dropped, ranked, and last epoch (hotkey, epoch), 0 if none."""
    named = hotkeys.where((F.col("hotkey") != "") & F.col("hotkey").isNotNull())
    return ranked(scores.join(named, "hash")).join(epochs, "hotkey", "left").withColumn("epoch", F.coalesce("epoch", F.lit(0)))


def unbanned(board: DataFrame, banned: DataFrame, key: str = "hotkey") -> DataFrame:
    """Ranks stay as they were, so the list may have gaps."""
    return board.join(banned.select(key).distinct(), key, "left_anti")


def weights(board: DataFrame, banned: DataFrame, key: str = "hotkey", score: str = "score") -> DataFrame:
    """Positive scores that aren't banned, clamped, over their sum."""
    own = free(board.columns, "clamped")
    kept = unbanned(board, banned, key).where(F.col(score) > 0).withColumn(own, clamp(F.col(score)))
    return sum_normalise(kept, own).drop(own)


def lookup(board: DataFrame, wanted: Column, order: str = "ord") -> DataFrame:
    """The first row that either its hash or its hotkey names."""
    return board.where((F.col("hash") == wanted) | (F.col("hotkey") == wanted)).orderBy(order).limit(1)


def top(board: DataFrame, n: int, offset: int = 0) -> DataFrame:
    return board.orderBy("rank").offset(offset).limit(n)


def stats(board: DataFrame) -> DataFrame:
    return board.agg(F.count("*").alias("total"), F.coalesce(F.sum((F.col("score") > 0).cast("long")), F.lit(0)).alias("active"))


def status_at(board: DataFrame, statuses: DataFrame, epoch: Column, default: str) -> DataFrame:
    """board with the status (hotkey, epoch, status) at an epoch of its own or a fixed one. Other columns keep any name; a status that it had is replaced."""
    at, found = (free([*board.columns, "status"], x) for x in ("_at", "_found"))
    met = board.withColumn(at, epoch).join(statuses.select("hotkey", F.col("epoch").alias(at), F.col("status").alias(found)), ["hotkey", at], "left")
    return met.select(*(F.col(f"`{c}`") for c in board.columns if c != "status"), F.coalesce(found, F.lit(default)).alias("status"))


def code_at(asked: DataFrame, codes: DataFrame) -> DataFrame:
    """asked (hotkey, epoch) with its code (hotkey, epoch, code) at that epoch, else at the one before (never below 0). Other columns keep any name; a code that it had is replaced."""
    at, now, before = (free([*asked.columns, "code"], x) for x in ("_e", "_code", "_before"))
    own = lambda name: codes.select("hotkey", F.col("epoch").alias(at), F.col("code").alias(name))
    rows = asked.withColumn(at, F.col("epoch")).join(own(now), ["hotkey", at], "left").withColumn(at, F.greatest(F.col("epoch") - 1, F.lit(0)))
    met = rows.join(own(before), ["hotkey", at], "left")
    return met.select(*(F.col(f"`{c}`") for c in asked.columns if c != "code"), F.coalesce(now, before).alias("code"))


def gate(enabled: Column, pending: Column) -> Column:
    """What an upload meets."""
    return F.when(~enabled, "forbidden").when(pending, "queued").otherwise("accepted")


def submission_problems(row: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    """row (hotkey, code_hash, package) with errors and warnings, all that apply."""
    empty = lambda c: F.coalesce(F.octet_length(c), F.lit(0)) == 0
    found = lambda *pairs: F.filter(F.array(*(F.when(c, F.lit(t)) for c, t in pairs)), lambda x: x.isNotNull())
    return row.withColumns(
        {"errors": found((empty("hotkey"), "hotkey is empty"), (empty("package"), "package is empty"), (F.coalesce(F.octet_length("package"), F.lit(0)) > most_bytes, "package is too large")), "warnings": found((empty("code_hash"), "code hash is missing"))}
    )


def complete(*fields: str) -> Column:
    """All fields are there and not empty."""
    out = F.lit(True)
    for f in fields:
        out = out & (F.coalesce(F.octet_length(f), F.lit(0)) > 0)
    return out


def config_problem(count: Column, timeout_s: Column, size: Column) -> Column:
    """The first setting out of range, null if none: 10 to 50 conversations, 7200 seconds, 104,857,600 bytes."""
    return F.when(~count.between(10, 50), "conversation_count").when(timeout_s > 7200, "timeout").when(size > 104_857_600, "size")


def limits_problem(cpu_s: Column, memory: Column, processes: Column, file_bytes: Column) -> Column:
    return F.when(cpu_s > 7200, "cpu").when(memory > 4_000_000_000, "memory").when(processes < 1, "processes").when(file_bytes > 200_000_000, "file_size")
