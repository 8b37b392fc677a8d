"""Read queries over the state tables: submissions, results, agents, logs, status, configuration. Each is one DataFrame; what a caller asks for is a column or a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.scalars import free

from .neighbours import as_of
from .state import latest, lookup

#: Packages above this size aren't stored.
MOST_CODE = 4 << 20
# fixed values: namespaces of a submission, and defaults of the challenge's parameters
NAMESPACES = ("agent_code", "submission_data", "agent_hash", "eval_status")
PARAMS = {"min_conversations": 10, "max_conversations": 50, "max_size_bytes": 104_857_600, "model": None}
# fixed values: defaults of the global state and of the reviews' timeouts
STATE = {"evaluation_enabled": True, "upload_state": "enabled", "sudo_owner": ""}
TIMEOUTS = {"llm_review_timeout_blocks": 3600, "ast_review_timeout_blocks": 1800, "basilica_timeout_blocks": 7200}


def _last(rows: DataFrame, epochs: DataFrame, default: Column) -> DataFrame:
    """rows with epoch: the last one of their hotkey, else default. epochs: (hotkey, epoch), one row a hotkey; a missing hotkey gives no match, not an error."""
    return rows.drop("epoch").join(epochs.select("hotkey", "epoch"), "hotkey", "left").withColumn("epoch", F.coalesce("epoch", default))


def _status(rows: DataFrame, statuses: DataFrame, at: Column) -> DataFrame:
    """rows with status (null if none) of their hotkey at an epoch."""
    found = statuses.select(F.col("hotkey").alias("_hotkey"), F.col("epoch").alias("_epoch"), "status")
    return rows.join(found, (F.col("hotkey") == F.col("_hotkey")) & (at == F.col("_epoch")), "left").drop("_hotkey", "_epoch")


def submissions(scores: DataFrame, epochs: DataFrame, statuses: DataFrame, current: int) -> DataFrame:
    """(hash, hotkey, score, epoch, status) of scores (hash, hotkey, score): the last epoch, the current one if there is none; the status at the current epoch, pending if there is none."""
    rows = _status(_last(scores.select("hash", "hotkey", "score"), epochs, F.lit(current)), statuses, F.lit(current))
    return rows.select("hash", "hotkey", "score", "epoch", F.coalesce("status", F.lit("pending")).alias("status"))


def submission(scores: DataFrame, epochs: DataFrame, statuses: DataFrame, wanted: Column) -> DataFrame:
    """The first of scores (hash, hotkey, score, ord) that wanted names, by hash or hotkey: its last epoch, 0 if there is none, and the status then, scored if there is none. No row if nothing is found."""
    rows = _last(lookup(scores, wanted).select("hash", "hotkey", "score"), epochs, F.lit(0))
    return _status(rows, statuses, F.col("epoch")).select("hash", "hotkey", "score", "epoch", F.coalesce("status", F.lit("scored")).alias("status"))


def agents(asked: DataFrame, scores: DataFrame, epochs: DataFrame, statuses: DataFrame, hashes: DataFrame, current: int) -> DataFrame:
    """(hotkey, epoch, score, status, code_hash) of each asked hotkey: the last epoch, else the current one; status and code hash at the current epoch. What isn't known is null."""
    rows = asked.select("hotkey").join(scores.select("hotkey", "score"), "hotkey", "left")
    rows = _status(_last(rows, epochs, F.lit(current)), statuses, F.lit(current))
    found = hashes.where(F.col("epoch") == current).select("hotkey", F.col("hash").alias("code_hash"))
    return rows.join(found, "hotkey", "left").select("hotkey", "epoch", "score", "status", "code_hash")


def logs(asked: DataFrame, stored: DataFrame, current: int) -> DataFrame:
    """(hotkey, epoch, logs) of each asked hotkey; stored: (hotkey, logs array<string>). Without an entry the list is empty."""
    met = asked.select("hotkey").join(stored.select("hotkey", "logs"), "hotkey", "left")
    return met.select("hotkey", F.lit(current).alias("epoch"), F.coalesce("logs", F.expr("cast(array() as array<string>)")).alias("logs"))


def status(board: DataFrame, current: int, enabled: bool, upload: str, miners: int, validators: int) -> DataFrame:
    """One row: the epoch, whether evaluation and uploads are on, and the counts."""
    return board.agg(F.count("*").alias("total_submissions")).select(
        F.lit(current).alias("epoch"), F.lit(enabled).alias("evaluation_enabled"), F.lit(upload).alias("upload_state"), F.lit(upload == "enabled").alias("upload_enabled"), "total_submissions", F.lit(miners).alias("active_miners"),
        F.lit(validators).alias("validator_count"),
    )


def params(stored: DataFrame) -> DataFrame:
    """One row of the challenge's parameters: the stored ones, at most one row, else the defaults."""
    kinds = {"min_conversations": "bigint", "max_conversations": "bigint", "max_size_bytes": "bigint", "model": "string"}
    found = stored.agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in PARAMS))
    return found.select(*(F.when(F.col("_n") > 0, F.col(c)).otherwise(F.lit(v)).cast(kinds[c]).alias(c) for c, v in PARAMS.items()))


def settings_at(asked: DataFrame, stored: DataFrame, defaults: dict, order: str = "seq") -> DataFrame:
    """asked with the settings that held at its order: those last stored (order, one column for each of defaults) at or before it, else the defaults.

    Settings are stored whole, so a null among them is null. Of two stored at one order the larger counts, compared column by column; those without order don't count, and an ask without order gets the defaults.
    Other columns keep any name; those that are called as a setting are replaced. Both sides are dealt by ranges of order.
    """
    held = free([*asked.columns, *stored.columns, *defaults], "_held")
    marks = stored.select(order, F.struct(*defaults).alias(held))
    met = as_of(asked.select(*(F.col(f"`{c}`") for c in asked.columns if c not in defaults)), marks, order, held, held)
    value = lambda c, v: F.when(F.col(held).isNull(), F.lit(v)).otherwise(F.col(held)[c]).cast(stored.schema[c].dataType).alias(c)
    return met.select(*(F.col(f"`{c}`") for c in met.columns if c != held), *(value(c, v) for c, v in defaults.items()))


def hotkey_values(asked: DataFrame, log: DataFrame, namespaces: tuple[str, ...] = ("score", "wta_weight")) -> DataFrame:
    """asked (hotkey) with a column for each namespace: the value last written to the log (namespace, hotkey, value, seq); null if there is none or it was deleted (null value).

    The log is summed by hotkey and namespace before it is shuffled; only what was deleted meets its deletion. A hotkey that is asked twice is answered twice, a null one has no values."""
    kept = latest(log.where(F.col("namespace").isin(*namespaces)), ["hotkey", "namespace"])
    wide = kept.groupBy("hotkey").agg(*(F.max(F.when(F.col("namespace") == n, F.col("value"))).alias(n) for n in namespaces))
    return asked.select("hotkey").join(wide, "hotkey", "left").select("hotkey", *namespaces)


def dataset_info(stored: DataFrame) -> DataFrame:
    """One row of the active dataset: the stored one, at most one row, else an inactive one without a name."""
    defaults = {"id": "", "name": "", "conversation_count": 0, "total_messages": 0, "size_bytes": 0, "created_at": 0, "is_active": False}
    found = stored.agg(*(F.first(c).alias(c) for c in defaults))
    return found.select(*(F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()))


def stored_code(packages: DataFrame) -> DataFrame:
    """packages (package) with stored: whether it is small enough. An empty one is stored as a deletion; a null one isn't stored."""
    return packages.withColumn("stored", F.coalesce(F.octet_length("package") <= MOST_CODE, F.lit(False)))


def has_submitted(asked: DataFrame, packages: DataFrame) -> DataFrame:
    """asked (hotkey, epoch) with submitted: whether there is a package that isn't empty."""
    there = packages.where((F.octet_length("package") > 0) & (F.octet_length("package") <= MOST_CODE)).select("hotkey", "epoch", F.lit(True).alias("submitted")).distinct()
    return asked.join(there, ["hotkey", "epoch"], "left").withColumn("submitted", F.coalesce("submitted", F.lit(False)))


def deletions(keys: DataFrame) -> DataFrame:
    """(namespace, hotkey, epoch, value): the empty values that delete a submission (hotkey, epoch)."""
    return keys.select(F.explode(F.array(*map(F.lit, NAMESPACES))).alias("namespace"), "hotkey", "epoch", F.lit(None).cast("string").alias("value"))


def direct_scores(bodies: DataFrame, records: DataFrame, current: int) -> DataFrame:
    """(hash, hotkey, score, epoch, status): what bodies (hotkey, agent_hash, score) write. The hash is the body's, else the one recorded for (hotkey, current epoch); a body without hotkey, score or
    any hash writes nothing."""
    found = records.where(F.col("epoch") == current).select("hotkey", F.col("hash").alias("_hash"))
    met = bodies.where(F.col("hotkey").isNotNull() & F.col("score").isNotNull()).join(found, "hotkey", "left").withColumn("hash", F.coalesce("agent_hash", "_hash", F.lit("")))
    return met.where(F.col("hash") != "").select("hash", "hotkey", "score", F.lit(current).alias("epoch"), F.lit("scored").alias("status"))


def status_view(replies: DataFrame, asked: str = "id", body: str = "body") -> DataFrame:
    """(submission_id, hotkey, status, total, completed, pending, progress, score, submitted, evaluation_ms) from replies of JSON: - for a missing hotkey or status, the asked id for a missing one, null for
    other missing fields."""
    kind = "submission_id string, miner_hotkey string, status string, progress struct<total_tasks:bigint,completed_tasks:bigint,pending_tasks:bigint,percentage:double>, score double, submitted_at string, evaluation_time_ms bigint"
    rows = replies.select(F.col(asked).alias("_id"), F.from_json(body, kind).alias("b"))
    return rows.select(
        F.coalesce("b.submission_id", "_id").alias("submission_id"), F.coalesce("b.miner_hotkey", F.lit("-")).alias("hotkey"), F.coalesce("b.status", F.lit("-")).alias("status"), F.col("b.progress.total_tasks").alias("total"),
        F.col("b.progress.completed_tasks").alias("completed"), F.col("b.progress.pending_tasks").alias("pending"), F.when(F.col("b.progress.percentage").isNotNull(), F.format_string("%.1f%%", "b.progress.percentage")).alias("progress"),
        F.when(F.col("b.score").isNotNull(), F.format_string("%.4f", "b.score")).alias("score"), F.col("b.submitted_at").alias("submitted"), F.col("b.evaluation_time_ms").alias("evaluation_ms"),
    )
