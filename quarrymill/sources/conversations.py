"""Conversations: JSON lines read strictly, the long table, and folders of sources."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALL = "struct<name:string,arguments:string>"
MESSAGE = f"struct<role:string,content:string,name:string,function_call:{CALL}>"
CONVERSATION = f"struct<messages:array<{MESSAGE}>,function_calls:array<{CALL}>,thinking:string>"

# fixed values: file names that a folder source takes and leaves
TAKEN = (".py", ".txt", ".cfg", ".yaml", ".yml", ".json", ".sh")
LEFT = (".pyc", ".pyo", ".so", ".png", ".jpg", ".gif", ".ico", ".md", ".wasm")


def table(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, messages) from the long table (conv_id, turn, role, text); turns in order of turn."""
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    message = lambda t: F.struct(t["role"].alias("role"), F.coalesce(t["text"], F.lit("")).alias("content"), F.lit(None).cast("string").alias("name"), F.lit(None).cast(CALL).alias("function_call"))
    return rows.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.transform("turns", message).alias("messages"))


class _Bad(ValueError):
    pass


def _pairs(pairs: list) -> dict:
    out = dict(pairs)
    for name in ("messages", "function_calls", "thinking", "role", "content", "name", "function_call", "arguments"):
        if sum(k == name for k, _ in pairs) > 1:
            raise _Bad(f"duplicate field `{name}`")
    return out


def _constant(name: str) -> None:
    raise _Bad(f"{name} is no JSON")


def _text(value: object, field: str, optional: bool = False) -> None:
    if value is None and optional:
        return
    if not isinstance(value, str):
        raise _Bad(f"`{field}` isn't a string")
    try:
        value.encode()
    except UnicodeEncodeError as e:
        raise _Bad("lone surrogate") from e


def _call(value: object) -> None:
    if not isinstance(value, dict):
        raise _Bad("a function call is an object")
    _text(value.get("name"), "name")
    _text(value.get("arguments"), "arguments")


def classify(line: str) -> tuple[str | None, str | None]:
    """(kind of error, message) of one line, (None, None) for a conversation. Unknown fields are ignored."""
    try:
        found = json.loads(line, object_pairs_hook=_pairs, parse_constant=_constant)
    except (ValueError, RecursionError) as e:
        return "InvalidJson", str(e)
    if not isinstance(found, dict):
        return "InvalidFormat", "expected a JSON object"
    if "messages" not in found:
        return "MissingField", "messages"
    try:
        if not isinstance(found["messages"], list):
            raise _Bad("`messages` isn't an array")
        for m in found["messages"]:
            if not isinstance(m, dict):
                raise _Bad("a message is an object")
            _text(m.get("role"), "role")
            _text(m.get("content"), "content")
            _text(m.get("name"), "name", optional=True)
            if m.get("function_call") is not None:
                _call(m["function_call"])
        calls = found.get("function_calls")
        if calls is not None:
            if not isinstance(calls, list):
                raise _Bad("`function_calls` isn't an array")
            for c in calls:
                _call(c)
        _text(found.get("thinking"), "thinking", optional=True)
    except _Bad as e:
        return "InvalidJson", str(e)
    if len(found["messages"]) < 2:
        return "InvalidFormat", f"must have at least {len(found['messages']) + 1} message" + "s" * len(found["messages"])
    return None, None


@F.pandas_udf(T.StructType([T.StructField("kind", T.StringType()), T.StructField("message", T.StringType())]))
def _classified(lines: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([classify(x) for x in lines], columns=["kind", "message"])


def parse(lines: DataFrame, line: str = "line", text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(kept columns, line, conversation fields, error<kind, message>) for the lines that aren't blank. line: numbers from 1."""
    rows = lines.where(F.trim(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")) != "")
    rows = rows.withColumn("_c", _classified(F.col(text)))
    ok = F.col("_c.kind").isNull()
    parsed = F.from_json(F.when(ok, F.col(text)), CONVERSATION)
    return rows.select(*keep, F.col(line).alias("line"), parsed.alias("_p"), F.when(~ok, F.col("_c")).alias("error")).select(*keep, "line", "_p.*", "error")


def _lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, value) of the lines of texts that aren't blank; lines end at \\n, one \\r before it is dropped."""
    rows = texts.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), "\n")).alias("line", "value")).withColumn("value", F.regexp_replace("value", "\r$", ""))
    return rows.where(F.trim(F.regexp_replace("value", r"(?U)^\s+|\s+$", "")) != "").withColumn("line", F.col("line") + 1)


def output_problems(outputs: DataFrame, key: str = "ord", text: str = "stdout") -> DataFrame:
    """(key, n_conversations, error<kind, line, message>) for each output of a script: blank ones and those with a bad line are invalid_output, at the first bad line. A null output is blank."""
    seen = _lines(outputs, key, text).withColumn("c", _classified("value"))
    bad = F.when(F.col("c.kind").isNotNull(), F.struct(F.col("line").cast("long").alias("line"), F.col("c.message").alias("message")))
    sums = seen.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n"), F.min(bad).alias("bad"))
    met = outputs.select(F.col(key).alias("key")).distinct().join(sums, F.col("key").eqNullSafe(F.col("_key")), "left")
    error = F.when(F.col("n").isNull(), F.struct(F.lit("invalid_output").alias("kind"), F.lit(None).cast("long").alias("line"), F.lit("Output is empty").alias("message")))
    error = error.when(F.col("bad").isNotNull(), F.struct(F.lit("invalid_output").alias("kind"), F.col("bad.line").alias("line"), F.col("bad.message").alias("message")))
    return met.select(F.col("key").alias(key), F.when(error.isNull(), F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_conversations"), error.alias("error"))


def output_rows(outputs: DataFrame, key: str = "ord", text: str = "stdout") -> DataFrame:
    """(key, line, conversation fields) of the outputs in which every line is a conversation."""
    good = output_problems(outputs, key, text).where("error IS NULL").select(F.col(key).alias("_key"))
    rows = _lines(outputs, key, text).join(good, F.col("key") == F.col("_key"), "left_semi")
    return rows.select(F.col("key").alias(key), "line", F.from_json("value", CONVERSATION).alias("p")).select(key, "line", "p.*")


def datasets(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, line, conversation fields) of the datasets (binary) that are good throughout: UTF-8, not empty, every line a conversation whose roles alternate. Any bad line leaves the whole dataset out."""
    from quarrymill.operators.quality import role_machine

    texts = files.where(F.is_valid_utf8(F.col(content).cast("string"))).select(key, F.col(content).cast("string").alias("_text"))
    rows = output_rows(texts, key, "_text")
    bad = rows.where(~role_machine(F.col("messages"))).select(F.col(key).alias("_bad")).distinct()
    return rows.join(bad, F.col(key) == F.col("_bad"), "left_anti")


def search(files: DataFrame, pattern: str, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line, text, shown) of the lines that match a regular expression (Java's); shown is path:line:text. Files that aren't UTF-8 are left out."""
    rows = files.where(F.is_valid_utf8(F.col(content).cast("string"))).select(F.col(path).alias("path"), F.posexplode(F.split(F.col(content).cast("string"), "\n")).alias("line", "text"), F.size(F.split(F.col(content).cast("string"), "\n")).alias("n"))
    # what follows the last line feed is a line only if there is something
    rows = rows.where((F.col("line") < F.col("n") - 1) | (F.col("text") != "")).select("path", (F.col("line") + 1).alias("line"), F.regexp_replace("text", "\r$", "").alias("text"))
    return rows.where(F.col("text").rlike(pattern)).withColumn("shown", F.concat_ws(":", "path", F.col("line").cast("string"), "text"))


def first_error(parsed: DataFrame) -> DataFrame:
    """(line, kind, message) of the first bad line, at which a strict parse ends; no row if all are good."""
    bad = parsed.where(F.col("error").isNotNull())
    return bad.agg(F.min(F.struct("line", "error.kind", "error.message")).alias("x")).where("x IS NOT NULL").select("x.*")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files with the part of the file from which they are read."""
    return spark.read.option("lineSep", "\n").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", "_metadata.file_block_length")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """place: a line's number within its block, from 1. The lines of a block follow one another in one task."""
    block, seen = None, 0
    for batch in batches:
        if batch.empty:
            continue
        keys = list(zip(batch["file_path"], batch["file_block_start"], strict=True))
        places = []
        for key in keys:
            seen = seen + 1 if key == block else 1
            block = key
            places.append(seen)
        yield batch.assign(place=places)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """parse() of files of lines, with their path. Lines end at \\n alone; one \\r before it is dropped, and so is a byte order mark at a file's start. A line that isn't UTF-8 is a bad line.

    Files are split for reading as Spark splits text. A task numbers the lines of its blocks, and the blocks' counts (one row a block) lift them to
    numbers within the file; lines aren't shuffled. The number of lines before a block depends on its start alone, so another split can't give wrong
    numbers: a block that was not counted fails the job.
    """
    key = ["file_path", "file_block_start", "file_block_length"]
    sizes = _blocks(spark, path).groupBy(*key).agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    valid = _blocks(spark, path).withColumn("value", F.when(F.is_valid_utf8("value"), F.regexp_replace("value", "\r$", "")).otherwise("not UTF-8"))
    lines = valid.mapInPandas(_count, T.StructType([*valid.schema.fields, T.StructField("place", T.LongType())]))
    met = lines.join(sizes.select(*key, earlier.alias("earlier")), key, "left")
    counted = F.coalesce("earlier", F.raise_error(F.lit("files were split anew while they were read")).cast("long"))
    return parse(met.select(F.col("file_path").alias("path"), (counted + F.col("place")).alias("line"), "value"), keep=("path",))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files below path that a harness takes, by path. Folders named to be skipped are read all the same, as their files are visited anyway."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.lower("path")
    taken = F.lit(False)
    for end in TAKEN:
        taken = taken | name.endswith(end)
    for end in LEFT:
        taken = taken & ~name.endswith(end)
    return files.where(taken).select("path", "content").orderBy("path")
