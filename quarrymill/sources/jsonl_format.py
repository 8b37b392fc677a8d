"""A data source of JSON lines: `spark.read.format("conversation_lines")` over files and folders, and a stream of what is appended to them.

    path string, start bigint, place int, at bigint, value string, kind string, message string

One row for each line that isn't blank: the file, where the part of the file begins that it was read in, its place in that part (blank lines counted), the byte at which it begins, and the error of a line that
is no conversation (value is null then). Parts are cut by `splitBytes` alone, so two scans of a file have the same parts; a line belongs to the part in which it
begins. With the option `count` there is one row for each part instead, whose place is its number of lines; read() lifts places to line numbers by these. Lines end at \\n, one \\r before it is dropped, as is a byte order mark at a file's start.

Files are opened by pyarrow's file systems on the driver and the executors, so the path must be one that both can open (a shared folder, or a store that pyarrow
knows); sources/conversations.py reads whatever Spark can read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .conversations import CONVERSATION, classify

SCHEMA = "path string, start bigint, place int, at bigint, value string, kind string, message string"
_ARROW = pa.schema([("path", pa.string()), ("start", pa.int64()), ("place", pa.int32()), ("at", pa.int64()), ("value", pa.string()), ("kind", pa.string()), ("message", pa.string())])
#: Bytes read at a time, rows of a batch.
STEP, ROWS = 1 << 20, 1000


class Part(InputPartition):
    def __init__(self, path: str, start: int, stop: int, whole: bool = True) -> None:
        """whole: the bytes before start may belong to a line that began there; else start is the beginning of a line."""
        self.path, self.start, self.stop, self.whole = path, start, stop, whole


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files below a folder, by path; names that begin with a dot or underscore are left out."""
    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    root, base = path.rstrip("/"), at.rstrip("/")
    found = [x for x in system.get_file_info(fs.FileSelector(at, recursive=True)) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")) and x.path.endswith(suffixes)]
    return sorted((root + x.path[len(base) :], x.size) for x in found)


def lines(path: str, start: int, stop: int, whole: bool, most: int) -> Iterator[tuple[int, bytes | None]]:
    """(byte, line) of the lines that begin in [start, stop); None for a line of more than `most` bytes, of which no more is held."""
    system, at = _open(path)
    with system.open_input_file(at) as file:
        begin = start
        if whole and start:  # what is left of the line that began before
            file.seek(start - 1)
            begin, tail = start - 1, b""
            while True:
                tail = file.read(STEP)
                if not tail:
                    return
                if (end := tail.find(b"\n")) >= 0:
                    begin += end + 1
                    break
                begin += len(tail)
        file.seek(begin)
        held, size, ended = [], 0, False
        while begin < stop and not ended:
            block = file.read(STEP)
            ended, from_ = not block, 0
            while begin < stop:
                end = block.find(b"\n", from_)
                piece = block[from_ : end if end >= 0 else None]
                size += len(piece)
                if size <= most:
                    held.append(piece)
                if end < 0:
                    break
                yield begin, b"".join(held) if size <= most else None
                begin, held, size, from_ = begin + size + 1, [], 0, end + 1
        if ended and size and begin < stop:
            yield begin, b"".join(held) if size <= most else None


def _rows(part: Part, most: int, count: bool) -> Iterator[tuple]:
    if count:
        yield part.path, part.start, sum(1 for _ in lines(part.path, part.start, part.stop, part.whole, 0)), None, None, None, None
        return
    for place, (at, raw) in enumerate(lines(part.path, part.start, part.stop, part.whole, most), 1):
        own = (part.path, part.start, place, at)
        if raw is None:
            yield (*own, None, "TooLarge", f"more than {most} bytes")
            continue
        if at == 0:
            raw = raw.removeprefix(b"\xef\xbb\xbf")
        try:
            text = raw.removesuffix(b"\r").decode()
        except UnicodeDecodeError as e:
            yield (*own, None, "InvalidJson", f"not UTF-8: {e.reason}")
            continue
        if text.strip():
            kind, message = classify(text)
            yield (*own, None if kind else text, kind, message)


def _batches(part: Part, most: int, count: bool = False) -> Iterator[pa.RecordBatch]:
    held = []
    for row in _rows(part, most, count):
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class _Options:
    def __init__(self, options: dict) -> None:
        get = {k.lower(): v for k, v in options.items()}
        if "path" not in get:
            raise ValueError("load a path")
        self.path, self.split = get["path"], int(get.get("splitbytes", 32 << 20))
        self.most_line, self.most_file = int(get.get("maxlinebytes", 64 << 20)), int(get.get("maxfilebytes", 1 << 62))
        self.count = get.get("count", "false").lower() == "true"
        self.suffixes = tuple(x for x in get.get("suffixes", ".jsonl,.json,.txt").split(",") if x) or ("",)
        if self.split < 1:
            raise ValueError("splitBytes is a positive number")

    def files(self) -> list[tuple[str, int]]:
        found = _files(self.path, self.suffixes)
        large = [p for p, size in found if size > self.most_file]
        if large:
            raise ValueError(f"{len(large)} files have more than {self.most_file} bytes, such as {large[0]}")
        return found

    def parts(self, path: str, start: int, stop: int, whole: bool) -> list[Part]:
        cuts = [*range(start, stop, self.split), stop]
        return [Part(path, a, b, whole or a > start) for a, b in zip(cuts, cuts[1:], strict=False)]


class _Reader(DataSourceReader):
    def __init__(self, options: _Options) -> None:
        self.options = options

    def partitions(self) -> list[Part]:
        return [part for path, size in self.options.files() for part in self.options.parts(path, 0, size, False)] or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _batches(partition, self.options.most_line, self.options.count) if partition.stop else iter(())


class _Stream(DataSourceStreamReader):
    """The offset is, for each file, the end of its last whole line: a line that is still being written waits."""

    def __init__(self, options: _Options) -> None:
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": json.dumps({})}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": json.dumps({path: self._end(path, size) for path, size in self.options.files()}, sort_keys=True)}

    @staticmethod
    def _end(path: str, size: int) -> int:
        system, at = _open(path)
        with system.open_input_file(at) as file:
            while size:
                low = max(0, size - STEP)
                file.seek(low)
                if (end := file.read(size - low).rfind(b"\n")) >= 0:
                    return low + end + 1
                size = low
        return 0

    def partitions(self, start: dict, end: dict) -> list[Part]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        return [part for path in sorted(after) if after[path] > before.get(path, 0) for part in self.options.parts(path, before.get(path, 0), after[path], False)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _batches(partition, self.options.most_line)

    def commit(self, end: dict) -> None:
        pass


class ConversationLines(DataSource):
    """Options: path; splitBytes; maxLineBytes (longer lines are TooLarge errors, never held whole); maxFileBytes (a larger file fails the read); suffixes of the files of a folder, joined by commas."""

    @classmethod
    def name(cls) -> str:
        return "conversation_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Options(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(_Options(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ConversationLines)


def read(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(path, line, conversation fields, error<kind, message>) of files of lines; line counts from 1, blank lines too. A first scan counts the lines of each part (one row a part), which is what
    lifts the places of the second: lines aren't shuffled."""
    register(spark)
    source = lambda count: spark.read.format("conversation_lines").options(**{k: str(v) for k, v in options.items()}).option("count", count).load(path)
    before = F.coalesce(F.sum("place").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = source("true").select("path", "start", before.alias("before"))
    met = source("false").join(parts, ["path", "start"])
    line, error = (F.col("before") + F.col("place")).alias("line"), F.when(F.col("kind").isNotNull(), F.struct("kind", "message")).alias("error")
    return met.select("path", line, F.from_json("value", CONVERSATION).alias("p"), error).select("path", "line", "p.*", "error")
