"""Chat formatting as a prefix tree.

A turn is spelt <s>[INST]role[/INST]text</s>. In roles and texts a backslash is doubled, and a control string gets one behind its
first character, so none stands in a formatted text but where the template puts it, and unescaping gives every text back.

Conversations that share their first turns share tokens. A node of the tree is a distinct sequence of turns. A conversation's path is the
128-bit digests of its turns on end; in order of paths, which is depth-first order, a conversation shares with the tree so far what it shares
with the one before it, so its new nodes are the turns after that. Paths are sorted by range over the cluster. Each new node emits its turn's tokens once, with

* start: where they lie in the emitted stream,
* position: the position id of the first (ids count up from there): as many as its ancestors have tokens,
* attends: the stretches of the stream that its tokens attend to besides their own (causally), its ancestors', neighbouring ones joined.

The stream is written in shards, one for about SHARD ids, which end where a conversation does. A shard begins with a key frame, the turns that are open there, so
that it can be read alone; key frames are no part of the stream and together no longer than it but for one path a partition.

Texts are shuffled once, by conversation, and read there as a sorted stream; ids once, by path. Of each partition only its first and last path go
through the driver. A first turn that a third of all conversations share, or a conversation that a third of all are, spreads over partitions, as equal
paths order by a hash of the id. One conversation's ids are one cell, so they must stay below 2 GB.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
SHARD = 1 << 18
_DIGEST = 16
#: Turns of at most so many characters are kept by a worker, so many of them.
_SHORT, _KEPT = 4096, 4096
_ESCAPE = re.compile(r"(\\)|(<(?=/?s>)|\[(?=/?INST\]))")
_UNESCAPE = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[1] else m[2] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class Vocabulary:
    """Byte-level ids by tiktoken for what stands between control strings; an id behind them for each control string."""

    def __init__(self, path: str, pattern: str) -> None:
        import base64

        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.size = max(ranks.values()) + 1
        self.control = {c: self.size + i for i, c in enumerate(CONTROLS)}
        self.bytes = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.bytes += [c.encode() for c in CONTROLS]
        #: How ids are written.
        self.kind = np.dtype("<u2" if len(self.bytes) <= 1 << 16 else "<u4")
        self.plain = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._short = lru_cache(_KEPT)(self._turn)

    def _turn(self, role: str, text: str) -> tuple[bytes, int, int]:
        c, body = self.control, self.plain(escape(text))
        head = [c["<s>"], c["[INST]"], *self.plain(escape(role)), c["[/INST]"]]
        ids = np.array([*head, *body, c["</s>"]], self.kind)
        return ids.tobytes(), len(head), len(head) + len(body) if role == "assistant" else len(head)

    def turn(self, role: str, text: str) -> tuple[bytes, int, int]:
        """Ids of a turn, and begin and end of its loss mask, which covers an assistant's text and nothing else."""
        return self._short(role, text) if len(text) <= _SHORT else self._turn(role, text)

    def text(self, ids: Sequence[int]) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode()


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def parse(ids: Sequence[int], begin: int, end: int, words: Vocabulary) -> tuple[str, str, str, int]:
    """(role, text, text under the loss mask, all unescaped, characters of the formatted turn), from the ids of a turn."""
    c = words.control
    if len(ids) < 4 or ids[0] != c["<s>"] or ids[1] != c["[INST]"] or ids[-1] != c["</s>"]:
        raise ValueError("a turn is <s>[INST]role[/INST]text</s>")
    a = ids.index(c["[/INST]"])
    role, body = words.text(ids[2:a]), words.text(ids[a + 1 : -1])
    learned = body if (begin, end) == (a + 1, len(ids) - 1) else words.text(ids[begin:end])
    text = unescape(body)
    return unescape(role), text, text if learned is body else unescape(learned), sum(map(len, CONTROLS)) + len(role) + len(body)


def _shared(a: bytes, b: bytes) -> int:
    """How many turns two paths have in common at their beginning."""
    n = min(len(a), len(b)) // _DIGEST
    if a[: n * _DIGEST] == b[: n * _DIGEST]:
        return n
    x, y = (np.frombuffer(v, "<u8", 2 * n).reshape(n, 2) for v in (a, b))
    return int((x != y).any(axis=1).argmax())


def _joined(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches [start, start + size), ascending, neighbouring ones made one."""
    if not starts.size:
        return np.zeros((0, 2), np.int64)
    ends = starts + sizes
    cut = np.flatnonzero(starts[1:] != ends[:-1])
    return np.stack((starts[np.concatenate(([0], cut + 1))], ends[np.concatenate((cut, [starts.size - 1]))]), axis=1)


def _ints(x: pa.Scalar, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(x.as_py(), kind)


_SHARD_SCHEMA = (
    "part int, seq int, start bigint, n_tokens bigint, ids binary, sizes binary, positions binary, learned binary, shared binary, made binary, n_spans binary, spans binary, "
    "frame_ids binary, frame_sizes binary, frame_starts binary, frame_learned binary"
)


class _Shard:
    """What a shard has so far: a key frame, then a run of new nodes for each conversation."""

    def __init__(self, part: int, seq: int, start: int, width: int, frame: tuple[bytes, np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.head, self.frame, self.size, self.width = (part, seq, start), frame, 0, width
        self.ids, self.sizes, self.positions, self.learned, self.shared, self.made, self.spans, self.convs = ([] for _ in range(8))

    def add(self, conv: object, shared: int, sizes: np.ndarray, learned: np.ndarray, spans: np.ndarray, position: int, ids: bytes) -> None:
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.learned.append(learned)
        self.positions.append(position + np.cumsum(sizes, dtype=np.int64) - sizes)
        self.shared.append(shared)
        self.made.append(sizes.size)
        self.spans.append(spans)
        self.convs.append(conv)
        self.size += len(ids) // self.width

    def row(self, conv_type: pa.DataType) -> pa.RecordBatch:
        counts = [len(x) for x in self.spans]
        cells = [b"".join(self.ids), *(np.concatenate(x).astype(k).tobytes() for x, k in ((self.sizes, "<i4"), (self.positions, "<i8"), (self.learned, "<i4"))), *(np.array(x, "<i4").tobytes() for x in (self.shared, self.made, counts)), np.concatenate(self.spans).astype("<i8").tobytes()]
        ids, sizes, starts, learned = self.frame
        cells += [ids, sizes.astype("<i4").tobytes(), starts.astype("<i8").tobytes(), learned.astype("<i4").tobytes()]
        part, seq, start = self.head
        columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()), pa.array([self.size], pa.int64()), *(pa.array([x], pa.binary()) for x in cells), pa.array([self.convs], pa.list_(conv_type))]
        return pa.RecordBatch.from_arrays(columns, names=[*(x.split()[0] for x in _SHARD_SCHEMA.split(", ")), "convs"])


def _paths(conversations: DataFrame, path: str, pattern: str, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Written: (conv, path, sizes, learned, ids), one row a conversation, made from a stream of turns in order."""
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        now, digests, sizes, learned, ids, kind = None, [], [], [], [], None
        done: list[tuple] = []
        held = 0

        def end() -> int:
            done.append((now, b"".join(digests), np.array(sizes, "<i4").tobytes(), np.array(learned, "<i4").tobytes(), b"".join(ids)))
            for x in (digests, sizes, learned, ids):
                x.clear()
            return len(done[-1][-1])

        def made() -> pa.RecordBatch:
            columns = [pa.array([d[0] for d in done], kind), *(pa.array([d[k] for d in done], pa.binary()) for k in range(1, 5))]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv", "path", "sizes", "learned", "ids"])

        for batch in batches:
            kind = batch.column(0).type
            for name, r, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if digests and not (name == now or (name != name and now != now)):
                    held += end()
                    if held > 1 << 22:
                        yield made()
                        held = 0
                now = name
                raw = r.encode()
                # role and text are told apart by the role's length in front
                digests.append(hashlib.blake2b(b"%d:%b%b" % (len(raw), raw, t.encode()), digest_size=_DIGEST).digest())
                got, a, b = words.turn(r, t)
                ids.append(got)
                sizes.append(len(got) // words.kind.itemsize)
                learned += (a, b)
        if digests:
            end()
        if done:
            yield made()

    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    kind = rows.schema["conv"].dataType.simpleString()
    return scratch.save(ordered.mapInArrow(run, f"conv {kind}, path binary, sizes binary, learned binary, ids binary"), "conversations")


def _borders(paths: DataFrame) -> list[dict]:
    """For each range of paths, in order: its first (path, tie), and offset, shared and starts for its first conversation: how much is added to starts as counted from
    the range's first turn, how many of its turns the range before has, and where those start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, starts, total = None, b"", np.zeros(0, np.int64), 0
        for batch in batches:
            for way, tie, sizes in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                way, own = way.as_py(), _ints(sizes).astype(np.int64)
                if first is None:
                    first = (batch.column(3)[0].as_py(), way, tie.as_py(), own.astype("<i8").tobytes())
                k = _shared(last, way)
                new = own[k:]
                starts = np.concatenate((starts[:k], total + np.cumsum(new) - new))
                total += int(new.sum())
                last = way
        if first is not None:
            cells = (*first, last, starts.astype("<i8").tobytes(), total)
            kinds = (pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=["part", "first", "tie", "sizes", "last", "starts", "total"])

    n = max(1, int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = paths.select("path", F.xxhash64("conv").alias("tie"), "sizes").repartitionByRange(n, "path", "tie").sortWithinPartitions("path", "tie").withColumn("part", F.spark_partition_id())
    rows = ranged.mapInArrow(run, "part int, first binary, tie bigint, sizes binary, last binary, starts binary, total bigint").collect()
    out, base, last, stack = [], 0, b"", np.zeros(0, np.int64)
    for r in sorted(rows, key=lambda r: r["part"]):
        way, end = bytes(r["first"]), bytes(r["last"])
        k = _shared(last, way)
        known = int(np.frombuffer(r["sizes"], "<i8")[:k].sum())
        out.append({"first": (way, r["tie"]), "offset": base - known, "shared": k, "starts": stack[:k]})
        starts = np.frombuffer(r["starts"], "<i8") + (base - known)
        same = min(k, _shared(way, end))
        starts[:same] = stack[:same]
        base, last, stack = base + r["total"] - known, end, starts
    return out


def tree(conversations: DataFrame, path: str, pattern: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The written shards; nodes() gives their nodes as rows, read() reads the conversations back.

    A null role or text counts as empty; turns order by (turn, role, text), nulls first; a repeated row is another turn; rows with a null conversation
    id form one conversation. Other columns are ignored, whatever their names. Very long texts and conversations are one cell of ids each. An empty table gives an empty one.
    """
    paths = _paths(conversations, path, pattern, conv, turn, role, text)
    borders = _borders(paths)
    firsts = [b["first"] for b in borders]
    kind = paths.schema["conv"].dataType.simpleString()

    @F.pandas_udf("int")
    def part_of(way: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series([max(0, bisect_right(firsts, (bytes(w), t)) - 1) for w, t in zip(way, tie, strict=True)], dtype="int32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = vocabulary(path, pattern).kind.itemsize
        part, shard = None, None
        for batch in batches:
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                way, ids, sizes, learned = at["path"][i].as_py(), at["ids"][i].as_py(), _ints(at["sizes"][i]).astype(np.int64), _ints(at["learned"][i]).reshape(-1, 2)
                fresh = at["part"][i].as_py() != part
                if fresh:
                    if shard is not None:
                        yield shard.row(at["conv"].type)
                    part, seq, shard = at["part"][i].as_py(), 0, None
                    border = borders[part]
                    k, starts = border["shared"], border["starts"]
                    known = int(sizes[:k].sum())
                    place = border["offset"] + known
                else:
                    k = _shared(last, way)
                    known = int(sizes[:k].sum())
                    if before[: known * width] != ids[: known * width]:
                        raise ValueError("two turns have one digest")
                if shard is None:
                    shard = _Shard(part, seq, place, width, (ids[: known * width], sizes[:k], starts[:k], learned[:k]))
                    seq += 1
                new = sizes[k:]
                spans = _joined(starts[:k], sizes[:k])
                starts = np.concatenate((starts[:k], place + np.cumsum(new) - new))
                shard.add(at["conv"][i].as_py(), k, new, learned[k:], spans, known, ids[known * width :])
                place += int(new.sum())
                last, before = way, ids
                if shard.size >= max(SHARD, len(shard.frame[0]) // width):
                    yield shard.row(at["conv"].type)
                    shard = None
        if shard is not None:
            yield shard.row(at["conv"].type)

    dealt = paths.withColumn("tie", F.xxhash64("conv")).withColumn("part", part_of("path", "tie")).repartitionById(max(1, len(borders)), F.col("part")).sortWithinPartitions("part", "path", "tie")
    out = scratch.save(dealt.mapInArrow(run, f"{_SHARD_SCHEMA}, convs array<{kind}>"), "tree")
    scratch.drop(paths)
    return out


class _Runs:
    """A shard read back: its key frame, and its runs as (conv, shared, spans, first node, end of nodes)."""

    def __init__(self, at: dict[str, pa.Scalar], words: Vocabulary) -> None:
        self.start, self.ids = at["start"].as_py(), _ints(at["ids"], words.kind)
        self.sizes, self.positions, self.learned = _ints(at["sizes"]), _ints(at["positions"], "<i8"), _ints(at["learned"]).reshape(-1, 2)
        self.frame = _ints(at["frame_ids"], words.kind), _ints(at["frame_sizes"]), _ints(at["frame_starts"], "<i8"), _ints(at["frame_learned"]).reshape(-1, 2)
        shared, made, counts, spans = _ints(at["shared"]).tolist(), _ints(at["made"]).tolist(), _ints(at["n_spans"]).tolist(), _ints(at["spans"], "<i8").reshape(-1, 2)
        self.runs, node, span = [], 0, 0
        for conv, k, m, c in zip(at["convs"].as_py(), shared, made, counts, strict=True):
            self.runs.append((conv, k, spans[span : span + c].tolist(), node, node + m))
            node, span = node + m, span + c


def nodes(shards: DataFrame, path: str, pattern: str) -> DataFrame:
    """(start, depth, position, n_tokens, ids array<int>, loss array<tinyint>, attends array<struct<begin, end>>), a row for each node of the tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int8()), span)
        for batch in batches:
            for i in range(batch.num_rows):
                shard, out, place = _Runs({n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}, words), [], 0
                for _, shared, spans, a, b in shard.runs:
                    head = shard.start + place
                    for d in range(a, b):
                        start, size = shard.start + place, int(shard.sizes[d])
                        own = [head, start]
                        joined = spans if start == head else [*spans[:-1], [spans[-1][0], start]] if spans and spans[-1][1] == head else [*spans, own]
                        begin, end = shard.learned[d].tolist()
                        loss = [0] * begin + [1] * (end - begin) + [0] * (size - end)
                        out.append((start, shared + d - a, int(shard.positions[d]), size, shard.ids[place : place + size].tolist(), loss, [{"begin": x, "end": y} for x, y in joined]))
                        place += size
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=["start", "depth", "position", "n_tokens", "ids", "loss", "attends"])

    return shards.mapInArrow(run, "start bigint, depth int, position bigint, n_tokens bigint, ids array<int>, loss array<tinyint>, attends array<struct<begin:bigint,end:bigint>>")


def read(shards: DataFrame, path: str, pattern: str, conv: str = "conv_id") -> DataFrame:
    """Per conversation, from the emitted stream alone: (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    A shard is read in order, with the open turns on a stack; each node is decoded once and its digests go on from its parent's. Position ids must follow on
    one another and the attended stretches must be the open turns', else this raises. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)

        def push(stack: list[tuple], start: int, size: int, ids: list[int], learned: list[int]) -> None:
            _, end, turns, loss, chars, formatted = stack[-1] if stack else (0, 0, hashlib.sha256(), hashlib.sha256(), 0, 0)
            role, text, taught, length = parse(ids, *learned, words)
            turns = turns.copy()
            turns.update(f"{role}\n{text}\n".encode())
            if taught:
                loss = loss.copy()
                loss.update(taught.encode())
            stack.append(((start, size), end + size, turns, loss, chars + len(taught), formatted + length))

        for batch in batches:
            for i in range(batch.num_rows):
                shard, out, stack, place = _Runs({n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}, words), [], [], 0
                for size, start, learned in zip(shard.frame[1].tolist(), shard.frame[2].tolist(), shard.frame[3].tolist(), strict=True):
                    push(stack, start, size, shard.frame[0][place : place + size].tolist(), learned)
                    place += size
                place = 0
                for name, shared, spans, a, b in shard.runs:
                    del stack[shared:]
                    if _joined(*(np.array([x[0][k] for x in stack], np.int64) for k in (0, 1))).tolist() != spans:
                        raise ValueError("the attended stretches aren't the open turns")
                    for d in range(a, b):
                        if int(shard.positions[d]) != (stack[-1][1] if stack else 0):
                            raise ValueError("position ids don't follow on one another")
                        size = int(shard.sizes[d])
                        push(stack, shard.start + place, size, shard.ids[place : place + size].tolist(), shard.learned[d].tolist())
                        place += size
                    _, _, turns, loss, chars, formatted = stack[-1]
                    out.append((name, len(stack), turns.hexdigest(), chars, loss.hexdigest(), formatted))
                kinds = (batch.schema.field("convs").type.value_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=[conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = shards.schema["convs"].dataType.elementType.simpleString()
    return shards.mapInArrow(run, f"`{conv}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
