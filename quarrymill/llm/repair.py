"""Repair of the structure of conversations: the cheapest edits after which roles follow `(s?(ua)+)?`.

From a conversation's last turn back, costs-to-go are found for each state of that grammar (nothing yet, after a system, user or
assistant turn); a forward walk then takes, of the edits whose cost is just the difference, the one whose initial is ASCII-least
(Delete, Insert, Keep, Rerole). The initials fix the states, so the walk gives the least audit.

Rows are dealt to tasks in ranges of (key, turn, role, text hash, row), so a conversation of any size, and rows of one turn too, are spread. A conversation
that lies inside a task's range and is short is solved there. Others are cut into segments: equal rows are matched over
segments by a grouped minimum; a segment's costs-to-go are a 4 x 4 table from the states before it to those after it; one scan back over the tables gives the costs after each
segment, one scan forward over its four possible walks the state before it; then all segments are walked at once, and their pieces are read in order. The scans hold one
segment at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, workers

#: Rows of a segment at most, and characters at which it ends (one row may be longer).
ROWS, CHARS = 4096, 4 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
SOUND, BAD, CUT = range(3)
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: Cost-to-go after the last turn.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
_SPACE = " \t\n\x0b\x0c\r"
_NEXT = (USER, USER, ASSISTANT, USER)
_LEGAL = ("su", "ua", "au")
_NAMES = {USER: "user", ASSISTANT: "assistant"}

Code = tuple[str, int]


def step(initial: str, state: int) -> int | None:
    """The state after a kept turn whose role begins so."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def costs(codes: list[Code], after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """For each place before a row, and after the last, the least cost from each state to the end."""
    out = [tuple(after)]
    n0, n1, n2, n3 = after
    for initial, fault in reversed(codes):
        b0, b1, b2, b3 = n0 + DELETE, n1 + DELETE, n2 + DELETE, n3 + DELETE
        if fault != BAD:
            more = TRUNCATED if fault == CUT else 0
            to_user, to_assistant = n2 + more + (0 if initial == "u" else REROLE), n3 + more + (0 if initial == "a" else REROLE)
            b0, b1, b2, b3 = min(b0, to_user), min(b1, to_user), min(b2, to_assistant), min(b3, to_user)
            if initial == "s":
                b0 = min(b0, n1 + more)
        n2, n3 = min(b2, b3 + INSERT), min(b3, b2 + INSERT)
        n0, n1 = min(b0, n2 + INSERT), min(b1, n2 + INSERT)
        out.append((n0, n1, n2, n3))
    out.reverse()
    return out


def walk(codes: list[Code], to_go: list[tuple[int, ...]], state: int, last: bool) -> Iterator[tuple[str, int, int]]:
    """(initial of the edit, row, state after it); the row of an insertion is the one it stands before. last: no rows follow."""
    for i, (initial, fault) in enumerate(codes):
        while True:
            left = to_go[i][state]
            if left == to_go[i + 1][state] + DELETE:
                yield "D", i, state
            elif left == to_go[i][_NEXT[state]] + INSERT:
                state = _NEXT[state]
                yield "I", i, state
                continue
            else:
                kept = step(initial, state)
                if kept is not None and left == to_go[i + 1][kept] + (TRUNCATED if fault == CUT else 0):
                    state = kept
                    yield "K", i, state
                else:
                    state = _NEXT[state]
                    yield "R", i, state
            break
    while last and END[state]:
        state = _NEXT[state]
        yield "I", len(codes), state


def fault(text: str, again: bool) -> tuple[str | None, int]:
    """(name, what it means for the edits) of a row's first fault."""
    core = text.rstrip(_SPACE)
    if not core:
        return "blank", BAD
    if again:
        return "duplicate", BAD
    return ("truncated", CUT) if core[-1] not in ".!?" else (None, SOUND)


def _measure(turns: list, roles: list[str], texts: list[str], first: Callable[[int], bool]) -> tuple[list[Code], dict]:
    """Codes of a segment's rows, and what is counted in it. first: whether the row is the first of its role and text."""
    codes, names = [], []
    for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
        name, meaning = fault(text, not first(i))
        names.append(name)
        codes.append((role[:1], meaning))
    known = [t for t in turns if t is not None]
    initials = [c for c, _ in codes]
    return codes, {
        "blank": names.count("blank"), "duplicate": names.count("duplicate"), "truncated": names.count("truncated"), "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        "first": initials[0] if initials else None, "last": initials[-1] if initials else None, "low": min(known, default=None), "high": max(known, default=None), "turns": len(set(known)),
    }


def _edited(codes: list[Code], to_go: list, state: int, last: bool, roles: list[str], texts: list[str]) -> tuple[str, list[dict], int]:
    """(audit, turns that are left, state after)."""
    audit, turns = [], []
    for edit, i, state in walk(codes, to_go, state, last):  # noqa: B020
        audit.append(edit)
        if edit != "D":
            turns.append({"role": roles[i] if edit == "K" else _NAMES[state], "text": "" if edit == "I" else texts[i]})
    return "".join(audit), turns, state


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_COUNTS = [("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64())]
_PIECE = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), *_COUNTS, ("cost", pa.int64()), ("audit", pa.string()), ("repaired", _TURNS)])
_CUT = [("at", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
_SEGMENT = pa.schema([*_PIECE, ("whole", pa.bool_()), *_CUT])
_CODED = pa.schema([*list(_PIECE)[:-3], *_CUT[1:], ("initials", pa.list_(pa.string())), ("faults", pa.list_(pa.int32())), ("table", pa.list_(pa.int64()))])


def _ddl(schema: pa.Schema) -> str:
    kind = lambda t: {"int64": "bigint", "int32": "int", "bool": "boolean"}.get(str(t)) or (f"array<{kind(t.value_type)}>" if pa.types.is_list(t) else "struct<" + ",".join(f"{f.name}:{kind(f.type)}" for f in t) + ">" if pa.types.is_struct(t) else str(t))
    return ", ".join(f"`{f.name}` {kind(f.type)}" for f in schema)


def _send(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded number and text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(map(len, row.get("texts") or ())) + sum(len(t["text"]) for t in row.get("repaired") or ()) + 100
        if len(held) >= 1000 or size >= CHARS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in workers.slices(batches, 200):
        yield from batch.to_pylist()


def _segments(most_rows: int, most_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows (key, turn, role, text; a null text is no row) to whole conversations, solved, and segments of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def cut() -> Iterator[tuple[object, bool, list]]:
            """(key, whether the run ends here, rows) for each segment of each run."""
            for key, own in groupby(_rows(batches), key=lambda r: r["key"]):
                held, size = [], 0
                for r in own:
                    if r["text"] is not None:
                        if len(held) >= most_rows or size >= most_chars:
                            yield key, False, held
                            held, size = [], 0
                        held.append(r)
                        size += len(r["text"])
                yield key, True, held

        def solved() -> Iterator[dict]:
            segments = cut()
            now, seq, open_ = next(segments, None), 0, True  # the first run may have begun in the range before
            while now:
                after = next(segments, None)
                key, ends, rows = now
                at, roles, texts = ([r[c] for r in rows] for c in ("turn", "role", "text"))
                row = {"key": key, "part": part, "seq": seq, "whole": ends and not open_ and after is not None}
                if row["whole"]:
                    seen: set = set()
                    codes, found = _measure(at, roles, texts, lambda i: (roles[i], texts[i]) not in seen and not seen.add((roles[i], texts[i])))  # noqa: B023
                    to_go = costs(codes, END)
                    audit, turns, _ = _edited(codes, to_go, START, True, roles, texts)
                    yield row | found | {"cost": to_go[0][START], "audit": audit, "repaired": turns}
                else:
                    yield row | {"at": at, "roles": roles, "texts": texts}
                seq, open_, now = seq + 1, not ends, after

        yield from _send(solved(), _SEGMENT)

    return run


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with the places of first occurrences to their codes, counts and table of costs."""

    def rows() -> Iterator[dict]:
        for r in _rows(batches):
            firsts = set(r["firsts"] or ())
            codes, found = _measure(r["at"], r["roles"], r["texts"], firsts.__contains__)
            ends = [costs(codes, tuple(0 if q == p else FAR for q in range(4)))[0] for p in range(4)]
            yield r | found | {"initials": [c for c, _ in codes], "faults": [f for _, f in codes], "table": [min(ends[q][p], FAR) for p in range(4) for q in range(4)]}

    names = set(_CODED.names)
    yield from _send(({k: v for k, v in r.items() if k in names} for r in rows()), _CODED)


_PLACE = [("part", pa.int32()), ("seq", pa.int64())]
_AFTER = pa.schema([*_PLACE, ("after", pa.list_(pa.int64())), ("final", pa.bool_())])
_ENTRY = pa.schema([*_PLACE, ("entry", pa.int32())])
_WALKS = pa.schema([("key", pa.int64()), *_PLACE, ("ends", pa.list_(pa.int32()))])


def _back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables of a conversation's segments, last one first, to the costs after each."""

    def rows() -> Iterator[dict]:
        for _, run in groupby(_rows(batches), key=lambda r: r["key"]):
            after, final = END, True
            for r in run:
                yield {"part": r["part"], "seq": r["seq"], "after": after, "final": final}
                after, final = tuple(min(r["table"][4 * p + q] + after[q] for q in range(4)) for p in range(4)), False

    yield from _send(rows(), _AFTER)


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after each segment for each state before it."""

    def rows() -> Iterator[dict]:
        for r in _rows(batches):
            codes = list(zip(r["initials"], r["faults"], strict=True))
            to_go, ends = costs(codes, r["after"]), []
            for state in range(4):
                for _, _, state in walk(codes, to_go, state, False):  # noqa: B007, B020, PLW2901
                    pass
                ends.append(state)
            yield {"key": r["key"], "part": r["part"], "seq": r["seq"], "ends": ends}

    yield from _send(rows(), _WALKS)


def _forth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks of a conversation's segments, in order, to the state before each."""

    def rows() -> Iterator[dict]:
        for _, run in groupby(_rows(batches), key=lambda r: r["key"]):
            state = START
            for r in run:
                yield {"part": r["part"], "seq": r["seq"], "entry": state}
                state = r["ends"][state]

    yield from _send(rows(), _ENTRY)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with the state before and the costs after them to their edits."""

    def rows() -> Iterator[dict]:
        for r in _rows(batches):
            codes = list(zip(r["initials"], r["faults"], strict=True))
            to_go = costs(codes, r["after"])
            audit, turns, state = _edited(codes, to_go, r["entry"], r["final"], r["roles"], r["texts"])
            cost = to_go[0][r["entry"]] - (0 if r["final"] else r["after"][state])
            yield {k: r[k] for k in ("key", "part", "seq", *(n for n, _ in _COUNTS))} | {"cost": cost, "audit": audit, "repaired": turns}

    yield from _send(rows(), _PIECE)


def damaged(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """rows (key, turn, role, text) with faults by crc32("key:turn") % 20, nulls as one space: 0 drops the row (its text is null: what is left of a conversation without rows), 1 empties the text, 2 takes its marks [.!?], 3 repeats
    the row, 4 makes it the user's."""
    k, t, r, x = (F.col(f"`{c}`") for c in (key, turn, role, text))
    shown = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(k), F.lit(":"), shown(t))) % 20
    new = F.when(kind == 0, F.lit(None)).when(kind == 1, "").when(kind == 2, F.regexp_replace(shown(x), "[.!?]", "")).otherwise(shown(x))
    out = rows.select(k.alias("key"), t.alias("turn"), F.when(kind == 4, "user").otherwise(shown(r)).alias("role"), new.alias("text"), F.monotonically_increasing_id().alias("row"), F.when(kind == 3, 2).otherwise(1).alias("copies"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies")


def repair(rows: DataFrame, most_rows: int = ROWS, most_chars: int = CHARS) -> DataFrame:
    """rows (key, turn, role, text, row: any number that tells rows of one content apart) to the written table of pieces: (key, part, seq, counts, cost, audit, repaired array<struct<role,text>>).

    A conversation's pieces, in order of (part, seq), are its edits and repaired turns. Turns are taken in order, nulls first, those of one turn by role and hash of the text. A null
    key is a conversation, a null role counts as empty; segments of at most most_rows rows are ended at most_chars characters; a row whose text is null only says that the conversation exists. An empty table gives none. Texts of any length and conversations of any number of rows are taken whole.
    """
    dealt = rows.select(F.col("key").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), "text", "row").withColumn("hash", F.xxhash64("text"))
    order = ("key", "turn", "role", "hash", "row")
    segments = scratch.save(dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "turn", "role", "text").mapInArrow(_segments(most_rows, most_chars), _ddl(_SEGMENT)), "segments")
    cut = segments.where("NOT whole").select("key", "part", "seq", "at", "roles", "texts")
    turns = cut.select("key", "part", "seq", "roles", F.posexplode("texts").alias("i", "text")).select("key", "part", "seq", "i", F.sha2("text", 256).alias("digest"), F.element_at("roles", F.col("i") + 1).alias("role"))
    firsts = turns.groupBy("key", "role", "digest").agg(F.min(F.struct("part", "seq", "i")).alias("at")).groupBy("at.part", "at.seq").agg(F.collect_list("at.i").alias("firsts"))
    coded = scratch.save(cut.join(firsts, ["part", "seq"], "left").mapInArrow(_coded, _ddl(_CODED)), "coded")
    back = coded.select("key", "part", "seq", "table").repartition("key").sortWithinPartitions("key", F.desc("part"), F.desc("seq"))
    after = scratch.save(back.mapInArrow(_back, _ddl(_AFTER)), "after")
    walks = coded.select("key", "part", "seq", "initials", "faults").join(after, ["part", "seq"]).mapInArrow(_walks, _ddl(_WALKS))
    entries = walks.repartition("key").sortWithinPartitions("key", "part", "seq").mapInArrow(_forth, _ddl(_ENTRY))
    pieces = coded.join(after, ["part", "seq"]).join(entries, ["part", "seq"]).mapInArrow(_pieces, _ddl(_PIECE))
    names = _PIECE.names
    out = scratch.save(segments.where("whole").select(*names, "whole").union(pieces.select(*names, F.lit(False).alias("whole"))), "pieces")
    scratch.drop(segments, coded, after)
    return out


_DIGEST = pa.schema([("key", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to one row for each conversation."""

    def rows() -> Iterator[dict]:
        for key, run in groupby(_rows(batches), key=lambda r: (r["key"], r["part"], r["seq"]) if r["whole"] else r["key"]):
            total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
            digest, audit, any_, last, low, high, turns = hashlib.sha256(), [], False, None, None, None, 0
            for r in run:
                key = r["key"]  # noqa: PLW2901
                for name in total:
                    total[name] += r[name]
                if r["first"] is not None:
                    total["illegal"] += last is not None and last + r["first"] not in _LEGAL
                    last = r["last"]
                if r["low"] is not None:  # turns ascend, so only the border's turn is counted twice
                    turns += r["turns"] - (high == r["low"])
                    low, high = r["low"] if low is None else low, r["high"]
                audit.append(r["audit"])
                for t in r["repaired"]:
                    digest.update((("\n" if any_ else "") + t["role"] + ":" + t["text"]).encode())
                    any_ = True
            gaps = 0 if low is None else min(high - low + 1 - turns, (1 << 63) - 1)
            yield {"key": key, "gaps": gaps, **total, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    yield from _send(rows(), _DIGEST)


def digest(pieces: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row for each conversation: (key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256). gaps beyond a long count as its largest. Only pieces of conversations that were cut are shuffled."""
    whole, cut = pieces.where("whole"), pieces.where("NOT whole").repartition("key").sortWithinPartitions("key", "part", "seq")
    out = whole.mapInArrow(_digests, _ddl(_DIGEST)).union(cut.mapInArrow(_digests, _ddl(_DIGEST)))
    return out.withColumnRenamed("key", key)
