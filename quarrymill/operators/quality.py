"""Validity and content quality of conversations, as columns over messages array<struct<role, content, name, function_call>>."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: pairs of roles that may follow one another, and phrases of generic replies
BIGRAMS = ("system>user", "system>assistant", "user>assistant", "user>function", "assistant>user", "assistant>function", "function>user", "function>assistant")
GENERIC = ("I understand.", "Can you provide more details?", "I'm here to help.", "Please let me know", "Is there anything else", "Thank you for your question.")


def role_machine(messages: Column) -> Column:
    """Turns alternate: a user or system where a user is due, else an assistant or function; a system leaves the user due. At least 2 messages."""
    start = F.struct(F.lit(True).alias("ok"), F.lit(True).alias("user_due"))

    def step(state: Column, m: Column) -> Column:
        fits = F.when(state["user_due"], m["role"].isin("user", "system")).otherwise(m["role"].isin("assistant", "function"))
        return F.struct((state["ok"] & F.coalesce(fits, F.lit(False))).alias("ok"), F.when(state["user_due"], m["role"] == "system").otherwise(F.lit(True)).alias("user_due"))

    return (F.size(messages) >= 2) & F.aggregate(messages, start, step)["ok"]


def role_bigrams(messages: Column) -> Column:
    """The first role is system, user or assistant, and every two neighbours are an allowed pair."""
    roles = F.transform(messages, lambda m: F.coalesce(m["role"], F.lit("")))
    pairs = F.transform(F.sequence(F.lit(1), F.size(messages) - 1), lambda i: F.concat_ws(">", F.element_at(roles, i), F.element_at(roles, i + 1)))
    first = F.try_element_at(roles, F.lit(1)).isin("system", "user", "assistant")
    return F.when(F.size(messages) == 0, False).when(F.size(messages) == 1, first).otherwise(first & F.forall(pairs, lambda p: p.isin(*BIGRAMS)))


def well_formed(messages: Column) -> Column:
    """At least 2 messages, each with content or a function call, in allowed roles."""
    filled = F.forall(messages, lambda m: (F.coalesce(F.octet_length(m["content"]), F.lit(0)) > 0) | m["function_call"].isNotNull())
    return (F.size(messages) >= 2) & filled & role_bigrams(messages)


def _near(a: bytes, b: bytes) -> bool:
    """Both non-empty, lengths within a tenth, and more than 0.9 of the shorter's bytes equal at their places."""
    short, long = sorted((len(a), len(b)))
    if not short or short / long < 0.9:
        return False
    same = np.count_nonzero(np.frombuffer(a, np.uint8, short) == np.frombuffer(b, np.uint8, short))
    return bool(same / short > 0.9)


@F.pandas_udf(T.BooleanType())
def near_duplicate(a: pd.Series, b: pd.Series) -> pd.Series:
    """_near() of two texts' bytes; null if either is null."""
    return pd.Series([None if x is None or y is None else _near(x.encode(), y.encode()) for x, y in zip(a, b, strict=True)], dtype="boolean")


#: Kept messages are found by blocks of WIDE bytes at fixed offsets if they are at least TALL bytes long, else by blocks of SLIM bytes.
WIDE, SLIM, TALL = 9, 5, 90


class _Leaders:
    """Messages that were kept, found by what a near one must share with them.

    Near messages differ in fewer than a tenth of the shorter one's bytes. It has more blocks than that (of 9 bytes from 90 bytes on, of 5 bytes from 5 on), each at a fixed offset, so one
    block is the same in both, at the same offset: what shares none is never compared.
    """

    def __init__(self) -> None:
        self.raws: list[bytes] = []
        self._places: dict[tuple[int, int, bytes], list[int]] = {}
        self._tiny: list[int] = []

    @staticmethod
    def _blocks(raw: bytes, width: int) -> list[tuple[int, int, bytes]]:
        return [(width, i, raw[i : i + width]) for i in range(0, len(raw) - width + 1, width)]

    def _candidates(self, raw: bytes) -> Iterator[int]:
        seen: set[int] = set()
        # the shorter of two near ones has nine tenths of either's length
        for key in self._blocks(raw, WIDE if 9 * len(raw) >= 10 * TALL else SLIM):
            for k in self._places.get(key, ()):
                if k not in seen:
                    seen.add(k)
                    yield k
        if len(raw) < 6:
            yield from (k for k in self._tiny if k not in seen)

    def add(self, raw: bytes) -> bool:
        """Keeps a message that is near none kept before."""
        if any(_near(self.raws[k], raw) for k in self._candidates(raw)):
            return False
        own = len(self.raws)
        self.raws.append(raw)
        # of a length that either width may be asked for: both
        keys = (self._blocks(raw, WIDE) if len(raw) >= TALL else []) + (self._blocks(raw, SLIM) if 9 * len(raw) <= 1000 else [])
        for key in keys:
            self._places.setdefault(key, []).append(own)
        if len(raw) < 7:
            self._tiny.append(own)
        return True


def _kept(contents: list[str | None]) -> int:
    """Of equal messages the first; then each one that is near none kept before."""
    kept = _Leaders()
    return sum(kept.add(raw) for raw in dict.fromkeys((c or "").encode() for c in contents))


@F.pandas_udf(T.IntegerType())
def leaders(contents: pd.Series) -> pd.Series:
    """How many messages are kept, in order, if each one is dropped that equals or nearly equals one kept before. Null for no list."""
    return pd.Series([None if c is None else _kept(list(c)) for c in contents], dtype="Int32")


def diversity(contents: Column) -> Column:
    """Share of leaders; halved below one half; 0 for fewer than 2 messages."""
    share = leaders(contents) / F.size(contents)
    return F.when(F.size(contents) < 2, 0.0).when(share < 0.5, share * 0.5).otherwise(share)


def _contents(messages: Column) -> Column:
    return F.transform(messages, lambda m: F.coalesce(m["content"], F.lit("")))


def quality(messages: Column) -> Column:
    """Turns, mean length and diversity; 0 for no messages."""
    n, contents = F.size(messages), _contents(messages)
    total = F.aggregate(contents, F.lit(0).cast("long"), lambda s, c: s + F.octet_length(c))
    mean = F.floor(total / F.greatest(n, F.lit(1)))
    turns = F.when(n.between(4, 20), 0.3).when(n >= 2, 0.2).otherwise(0.0)
    size = F.when(mean.between(50, 500), 0.3).when(mean >= 10, 0.15).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(F.least(F.greatest(turns + size + 0.4 * diversity(contents), F.lit(0.0)), F.lit(1.0)))


def pattern_penalty(messages: Column) -> Column:
    """0.1 if more than half of the messages are assistants' of under 20 bytes, and 0.1 if more than a third hold a generic phrase."""
    n = F.size(messages)
    short = F.size(F.filter(messages, lambda m: (m["role"] == "assistant") & (F.octet_length(F.coalesce(m["content"], F.lit(""))) < 20)))

    def generic(m: Column) -> Column:
        text, found = F.lower(F.coalesce(m["content"], F.lit(""))), F.lit(False)
        for phrase in GENERIC:
            found = found | F.contains(text, F.lit(phrase.lower()))
        return found

    return F.when(short > F.floor(n / 2), 0.1).otherwise(0.0) + F.when(F.size(F.filter(messages, generic)) > F.floor(n / 3), 0.1).otherwise(0.0)


def content_key(messages: Column) -> Column:
    """All contents on end, roles ignored: conversations with the same key are the same content."""
    return F.array_join(_contents(messages), "")


def measures(conversations: DataFrame) -> DataFrame:
    """One row of all per-conversation measures added to conversations (messages)."""
    m = F.col("messages")
    return conversations.withColumns(
        {"n_messages": F.size(m), "valid_format": well_formed(m), "quality": quality(m), "penalty": pattern_penalty(m), "content_key": F.sha2(content_key(m), 256)}
    )
