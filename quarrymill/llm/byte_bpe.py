"""Byte-level BPE over rank files, with a hierarchical-bitmap rank queue.

Bytes stand in linked lists, one list for each pre-token. Each merge rank has a bucket of list positions; a
three-level bitmap marks the buckets that hold something, and find-first-set on it gives the next
rank. Entries whose pair has changed meanwhile are stale and skipped.

A long pre-token has a queue of its own, whose buckets are heaps: the leftmost entry of the lowest rank is next, so n bytes take
O(n log n) steps whatever they are. One queue serves all short pre-tokens of a batch: all occurrences in a bucket are
merged at once in numpy, so the cost of a step is shared by the pre-tokens of the batch.

The order within one pre-token is exactly "lowest rank first, leftmost first". Merging many at once, two cases need care.
Overlapping pairs of twins (aa in aaaa) are taken alternately from the left of each run. A merge
that makes a pair of a still lower rank has to let that pair go first: for the ranks where this can
happen (known from the vocabulary) only the leftmost occurrence of each pre-token is taken, and the
rest of the bucket is put back, which is why long pre-tokens aren't merged so.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from functools import cached_property, lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_table import ChunkTable
from .workers import slices

_NONE = np.int64(1 << 40)
_SHIFT = 20
#: Pre-tokens of more bytes have a queue of their own.
LONG = 512


class RankQueue:
    """Buckets of entries by rank (arrays of positions, or positions) under a bitmap of three levels of 64-bit words."""

    def __init__(self, size: int) -> None:
        self.buckets: list[list] = [[] for _ in range(size)]
        n0 = (size + 63) // 64
        n1 = (n0 + 63) // 64
        self.low, self.mid, self.top = [0] * n0, [0] * n1, 0
        if n1 > 64:
            raise ValueError("a rank file has at most 64 ** 3 ranks")

    def mark(self, rank: int) -> None:
        """The rank's bucket holds something."""
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.mid[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def clear(self, rank: int) -> None:
        """The rank's bucket is empty."""
        word = rank >> 6
        self.low[word] &= ~(1 << (rank & 63))
        if not self.low[word]:
            self.mid[word >> 6] &= ~(1 << (word & 63))
            if not self.mid[word >> 6]:
                self.top &= ~(1 << (word >> 6))

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets[rank]
        if not bucket:
            self.mark(rank)
        bucket.append(positions)

    def push_one(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if not bucket:
            self.mark(rank)
        heappush(bucket, position)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Adds positions[i] to bucket ranks[i]."""
        if not ranks.size:
            return
        if ranks.size > 1:
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
        starts = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
        stops = [*starts[1:].tolist(), ranks.size]
        for rank, a, b in zip(ranks[starts].tolist(), starts.tolist(), stops, strict=True):
            self.push(rank, positions[a:b])

    def first(self) -> int:
        """The lowest rank with a non-empty bucket, -1 if none: find-first-set from the top level down."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        b = (a << 6) | ((w := self.mid[a]) & -w).bit_length() - 1
        return (b << 6) | ((w := self.low[b]) & -w).bit_length() - 1

    def take(self, rank: int) -> np.ndarray:
        bucket, self.buckets[rank] = self.buckets[rank], []
        self.clear(rank)
        return bucket[0] if len(bucket) == 1 else np.concatenate(bucket)


class RankFile:
    """A vocabulary of byte strings, each with its merge rank, which is also its id."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs: dict[int, int] = {}
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None:
                    pairs[a << _SHIFT | b] = rank
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.pair_ranks = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        #: Whether merging into this token can make a pair of a lower rank.
        self.undercuts = np.zeros(self.size, bool)
        for part in (self.keys >> _SHIFT, self.keys & ((1 << _SHIFT) - 1)):
            self.undercuts[part[self.pair_ranks < part]] = True

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE where it isn't in the vocabulary."""
        key = left << _SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
        return np.where(self.keys[at] == key, self.pair_ranks[at], _NONE)

    @cached_property
    def rank_of(self) -> dict[int, int]:
        """The rank of each pair of the vocabulary, for one pair at a time; made when the first long piece comes."""
        return dict(zip(self.keys.tolist(), self.pair_ranks.tolist(), strict=True))

    def merge_long(self, piece: bytes) -> bytes:
        """The ids of one piece, an occurrence at a time."""
        n, get, queue = len(piece), self.rank_of.get, RankQueue(self.size)
        token = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before, rank = [*range(1, n), -1], list(range(-1, n - 1)), [-1] * n
        for i in range(n - 1):
            if (r := get(token[i] << _SHIFT | token[i + 1])) is not None:
                rank[i] = r
                queue.push_one(r, i)
        while (r := queue.first()) >= 0:
            bucket, lower = queue.buckets[r], False
            while bucket and not lower:
                i = heappop(bucket)
                if rank[i] != r:
                    continue
                j = after[i]
                k, h = after[j], before[i]
                token[i], token[j], rank[j], rank[i], after[i] = r, -1, -1, -1, k
                if k >= 0:
                    before[k] = i
                    if (new := get(r << _SHIFT | token[k])) is not None:
                        rank[i], lower = new, new < r
                        queue.push_one(new, i)
                if h >= 0:
                    if (new := get(token[h] << _SHIFT | r)) is not None:
                        rank[h], lower = new, lower or new < r
                        queue.push_one(new, h)
                    else:
                        rank[h] = -1
            if not bucket:
                queue.clear(r)
        return np.array([t for t in token if t >= 0], "<u4").tobytes()

    def merge(self, pieces: Sequence[bytes]) -> list[bytes]:
        """The ids of each non-empty piece as little-endian unsigned 32-bit integers."""
        if any(len(p) > LONG for p in pieces):
            short = [p for p in pieces if len(p) <= LONG]
            made = iter(self._merge_short(short) if short else ())
            return [self.merge_long(p) if len(p) > LONG else next(made) for p in pieces]
        return self._merge_short(pieces)

    def _merge_short(self, pieces: Sequence[bytes]) -> list[bytes]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        text = np.frombuffer(b"".join(pieces), np.uint8)
        n = text.size
        stops = np.cumsum(lengths)
        starts = stops - lengths
        token = self.byte_ids[text]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[stops - 1] = -1
        before[starts] = -1
        rank = np.full(n, _NONE)
        at = np.flatnonzero(after >= 0)
        rank[at] = self.lookup(token[at], token[at + 1])
        at = at[rank[at] != _NONE]
        queue = RankQueue(self.size)
        queue.push_all(rank[at], at)
        while (r := queue.first()) >= 0:
            at = queue.take(r)
            at = at[rank[at] == r]
            if not at.size:
                continue
            if at.size > 1:
                at = np.unique(at)
            if at.size > 1 and self.undercuts[r]:
                piece = np.searchsorted(stops, at, side="right")
                lead = np.concatenate(([True], piece[1:] != piece[:-1]))
                if not lead.all():
                    queue.push(r, at[~lead])
                at = at[lead]
            second = after[at]
            if at.size > 1 and (chained := second[:-1] == at[1:]).any():
                index = np.arange(at.size)
                begin = np.maximum.accumulate(np.where(np.concatenate(([True], ~chained)), index, 0))
                at = at[(index - begin) % 2 == 0]
                second = after[at]
            third = after[second]
            token[at] = r
            token[second] = -1
            rank[second] = _NONE
            rank[at] = _NONE
            after[at] = third
            has = third >= 0
            before[third[has]] = at[has]
            left = before[at]
            made = np.concatenate((at[has], left[left >= 0]))
            if made.size:
                new = self.lookup(token[made], token[after[made]])
                rank[made] = new
                use = new != _NONE
                queue.push_all(new[use], made[use])
        alive = token >= 0
        counts = np.add.reduceat(alive.astype(np.int64), starts) * 4
        ids = token[alive].astype("<u4").tobytes()
        out, a = [], 0
        for k in counts.tolist():
            out.append(ids[a : a + k])
            a += k
        return out


class Encoder:
    """Texts to ids: pre-tokens by a pattern, each whole pre-token in the vocabulary as it is, the others merged.

    A space or line feed between two characters that aren't white space starts a pre-token whatever
    stands around it, so texts are cut there and each distinct chunk is encoded once. All pre-tokens that a
    batch adds go through one queue.
    """

    def __init__(self, path: str, pattern: str, cached: int = 200_000) -> None:
        self.file, self.find, self.cached = RankFile(path), regex.compile(pattern).findall, cached
        self.pieces: dict[str, bytes] = {}
        self.encode = ChunkTable(self._learn, strict=True).encode

    def _split(self, chunk: str) -> list[str]:
        if chunk[:1] == " ":
            if chunk[1:].isalpha():
                return [chunk]
            if chunk[-1] in ".," and chunk[1:-1].isalpha():
                return [chunk[:-1], chunk[-1]]
        return self.find(chunk)

    def _learn(self, chunks: list[str]) -> list[bytes]:
        pieces = self.pieces
        if len(pieces) > self.cached:
            pieces.clear()
        found = [self._split(x) for x in chunks]
        merged, raws = [], []
        for piece in {p for ps in found for p in ps} - pieces.keys():
            raw = piece.encode()
            if (rank := self.file.ranks.get(raw)) is not None:
                pieces[piece] = rank.to_bytes(4, "little")
            else:
                merged.append(piece)
                raws.append(raw)
        if raws:
            pieces.update(zip(merged, self.file.merge(raws), strict=True))
        return [b"".join([pieces[p] for p in ps]) for ps in found]

    def whole(self, text: str) -> bytes:
        """The ids of a text without the table of chunks."""
        return self._learn([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.file.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker: its tables and caches serve all batches that the worker gets."""
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """Ids of every text and their decoding: (key, n_tokens, ids_sha256, decoded_sha256[, ids][, decoded]).

    ids is binary, little-endian unsigned 32-bit; decoded is the text that the ids give back. A null
    text counts as empty: no tokens, digests of the empty string. Equal texts give equal rows; keys
    may repeat or be null and are only carried. Very long texts are encoded whole. Other columns of docs are ignored, whatever their names. An empty table
    gives an empty one. One pass over the input, without a shuffle.
    """
    kind = docs.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in slices(batches):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n, ids_digest, text_digest, all_ids, all_texts = [], [], [], [], []
            for x, ids in zip(texts, own.encode(texts), strict=True):
                back = own.decode(ids)
                if back != x.encode():  # two chunks of one hash: the text goes past the table
                    ids = own.whole(x)
                    back = own.decode(ids)
                n.append(len(ids) // 4)
                ids_digest.append(hashlib.sha256(ids).hexdigest())
                text_digest.append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                if with_text:
                    all_texts.append(back.decode())
            names, columns = [key, "n_tokens", "ids_sha256", "decoded_sha256"], [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())]
            if with_ids:
                names, columns = [*names, "ids"], [*columns, pa.array(all_ids, pa.binary())]
            if with_text:
                names, columns = [*names, "decoded"], [*columns, pa.array(all_texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
