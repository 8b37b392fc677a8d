"""Ids of whole texts from the ids of their distinct chunks, in numpy.

Texts are cut before spaces and line feeds. Chunks are told apart by two 64-bit polynomial hashes of their bytes
(longer ones than LONG by the halves of a 128-bit XXH3), so that each batch calls the slow encoder only for chunks that
are new, and the table of known chunks holds numbers, not strings. The first hash finds a chunk, the second confirms it;
a batch with a chunk that isn't confirmed is encoded without the table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import xxhash

LONG = 64
BATCH = 1 << 21
_STEP = 1 << 19


def _powers(base: int) -> np.ndarray:
    return np.array([pow(base, i, 1 << 64) for i in range(LONG + 1)], np.uint64)


_POWERS, _OTHERS = _powers(0x9E3779B97F4A7C13), _powers(0xC2B2AE3D27D4EB4F)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_CUT = np.zeros(256, bool)
_CUT[[10, 32]] = True
#: White space beyond ASCII.
_ODD = re.compile("[\x85\xa0  -     　]").search


class ChunkTable:
    """learn(chunks) gives the ids of each as little-endian uint32 bytes; a text's ids must be those of its chunks on end.

    strict: cut only at a space or line feed between two characters that aren't white space; a text with white space
    beyond ASCII then goes to learn whole.
    """

    def __init__(self, learn: Callable[[list[str]], list[bytes]], strict: bool, cached: int = 600_000) -> None:
        self.learn, self.strict, self.cached = learn, strict, cached
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.slots, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.pool, self.start, self.length = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _cuts(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts of chunks, hashes of chunks, chunks of each text, second hashes of chunks)."""
        text = np.frombuffer(b"".join(raws), np.uint8)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        stops = np.cumsum(sizes)
        flag = _CUT[text]
        if self.strict and text.size:
            white = _WHITE[text]
            flag[1:] &= ~white[:-1]
            flag[:-1] &= ~white[1:]
        flag[(stops - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(flag)
        counts = np.diff(np.searchsorted(starts, np.concatenate(([0], stops))))
        if not starts.size:
            return text, starts, np.zeros(0, np.uint64), counts, np.zeros(0, np.uint64)
        lengths = np.diff(starts, append=text.size)
        place = np.minimum(np.arange(text.size) - np.repeat(starts, lengths), LONG)
        value = text.astype(np.uint64) + np.uint64(1)
        hashes = np.add.reduceat(value * _POWERS[place], starts) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(32)
        checks = np.add.reduceat(value * _OTHERS[place], starts)
        for i in np.flatnonzero(lengths > LONG).tolist():
            digest = xxhash.xxh3_128_intdigest(text[starts[i] : starts[i] + lengths[i]].tobytes())
            hashes[i], checks[i] = digest & (1 << 64) - 1, digest >> 64
        return text, starts, hashes, counts, checks

    def encode(self, texts: Sequence[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers. Works on about BATCH characters at a time."""
        a = size = 0
        for b, x in enumerate(texts, 1):
            size += len(x)
            if size >= BATCH or b == len(texts):
                yield from self._encode(texts[a:b])
                a, size = b, 0

    def _encode(self, texts: Sequence[str]) -> Iterator[bytes]:
        odd = {i for i, x in enumerate(texts) if not x.isascii() and _ODD(x)} if self.strict else set()
        parts, held, size = [], [], 0
        for i, x in enumerate(texts):
            held.append(b"" if i in odd else x.encode())
            size += len(held[-1])
            if size >= _STEP:
                parts.append(self._cuts(held))
                held, size = [], 0
        parts.append(self._cuts(held))
        hashes, first, at = np.unique(np.concatenate([p[2] for p in parts]), return_index=True, return_inverse=True)
        checks = np.concatenate([p[4] for p in parts])
        sure = bool((checks == checks[first][at]).all())
        slot, checks = np.full(hashes.size, -1), checks[first]
        if self.hashes.size:
            near = np.minimum(np.searchsorted(self.hashes, hashes), self.hashes.size - 1)
            slot = np.where(self.hashes[near] == hashes, self.slots[near], -1)
            sure = sure and bool((checks == self.checks[near])[slot >= 0].all())
        if not sure:
            yield from self._plain(texts, parts, odd)
            return
        if (new := np.flatnonzero(slot < 0)).size:
            slot[new] = self.start.size + np.arange(new.size)
            self._add(hashes[new], checks[new], self._strings(parts, first[new]))
        at = slot[at]
        a, whole = 0, dict(zip(sorted(odd), self.learn([texts[i] for i in sorted(odd)]), strict=True)) if odd else {}
        for i, n in enumerate(np.concatenate([p[3] for p in parts]).tolist()):
            if i in odd:
                yield whole[i]
                continue
            own = at[a : a + n]
            a += n
            lengths = self.length[own]
            stops = np.cumsum(lengths)
            yield self.pool[np.arange(stops[-1]) + np.repeat(self.start[own] - stops + lengths, lengths)].tobytes() if n else b""
        if self.start.size > self.cached or self.pool.size > 8 * self.cached:
            self._clear()

    def _plain(self, texts: Sequence[str], parts: list[tuple], odd: set[int]) -> Iterator[bytes]:
        """The ids of each text without the table: two chunks have the same hash."""
        counts = np.concatenate([p[3] for p in parts])
        ids = self.learn(self._strings(parts, np.arange(counts.sum())))
        stops = np.cumsum(counts)
        for i, (a, b) in enumerate(zip((stops - counts).tolist(), stops.tolist(), strict=True)):
            yield self.learn([texts[i]])[0] if i in odd else b"".join(ids[a:b])

    @staticmethod
    def _strings(parts: list[tuple], places: np.ndarray) -> list[str]:
        """The chunks at these places of the batch."""
        out: list[str] = [""] * places.size
        bounds = np.cumsum([0, *(p[1].size for p in parts)])
        of = np.searchsorted(bounds, places, side="right") - 1
        for k in np.unique(of).tolist():
            text, starts = parts[k][0], parts[k][1]
            raw, stops = text.tobytes(), np.append(starts[1:], text.size)
            mine = np.flatnonzero(of == k)
            for j, a, b in zip(mine.tolist(), starts[places[mine] - bounds[k]].tolist(), stops[places[mine] - bounds[k]].tolist(), strict=True):
                out[j] = raw[a:b].decode()
        return out

    def _add(self, hashes: np.ndarray, checks: np.ndarray, chunks: list[str]) -> None:
        ids = self.learn(chunks)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.hashes, self.slots = np.concatenate((self.hashes, hashes)), np.concatenate((self.slots, self.start.size + np.arange(hashes.size)))
        order = np.argsort(self.hashes, kind="stable")
        self.checks = np.concatenate((self.checks, checks))[order]
        self.hashes, self.slots = self.hashes[order], self.slots[order]
        self.start = np.concatenate((self.start, self.pool.size + np.cumsum(lengths) - lengths))
        self.length = np.concatenate((self.length, lengths))
        self.pool = np.concatenate((self.pool, np.frombuffer(b"".join(ids), "<u4")))
