"""Toxicity by logistic regression with FTRL-proximal over hashed word features.

Features of a text, each present or not: words, word stems (their first 4, 5 and 6 letters, which inflected
forms share), word pairs, and pairs that skip one word, hashed into 2 ** BITS places. FTRL-proximal keeps a rate for each coordinate
and holds coordinates at exactly 0 under its L1 term, so the model is a short list of places and weights, at
most 8 * 2 ** BITS bytes, that goes to executors with the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workers import slices, trim

BITS = 20
STEMS = (4, 5, 6)
_WORDS = re.compile(r"[^\W_]+").findall
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SHIFT = np.uint64(64 - BITS)


class _Words(dict):
    """Numbers of words; hashes and single-word features are kept by number. Bounded by `most`, and emptied when a task ends."""

    most = 100_000

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.hash = np.zeros(1 << 12, np.uint64)
        self.own = np.zeros((1 << 12, 1 + len(STEMS)), np.int32)

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == self.hash.size:
            self.hash, self.own = np.concatenate((self.hash, self.hash)), np.concatenate((self.own, self.own))
        self[word] = n
        self.hash[n] = h = xxhash.xxh64_intdigest(word.encode(), 1)
        # a stem as long as its word is the word again
        self.own[n] = [h >> (64 - BITS), *((xxhash.xxh64_intdigest(word[:k].encode(), 2) if len(word) > k else h) >> (64 - BITS) for k in STEMS)]
        return n


_words = _Words()


def _places(text: str | None) -> np.ndarray:
    """The places of a text's features, some more than once; none for a text without words."""
    words = _WORDS((text or "").lower())
    if not words:
        return np.zeros(0, np.int64)
    if len(_words) > _words.most:
        _words.reset()
    at = np.fromiter(map(_words.__getitem__, words), np.int64, len(words))
    h = _words.hash[at]
    parts = [_words.own[at].reshape(-1)]
    for gap, a, b in ((1, _MUL[0], _MUL[1]), (2, _MUL[1], _MUL[2])):
        if h.size > gap:
            parts.append((((h[:-gap] * a) ^ (h[gap:] * b)) * _MUL[0] >> _SHIFT).astype(np.int64))
    return np.concatenate(parts)


def features(text: str | None) -> np.ndarray:
    """The places of a text's features, ascending, each once."""
    return np.unique(_places(text))


@dataclass
class Model:
    """Non-zero weights by place, and the intercept. rows: how many rows it was trained on."""

    places: np.ndarray
    weights: np.ndarray
    intercept: float
    rows: int
    _dense: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_dense": None}

    def score(self, text: str | None) -> float:
        """The probability of the label; 0 if there was nothing to learn from."""
        if not self.rows:
            return 0.0
        if self._dense is None:
            self._dense = np.zeros(1 << BITS)
            self._dense[self.places] = self.weights
        at = _places(text)
        x = self.intercept + float(self._dense[np.unique(at[self._dense[at] != 0])].sum())
        return float(1 / (1 + np.exp(-max(-500.0, min(500.0, x)))))


def fit(rows: list[tuple[np.ndarray, int]], alpha: float = 0.5, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0, epochs: int = 6) -> Model:
    """FTRL-proximal over rows of (places, label), in the order given. The intercept has no L1 term.

    The settings, and STEMS, are those of the least log loss on a fifth of the rows that may be learned from (crc32 mod 5 is 1), of 108 tried on one table; held-out rows had no part in it.
    """
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    z0 = n0 = 0.0
    total = sum(y for _, y in rows)
    start = float(np.log((total + 1) / (len(rows) - total + 1)))
    for _ in range(epochs):
        for at, y in rows:
            zs, ns = z[at], n[at]
            root = np.sqrt(ns)
            w = np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / ((beta + root) / alpha + l2))
            w0 = -z0 / ((beta + n0**0.5) / alpha + l2)
            g = 1 / (1 + np.exp(-max(-500.0, min(500.0, start + w0 + w.sum())))) - y
            z[at] = zs + g - (np.sqrt(ns + g * g) - root) / alpha * w
            n[at] = ns + g * g
            z0 += g - ((n0 + g * g) ** 0.5 - n0**0.5) / alpha * w0
            n0 += g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    places = np.flatnonzero(w)
    return Model(places, w[places], start - z0 / ((beta + n0**0.5) / alpha + l2), len(rows))


def _crc(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the key as text, mod 5, is 0. A null key counts as empty text."""
    return _crc(key) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = 20_000) -> Model:
    """Learns from the labelled documents that aren't held out, at most about most_rows of them.

    most_rows bounds the training set, which one task holds: where more rows are labelled, those with the lowest
    hash of their key are taken. Keys labelled twice count as 1 if any label is 1; null labels, labels other than 0 and 1, and
    labels without a document count as none. Without any row to learn from, every score is 0. Repeated documents are as many rows; very long texts are taken whole. Only the sample's keys, at most about most_rows, are broadcast;
    only the sample's features are shuffled.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    spot = F.conv(F.substring(F.md5(F.col("k").cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    share = most_rows / max(1, own.count())
    sample = own.withColumn("spot", spot).where(F.col("spot") < share)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k").select("spot", "y", "t")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = [features(x).astype("<i4").tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary())], names=["spot", "y", "at"])
        _words.reset()
        trim()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for batch in slices(batches) for x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
        held.sort()
        model = fit([(np.frombuffer(at, "<i4"), y) for _, y, at in held])
        held.clear()
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in ((model.places.astype("<i4").tobytes(), pa.binary()), (model.weights.astype("<f8").tobytes(), pa.binary()), (model.intercept, pa.float64()), (model.rows, pa.int64()))], names=["places", "weights", "intercept", "n"])

    made = rows.mapInArrow(extract, "spot double, y int, at binary").repartition(1).mapInArrow(learn, "places binary, weights binary, intercept double, n bigint").collect()
    if not made:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, 0)
    r = made[0]
    return Model(np.frombuffer(bytes(r["places"]), "<i4"), np.frombuffer(bytes(r["weights"]), "<f8"), r["intercept"], r["n"])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) for every row.

    A null text counts as empty and gets the intercept's score; very long texts are scored whole; repeated rows give repeated rows; a null key counts as empty text where rows are held out; other
    columns are ignored, whatever their names. An empty table gives an empty one. Without training rows every score is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = np.array([model.score(x) for x in batch.column(2).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[key, "held_out", "score", "predicted"])
        _words.reset()
        trim()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, held_out(F.col(key)).alias("held_out"), text).mapInArrow(run, f"`{key}` {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score below threshold; a null or empty text has the intercept's score. An empty table gives an empty one."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([model.score(x) < threshold for x in batch.column(place).to_pylist()], pa.bool_()))
        _words.reset()
        trim()

    return docs.mapInArrow(run, docs.schema)
