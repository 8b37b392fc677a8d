"""A hidden Markov language model: Baum-Welch counts aggregated over partitions, exact likelihood by the scaled forward recursion.

Tokens are words and an end of text. The states emit symbols: each word of at least FREQUENT of all training tokens is a symbol of its own (at
most 1 / FREQUENT of them), every other word belongs to one of RARE symbols by its last two bytes. Within such a symbol a word of the training texts
has its count less a discount; what the discounts leave is dealt to all spellings that end so, by a model of bytes:

    P(text) = sum over state paths of  prod P(state | state before) * P(symbol | state) * P(word | symbol)
    P(word | rare symbol) = (count - discount) / N(symbol)                                      of a word of the training texts,
                            discount * types(symbol) / N(symbol) * P(spelling | symbol)         of any other

A spelling is its last two bytes, then each byte before by the one after it, then its beginning, so spellings of a symbol sum to 1 and texts to no more than 1.

Training is Baum-Welch over whole texts: each of PASSES passes counts all training texts, counts of all tasks are summed by symbol before they reach the driver. The number of symbols,
and so the model, is bounded; the counts of all words grow with the input and are never in one place. Texts are numbered once, in chunks with their own word lists. The
lists' hashes are dealt by value into buckets, each summed by one task and answered to the chunks, so what is shuffled are the distinct words of chunks, in arrays, not tokens. Words are told
apart by 64 bits of their hash. Nothing depends on how the input is split but the order in which numbers are added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .workers import slices, trim

STATES, FREQUENT, RARE, PASSES = 8, 5e-5, 256, 3
#: Bytes of the texts of a chunk; texts of up to so many bytes are in chunks of their own, as texts of a chunk go step by step together.
CHUNK, TIERS = 2 << 20, (4 << 10, 16 << 10)
#: Pairs of a chunk and a word that a bucket has on average, and tokens whose messages are held at a time.
BUCKET, SPAN = 1 << 20, 1 << 19
ENDS = 1 + 256 + 65536


def held_out(key: Column) -> Column:
    """Texts that nothing is learned from: crc32 of the key as text, mod 7, is 2. A null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 7 == 2


class _Chunk:
    """Texts of about one length, their words numbered."""

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {}
        self.keys, self.held, self.tokens, self.size = [], [], [], 0

    def add(self, key: object, held: bool, raw: bytes) -> None:
        index, words = self.index, raw.lower().split()
        words.append(b"")
        self.tokens.append(np.array([index.setdefault(w, len(index)) for w in words], np.int32))
        self.keys.append(key)
        self.held.append(held)
        self.size += len(raw)

    def row(self, number: int, key_type: pa.DataType) -> pa.RecordBatch:
        words = list(self.index)
        hashes = np.array([xxhash.xxh64_intdigest(w, 5) for w in words], np.uint64)
        order = np.argsort(hashes, kind="stable")
        place = np.empty(order.size, np.int32)
        place[order] = np.arange(order.size)
        lengths = np.array([t.size for t in self.tokens], "<i4")
        tokens = place[np.concatenate(self.tokens)]
        counts = np.bincount(tokens[~np.repeat(np.array(self.held, bool), lengths)], minlength=order.size)
        cells = [lengths.tobytes(), tokens.astype("<u2" if order.size <= 1 << 16 else "<u4").tobytes(), b"\n".join([words[i] for i in order]), hashes[order].astype("<u8").tobytes(), counts.astype("<i4").tobytes()]
        columns = [pa.array([number], pa.int64()), pa.array([self.keys], pa.list_(key_type)), pa.array([self.held]), *(pa.array([c], pa.binary()) for c in cells), pa.array([int(counts.sum())], pa.int64()), pa.array([order.size], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "keys", "held", "lengths", "tokens", "words", "hashes", "counts", "trained", "types"])


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Written: (chunk, keys, held, lengths, tokens, words, hashes, counts, trained, types). words are in order of their hashes, joined by line feeds; tokens are places among them, each text
    ended by the empty word; counts are those in texts that aren't held out."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"chunk bigint, keys array<{kind}>, held array<boolean>, lengths binary, tokens binary, words binary, hashes binary, counts binary, trained bigint, types bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, open_ = TaskContext.get().partitionId() << 32, 0, [_Chunk() for _ in range(len(TIERS) + 1)]
        for batch in slices(batches):
            key_type = batch.column(0).type
            for name, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                tier = sum(len(raw) > t for t in TIERS)
                open_[tier].add(name, out, raw)
                if open_[tier].size >= CHUNK:
                    yield open_[tier].row(part + seq, key_type)
                    open_[tier], seq = _Chunk(), seq + 1
        for chunk in open_:
            if chunk.keys:
                yield chunk.row(part + seq, key_type)
                seq += 1
        del open_
        trim()

    return scratch.save(docs.select(F.col(f"`{key}`"), held_out(F.col(f"`{key}`")).alias("held"), F.col(f"`{text}`")).mapInArrow(run, schema), "chunks")


def _ints(x: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(x.as_py(), kind)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    for batch in slices(batches, 1):
        yield {n: batch.column(j)[0] for j, n in enumerate(batch.schema.names)}


@dataclass
class Words:
    """The words of a chunk as bytes. end: 0 for the empty word, else a number of the last byte or two."""

    raw: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, joined: bytes) -> Words:
        raw = np.frombuffer(joined + b"\n", np.uint8)
        stops = np.flatnonzero(raw == 10)
        starts = np.concatenate(([0], stops[:-1] + 1))
        sizes = stops - starts
        last, before = raw[stops - 1].astype(np.int64), raw[np.maximum(stops - 2, 0)].astype(np.int64)
        return cls(raw, starts, sizes, np.where(sizes == 0, 0, np.where(sizes == 1, 1 + last, 257 + before * 256 + last)))

    def pairs(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(of, code) of the steps from each byte but the last to the one before it or the beginning, of words of 2 bytes or more among which: of is the place in which."""
        sizes = np.maximum(self.sizes[which] - 1, 0)
        of = np.repeat(np.arange(which.size), sizes)
        inside = np.arange(of.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = self.starts[which][of] + inside
        prior = np.where(inside == 0, 256, self.raw[np.maximum(at - 1, 0)])
        return of, prior.astype(np.int64) * 256 + self.raw[at]


def rare(end: np.ndarray) -> np.ndarray:
    """The rare symbol, below RARE, of words with that end."""
    return (end * 40503 >> 4) % RARE


def counted(table: DataFrame) -> tuple[DataFrame, dict]:
    """(answers, facts) from the chunks. answers, written: (chunk, bucket, totals): for each chunk the counts of its words in all training texts, in order of bucket and word. facts: of the whole corpus."""
    sums = table.agg(F.coalesce(F.sum("trained"), F.lit(0)).alias("total"), F.coalesce(F.sum("types"), F.lit(0)).alias("pairs")).first()
    total, n = sums["total"], max(1, -(-sums["pairs"] // BUCKET))
    least = max(2.0, FREQUENT * total)
    bounds = np.array([(i << 64) // n for i in range(1, n)], np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at in _cells(batches):
            hashes, counts = _ints(at["hashes"], "<u8"), _ints(at["counts"], "<i4")
            symbols = rare(Words.of(at["words"].as_py()).end).astype(np.uint8)
            cuts = [0, *np.searchsorted(hashes, bounds).tolist(), hashes.size]
            full = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
            columns = [pa.array([i for i, _, _ in full], pa.int64()), pa.array([at["chunk"].as_py()] * len(full), pa.int64()), *(pa.array([x[a:b].tobytes() for _, a, b in full], pa.binary()) for x in (hashes, counts, symbols))]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", "hashes", "counts", "symbols"])

    def add(whole: pa.Table) -> pa.Table:
        hashes, counts, symbols = (np.frombuffer(b"".join(whole[c].to_pylist()), k) for c, k in (("hashes", "<u8"), ("counts", "<i4"), ("symbols", np.uint8)))
        values, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        totals = np.zeros(values.size, np.int64)
        np.add.at(totals, at, counts)
        answer, stops = totals[at], np.cumsum([len(x.as_py()) // 8 for x in whole["hashes"]]).tolist()
        bucket = whole["bucket"][0].as_py()
        rows = [(0, c.as_py(), bucket, answer[a:b].astype("<i8").tobytes(), 0, 0, 0) for c, a, b in zip(whole["chunk"], [0, *stops], stops, strict=False)]
        own, few = totals >= least, (totals > 0) & (totals < least)
        rows += [(1, None, None, None, int(h), int(t), 0) for h, t in zip(values[own].view(np.int64), totals[own], strict=True)]
        n, t = (np.bincount(symbols[first][few], weights=w, minlength=RARE) for w in (totals[few], None))
        rows += [(2, None, None, None, int(s), int(n[s]), int(t[s])) for s in np.flatnonzero(t)]
        rows.append((3, None, None, None, int((totals > 0).sum()), int((few & (totals == 1)).sum()), int((few & (totals == 2)).sum())))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["kind", "chunk", "bucket", "totals", "a", "b", "c"])

    dealt = table.select("chunk", "words", "hashes", "counts").mapInArrow(deal, "bucket bigint, chunk bigint, hashes binary, counts binary, symbols binary")
    made = scratch.save(dealt.groupBy("bucket").applyInArrow(add, "kind int, chunk bigint, bucket bigint, totals binary, a bigint, b bigint, c bigint"), "answers")
    own = sorted((r["a"] % (1 << 64), r["b"]) for r in made.where("kind = 1").select("a", "b").collect())  # at most 1 / FREQUENT
    counts, types = np.zeros(len(own) + RARE), np.zeros(len(own) + RARE)
    counts[: len(own)] = [t for _, t in own]
    for r in made.where("kind = 2").groupBy("a").agg(F.sum("b").alias("n"), F.sum("c").alias("types")).collect():  # at most RARE
        counts[len(own) + r["a"]], types[len(own) + r["a"]] = r["n"], r["types"]
    size, once, twice = made.where("kind = 3").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in "abc")).first()
    facts = {"total": total, "size": size, "discount": min(0.95, max(0.05, once / max(1, once + 2 * twice))), "own": np.array([h for h, _ in own], np.uint64), "counts": counts, "types": types}
    return made.where("kind = 0").select("chunk", "bucket", "totals"), facts


@dataclass
class Model:
    """own: hashes of frequent words, ascending, which are the first symbols; rare symbols follow. first, step, emit: probabilities; emit[symbol, state]. ends, prior: log10
    of the probabilities of a rare word's end within its symbol and of a byte (256: none) before another."""

    own: np.ndarray
    first: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    ends: np.ndarray = field(default_factory=lambda: np.zeros(ENDS))
    prior: np.ndarray = field(default_factory=lambda: np.zeros(257 * 256))

    def symbols(self, hashes: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = rare(end) + self.own.size
        if self.own.size:
            at = np.minimum(np.searchsorted(self.own, hashes), self.own.size - 1)
            out = np.where(self.own[at] == hashes, at, out)
        return out.astype(np.int32)

    def spelt(self, words: Words, which: np.ndarray) -> np.ndarray:
        """log10 of the probability of each of these words' spellings within their rare symbol."""
        of, code = words.pairs(which)
        return self.ends[words.end[which]] + np.bincount(of, weights=self.prior[code], minlength=which.size)


def start(own: np.ndarray, counts: np.ndarray) -> Model:
    """Uniform states that tend to stay, with each state's emissions set apart from the symbols' shares by fixed noise."""
    share = (counts + 0.5) / (counts + 0.5).sum()
    emit = share[:, None] * np.random.default_rng(5).uniform(0.3, 1.7, (share.size, STATES))
    step = np.full((STATES, STATES), 0.3 / (STATES - 1))
    np.fill_diagonal(step, 0.7)
    return Model(own, np.full(STATES, 1 / STATES), step, emit / emit.sum(axis=0))


def spelling(table: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Model.ends and Model.prior, from all training tokens that are rare words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(ENDS + 257 * 256)
        for at in _cells(batches):
            words, counts = Words.of(at["words"].as_py()), _ints(at["counts"], "<i4").astype(np.float64)
            which = np.flatnonzero((counts > 0) & (model.symbols(_ints(at["hashes"], "<u8"), words.end) >= model.own.size))
            of, code = words.pairs(which)
            sums[:ENDS] += np.bincount(words.end[which], weights=counts[which], minlength=ENDS)
            sums[ENDS:] += np.bincount(code, weights=counts[which][of], minlength=257 * 256)
        row = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(sums[row].astype(np.int64))], names=["row", "n"])

    sums = np.zeros(ENDS + 257 * 256)
    for r in table.select("words", "hashes", "counts").mapInArrow(count, "row bigint, n bigint").groupBy("row").agg(F.sum("n").alias("n")).collect():
        sums[r["row"]] = r["n"]
    sums += 0.5
    ends, prior = sums[:ENDS], sums[ENDS:].reshape(257, 256)
    of = rare(np.arange(ENDS))
    return np.log10(ends / np.bincount(of, weights=ends, minlength=RARE)[of]), np.log10(prior / prior.sum(axis=0)).reshape(-1)


class _Layout:
    """Texts of symbols side by side, longest first: token t of the r-th is at offset[t] + r."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        lengths = np.array([t.size for t in texts], np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        sizes = lengths[self.order]
        self.active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # texts longer than t
        offset = np.concatenate(([0], np.cumsum(self.active)))
        time = np.arange(offset[-1]) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.symbols = np.empty(offset[-1], np.int32)
        self.symbols[offset[time] + np.repeat(np.arange(sizes.size), sizes)] = np.concatenate([texts[i] for i in self.order])
        self.offset: list[int] = offset.tolist()
        #: Times at which spans of about SPAN tokens begin, and the end.
        cuts = np.searchsorted(offset, np.arange(0, offset[-1], SPAN), side="left").tolist()
        self.cuts = [*dict.fromkeys(c for c in cuts if c < sizes[0]), int(sizes[0])]

    def ahead(self, model: Model, a: int, b: int, now: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(emissions, scaled forward messages, scales) of times a to b - 1, and the last message. now: the message of time a - 1."""
        base = self.offset[a]
        seen = model.emit[self.symbols[base : self.offset[b]]]
        alpha, scale, step = np.empty_like(seen), np.empty(len(seen)), model.step
        for t in range(a, b):
            i, j = self.offset[t] - base, self.offset[t + 1] - base
            now = (model.first if now is None else now[: j - i] @ step) * seen[i:j]
            scale[i:j] = s = now.sum(axis=1)
            now /= s[:, None]
            alpha[i:j] = now
        return seen, alpha, scale, now


def forward(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of each text of symbols, by the scaled forward recursion over all texts at once."""
    layout, total, now = _Layout(texts), np.zeros(len(texts)), None
    for a, b in zip(layout.cuts, layout.cuts[1:], strict=False):
        _, _, scale, now = layout.ahead(model, a, b, now)
        rank = np.arange(scale.size) - np.repeat(np.array(layout.offset[a:b]) - layout.offset[a], layout.active[a:b])
        total += np.bincount(rank, weights=np.log10(scale), minlength=len(texts))
    out = np.empty(len(texts))
    out[layout.order] = total
    return out


def expect(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts (first, step, emit) of whole texts of symbols. Messages are held for one span of tokens at a time: where there are more, the forward messages of a span are made again for the way back."""
    layout, step = _Layout(texts), model.step
    moves, out = np.zeros((STATES, STATES)), np.zeros(model.emit.shape)
    spans = list(zip(layout.cuts, layout.cuts[1:], strict=False))
    before: list[np.ndarray | None] = [None]
    for a, b in spans[:-1]:
        before.append(layout.ahead(model, a, b, before[-1])[3])
    back = np.zeros((0, STATES))
    for (a, b), now in zip(reversed(spans), reversed(before), strict=True):
        seen, alpha, scale, _ = layout.ahead(model, a, b, now)
        base, gamma = layout.offset[a], np.empty_like(alpha)
        seen /= scale[:, None]
        for t in range(b - 1, a - 1, -1):
            i, j = layout.offset[t] - base, layout.offset[t + 1] - base
            beta = np.ones((j - i, STATES))
            beta[: len(back)] = back
            np.multiply(alpha[i:j], beta, out=gamma[i:j])
            seen[i:j] *= beta
            back = seen[i:j] @ step.T
        head = int(layout.active[a])
        if now is not None:
            moves += now[:head].T @ seen[:head]
        later = np.arange(head, len(seen))
        moves += alpha[later - np.repeat(layout.active[a : b - 1], layout.active[a + 1 : b])].T @ seen[head:]
        for k in range(STATES):
            out[:, k] += np.bincount(layout.symbols[base : layout.offset[b]], weights=gamma[:, k], minlength=len(out))
        if a == 0:
            first = gamma[:head].sum(axis=0)
    return first, moves * step, out


def maximise(model: Model, counts: np.ndarray, first: np.ndarray, step: np.ndarray, emit: np.ndarray, prior: float = 20.0) -> Model:
    """Probabilities from expected counts, with `prior` counts dealt by the symbols' shares."""
    share = (counts + 0.5) / (counts + 0.5).sum()
    e = emit + prior * share[:, None]
    return Model(model.own, (first + 0.1) / (first + 0.1).sum(), (step + 0.1) / (step + 0.1).sum(axis=1, keepdims=True), e / e.sum(axis=0))


def _texts(at: dict, symbols: np.ndarray) -> list[np.ndarray]:
    lengths = _ints(at["lengths"], "<i4")
    raw = at["tokens"].as_py()
    tokens = np.frombuffer(raw, "<u2" if len(raw) == 2 * int(lengths.sum(dtype=np.int64)) else "<u4")
    return np.split(symbols[tokens], np.cumsum(lengths)[:-1])


def train(table: DataFrame, facts: dict) -> Model:
    """PASSES passes of Baum-Welch over all training texts."""
    counts = facts["counts"]
    model = start(facts["own"], counts)
    if not facts["total"]:
        model.ends, model.prior = spelling(table, model)
        return model
    names = [f"c{k}" for k in range(STATES)]
    for _ in range(PASSES):

        def count(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            sums = None
            for at in _cells(batches):
                texts = [t for t, h in zip(_texts(at, model.symbols(_ints(at["hashes"], "<u8"), Words.of(at["words"].as_py()).end)), at["held"].as_py(), strict=True) if not h]
                if texts:
                    got = expect(model, texts)
                    sums = got if sums is None else tuple(a + b for a, b in zip(sums, got, strict=True))
            if sums is not None:
                whole = np.concatenate((sums[0][None], sums[1], sums[2]))
                row = np.flatnonzero(whole.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(row), *(pa.array(whole[row, k]) for k in range(STATES))], names=["row", *names])

        made = table.select("held", "lengths", "tokens", "words", "hashes").mapInArrow(count, "row bigint, " + ", ".join(f"{n} double" for n in names))
        whole = np.zeros((1 + STATES + counts.size, STATES))
        for r in made.groupBy("row").agg(*(F.sum(n).alias(n) for n in names)).collect():
            whole[r["row"]] = r[1:]
        model = maximise(model, counts, whole[0], whole[1 : 1 + STATES], whole[1 + STATES :])
    model.ends, model.prior = spelling(table, model)
    return model


def within(model: Model, facts: dict, words: Words, symbols: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """log10 of each word's share of its symbol. totals: its count in the training texts."""
    out, few = np.zeros(symbols.size), symbols >= model.own.size
    of, seen = facts["counts"][symbols], totals > 0
    known = few & seen
    out[known] = np.log10((totals[known] - facts["discount"]) / of[known])
    new = np.flatnonzero(few & ~seen)
    left, base = facts["discount"] * facts["types"][symbols[new]], of[new]
    out[new] = np.where(base > 0, np.log10(np.maximum(left, 1e-300) / np.maximum(base, 1)), 0) + model.spelt(words, new)
    return out


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    A null or empty text has one token, its end; very long texts are scored whole. Words are what stands between ASCII white space, A-Z in lower case. Without training texts every symbol
    is rare. A null key counts as empty text where rows are held out. Repeated rows give repeated rows; other columns are ignored, whatever their names. An empty table gives an empty one.
    """
    table = chunks(docs, key, text)
    answers, facts = counted(table)
    scratch.release(docs.sparkSession)
    model = train(table, facts)
    known = answers.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "totals"))), lambda x: x["totals"]).alias("totals"))
    placed = table.select("chunk", "keys", "held", "lengths", "tokens", "words", "hashes").join(known, "chunk")
    kind = docs.schema[key].dataType.simpleString()
    total, size = facts["total"], facts["size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at in _cells(batches):
            words, totals = Words.of(at["words"].as_py()), np.frombuffer(b"".join(at["totals"].as_py()), "<i8")
            symbols = model.symbols(_ints(at["hashes"], "<u8"), words.end)
            shares, base = within(model, facts, words, symbols, totals), np.log10((totals + 1) / (total + 1 * (size + 1)))
            places = _texts(at, np.arange(symbols.size))
            lengths = np.array([p.size for p in places], np.int64)
            flat, starts = np.concatenate(places), np.cumsum(lengths) - lengths
            scores = forward(model, [symbols[p] for p in places]) + np.add.reduceat(shares[flat], starts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(at["keys"].as_py(), at["keys"].type.value_type), pa.array(at["held"].as_py(), pa.bool_()), pa.array(lengths), pa.array(np.add.reduceat((totals > 0)[flat].astype(np.int64), starts)),
                    pa.array(np.full(lengths.size, total, np.int64)), pa.array(np.add.reduceat(base[flat], starts)), pa.array(scores),
                ], names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return placed.drop("chunk").mapInArrow(run, f"`{key}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
