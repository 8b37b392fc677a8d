import base64
import hashlib
import math
import random
import re
import textwrap
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrymill.llm import byte_bpe, chat, chunk_table, components, hmm, imatch, licenses, mixing, scratch, simhash, token_files, toxicity, vectors, word_pieces

BPE, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
# extra columns whose names the operators use inside
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, bits long, hash long, row int, `_row` int, copies int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts += [None, "", " \n\t ", "x", "A a A", "a" * 50_000, "word " * 9000, texts[0], texts[0], texts[1] + " end", "Don't  stop!!\r\n\x85 now", "MIT", "SPDX-License-Identifier: MIT\nrest", "released under the mit licence"]
    out = [(i, t, "en", ("s1", "s2", None)[i % 3], None) for i, t in enumerate(texts)]
    return [*out, out[3], out[40], (None, "no key here", None, "s1", None), (None, texts[2], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, 3, 4, 5, 6) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def tik():
    with open(BPE, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_bpe_equals_the_library():
    rng, own, want = random.Random(1), byte_bpe.Encoder(BPE, P.PATTERN), tik()
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "1", "\x1c", "\x85", "\xa0", "!", "the", "ing", " \n", "中", "🙂", "aaaa", "--", "İ", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["a" * n for n in range(40)] + ["-" * 999, "ab" * 5000]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want(text), text
        assert own.decode(ids) == text.encode()


def test_bpe_of_long_pre_tokens():
    """Equal to the library where both queues are used, and in proportion to the length, also where each merge makes a pair of a lower rank."""
    rng, file, encode = random.Random(3), byte_bpe.encoder(BPE, P.PATTERN).file, tik()
    for n in (500, 513, 3000):
        for text in ("Thisq" * (n // 5), "".join(rng.choice(("The", "Is", "ing", "Xx", "q")) for _ in range(n)), "".join(rng.choice("abctehrsin") for _ in range(n)), "a" * n, "é" * n):
            raw = text.encode()
            assert np.frombuffer(file.merge([raw])[0], "<u4").tolist() == np.frombuffer(file.merge_long(raw), "<u4").tolist() == encode(text), text[:20]
    began = time.perf_counter()
    file.merge([b"Thisq" * 10_000])
    once = time.perf_counter() - began
    file.merge([b"Thisq" * 80_000])
    assert time.perf_counter() - began < 30 * max(once, 0.05)


def test_rank_queue():
    rng, queue, want = random.Random(2), byte_bpe.RankQueue(5000), Counter()
    for _ in range(2000):
        if rng.random() < 0.6 or not want:
            r = rng.randrange(5000)
            queue.push(r, np.array([1]))
            want[r] += 1
        else:
            r = queue.first()
            assert r == min(want) and queue.take(r).size == want.pop(r)
    assert queue.first() == (min(want) if want else -1)


def test_op2(docs, rows, none):
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.encode(docs, BPE, P.PATTERN, with_ids=False).collect())
    want, encode = [], tik()
    for i, t, *_ in rows:
        ids = encode(t or "")
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert byte_bpe.encode(none, BPE, P.PATTERN).collect() == []


def test_pack():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 5000):
        for ids in (rng.integers(0, 2**32, n, dtype=np.uint32), rng.integers(0, 50, n).astype(np.uint32), np.where(rng.random(n) < 0.02, 2**31, 7).astype(np.uint32)):
            shard = token_files.Shard(token_files.pack(np.arange(1), np.array([n]), ids))
            assert (shard.read() == ids).all()
            if shard.blocks > 2:
                assert (shard.read(1, 2) == ids[512:1024]).all()
    with pytest.raises(ValueError):
        token_files.Shard(token_files.pack(np.arange(1), np.array([1]), np.zeros(1, np.uint32))[:-1])


def test_op4(docs, rows, none):
    files = token_files.write(docs, word_pieces.maker(WORDS), 1, shard_ids=500)
    got = token_files.read(files).orderBy("start").collect()
    library, start, want = Tokenizer.from_file(WORDS), 0, []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    for i, t, *_ in order:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert token_files.read(token_files.write(none, word_pieces.maker(WORDS), 1)).collect() == []
    ends = docs.sparkSession.createDataFrame([(-(1 << 63), "a"), ((1 << 63) - 1, "b"), (None, "c"), (0, "d")], "doc_id long, text string")
    assert [r["doc_id"] for r in token_files.read(token_files.write(ends, word_pieces.maker(WORDS), 1)).orderBy("start").collect()] == [None, -(1 << 63), 0, (1 << 63) - 1]


def test_chunks_with_equal_hashes(monkeypatch):
    library = Tokenizer.from_file(WORDS)
    texts = ["one two one three", "", "four\nfive six", "x" * 200 + " y", "two one"]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    cuts = chunk_table.ChunkTable._cuts
    calls = []

    def clash(self, raws):  # all chunks have one hash; the second tells them apart
        text, starts, hashes, counts, checks = cuts(self, raws)
        calls.append(len(raws))
        return text, starts, hashes * np.uint64(0), counts, checks

    plain = list(word_pieces.WordEncoder(WORDS).encode(texts))
    monkeypatch.setattr(chunk_table.ChunkTable, "_cuts", clash)
    encode = word_pieces.WordEncoder(WORDS).encode
    # within a batch, and against what the table knows from batches before
    assert plain == want == list(encode(texts)) == [x for t in texts for x in encode([t])]
    right, strict = tik(), byte_bpe.Encoder(BPE, P.PATTERN).encode([*texts, "odd\x85 white"])
    assert list(strict) == [np.array(right(t), "<u4").tobytes() for t in [*texts, "odd\x85 white"]]
    assert calls


def test_op6(spark, docs, rows, none):
    prints = [simhash.fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    want = Counter((r[0], f"{prints[i]:016x}", least.get(find(i))) for i, r in enumerate(rows))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(none).collect() == []
    assert prints[40] == prints[41] == prints[42] == 0


def test_links_are_all_pairs_near(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(60)]
    bits = {b for x in base for b in (x, *(x ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 4))) for _ in range(4)))}
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(b,) for b in signed], "bits long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (7, 7)] + [(200, 200 + i) for i in range(50)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | dict.fromkeys((90, 95, 100), 90) | {200 + i: 200 for i in range(50)}


def test_op1(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 24))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 24)) * 0.1, base[:5], base[:1] + rng.normal(size=(60, 24)) * 0.1])
    label = [i % 3 for i in range(40)] + [i % 3 for i in range(20)] + [i % 3 for i in range(5)] + [0] * 60
    table = [(i, [float(v) for v in row], label[i], 1) for i, row in enumerate(x)]
    bad = [(900, None, 0, 1), (901, [0.0] * 24, 0, 1), (902, [float("nan")] * 24, 0, 1), (903, [None] * 24, 0, 1), (904, table[0][1], None, 1), (None, table[0][1], 0, 1), (905, [], 0, 1), (906, [1.0, 2.0], 0, 1)]
    df = spark.createDataFrame(table + bad, "vec_id long, embedding array<double>, label int, n int")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = (unit @ unit.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.minimum(root, np.where(near, root[None], len(x)).min(axis=1))
    block, vectors.BLOCK = vectors.BLOCK, 16
    try:
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect()}
    finally:
        vectors.BLOCK = block
    want = {i: (int(near[i].sum()), int(root[i]), bool(root[i] == i)) for i in range(len(x))}
    links = sum(v[0] for v in want.values())
    assert sum(got[i][0] for i in want) >= 0.99 * links and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)
    assert all(got[i] == (0, i, True) for i in (900, 901, 902, 903, 904, 905, 906)) and got[None] == (0, None, False)
    assert vectors.near_duplicates(df.where("false")).collect() == []


def test_op1_sketches_leave_no_link_out():
    rng = np.random.default_rng(6)
    for d in (2, 7, 64, 300):
        base = rng.normal(size=(60, d)) * rng.uniform(0.1, 30, d)
        x = vectors._unit(np.concatenate([base, base + rng.normal(size=base.shape) * np.abs(base) * 0.25]))
        side = rng.integers(0, 2, len(x))
        for across in (False, True):
            near = (x @ x.T >= 0.98) & ~np.eye(len(x), dtype=bool) & (~np.bool_(across) | (side[:, None] != side))
            may = vectors._may_link(*vectors._sketch(x), side, across, 0.98)
            assert not (near.any(axis=1) & ~may).any()
            assert d < 64 or may.sum() < len(x)


def test_op1_of_floats(spark):
    """Single-precision components are compared in double precision; the same links as by brute force."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(50, 64)).astype(np.float32)
    x = np.concatenate([base, (base[:30] + rng.normal(size=(30, 64)) * 0.1).astype(np.float32), base[:4]])
    df = spark.createDataFrame([(i, [float(v) for v in r], 1, 2, 3) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int, rep int, task int")
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    near = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(x))] == near.tolist()


def test_op7(spark, docs, none):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    table = [(i, " ".join(rng.choices(words, k=30)) + (f" zorg{rng.choice(['a', 'en', 'ist'])}" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(1500)]
    df = spark.createDataFrame([r[:2] for r in table], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in table] + [(1, None), (None, 1), (9_999, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    out = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    held = [i for i, *_ in table if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i]["held_out"] == (i in set(held)) for i, *_ in table)
    assert sum(out[i]["predicted"] == table[i][2] for i in held) >= 0.98 * len(held)
    assert len(model.places) < 200
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.score(none, model).collect() == []
    assert toxicity.train(df, labels.where("false")).score("x") == 0.0


def test_op9(docs, rows, none):
    got = mixing.mix(docs.select("doc_id", "source", mixing.words("text").alias("size"), "copies")).collect()
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len((t or "").encode().split())
    goal = dict(zip(("s1", "s2", None), mixing.targets([size["s1"], size["s2"], size[None]], [3, 1, 2], 1.5, 2.0), strict=True))
    assert sum(goal.values()) == pytest.approx(1.5 * sum(size.values()))
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == goal[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    most = max(r["size"] for r in got)
    assert all(0 <= goal[s] - taken[s] <= most for s in goal)
    assert mixing.mix(none).collect() == []
    assert mixing.take(docs).count() == sum(r["copies"] for r in got) and mixing.take(docs).columns == docs.columns
    assert mixing.targets([10, 1000], [3, 1], 1.5, 2.0) == [20.0, 1495.0] and mixing.targets([], [], 1.5, 2.0) == []


def test_op9_splits_rows_of_one_key(spark):
    """Rows without a key, or with one key, are told apart by their texts; columns may have the names used inside; many sources."""
    table = [(None if i % 2 else 7, f"s{i % 2}", " ".join(f"w{i}x{j}" for j in range(20)), i) for i in range(400)] + [(i, f"t{i}", "one two three", i) for i in range(300)]
    docs = spark.createDataFrame(table, "doc_id long, source string, text string, OWN int").withColumn("_mix_own", F.lit(1)).withColumn("threshold", F.lit(2)).withColumn("copy", F.lit(3))
    out = mixing.take(docs)
    taken = Counter(r["source"] for r in out.collect())
    got = {r["source"]: r for r in mixing.mix(docs.select("*", mixing.words("text").alias("size")), tie="text").collect()}
    assert out.columns == docs.columns and len(got) == 302
    for s in ("s0", "s1"):
        assert got[s]["source_size"] == 4000 and 0 <= got[s]["target"] - 20 * taken[s] <= 20
    sizes = [got[s]["source_size"] for s in sorted(got)]
    goal = mixing.targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], 1.5, 2.0)
    assert [got[s]["target"] for s in sorted(got)] == pytest.approx(goal)


def test_op7_fit_is_the_plain_loop():
    """Weights by FTRL-proximal, one coordinate at a time."""
    rng = random.Random(19)
    rows = [(np.array(sorted(rng.sample(range(50), 8))), rng.randint(0, 1)) for _ in range(200)]
    rows = [(at, int(at.min() < 3 or y and at.max() > 45)) for at, y in rows]
    alpha, beta, l1, l2, epochs = 0.3, 1.0, 0.7, 0.5, 2
    z, n, zi, ni = [0.0] * 50, [0.0] * 50, 0.0, 0.0
    ones = sum(y for _, y in rows)
    start = math.log((ones + 1) / (len(rows) - ones + 1))

    def weight(j):
        return 0.0 if abs(z[j]) <= l1 else (math.copysign(l1, z[j]) - z[j]) / ((beta + math.sqrt(n[j])) / alpha + l2)

    for _ in range(epochs):
        for at, y in rows:
            w = {j: weight(j) for j in at.tolist()}
            own = -zi / ((beta + math.sqrt(ni)) / alpha + l2)
            g = 1 / (1 + math.exp(-(start + own + sum(w.values())))) - y
            for j, v in w.items():
                z[j] += g - (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / alpha * v
                n[j] += g * g
            zi += g - (math.sqrt(ni + g * g) - math.sqrt(ni)) / alpha * own
            ni += g * g
    model = toxicity.fit(rows, alpha, beta, l1, l2, epochs)
    want = {j: weight(j) for j in range(50) if weight(j)}
    assert dict(zip(model.places.tolist(), model.weights.tolist(), strict=True)) == pytest.approx(want)
    assert model.intercept == pytest.approx(start - zi / ((beta + math.sqrt(ni)) / alpha + l2)) and model.rows == 200


def test_op5(docs, rows, none):
    got = hmm.score(docs).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    count = Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t, *_ in rows:
        w = tokens(t)
        want[i, held(i), len(w), sum(x in count for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] <= 1e-9 for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert hmm.score(none).collect() == []


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(1)
    k = hmm.STATES
    norm = lambda x, a: x / x.sum(axis=a, keepdims=True)
    model = hmm.Model(np.zeros(0, np.uint64), norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((5, k)), 0))
    texts = [rng.integers(0, 5, n) for n in (1, 2, 3, 3)]
    for text, got in zip(texts, hmm.forward(model, texts), strict=True):
        total = 0.0
        for path in np.ndindex(*[k] * len(text)):
            p = model.first[path[0]] * model.emit[text[0], path[0]]
            for a, b, s in zip(path, path[1:], text[1:]):
                p *= model.step[a, b] * model.emit[s, b]
            total += p
        assert got == pytest.approx(math.log10(total))
    assert hmm.forward(model, [np.array([1])])[0] == pytest.approx(math.log10(float(model.first @ model.emit[1])))


def test_expect_is_the_sum_over_paths(monkeypatch):
    """Counts of states, steps and emissions by all paths, and the same whatever the spans in which messages are held."""
    rng = np.random.default_rng(2)
    k = hmm.STATES
    norm = lambda x, a: x / x.sum(axis=a, keepdims=True)
    model = hmm.Model(np.zeros(0, np.uint64), norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((5, k)), 0))
    texts = [rng.integers(0, 5, n) for n in (3, 1, 2, 3)]
    first, moves, emit = np.zeros(k), np.zeros((k, k)), np.zeros((5, k))
    for text in texts:
        paths = list(np.ndindex(*[k] * len(text)))
        p = np.array([model.first[s[0]] * np.prod([model.emit[x, y] for x, y in zip(text, s)]) * np.prod([model.step[a, b] for a, b in zip(s, s[1:])]) for s in paths])
        for s, w in zip(paths, p / p.sum(), strict=True):
            first[s[0]] += w
            for a, b in zip(s, s[1:]):
                moves[a, b] += w
            for x, y in zip(text, s, strict=True):
                emit[x, y] += w
    long = [rng.integers(0, 5, n) for n in (400, 1, 37, 400, 90)]
    whole = hmm.expect(model, long), hmm.forward(model, long)
    for span in (1 << 19, 5, 1):
        monkeypatch.setattr(hmm, "SPAN", span)
        for got, want in zip(hmm.expect(model, texts), (first, moves, emit), strict=True):
            assert got == pytest.approx(want)
        for got, want in zip((*hmm.expect(model, long), hmm.forward(model, long)), (*whole[0], whole[1]), strict=True):
            assert got == pytest.approx(want)


def test_op5_is_a_probability(spark):
    """Spellings of a rare symbol sum to 1, all words together to no more than 1; unseen words cost what their spelling does."""
    rng = random.Random(17)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(20)]
    table = [(i, " ".join(rng.choices(words, k=30))) for i in range(60)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    chunks = hmm.chunks(df)
    answers, facts = hmm.counted(chunks)
    model = hmm.train(chunks, facts)
    assert facts["counts"].sum() == facts["total"] and (model.emit.sum(axis=0) == pytest.approx(1)) and (model.step.sum(axis=1) == pytest.approx(1)) and model.first.sum() == pytest.approx(1)
    ends = np.bincount(hmm.rare(np.arange(hmm.ENDS)), weights=10**model.ends, minlength=hmm.RARE)
    assert ends == pytest.approx(1) and (10 ** model.prior.reshape(257, 256)).sum(axis=0) == pytest.approx(1)
    import xxhash

    alphabet = [w for w in (bytes(x) for n in range(1, 7) for x in __import__("itertools").product(b"ab", repeat=n))]
    listed = hmm.Words.of(b"\n".join([b"", *alphabet]))
    count = Counter(w for i, t in table if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*t.encode().split(), b""])
    totals = np.array([count[w] for w in [b"", *alphabet]])
    symbols = model.symbols(np.array([xxhash.xxh64_intdigest(w, 5) for w in [b"", *alphabet]], np.uint64), listed.end)
    share = 10 ** hmm.within(model, facts, listed, symbols, totals)
    assert np.bincount(symbols, weights=share, minlength=symbols.max() + 1).max() <= 1 + 1e-9
    # the same whatever the split of the input
    one, many = (sorted((r["doc_id"], r["score"]) for r in hmm.score(x).collect()) for x in (df.coalesce(1), df.repartition(7)))
    assert [s for _, s in one] == pytest.approx([s for _, s in many], rel=1e-9)


def test_op5_learns_more_than_counts(spark):
    """Texts of two kinds of words are likelier than by counts alone, held-out ones too, which aren't likelier than training texts for their unseen words."""
    rng = random.Random(18)
    kinds = [["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(40)] for _ in range(4)]
    table = [(i, " ".join([*rng.choices(kinds[i % 4], k=80), *(f"new{rng.randrange(10**6)}" for _ in range(2))])) for i in range(400)]
    got = hmm.score(spark.createDataFrame(table, "doc_id long, text string")).collect()
    rate = lambda h, c: sum(r[c] for r in got if r["held_out"] == h) / sum(r["n_tokens"] for r in got if r["held_out"] == h)
    assert rate(True, "score") > rate(True, "base_score") and rate(False, "score") >= rate(True, "score")


def test_op8(docs, rows, none):
    got = imatch.fingerprints(docs)
    by = {}
    for r in got.join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        by.setdefault(r["text"] or "", set()).add(r["fingerprint"])
        assert r["n_chars"] == len(r["text"] or "") and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) > 30
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    want = Counter()
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        t, n = a[1] or "", b[1] or ""
        want[a[0], hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got.collect()) == want
    assert imatch.fingerprints(none).collect() == []


def plain_imatch(spark, texts, most_share=0.02):
    """(fingerprint, edited fingerprint, near_edited, near_next) of each text, the next one being its successor, in plain Python but for the hash functions."""
    import re

    cut = lambda t: list(dict.fromkeys(w for w in re.split(r"[\W_]+", t.lower()) if w))
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, [*texts[1:], texts[0]], strict=True)]
    words = sorted({w for t in [*texts, *edited] for w in cut(t)})
    hashed = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.shiftrightunsigned(F.xxhash64("w"), 2).alias("h")).collect()}
    df = Counter(hashed[w] for t in texts for w in cut(t))

    def keep(t):
        own = [hashed[w] for w in cut(t)]
        low = [h for h in own if df[h] <= most_share * len(texts)] or own
        level = next((k for k in range(4) if len(low) <= 64 * 4**k), 4)
        low = [h for h in low if h < 64 << 56 - 2 * level]
        return level, sorted([h for h in low if df[h] > 1] or low)

    kept = [keep(t) for t in [*texts, *edited]]
    rows = [[h for h in s if h >> 56 - 2 * (level + half) == v] for level, s in kept for half in (0, 1) for v in range(64)]
    made = spark.createDataFrame(list(enumerate(rows)), "i int, r array<bigint>").select("i", (F.pmod(F.hash("r"), F.lit(65535)) + 1).alias("h")).collect()
    value = {r["i"]: r["h"] for r in made}
    hashes = [value[i] if r else 0 for i, r in enumerate(rows)]
    prints = [(level, hashes[128 * i : 128 * i + 64], hashes[128 * i + 64 : 128 * i + 128]) for i, (level, _) in enumerate(kept)]

    def like(a, b):
        if a == b:
            return 1.0
        top = max(a[0], b[0])
        x, y = (p[1] if p[0] == top else p[2] if p[0] == top - 1 else None for p in (a, b))
        some = [(p, q) for p, q in zip(x or [], y or [], strict=False) if p or q]
        return sum(p == q for p, q in some) / len(some) if some else 0.0

    show = lambda p: str(p[0]) + "".join(f"{v:04x}" for v in p[1] + p[2])
    k = len(texts)
    return [(show(prints[i]), show(prints[k + i]), like(prints[i], prints[k + i]), like(prints[i], prints[(i + 1) % k])) for i in range(k)]


def test_op8_equals_plain_python(spark):
    """Bands, subsets, fingerprints and likenesses; texts of 0 to 3000 words, copies, words at the seams that other documents have."""
    rng = random.Random(15)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(3000)], k=rng.choice([1, 5, 40, 200, 3000]))) for _ in range(60)] + ["", "  ", "the the", "only"]
    texts += [texts[3], texts[3], texts[5]]
    rng.shuffle(texts)
    df = spark.createDataFrame([(len(texts) - i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, digest int").repartition(4)
    for share in (0.1, 0.5):
        got = sorted(imatch.fingerprints(df, most_share=share).collect(), key=lambda r: -r["doc_id"])
        want = plain_imatch(spark, texts, share)
        for r, w in zip(got, want, strict=True):
            assert (r["fingerprint"], r["edited_fingerprint"]) == w[:2]
            assert (r["near_edited"], r["near_next"]) == pytest.approx(w[2:])


def test_op8_likeness_tells_edits_from_others(spark):
    """Half a text is nearer to it than the next text, of whatever length."""
    rng = random.Random(16)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    table = [(i, " ".join(rng.choices(words, k=rng.choice([30, 100, 400, 1500])))) for i in range(600)]
    got = imatch.fingerprints(spark.createDataFrame(table, "doc_id long, text string"), most_share=0.5).collect()
    assert sum(r["near_edited"] > r["near_next"] for r in got) >= 0.99 * len(got)


def test_op10(spark, docs, none):
    by = {r["doc_id"]: r for r in licenses.scan(docs.where("doc_id >= 40")).collect()}
    assert (by[53]["text_license"], by[53]["line_licenses"]) == ("MIT", "MIT")
    assert (by[52]["text_license"], by[52]["line_licenses"], by[52]["n_license_lines"]) == (None, "MIT", 1)
    assert by[51]["text_license"] is None and by[40]["text_license"] is None and by[40]["n_license_lines"] == 0
    text = "Copyright (c) 2020 A. Uthor\n\n" + licenses.KNOWN["MIT"][0].upper().replace(",", " ,")
    assert licenses.scan(spark.createDataFrame([(1, text), (2, text + " more")], "doc_id long, text string")).orderBy("doc_id").first()["text_license"] == "MIT"
    assert licenses.scan(none).collect() == []


def test_op10_knows_whole_texts(spark):
    """Whole licence texts, with and without heading, as stored, in capitals, with other line ends, with a holder's notice, and wrapped anew; part of one is none, nor is an altered one."""
    import duckdb

    from quarrymill.llm import queries

    head = {"MIT": "MIT License", "ISC": "ISC License"}
    folder = licenses.Path(licenses.__file__).with_name("license_texts")
    texts = {p.stem: p.read_text() for p in folder.glob("*.txt")} | {n: f"{h}\n\nCopyright (c) 2020 A. Uthor\n\n{licenses.KNOWN[n][0]}" for n, h in head.items()}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "Unlicense", "MIT", "ISC"} == set(texts)
    table = [(n, t) for n, t in texts.items()]
    table += [(n, texts[n].split("\n\n", 1)[1].lstrip()) for n in texts if n != "Unlicense"]
    table += [(n, texts[n].split("END OF TERMS")[0]) for n in ("Apache-2.0", "GPL-2.0", "GPL-3.0")]
    bare = texts["BSD-3-Clause"].split("\n\n", 1)[1].replace(" the ", "\nthe ")
    table += [("BSD-3-Clause", "Copyright (c) 2020, A. Uthor\nAll rights reserved.\n\n" + bare), ("Unlicense", "The Unlicense\n\n" + texts["Unlicense"])]
    for n, t in texts.items():
        blocks = [" ".join(x.split()) for x in re.split(r"\n\s*\n", t) if x.strip()]
        for width in (60, 66, 76, 100, 10**9):
            table.append((n, "\n\n".join(textwrap.fill(x, width) for x in blocks)))
        table += [(n, t.upper()), (n, t.replace("\n", "\r\n")), (n, "Copyright (c) 2019-2021 Some Holder <s@example.org>\nCopyright 2022 Another\n\n" + t), (None if n == "Unlicense" else n, "(C) 2020 Some Holder\n" + t)]  # its first paragraph is short: one notice with the line above
        table.append((n, "\n".join("# " + x for x in t.split("\n"))))
    table += [(None, t[: len(t) // 2]) for t in texts.values()]
    lettered = re.sub(r"\(c\) You must retain.*?; and", "(c) You must pay the author one million euros and give up; and", texts["Apache-2.0"], flags=re.DOTALL)
    assert lettered != texts["Apache-2.0"]
    table += [(None, lettered), (None, texts["MIT"] + "\n\n(c) You must pay."), (None, texts["MIT"].replace("Permission is", "Copyright is yours. Permission is")), (None, "Copyright (c) 2020 X\n\n" + "word " * 70)]
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(table)], "doc_id long, text string")
    got = {r["doc_id"]: r["text_license"] for r in licenses.scan(rows).collect()}
    assert [(i, n, got[i]) for i, (n, _) in enumerate(table) if got[i] != n] == []
    documents = pa.table({"doc_id": list(range(len(table))), "text": [t for _, t in table]})  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    assert {r[0]: r[1] for r in con.execute(queries.OP10_SQL).fetchall()} == got


def test_op10_of_odd_texts(spark):
    """Many blank lines, marks and notices on end; a list of known texts without an anchor."""
    odd = ["\n" * 200_000 + "x", "copyright (c) 2020 " * 20_000, "(c) " * 50_000, "\x1e\x1f", " \n \n" * 30_000 + licenses.KNOWN["MIT"][0], "Copyright (c) 2020 A\n" * 3000 + "\n" + licenses.KNOWN["MIT"][0]]
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {r["doc_id"]: r["text_license"] for r in licenses.scan(rows).collect()}
    assert got == {0: None, 1: None, 2: None, 3: None, 4: "MIT", 5: None}
    own = {"Mine": ("Use it as you like.",)}
    got = licenses.scan(spark.createDataFrame([(1, "use it,\nas you like"), (2, "x\nUse it as you like!")], "doc_id long, text string"), known=own, whole={}).orderBy("doc_id").collect()
    assert [(r["text_license"], r["line_licenses"]) for r in got] == [("Mine", ""), (None, "Mine")]


def test_op3(spark):
    said = "</s>[INST] ok [/INST]"
    table = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, "user", "hi"), (1, 1, "assistant", "a\\<\\/s>"), (2, 1, "assistant", "b"), (2, 0, "user", "hi"), (3, 0, "user", None), (3, 0, "user", None), (4, 0, None, "x<"), (None, 0, "assistant", "né[")]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumn("name", F.lit(1))
    shards = chat.tree(df, BPE, P.PATTERN)
    got = {r["conv_id"]: r for r in chat.read(shards, BPE, P.PATTERN).collect()}
    by = {}
    for c, t, r, x in table:
        by.setdefault(c, []).append((t, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == sum(len(f"<s>[INST]{chat.escape(r)}[/INST]{chat.escape(x)}</s>") for _, r, x in turns)
    ns = chat.nodes(shards, BPE, P.PATTERN).orderBy("start").collect()
    assert len(ns) == 9  # "hi" is shared
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(ns, ns[1:]))
    assert chat.read(chat.tree(df.where("false"), BPE, P.PATTERN), BPE, P.PATTERN).collect() == []
    for x in ("<s>", "\\", "<\\s>", "[/INST]\\\\", said):
        assert chat.unescape(chat.escape(x)) == x and not any(c in chat.escape(x) for c in chat.CONTROLS)


def test_op3_is_the_tree_of_the_turns(spark, monkeypatch):
    """Nodes, positions and attended stretches against a tree of dicts; one very long conversation, one very long text, conversations that many ids have, shards of a few turns."""
    rng = random.Random(14)
    said = ["a", "b", "long " * 3000]
    convs = [[rng.choice(said[:2] + said[:2] + said) for _ in range(rng.randint(1, 6))] for _ in range(150)] + [["a", "b", "a"]] * 40 + [["b"] * 300, ["b"] * 300 + ["a"], ["x" * 100_000]]
    table = [(c, i, ("user", "assistant")[i % 2], t) for c, ts in enumerate(convs) for i, t in enumerate(ts)]
    rng.shuffle(table)
    monkeypatch.setattr(chat, "SHARD", 2000)
    shards = chat.tree(spark.createDataFrame(table, "conv_id long, turn int, role string, text string").repartition(5), BPE, P.PATTERN)
    assert shards.count() > 10
    ns, words = chat.nodes(shards, BPE, P.PATTERN).orderBy("start").collect(), chat.vocabulary(BPE, P.PATTERN)
    stack, seen, end = [], set(), 0
    for n in ns:
        assert n["start"] == end and n["n_tokens"] == len(n["ids"]) == len(n["loss"])
        end += n["n_tokens"]
        del stack[n["depth"] :]
        assert len(stack) == n["depth"] and n["position"] == sum(m["n_tokens"] for m in stack)
        cover = [i for x in n["attends"] for i in range(x["begin"], x["end"])]
        assert cover == [i for m in stack for i in range(m["start"], m["start"] + m["n_tokens"])]
        assert all(a["end"] < b["begin"] for a, b in zip(n["attends"], n["attends"][1:]))
        stack.append(n)
        seen.add(tuple(words.text(m["ids"]) for m in stack))
    want = {tuple(f"<s>[INST]{('user', 'assistant')[j % 2]}[/INST]{t}</s>" for j, t in enumerate(ts[: i + 1])) for ts in convs for i in range(len(ts))}
    assert len(seen) == len(ns) and seen == want
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.read(shards, BPE, P.PATTERN).collect()}
    assert got == {c: (len(ts), sum(map(len, ts[1::2]))) for c, ts in enumerate(convs)}


def jaccard_groups(texts, width=5, least=0.8):
    """Group number of each text, by all pairs."""
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in words]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= least * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_keep_one(spark, docs, rows, none):
    """One row of each group of the brute force stays: the smallest key, a null key only if there is no other."""

    def least(table):
        groups = {}
        for g, r in zip(jaccard_groups([r[1] for r in table]), table, strict=True):
            groups.setdefault(g, []).append(r[0])
        return Counter(min((x for x in ids if x is not None), default=None) for ids in groups.values())

    assert Counter(r["doc_id"] for r in simhash.keep_one(scratch.save(docs, "docs")).collect()) == least(rows)
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(800)]
    table = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([30, 80, 400]))), None, None, None) for i in range(80)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    table += [(100 + i, f"{passage} {' '.join(rng.choices(vocabulary, k=60))}", None, None, None) for i in range(30)]
    for i in range(240):
        words = table[rng.randrange(80)][1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = "edit"
        table.append((1000 + i, " ".join(words).upper() if i % 5 == 0 else " ".join(words), None, None, None))
    rng.shuffle(table)
    df = scratch.save(spark.createDataFrame([r[:2] for r in table], "doc_id long, text string"), "docs")
    got, want = Counter(r["doc_id"] for r in simhash.keep_one(df).collect()), least(table)
    assert not want - got  # no group is lost
    assert sum((got - want).values()) <= 0.04 * (len(table) - sum(want.values()))  # copies that the search misses
    assert simhash.keep_one(scratch.save(none, "docs")).collect() == []


def test_keep_one_of_many_edited_copies(spark, monkeypatch):
    """Copies of one text that are like it, but not like one another, are one group; the text itself isn't the first row. Whole classes and classes in blocks."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(4000)]
    table = []
    for _ in range(2):
        words = rng.choices(vocabulary, k=250)
        copies = [list(words) for _ in range(150)]
        for copy in copies:
            for place in rng.sample(range(250), 4):
                copy[place] = rng.choice(vocabulary)
        table += [" ".join(x) for x in [*copies, words]]
    want = sorted(set(jaccard_groups(table)))
    assert len(want) < 10
    df = scratch.save(spark.createDataFrame(list(enumerate(table)), "doc_id long, text string"), "docs")
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == want
    monkeypatch.setattr(simhash, "BLOCK", 16)
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == want


def test_keep_one_whatever_the_edit(spark):
    """Copies with one stretch cut, appended or replaced are found as those with scattered edits are."""
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(4000)]
    edits = {
        "scattered": lambda w, n: [rng.choice(vocabulary) if i % 60 == n % 60 else x for i, x in enumerate(w)],
        "end cut": lambda w, n: w[: len(w) - len(w) // 7],
        "start cut": lambda w, n: w[len(w) // 8 :],
        "middle cut": lambda w, n: w[:90] + w[90 + len(w) // 8 :],
        "replaced": lambda w, n: w[:70] + rng.choices(vocabulary, k=len(w) // 13) + w[70 + len(w) // 13 :],
        "appended": lambda w, n: w + rng.choices(vocabulary, k=len(w) // 6),
    }
    table = []
    for edit in edits.values():
        for n in range(40):
            words = rng.choices(vocabulary, k=rng.choice([150, 250, 400]))
            table += [" ".join(words), " ".join(edit(words, n))]
    groups = jaccard_groups(table)
    df = scratch.save(spark.createDataFrame(list(enumerate(table)), "doc_id long, text string"), "docs")
    kept = {r["doc_id"] for r in simhash.keep_one(df).collect()}
    assert set(groups) <= kept
    for k, name in enumerate(edits):
        copies = [i for i in range(80 * k + 1, 80 * k + 80, 2) if groups[i] != i]
        assert len(copies) >= 30, name
        assert sum(i not in kept for i in copies) >= 0.99 * len(copies), name


def test_classes_are_compared_in_full():
    """Chains and pairs that the first comparisons leave out, in one block and between two."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 60, 100).astype(np.uint64)) for _ in range(4)]
    chain = [np.concatenate([sets[0][5 * i :], sets[1][: 5 * i]]) for i in range(12)]
    rows = [*chain, sets[2], sets[3]]
    block = [i % 2 for i in range(len(rows))]

    def linked(one, two):
        use = [i for i in range(len(rows)) if block[i] in (one, two)]
        table = {"root": use, "block": [block[i] for i in use], "one": [one] * len(use), "two": [two] * len(use), "print": [simhash._print(rows[i]) for i in use], "size": [rows[i].size for i in use], "set": [rows[i].tobytes() for i in use]}
        links = simhash._join_within(pa.table(table), 0.8)
        assert {r for x in links.to_pylist() for r in x.values()} <= {r["root"] for r in simhash._candidates(pa.table(table), 0.8).to_pylist()}
        return {tuple(sorted(x.values())) for x in links.to_pylist()}

    found = linked(0, 0) | linked(0, 1) | linked(1, 1)
    root = list(range(len(rows)))
    for _ in root:
        for u, v in found:
            root[u] = root[v] = min(root[u], root[v])
    assert root == [0] * 12 + [12, 13]


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Toxic rows, exact and edited copies, several sources: the four stages by plain loops give run()'s rows."""
    import corpus_pipeline

    rng = random.Random(20)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(600)]
    table = []
    for i in range(500):
        table.append((i, " ".join(rng.choices(words, k=rng.choice([30, 60, 200])) + (["zorgen"] * 2 if i % 5 == 0 else [])), "en", f"s{i % 4}" if i % 9 else None, i))
    for i in range(500, 620):
        own = table[rng.randrange(500)][1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            own[rng.randrange(len(own))] = "edit"
        table.append((i, " ".join(own), "en", f"s{i % 4}", i))
    table += [(700, None, "en", "s1", 0), (701, "", None, None, None), (702, " ", "en", "s2", 0), (703, table[3][1] + " " + "tail " * 20_000, "en", "s0", 0)]
    rng.shuffle(table)
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    marked = [(i, 1, int("zorg" in (t or ""))) for i, t, *_ in table if i < 500]
    spark.createDataFrame(marked, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    # toxicity: the plain-loop-tested fit over the labelled rows that aren't held out, in order of their hash
    spot = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16)
    text = {i: t for i, t, *_ in table}
    learned = sorted((spot(i), y, toxicity.features(text[i])) for i, _, y in marked if zlib.crc32(str(i).encode()) % 5)
    model = toxicity.fit([(f, y) for _, y, f in learned])
    clean = [r for r in table if model.score(r[1]) < 0.5]
    assert 60 < len(table) - len(clean) < 160
    # near copies
    groups = {}
    for g, r in zip(jaccard_groups([r[1] for r in clean]), clean, strict=True):
        groups.setdefault(g, []).append(r)
    kept = [min(rs, key=lambda r: r[0]) for rs in groups.values()]
    assert len(kept) < len(clean) - 60
    # mix: documents by hash while the running size fits
    size = lambda r: len((r[1] or "").encode().split())
    names = sorted({r[3] for r in kept}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(r) for r in kept if r[3] == s) for s in names]
    goal = mixing.targets(sizes, [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5, 2.0)
    mixed = Counter()
    for s, total, target in zip(names, sizes, goal, strict=True):
        whole, run, stop = int(target // total), 0, False
        for r in sorted((r for r in kept if r[3] == s), key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()[:12]):
            run += size(r)
            stop = stop or run > target - whole * total
            if whole + (not stop):
                mixed[r[0]] = whole + (not stop)
    # tokens
    encode = tik()
    want = Counter()
    for i, n in mixed.items():
        ids = encode(text[i] or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text[i] or "").encode()).hexdigest()] = n
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want


def test_pipeline_of_no_documents(spark, tmp_path, none):
    import corpus_pipeline

    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_keep_one_whatever_the_splits(spark, tmp_path):
    """Rows keep their identity when files are split otherwise between reads, and under names used inside."""
    rows = [(i, f"text number {i % 300} " + "some words that all texts have in common " * 3 + f"{i % 300} end") for i in range(900)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("_ROW", F.col("doc_id") * 2).withColumn("file", F.lit("f")).repartition(6).write.parquet(str(tmp_path / "t"))
    docs, old = spark.read.parquet(str(tmp_path / "t")), spark.conf.get("spark.sql.files.maxPartitionBytes")
    out = simhash.keep_one(docs)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r["doc_id"] for r in got) == list(range(300)) and all(r["_ROW"] == 2 * r["doc_id"] and r["file"] == "f" for r in got)


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = [r["doc_id"] for r in simhash.keep_one(read).collect()]
    assert simhash.keep_one(read).columns == read.columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} <= set(ids)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "mix", "bpe"]
