import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from quarrymill.llm import packing, word_pieces

WORDS = P.path("word_bpe_49k.json")


def test_windows_are_full():
    rng = random.Random(1)
    for _ in range(300):
        lengths = [rng.choice((0, 1, rng.randint(1, 64), rng.randint(1, 4095), 4096, 64, 2048)) for _ in range(rng.randint(0, 40))]
        windows, left = packing.fill(lengths, 64)
        assert sum(n for *_, n in left) < 4096
        ends = packing.tail(left)
        seen = {}
        for size, parts in windows + ends:
            assert sum(n for *_, n in parts) == size == 1 << (size.bit_length() - 1)
            for i, a, n in parts:
                seen.setdefault(i, []).append((a, n))
        assert all(size >= 64 for size, _ in windows) and len({size for size, _ in ends}) == len(ends)
        for i, n in enumerate(lengths):
            at = 0
            for a, m in sorted(seen.get(i, [])):
                assert a == at and m > 0
                at += m
            assert at == n


def test_gaps_are_filled_from_shorter_tiers_and_cuts_are_rare():
    rng = random.Random(2)
    lengths = [int(rng.lognormvariate(5.5, 1.0)) % 4095 + 1 for _ in range(4000)]
    windows, left = packing.fill(lengths, 64)
    for size, parts in windows:
        assert packing.tier_of(parts[0][2], 64) == size  # the opener is of this tier, the gap less than half
        assert all(n <= size - parts[0][2] for *_, n in parts[1:])
    pieces = Counter(i for _, parts in windows for i, *_ in parts)
    assert sum(n - 1 for n in pieces.values()) < len(windows) and sum(n == 1 for n in pieces.values()) > 0.9 * len(lengths)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 300))) for _ in range(80)]
    texts += [None, "", " \n\t ", "x", "a" * 50_000, "word " * 9000, "word " * 4095, texts[0], texts[0]]
    return [*enumerate(texts), (3, texts[3]), (None, "no key here"), (None, "no key here")]


SCHEMA = "doc_id long, text string, size int, `at` int, ids int, PART int, rank int, step int, pieces string"


def test_op13(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, "x") for r in rows], SCHEMA).repartition(3)
    sequences = packing.pack(docs, word_pieces.maker(WORDS), 2)
    got = packing.read(sequences, step_ids=8192).collect()
    library = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    # the ids of every sequence, from the table; documents put together from their pieces
    ids = {(r["part"], r["size"], r["at"]): bytes(r["ids"]) for r in sequences.collect()}
    assert all(len(raw) == 4 * size for (_, size, _), raw in ids.items())
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by_sequence) == list(range(len(ids)))
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == pieces[0]["window"] and at <= 4096 and at & (at - 1) == 0
    found = Counter()
    for r in sequences.collect():
        at = 0
        for p in r["pieces"]:
            found[p["key"], p["start"], p["length"], zlib.crc32(bytes(r["ids"])[4 * at : 4 * (at + p["length"])]), p["doc_tokens"]] += 1
            at += p["length"]
    assert found == Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got)
    pieces = {}
    for r in sequences.collect():
        at = 0
        for p in r["pieces"]:
            pieces.setdefault((p["key"], p["doc_tokens"]), []).append((p["start"], bytes(r["ids"])[4 * at : 4 * (at + p["length"])]))
            at += p["length"]
    for (i, n), own in pieces.items():
        copies = sum(c for (k, m, _), c in want.items() if (k, m) == (i, n))
        assert sum(len(raw) for _, raw in own) == 4 * n * copies
        if copies == 1:
            assert (i, n, zlib.crc32(b"".join(raw for _, raw in sorted(own)))) in want
    # steps: one window size and the same number of ids each, but for the last of a size
    steps = {}
    for number, of in by_sequence.items():
        steps.setdefault(of[0]["step"], []).append((of[0]["window"], number))
    assert sorted(steps) == list(range(len(steps)))
    partial = Counter()
    for of in steps.values():
        assert len({w for w, _ in of}) == 1
        partial[of[0][0]] += sum(w for w, _ in of) < 8192
    assert max(partial.values()) <= 1


def test_op13_of_nothing(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, "x") for r in rows], SCHEMA)
    assert packing.read(packing.pack(docs.where("false"), word_pieces.maker(WORDS), 2)).collect() == []
    assert packing.read(packing.pack(docs.where("text = ''"), word_pieces.maker(WORDS), None)).collect() == []


def test_steps_of_the_sizes_are_spread(spark):
    rows = [(p, size, at, b"", []) for p in range(3) for size, n in ((4096, 20), (1024, 60), (64, 1)) for at in range(n)]
    sequences = spark.createDataFrame(rows, "part int, size int, at long, ids binary, pieces array<struct<key:bigint>>")
    got = packing.numbered(sequences, 4096 * 2).collect()
    assert sorted(r["sequence_id"] for r in got) == list(range(243))
    order = [size for _, size in sorted({(r["step"], r["size"]) for r in got})]
    assert len(order) == len({r["step"] for r in got}) == 30 + 23 + 1
    assert all(4 <= order[i : i + 10].count(4096) <= 7 for i in range(0, 44))
