import itertools
import random
import time

import pytest

from quarrymill.operators import programs

LINES = ["x = 1", "print(y)", "import os", "for i in z:\n  f(i)", "a.b(c)", "def g(u):\n  return u"]


def source(rng, longest):
    return "\n".join(rng.choice(LINES) for _ in range(rng.randint(0, longest)))


def by_hand(rows):
    """The report by all pairs of (key, nodes)."""
    pairs = [(min(a, b), max(a, b), programs.structural_score(x, y)) for (a, x), (b, y) in itertools.combinations(rows, 2) if a != b]
    lists = {"plagiarized": {}, "to_verify": {}}
    for a, b, score in sorted(pairs):
        if score >= 30:
            lists["plagiarized" if score >= 97 else "to_verify"] |= dict.fromkeys(x for x in (a, b) if x not in lists["plagiarized" if score >= 97 else "to_verify"])
    score, a, b = max((s, a, b) for a, b, s in pairs)
    return ("results", None, len(pairs), list(lists["plagiarized"]), list(lists["to_verify"]), score, a, b)


@pytest.mark.parametrize("seed", range(4))
def test_report_and_pairs_against_a_loop(spark, monkeypatch, seed):
    monkeypatch.setattr(programs, "PACK", 3)
    monkeypatch.setattr(programs, "BLOCK", 10)
    monkeypatch.setattr(programs, "BATCH", 50)
    monkeypatch.setattr(programs, "LONGEST", 100)
    rng = random.Random(seed)
    sources = [source(rng, (3, 60)[seed % 2 and rng.random() < 0.5]) for _ in range(45)]
    keys = sorted(rng.choices(range(40), k=45))  # some programs have one key
    rows = list(zip(keys, map(programs.tokens, sources), strict=True))
    df = spark.createDataFrame(list(zip(keys, sources, strict=True)), "ord long, source string").repartition(3)
    assert tuple(programs.report(df).first()) == by_hand(rows)
    want = sorted((min(a, b), max(a, b), programs.structural_score(x, y)) for (a, x), (b, y) in itertools.combinations(rows, 2) if a != b)
    assert sorted(tuple(r) for r in programs.similarities(df, reindex=False).collect()) == want


def test_report_without_likeness(spark):
    rows = [(1, "import a"), (2, "for x in y: pass"), (3, "def f(:")]
    df = spark.createDataFrame(rows, "ord long, source string")
    assert tuple(programs.report(df.where("ord < 3")).first()) == by_hand([(k, programs.tokens(s)) for k, s in rows[:2]])
    assert tuple(programs.report(df).first()) == ("parse_error", 3, None, None, None, None, None, None)


def test_work_grows_with_structures(spark):
    """20,000 programs of 40 structures: 2 * 10^8 pairs, 780 comparisons."""
    rng = random.Random(3)
    kinds = [source(rng, 12) for _ in range(40)]
    df = spark.createDataFrame([(k, rng.choice(kinds)) for k in range(20_000)], "ord long, source string").repartition(8)
    began = time.monotonic()
    assert programs.report(df).first()["n_pairs"] == 20_000 * 19_999 // 2
    assert programs.similarities(df).selectExpr("count(*)").first()[0] == 20_000 * 19_999 // 2 and time.monotonic() - began < 150
