import random
import time

import pytest

from quarrymill.operators import program_join, programs


def program(rng, names, size):
    forms = ("%s = 1", "%s(1)", "import %s", "a.%s", "for i in %s:\n    print(i)", "if %s > 1:\n    b.c(d)", "def %s(x):\n    return x")
    return "\n".join(rng.choice(forms) % rng.choice(names) for _ in range(size))


def corpus(rng, n):
    names = [f"n{i}" for i in range(60)]
    out = [program(rng, names, rng.choice((0, 1, 3, 8, 20))) for _ in range(n)]
    for i in range(0, n, 5):  # copies, renamed ones, edited ones
        source = rng.choice([x for x in out if x])
        out[i] = rng.choice((source, source.replace(" = 1", " = 2"), source + "\nimport zz", "def f(:", None))
    return out


@pytest.mark.parametrize("least", [30, 97])
def test_join_equals_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(program_join, "BLOCK", 20)  # many blocks of common elements
    sources = corpus(random.Random(least), 500)
    rows = spark.createDataFrame(list(enumerate(sources)), "ord long, source string").repartition(4)
    members, heads = program_join.classes(rows)
    got = {(r["a"], r["b"]): r["score"] for r in program_join.similar(heads, least).collect()}
    nodes = {r["class"]: r["nodes"] for r in heads.collect()}
    own = {i: programs.tokens(s) for i, s in enumerate(sources) if s is not None}
    own = {i: t for i, t in own.items() if t is not None}
    assert {r["id"] for r in members.collect()} == set(own) and all(nodes[r["class"]] == own[r["id"]] for r in members.collect())
    ids = sorted(nodes)
    want = {(a, b): s for k, a in enumerate(ids) for b in ids[k + 1 :] if (s := programs.structural_score(nodes[a], nodes[b])) >= least}
    assert got == want and len(want) > 2


def test_flags(spark):
    sources = ["x = 1", "y = 2", "import a", "import a\nx = 1", "def f(:", None, "", ""]
    got = {r["ord"]: tuple(r)[1:] for r in program_join.flags(spark.createDataFrame(list(enumerate(sources)), "ord int, source string")).collect()}
    assert got == {0: (0, 2, 1, 1, 100, 0), 1: (0, 2, 1, 1, 100, 0), 2: (2, 1, 0, 1, 40, 3), 3: (3, 1, 0, 3, 60, 0), 6: (6, 2, 1, 0, 100, 6), 7: (6, 2, 1, 0, 100, 6)}
    assert program_join.flags(spark.createDataFrame([], "ord int, source string")).collect() == []
    with pytest.raises(ValueError):
        program_join.similar(None, 0)


def test_join_grows_with_results(spark):
    """2,100 programs of their own names, each with two that are nearly alike: the pairs that are looked at stay in proportion."""
    rng = random.Random(7)
    rows = []
    for i in range(700):
        base = "\n".join(f"import m{rng.randrange(10**6)}\nx.a{rng.randrange(10**6)}" for _ in range(8))
        rows += [(3 * i, base), (3 * i + 1, base + "\nprint(1)"), (3 * i + 2, base + "\ny.z")]
    began = time.monotonic()
    _, heads = program_join.classes(spark.createDataFrame(rows, "ord long, source string").repartition(8))
    assert program_join.similar(heads, 80).count() == 2100 and time.monotonic() - began < 120
