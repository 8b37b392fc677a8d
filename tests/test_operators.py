import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import scalars
from quarrymill.operators import evaluation, programs, reads, runner, state
from quarrymill.streaming import ttl_cache


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_scalars(spark):
    lit = F.lit
    assert [one(spark, scalars.weighted_score(lit(x), lit(x), lit(x))) for x in (1.0, 0.5, -0.5, 2.0)] == pytest.approx([1, 0.5, 0, 1])
    assert [one(spark, scalars.to_weight(lit(a), lit(b))) for a, b in ((0.5, 1.0), (0.5, 0.0), (0.5, -1.0), (2.0, 1.0))] == [0.5, 0, 0, 1]
    assert [one(spark, scalars.decay(lit(s), lit(b), lit(h))) for s, b, h in ((1.0, 0, 100), (1.0, 100, 100), (1.0, 200, 100), (0.5, 100, 0))] == [1, 0.5, 0.25, 0.5]
    assert one(spark, scalars.criteria_mean(lit(0.5), lit(0.6), lit(0.7), lit(0.8))) == pytest.approx(0.65)
    assert [one(spark, scalars.score_error(lit(x))) for x in (0.0, 1.0, 1.5, -0.1, float("nan"))] == [None, None, "above_max", "below_min", "not_a_number"]
    assert [one(spark, scalars.status(lit(x))) for x in (99, 97, 96, 30, 29, 0)] == ["plagiarized"] * 2 + ["needs_verification"] * 2 + ["clean"] * 2
    assert one(spark, scalars.outer_json(lit('say {"a": {"b": 1}} end'))) == '{"a": {"b": 1}}'
    assert one(spark, scalars.outer_json(lit("none"))) is None
    assert [one(spark, scalars.truncate(lit("héllo"), n)) for n in (2, 3, 6)] == ["h...", "hé...", "héllo"]
    want = "".join(f"{(b + i) % 256:02x}" for i, b in enumerate(b"key:7"))
    assert one(spark, scalars.fallback_hash(lit("key"), lit(7))) == want
    assert one(spark, scalars.words(lit(" a　b\n c"))) == ["a", "b", "c"]


def test_sum_normalise(spark):
    def of(*v):
        return [r[0] for r in evaluation.sum_normalise(spark.createDataFrame([(x,) for x in v], "v double"), "v").select("weight").collect()]

    assert sum(of(1.0, 2.0, 3.0)) == pytest.approx(1)
    assert of(0.0, 0.0, 0.0) == pytest.approx([1 / 3] * 3)
    assert of() == []


def test_state(spark):
    log = spark.createDataFrame([("a", 1, 5), ("b", 2, 6), ("a", 3, None), ("a", 4, 7), ("c", 5, None)], "k string, seq int, value int")
    assert {tuple(r) for r in state.latest(log, ["k"]).collect()} == {("a", 7, 4), ("b", 6, 2)}
    scores = spark.createDataFrame([("h1", 0.5, 1), ("h2", 0.9, 2), ("h3", 0.5, 0), ("h4", 1.0, 9), ("h5", 0.1, 3)], "hash string, score double, ord int")
    names = spark.createDataFrame([("h1", "x"), ("h2", "y"), ("h3", "z"), ("h4", ""), ("h5", "w")], "hash string, hotkey string")
    epochs = spark.createDataFrame([("x", 3)], "hotkey string, epoch int")
    board = state.leaderboard(scores, names, epochs)
    assert [(r["rank"], r["hotkey"], r["epoch"]) for r in board.orderBy("rank").collect()] == [(1, "y", 0), (2, "z", 0), (3, "x", 3), (4, "w", 0)]
    banned = spark.createDataFrame([("z",)], "hotkey string")
    assert [r["rank"] for r in state.unbanned(board, banned).orderBy("rank").collect()] == [1, 3, 4]
    assert sum(r["weight"] for r in state.weights(board, banned).collect()) == pytest.approx(1)
    assert [r["hotkey"] for r in state.top(board, 1, 1).collect()] == ["z"]
    codes = spark.createDataFrame([("x", 2, "c2"), ("x", 0, "c0")], "hotkey string, epoch int, code string")
    asked = spark.createDataFrame([("x", 3), ("x", 0), ("x", 5)], "hotkey string, epoch int")
    assert {(r["epoch"], r["code"]) for r in state.code_at(asked, codes).collect()} == {(3, "c2"), (0, "c0"), (5, None)}
    rows = spark.createDataFrame([("", None, bytearray(b"")), ("k", "h", bytearray(b"xx"))], "hotkey string, code_hash string, package binary")
    got = state.submission_problems(rows, most_bytes=1).collect()
    assert [(len(r["errors"]), len(r["warnings"])) for r in got] == [(2, 1), (1, 0)]
    assert one(spark, state.config_problem(F.lit(5), F.lit(1), F.lit(1))) == "conversation_count"
    assert one(spark, state.config_problem(F.lit(50), F.lit(7200), F.lit(104_857_600))) is None
    assert one(spark, state.limits_problem(F.lit(0), F.lit(0), F.lit(0), F.lit(0))) == "processes"


def test_ranks_with_shared_scores(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0.0, 0.0, 0.0, 1.0, None, float("nan"), rng.random()]), i, f"k{i:03}", "own") for i in rng.sample(range(900), 500)]
    df = spark.createDataFrame(rows, "score double, ord int, name string, _part string")
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (0 if r[0] != r[0] else 1, -r[0] if r[0] == r[0] else 0, r[1]))
    want = [(i, r[1], "own") for i, r in enumerate(order, 1)]
    for by in ("ord", "name"):  # strings order like the numbers here
        assert [(r["rank"], r["ord"], r["_part"]) for r in state.ranked(df, order=by).orderBy("rank").collect()] == want
    assert state.ranked(df.where("false")).collect() == []


def test_ttl(spark):
    rows = [("k", 0, 1, True), ("k", 5, 2, False), ("k", 10, 3, False), ("k", 11, 4, False), ("k", 12, 5, True), ("k", 21, 6, False), ("j", 1, 7, False)]
    df = spark.createDataFrame(rows, "k string, at long, id int, ins boolean")
    got = {r["id"]: r["hit"] for r in ttl_cache.hits(df, "k", "at", "id", F.col("ins"), 10).collect()}
    assert got == {2: True, 3: False, 4: False, 6: True, 7: False}


def test_ttl_against_a_loop(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "k", None]), rng.randint(0, 300), i, rng.random() < 0.2, "own") for i in range(400)]
    last, want = {}, {}
    for k, at, i, inserted, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        if inserted:
            last[k] = at
        else:
            want[i] = k in last and at - last[k] < 4
    df = spark.createDataFrame(rows, "k string, at long, id int, ins boolean, _part string")
    got = ttl_cache.hits(df, "k", "at", "id", F.col("ins"), 4).collect()
    assert {r["id"]: r["hit"] for r in got} == want and len(got) == len(want) and {r["_part"] for r in got} == {"own"}
    assert ttl_cache.hits(df.where("false"), "k", "at", "id", F.col("ins"), 4).collect() == []


def test_program_tokens():
    assert programs.tokens("x = 1\ny = x + 2") == ["Assign", "Name(var_0)", "Constant", "Assign", "Name(var_1)", "BinOp", "Name(var_0)", "Constant"]
    assert programs.tokens("x = 1\ny = x + 2") == programs.tokens("a = 1\nb = a + 2")
    assert programs.tokens("def f(a, b=1):\n  'doc'\n  return a") == ["FunctionDef", "var_0", "var_1", "var_2", "Return", "Name(var_1)"]
    assert programs.tokens("import os\nfrom a import b\nraise X\nawait_ = {**a, 1: 2}") == ["Import", "import:os", "ImportFrom", "from:a", "Stmt", "Assign", "Name(var_0)", "Dict", "Name(var_1)", "Constant", "Constant"]
    assert programs.tokens("def broken(:") is None
    assert programs.structural_score(programs.tokens("x = 1"), programs.tokens("def foo(): return 42")) == 25


def test_structure_hash(spark):
    got = one(spark, programs.structure_hash(F.array(*(F.lit(t) for t in programs.tokens("x = 1\ny = x + 2")))))
    assert got == "d5508332be9d66651adec0e552c27b2ee8325e81bdbb0eb34aef866ebb92b81d"


def test_lcs_against_the_table():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 20))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
        assert programs.lcs(a, b) == row[-1]


def test_scan():
    def found(source):
        return [(v["pattern"], v["severity"]) for v in programs.violations(source)]

    assert found("import os, subprocess") == []
    assert found("eval('1'); exec('2'); os.system('x')") == [("eval", "critical"), ("exec", "critical"), ("os.system", "critical")]
    assert found("os.path.remove('x')") == [("os.remove", "warning")]
    assert found("os.system('x').foo()") == []
    assert found("getattr(os, 'system')('x'); getattr(os, name)") == []
    assert found("f = getattr(os, 'system')") == [("getattr(os, 'system')", "critical")]
    assert found("@d(eval('3'))\ndef f(a=eval('1')):\n  exec('2')") == [("eval", "critical"), ("exec", "critical"), ("eval", "critical")]
    assert programs.violations("é = 1; eval('1')")[0] == {"pattern": "eval", "severity": "critical", "line": 1, "column": 7}
    assert programs.violations("def (") is None


def test_similarities_and_report(spark):
    def of(*sources):
        return spark.createDataFrame(list(enumerate(sources)), "ord long, source string")

    got = programs.similarities(of("def (", "x = 1", "a = 1", "def foo(): return 42")).orderBy("a", "b").collect()
    assert [tuple(r) for r in got] == [(0, 1, 100), (0, 2, 25), (1, 2, 25)]
    r = programs.report(of("x = 1", "a = 1")).first()
    assert (r["kind"], r["n_pairs"], r["plagiarized"], r["to_verify"], r["top_score"]) == ("results", 1, [0, 1], [], 100)
    assert programs.report(of("x = 1")).first()["kind"] == "insufficient_data"
    assert programs.report(of("x").where("false")).first()["kind"] == "no_submissions"
    assert programs.report(of("x = 1", "def (")).first()["first_error"] == 1
    assert [(r["n"], r["first"]) for r in programs.cluster_sizes(of("x = 1", "a = 1", "def f(): pass", "def (")).collect()] == [(2, 0)]
    assert [r["members"] for r in programs.clusters(of("x = 1", "a = 1", "def f(): pass")).collect()] == [[0, 1]]


def test_similarities_against_a_loop(spark):
    rng = random.Random(6)
    sources = [rng.choice(["def (", *("\n".join(rng.choice(["x = 1", "print(y)", "import os", "for i in z:\n  f(i)"]) for _ in range(rng.randint(1, 4))) for _ in range(4))]) for _ in range(25)]
    keys = sorted(rng.sample(range(1000), 25))
    parsed = [(k, t) for k, s in zip(keys, sources) if (t := programs.tokens(s)) is not None]
    df = spark.createDataFrame(list(zip(keys, sources)), "ord long, source string")
    for reindex in (True, False):
        names = range(len(parsed)) if reindex else [k for k, _ in parsed]
        want = sorted((a, b, programs.structural_score(x[1], y[1])) for (a, x), (b, y) in itertools.combinations(zip(names, parsed), 2))
        assert sorted(tuple(r) for r in programs.similarities(df, reindex=reindex).collect()) == want


def test_runner(spark):
    scripts = spark.createDataFrame([(0, "print('hi')"), (1, "import sys\nsys.exit(3)"), (2, "eval('1')"), (3, "while True: pass")], "ord int, source string")
    with pytest.raises(PermissionError):
        runner.run_scripts(scripts)
    rows = runner.run_scripts(scripts, timeout_s=3, allow=True).orderBy("key").collect()
    assert [(r["stdout"], r["exit_code"], r["timed_out"], r["error"]) for r in rows] == [("hi\n", 0, False, None), ("", 3, False, None), ("", None, False, "security_violation"), ("", None, True, "timeout")]
    out = runner.score_texts(scripts, runner.fixed_scorer(0.5), "ord", "source").collect()
    assert {r["overall"] for r in out} == {0.5}
    replies = spark.createDataFrame([('x {"is_plagiarism": true, "confidence": 0.5, "reasoning": "r"} y',), ("none",), ('{"is_plagiarism": true, "confidence": 2.0, "reasoning": "r"}',)], "reply string")
    assert [r["verdict_error"] for r in runner.verdicts(replies).collect()] == [None, "no_json", "confidence"]


def test_first_only_spreads_a_hot_key(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, *range(40)]), i) for i in range(300)] + [("a", 0, 7), ("a", 0, 7)]
    df = spark.createDataFrame(rows, "k string, at long, _part int").withColumn("accepted", F.lit("x"))
    out = state.first_only(df, ["k"], ["at", "_part"])
    assert out.columns == ["k", "at", "_part", "accepted"] and out.count() == len(rows)
    order = lambda r: [(x is not None, x or 0) for x in r[1:]]
    firsts = [min((r for r in rows if r[0] == k), key=order) for k in ("hot", "a", None)]
    assert sorted(map(str, (tuple(r)[:3] for r in out.where("accepted").collect()))) == sorted(map(str, firsts))
    texts = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x"), ("b", None), ("b", "")], "k string, at string")
    assert sorted(map(str, state.first_only(texts, ["k"], ["at"]).where("accepted").select("k", "at").collect())) == ["Row(k='a', at='x')", "Row(k='b', at=None)"]
    assert state.first_only(texts.where("false"), ["k"], ["at"]).collect() == []


def test_settings_hold_from_when_they_were_stored(spark):
    defaults = {"a": 1, "b": "x"}
    stored = spark.createDataFrame([(5, 2, "y"), (9, None, "z"), (9, None, "w"), (None, 7, "q")], "seq long, a int, b string")
    asked = spark.createDataFrame([(4, "p", 0), (5, "q", 0), (8, None, 0), (9, "r", 0), (40, "r", 0), (40, "r", 0), (None, "s", 0)], "seq long, _held string, a int")
    got = reads.settings_at(asked, stored, defaults)
    assert got.columns == ["seq", "_held", "a", "b"]
    want = [(4, "p", 1, "x"), (5, "q", 2, "y"), (8, None, 2, "y"), (9, "r", None, "z"), (40, "r", None, "z"), (40, "r", None, "z"), (None, "s", 1, "x")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert {tuple(r)[2:] for r in reads.settings_at(asked, stored.where("false"), defaults).collect()} == {(1, "x")}
    assert reads.settings_at(asked.where("false"), stored, defaults).collect() == []


def test_values_of_hotkeys(spark):
    log = spark.createDataFrame([("score", "a", 0.5, 1), ("score", "a", 0.7, 2), ("wta_weight", "a", 1.0, 3), ("wta_weight", "a", None, 4), ("score", "b", None, 5), ("wta_weight", "b", 0.2, 6), ("other", "c", 9.0, 7), ("score", None, 1.0, 8)], "namespace string, hotkey string, value double, seq long")
    asked = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "hotkey string")
    got = sorted(map(str, map(tuple, reads.hotkey_values(asked, log).collect())))
    assert got == sorted(map(str, [("a", 0.7, None), ("b", None, 0.2), ("b", None, 0.2), ("c", None, None), (None, None, None)]))
    assert reads.hotkey_values(asked, log.where("false")).where("score IS NOT NULL OR wta_weight IS NOT NULL").count() == 0
