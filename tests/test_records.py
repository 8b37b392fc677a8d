import json

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import scalars
from quarrymill.operators import neighbours, programs, reads, runner, state
from quarrymill.sources import conversations

GOOD = '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}'


def test_outputs_are_all_good_or_invalid(spark):
    rows = [(1, f"{GOOD}\n\n{GOOD}\r\n"), (2, f"{GOOD}\nx"), (3, " \n\t"), (4, None), (5, f"{GOOD}{GOOD}")]
    df = spark.createDataFrame(rows, "ord int, stdout string")
    got = {r["ord"]: (r["n_conversations"], r["error"] and (r["error"]["kind"], r["error"]["line"])) for r in conversations.output_problems(df).collect()}
    assert got == {1: (2, None), 2: (0, ("invalid_output", 2)), 3: (0, ("invalid_output", None)), 4: (0, ("invalid_output", None)), 5: (0, ("invalid_output", 1))}
    assert [(r["ord"], r["line"]) for r in conversations.output_rows(df).orderBy("line").collect()] == [(1, 1), (1, 3)]
    assert conversations.output_problems(df.where("false")).collect() == []


def test_datasets_need_utf8_and_alternating_roles(spark):
    swapped = GOOD.replace("user", "x").replace("assistant", "user").replace("x", "assistant")
    rows = [("a", GOOD.encode()), ("b", GOOD.encode() + b"\n\xff"), ("c", swapped.encode()), ("d", b""), ("e", f"{GOOD}\n{swapped}".encode()), ("f", None)]
    got = conversations.datasets(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert [r["path"] for r in got] == ["a"]


def test_folder_and_search(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_text("one\ntwo three\r\n")
    (tmp_path / "sub" / "b.txt").write_text("three")
    (tmp_path / "c.png").write_text("three")
    (tmp_path / "d.md").write_text("three")
    files = conversations.read_folder(spark, str(tmp_path))
    assert [r["path"].rpartition("/")[2] for r in files.collect()] == ["a.py", "b.txt"]
    assert sorted(r["shown"].rpartition("/")[2] for r in conversations.search(files, "three$").collect()) == ["a.py:2:two three", "b.txt:1:three"]


def test_batch_of_scripts(spark, monkeypatch):
    sources = [f"print('{GOOD}')", "print('no')", "def f(:", "import time\ntime.sleep(30)"]
    scripts = spark.createDataFrame(list(enumerate(sources)), "ord int, source string")
    with pytest.raises(PermissionError):
        runner.run_batch(scripts)
    out = runner.run_batch(scripts, timeout_s=5, allow=True)
    assert {r["ord"]: r["error"] for r in out["results"].collect()} == {0: None, 1: None, 2: None, 3: "timeout"}
    assert out["first_failure"].collect()[0]["ord"] == 3 and out["conversations"].count() == 1 and out["report"].first()["kind"] == "parse_error"
    assert {r["ord"] for r in out["problems"].where("error IS NULL").collect()} == {0} and out["scores"].count() == 3


def test_conversation_hash_is_compact_json(spark):
    import hashlib

    text = 'tab\t "quote" \\u001F \x1f \x0b \\ é'
    df = spark.createDataFrame([([("user", text, None, None)],)], f"messages array<{conversations.MESSAGE}>")
    want = json.dumps({"messages": [{"role": "user", "content": text}]}, ensure_ascii=False, separators=(",", ":"))
    assert df.select(scalars.conversation_hash(F.col("messages"))).first()[0] == hashlib.sha256(want.encode()).hexdigest()


def test_reviewer_scores(spark):
    part = '"criteria":{"diversity_thematic":0.5,"diversity_structural":0,"uniqueness":1,"quality_semantic":0.25},"reasoning":"","summary":""}'
    rows = [(0, '{"overall":0.9,' + part), (1, '{"overall":1.01,' + part), (2, '{"overall":0.9,' + part.replace('":1', '":-1')), (3, "{"), (4, None), (5, "{}")]
    got = {r["i"]: (r["score"] and r["score"]["overall"], r["score_error"]) for r in runner.parse_scores(spark.createDataFrame(rows, "i int, reply string")).collect()}
    assert got == {0: (0.9, None), 1: (None, "overall"), 2: (None, "criteria"), 3: (None, "no_json"), 4: (None, "no_json"), 5: (None, "no_json")}


def test_retries():
    calls = []

    def call(text):
        calls.append(text)
        if len(calls) < 3:
            raise TimeoutError("busy")
        return {"overall": 1.0}

    assert runner.with_retries(call, first_delay_s=0)("x") == {"overall": 1.0} and len(calls) == 3
    calls.clear()
    assert runner.with_retries(call, attempts=2, first_delay_s=0)("x")["error"] == "busy"


def test_next_rows_whatever_lies_between(spark):
    keys = [1, 3, 4, 10, 1000, 1001, 5_000_000]
    rows = spark.createDataFrame([(k, f"v{k}", 0) for k in keys], "k long, v string, _RANGE_ int").repartition(3)
    got = {r["k"]: r["next"] and tuple(r["next"]) for r in neighbours.with_next(rows, "k", "v").collect()}
    assert got == {a: (b, f"v{b}") for a, b in zip(keys, keys[1:])} | {keys[-1]: None}
    assert neighbours.with_next(rows.where("false"), "k", "v").collect() == []


def test_columns_after_odd_line_ends():
    assert programs.violations("a = ' '; x = 1\neval('1')")[0]["line"] == 2
    assert programs.violations("a = ' '; eval('1')")[0]["column"] == 9


def test_scores_of_two_sources(spark):
    df = spark.createDataFrame([("x = 1", "y = 2"), ("x = 1", "def f(:"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(programs.score_or_zero(F.col("a"), F.col("b"))).collect()] == [100, 0, 0]


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"b": [1, {"d": null, "c": "é"}], "a": 1.5}',), ("{",), (None,)], "t string")
    assert [r[0] for r in df.select(programs.canonical_json("t")).collect()] == ['{"a":1.5,"b":[1,{"c":"é","d":null}]}', None, None]


def test_reads_without_entries(spark):
    scores = spark.createDataFrame([("h", "k", 0.5, 1)], "hash string, hotkey string, score double, ord int")
    empty = spark.createDataFrame([], "hotkey string, epoch long")
    statuses = spark.createDataFrame([("k", 0, "s0")], "hotkey string, epoch long, status string")
    assert tuple(reads.submissions(scores, empty, statuses, 5).first()) == ("h", "k", 0.5, 5, "pending")
    assert tuple(reads.submission(scores, empty, statuses, F.lit("k")).first()) == ("h", "k", 0.5, 0, "s0")
    assert reads.submission(scores, empty, statuses, F.lit("?")).collect() == []
    big = spark.createDataFrame([("k", 1, bytearray(4 << 20)), ("k", 2, bytearray((4 << 20) + 1)), ("k", 3, None)], "hotkey string, epoch int, package binary")
    assert [r["stored"] for r in reads.stored_code(big).orderBy("epoch").collect()] == [True, False, False]
    board = spark.createDataFrame([("a", 2.0, 1, 7)], "hotkey string, score double, ord int, clamped int")
    assert state.weights(board, empty.select("hotkey")).columns == ["hotkey", "score", "ord", "clamped", "weight"]


def test_names_used_inside_are_free_for_users(spark):
    log = spark.createDataFrame([("a", 1, 1.0, 7), ("a", 2, None, 8), ("a", 3, 2.0, 9)], "k string, seq int, value double, _gone int")
    assert [tuple(r) for r in state.latest(log, ["k"]).collect()] == [("a", 2.0, 3)]
    asked = spark.createDataFrame([("h", 3, 1, 2, 3, "old")], "hotkey string, epoch int, _e int, _code int, _at int, code string")
    codes = spark.createDataFrame([("h", 2, "c2")], "hotkey string, epoch int, code string")
    assert state.code_at(asked, codes).first().asDict() == {"hotkey": "h", "epoch": 3, "_e": 1, "_code": 2, "_at": 3, "code": "c2"}
    statuses = spark.createDataFrame([("h", 3, "s")], "hotkey string, epoch int, status string")
    assert state.status_at(asked, statuses, F.col("epoch"), "none").first().asDict() == {"hotkey": "h", "epoch": 3, "_e": 1, "_code": 2, "_at": 3, "code": "old", "status": "s"}
    rows = spark.createDataFrame([(1, "a", 5, 6, 7), (2, "b", 5, 6, 7)], "k int, v string, _range int, _head int, next int")
    got = sorted(neighbours.with_next(rows, "k", "v").collect())
    assert [(r["k"], r["_range"], r["_head"], r["next"] and tuple(r["next"])) for r in got] == [(1, 5, 6, (2, "b")), (2, 5, 6, None)]


def test_ranges_of_strings_that_begin_alike(spark):
    names = [f"Customer#{i:09d}" for i in range(400)] + [None, "Customer#"]
    df = spark.createDataFrame([(n,) for n in names], "n string").repartition(4)
    got = df.withColumn("part", neighbours.ranges(df, "n")[0]).collect()
    parts = {r["n"]: r["part"] for r in got}
    assert len(set(parts.values())) == 4 and max(list(parts.values()).count(x) for x in set(parts.values())) < 150
    assert all(parts[a] <= parts[b] for a, b in zip(names[:399], names[1:400]))
