import random

import pytest

from quarrymill.sources import conversations, jsonl_format

GOOD = '{"messages":[{"role":"user","content":"a%s"},{"role":"assistant","content":"é"}]}'


def text(rng, n):
    kinds = [lambda: GOOD % rng.random(), lambda: GOOD % ("x" * rng.randint(0, 300)), lambda: "", lambda: " \t", lambda: "no", lambda: GOOD % 1 + "\r", lambda: "{}"]
    return "\n".join(rng.choice(kinds)() for _ in range(n))


def shown(df, name=None):
    return sorted((r["path"].rpartition("/")[2], r["line"], r["messages"] and r["messages"][0]["content"], r["error"] and r["error"]["kind"]) for r in df.collect())


def test_splits_equal_the_plain_parser(spark, tmp_path):
    rng = random.Random(3)
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, body in (("a.jsonl", text(rng, 200)), ("b.jsonl", text(rng, 60) + "\n"), ("sub/c.jsonl", ""), ("sub/d.jsonl", "\n\n\n"), ("e.txt", "﻿" + GOOD % 2), ("left.md", "x"), ("_hidden.jsonl", "x")):
        (tmp_path / "in" / name).write_text(body, newline="")
    (tmp_path / "in" / "f.jsonl").write_bytes(b"\xff\n" + (GOOD % 3).encode())
    want = []
    for path in sorted((tmp_path / "in").rglob("*")):
        if path.is_file() and path.suffix in (".jsonl", ".txt") and not path.name.startswith("_"):
            for line, raw in enumerate(path.read_bytes().removeprefix(b"\xef\xbb\xbf").split(b"\n"), 1):
                value = raw.removesuffix(b"\r").decode(errors="replace")
                if value.strip():
                    kind = conversations.classify(value)[0]
                    want.append((path.name, line, None if kind else __import__("json").loads(value)["messages"][0]["content"], kind))
    for split in (700, 1 << 25):
        assert shown(jsonl_format.read(spark, str(tmp_path / "in"), splitBytes=split)) == sorted(want)
    one = shown(jsonl_format.read(spark, str(tmp_path / "in" / "a.jsonl"), splitBytes=900))
    assert one == sorted(w for w in want if w[0] == "a.jsonl")
    assert [w[1:] for w in one] == [w[1:] for w in shown(conversations.read_jsonl(spark, str(tmp_path / "in" / "a.jsonl")))]
    assert spark.read.format("conversation_lines").option("splitBytes", 100).load(str(tmp_path / "in" / "a.jsonl")).rdd.getNumPartitions() > 50


def test_every_way_to_cut_a_file(tmp_path):
    path, rng = tmp_path / "x", random.Random(1)
    for _ in range(30):
        raw = bytes(rng.choice(b"ab\n\n") for _ in range(rng.randint(0, 40)))
        path.write_bytes(raw)
        starts = [0] + [i + 1 for i, c in enumerate(raw) if c == 10]
        want = [(s, raw[s:].split(b"\n")[0]) for s in starts if s < len(raw)]
        for split in (1, 2, 5, 100):
            cuts = [*range(0, len(raw), split), len(raw)]
            got = [x for a, b in zip(cuts, cuts[1:]) for x in jsonl_format.lines(str(path), a, b, a > 0, 100)]
            assert got == want, (raw, split)


def test_limits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("x" * 3_000_000 + "\n" + GOOD % 1)
    got = shown(jsonl_format.read(spark, str(tmp_path), maxLineBytes=1000, splitBytes=500_000))
    assert got == [("a.jsonl", 1, None, "TooLarge"), ("a.jsonl", 2, "a1", None)]
    with pytest.raises(Exception, match="more than 10 bytes"):
        jsonl_format.read(spark, str(tmp_path), maxFileBytes=10).collect()
    with pytest.raises(Exception, match="none"):
        jsonl_format.read(spark, str(tmp_path / "none")).collect()


def test_stream_reads_what_is_appended(spark, tmp_path):
    (tmp_path / "in").mkdir()
    jsonl_format.register(spark)

    def run():
        rows = spark.readStream.format("conversation_lines").option("splitBytes", 50).load(str(tmp_path / "in"))
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start().awaitTermination()
        return sorted((r["path"].rpartition("/")[2], r["at"], r["kind"]) for r in spark.read.schema(jsonl_format.SCHEMA).parquet(str(tmp_path / "out")).collect())

    first = GOOD % 1 + "\n"
    (tmp_path / "in" / "a.jsonl").write_text(first + '{"mess')
    at = len(first.encode())
    assert run() == [("a.jsonl", 0, None)]
    (tmp_path / "in" / "a.jsonl").write_text(first + "no\n" + GOOD % 2)
    (tmp_path / "in" / "b.jsonl").write_text("\n" + GOOD % 3 + "\n")
    assert run() == [("a.jsonl", 0, None), ("a.jsonl", at, "InvalidJson"), ("b.jsonl", 1, None)]
