import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import evaluation, quality, similarity
from quarrymill.sources import conversations

SCHEMA = f"conv_id long, messages array<{conversations.MESSAGE}>"


def dialog(*texts, roles=("user", "assistant")):
    return [(roles[i % len(roles)], t, None, None) for i, t in enumerate(texts)]


def frame(spark, *dialogs):
    return spark.createDataFrame(list(enumerate(dialogs)), SCHEMA)


def scores(spark, *dialogs):
    r = evaluation.evaluate(frame(spark, *dialogs)).first()
    return {k: round(r[k], 6) for k in ("format_score", "quality_score", "mean_similarity", "originality_score", "score")}


def test_duplicates_and_pair_penalties(spark):
    a = dialog("alpha beta gamma", "one two three four five six")
    r = scores(spark, a, a, dialog("x y z", "seven eight nine ten eleven"))
    assert (r["mean_similarity"], r["originality_score"], r["score"]) == (0.333333, 0.666667, 0.766667)
    r = scores(spark, dialog("a b c d", "reply number one is here ok"), dialog("a b c e", "reply number two is here ok"))
    assert (r["mean_similarity"], r["originality_score"], r["score"]) == (0.6, 0.88, 0.852)
    r = scores(spark, dialog("a b c d", "reply number one is here ok"), dialog("a b c d", "a different longer reply text"))
    assert (r["mean_similarity"], r["originality_score"], r["score"]) == (1.0, 0.5, 0.7)


def test_repetition_generic_short_and_empty(spark):
    assert scores(spark, dialog(*["same text here"] * 4, "same text here!")) | {} == {"format_score": 1.0, "quality_score": 0.49, "mean_similarity": 0.0, "originality_score": 1.0, "score": 0.796}
    r = scores(spark, dialog("I need help please", "I understand. Go on", "ok tell me more", "Is there anything else today?"))
    assert (r["originality_score"], r["quality_score"]) == (0.9, 0.85)
    assert scores(spark, dialog("hello there friend", "hi", "and more text here", "ok"))["score"] == 0.94
    r = scores(spark, [("user", "question one", None, None), ("function", '{"r":1}', None, None), ("user", "again", None, None), ("assistant", "", None, None)])
    assert (r["format_score"], r["quality_score"], r["score"]) == (0.0, 0.7, 0.68)
    empty = evaluation.evaluate(frame(spark, dialog("a", "b")).where("false")).first()
    assert (empty["n_conversations"], empty["score"], empty["passed"]) == (0, 0.0, False)


def test_pairs_are_not_symmetric(spark):
    rows = lambda *t: [x["similarity"] for x in similarity.pairs(frame(spark, *(dialog(a, "reply") for a in t))).collect()]
    assert rows("a a b", "a c") == pytest.approx([2 / 3])
    assert rows("a c", "a a b") == pytest.approx([0.25])
    assert rows("", "a") == []


def test_pairs_against_nested_loops(spark):
    rng = random.Random(3)
    texts = [[" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 6))] for _ in range(30)]
    want = {}
    for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2):
        x, y = a[0].split(), b[0].split()
        if min(len(a), len(b)) / max(len(a), len(b)) >= 0.5 and x and y:
            n = sum(t in y for t in x)
            if n:
                want[i, j] = n / (len(x) + len(y) - n)
    for most in (1024, 3):  # tokens in one part, and common ones in several
        got = {(r["a"], r["b"]): r["similarity"] for r in similarity.pairs(frame(spark, *(dialog(*t) for t in texts)), most=most).collect()}
        assert got == pytest.approx(want)


@pytest.mark.parametrize(
    ("roles", "machine", "bigrams"),
    [("user assistant function", False, True), ("system system user assistant", True, False), ("user assistant system user", True, False), ("user assistant user", True, True), ("assistant user", False, True), ("system assistant", False, True), ("user user", False, False)],
)
def test_role_rules(spark, roles, machine, bigrams):
    df = frame(spark, [(r, "x", None, None) for r in roles.split()])
    assert tuple(df.select(quality.role_machine(F.col("messages")), quality.role_bigrams(F.col("messages"))).first()) == (machine, bigrams)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("a" * 10, "a" * 9 + "b", False), ("a" * 11, "a" * 10 + "b", True), ("é" * 10, "é" * 9 + "e", True), ("Hello world", "Hello world!", True), ("Hello world", "Completely different text", False), ("", "", False)],
)
def test_near_duplicate(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(quality.near_duplicate(F.col("a"), F.col("b"))).first()[0] is want


def test_leaders_against_a_loop(spark):
    def near(a, b):
        x, y = a.encode(), b.encode()
        n, m = min(len(x), len(y)), max(len(x), len(y))
        return n > 0 and n / m >= 0.9 and sum(p == q for p, q in zip(x, y)) / n > 0.9

    rng, rows = random.Random(1), []
    for _ in range(60):
        base = ["".join(rng.choice("ab") for _ in range(12)) for _ in range(3)]
        rows.append([x[:k] + rng.choice("abé") + x[k + 1 :] for x in (rng.choice(base) for _ in range(6)) for k in [rng.randrange(12)]])
    want = []
    for texts in rows:
        kept = []
        for t in texts:
            if not any(k == t or near(k, t) for k in kept):
                kept.append(t)
        want.append(len(kept))
    df = spark.createDataFrame(list(enumerate(rows)), "i int, c array<string>")
    assert [r[0] for r in df.orderBy("i").select(quality.leaders(F.col("c"))).collect()] == want


GOOD = '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}'


@pytest.mark.parametrize(
    ("line", "kind"),
    [
        (GOOD, None), (GOOD[:-1], "InvalidJson"), (GOOD + " x", "InvalidJson"), (GOOD + GOOD, "InvalidJson"), ("[1]", "InvalidFormat"), ("{}", "MissingField"), ('{"messages":[]}', "InvalidFormat"),
        ('{"messages":[{"role":"user","content":"a"}]}', "InvalidFormat"), ('{"messages":[{"role":"user"},{"role":"a","content":"b"}]}', "InvalidJson"), ('{"messages":[{"role":"user","content":5},{"role":"a","content":"b"}]}', "InvalidJson"),
        ('{"messages":[{"role":"u","role":"u","content":"a"},{"role":"a","content":"b"}]}', "InvalidJson"), ('{"messages":NaN}', "InvalidJson"), (GOOD[:-1] + ',"other":1}', None),
    ],
)
def test_classify(line, kind):
    assert conversations.classify(line)[0] == kind


def test_read_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes((GOOD + "\r\n\n  \n" + GOOD + "\n{}\n{bad\n").encode())
    rows = conversations.read_jsonl(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r["line"], r["error"] and r["error"]["kind"]) for r in rows] == [(1, None), (4, None), (5, "MissingField"), (6, "InvalidJson")]
    assert rows[0]["messages"][1]["content"] == "b" and rows[2]["messages"] is None
    first = conversations.first_error(conversations.read_jsonl(spark, str(tmp_path))).collect()
    assert [(r["line"], r["kind"]) for r in first] == [(5, "MissingField")]
    assert json.loads(GOOD)["messages"][0]["role"] == rows[0]["messages"][0]["role"]


def test_read_jsonl_split_into_blocks(spark, tmp_path):
    rng, want = random.Random(5), {}
    for name in "ab":
        lines = [rng.choice((GOOD, "", "{}", "x" * rng.randint(1, 300))).encode() for _ in range(200)] + [b"\xff\xfe"] + [GOOD.encode()] * (name == "a")
        (tmp_path / f"{name}.jsonl").write_bytes(b"\n".join(lines))
        kinds = [conversations.classify(x.decode(errors="replace"))[0] for x in lines]
        want |= {(f"{name}.jsonl", i): k for i, (x, k) in enumerate(zip(lines, kinds), 1) if x}
    (tmp_path / "empty.jsonl").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        rows = conversations.read_jsonl(spark, str(tmp_path))
        got = [((r["path"].rpartition("/")[2], r["line"]), r["error"] and r["error"]["kind"]) for r in rows.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == len(want) and dict(got) == want


def test_consensus(spark):
    def of(*s):
        df = spark.createDataFrame([("g", i, x) for i, x in enumerate(s)], "g string, i int, s double")
        r = evaluation.consensus(df, "g", "s", "i").first()
        return round(r["final_score"], 6), round(r["agreement"], 6), r["outliers"]

    assert of(0.8, 0.85, 0.9, 0.5) == (0.85, 0.0, [3])
    assert of(0.5, 0.9) == (0.5, 0.0, [1])
    assert of(0.1, 0.5, 0.9) == (0.5, 0.0, [0, 2])
    assert of(0.85) == (0.85, 1.0, [])


def test_consensus_of_large_and_odd_groups(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "x", None]), i, rng.choice([None, 0.1, 0.5, 0.6, 0.9])) for i in rng.sample(range(400), 300)] + [("none", 1, None)]
    want = {}
    for g in {r[0] for r in rows}:
        scores = [s for _, _, s in sorted((r for r in rows if r[0] == g), key=lambda r: r[1])]
        there = [s for s in scores if s is not None]
        mean = sum(there) / len(there) if there else None
        near = [s for s in there if abs(s - mean) <= 0.2]
        want[g] = (round(sum(near) / len(near) if near else mean, 6) if there else None, len(scores), [i for i, s in enumerate(scores) if s is not None and abs(s - mean) > 0.2])
    got = evaluation.consensus(spark.createDataFrame(rows, "g string, i int, s double"), "g", "s", "i").collect()
    assert {r["g"]: (r["final_score"] and round(r["final_score"], 6), r["n_scores"], r["outliers"]) for r in got} == want
    assert evaluation.consensus(spark.createDataFrame(rows, "g string, i int, s double").where("false"), "g", "s", "i").collect() == []


def _looped(contents):
    kept = []
    for raw in dict.fromkeys((c or "").encode() for c in contents):
        if not any(quality._near(k, raw) for k in kept):
            kept.append(raw)
    return len(kept)


def test_leaders_of_long_conversations_equal_the_loop():
    """Edited copies of every length, edits on the border of a tenth, few letters: 200 conversations, and one of 3,000 messages."""
    import random
    import time

    rng = random.Random(6)

    def edited(x):
        out = list(x)
        for i in rng.sample(range(len(out)), min(len(out), max(0, len(out) // 10 + rng.choice((-1, 0, 0, 1))))):
            out[i] = rng.choice("ab")
        return "".join(out) + "b" * rng.choice((0, 0, 1, len(x) // 10))

    for letters in ("ab", "abcdefgh "):
        for _ in range(100):
            words = []
            for _ in range(rng.randint(1, 40)):
                words.append(edited(rng.choice(words)) if words and rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.choice((0, 1, 3, 5, 6, 7, 9, 10, 11, 20, 45, 89, 90, 99, 100, 111, 112, 300)))))
            assert quality._kept(words) == _looped(words)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(80, 400))) for _ in range(2400)]
    texts += [edited(rng.choice(texts)) for _ in range(600)]
    rng.shuffle(texts)
    assert quality._kept(texts) == _looped(texts)
    fresh = lambda n: ["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(n)]
    times = []
    for n in (5000, 20_000):
        many = fresh(n)
        began = time.perf_counter()
        assert quality._kept(many) == n
        times.append(time.perf_counter() - began)
    assert times[1] < 12 * times[0]
