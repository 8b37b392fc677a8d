import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import evaluation, similarity


def talks(rng, n):
    """(key, first message, number of messages); some keys and texts are there twice."""
    return [(rng.randrange(2 * n), " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 2) for _ in range(rng.randint(0, 9))), rng.randint(1, 6)) for _ in range(n)]


def frame(spark, rows):
    made = [(k, [("user", t)] + [("assistant", "r")] * (n - 1)) for k, t, n in rows]
    return spark.createDataFrame(made, "conv_id long, messages array<struct<role: string, content: string>>").repartition(3)


def by_hand(rows):
    out = []
    for a, x, m in rows:
        for b, y, n in rows:
            x_, y_ = x.split(), y.split()
            shared = sum(w in y_ for w in x_)
            if a < b and min(m, n) * 2 >= max(m, n) and shared:
                out.append((a, b, shared / (len(x_) + len(y_) - shared)))
    return sorted(out)


@pytest.mark.parametrize("most", [4, 1024])
def test_pairs_and_sums_against_a_loop(spark, monkeypatch, most):
    monkeypatch.setattr(similarity, "BLOCK", 25)
    rows = talks(random.Random(most), 90)
    df, want = frame(spark, rows), by_hand(rows)
    assert sorted(tuple(r) for r in similarity.pairs(df, most=most).collect()) == want
    got = similarity.internal(df, most=most).first()
    assert (got["n"], got["n_pairs"]) == (90, 45 * 89) and got["max_similarity"] == max(s for *_, s in want)
    assert got["mean_similarity"] == pytest.approx(sum(s for *_, s in want) / (45 * 89))


def test_no_pairs(spark):
    df = frame(spark, [(1, "a b", 2), (2, "c", 2), (3, "", 2)])
    assert similarity.pairs(df).collect() == [] and tuple(similarity.internal(df).first())[:4] == (3, 3, 0.0, 0.0)
    assert similarity.internal(df.where("false")).first()["n"] == 0


def test_pairs_are_not_shuffled(spark):
    """2,000 conversations with a token in common are 2 * 10^6 pairs; what is shuffled is a row for each conversation and block."""
    rows = spark.range(2000).select(F.col("id").alias("conv_id"), F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("so "), F.col("id") % 7).alias("content"))).alias("messages"))
    plan = similarity.pairs(rows)._jdf.queryExecution()
    assert similarity.pairs(rows).count() == 1000 * 1999
    shown = plan.executedPlan().toString()
    assert "FlatMapGroupsInArrow" in shown


def test_evaluation_gathers_texts_once(spark):
    """400 conversations with short first messages and long replies: the replies are shuffled once, whatever is told of them."""
    text = F.concat_ws("", *[F.sha2(F.concat_ws("/", "conv_id", "turn", F.lit(i)), 512) for i in range(39)])
    rows = spark.range(1600).select((F.col("id") % 400).alias("conv_id"), F.floor(F.col("id") / 400).alias("turn"))
    rows = rows.withColumn("text", F.when(F.col("turn") == 0, F.concat(F.lit("so "), F.col("conv_id") % 7)).otherwise(text)).localCheckpoint()
    made = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    message = "transform(turns, t -> struct(if(t.turn % 2 = 0, 'user', 'assistant') as role, t.text as content, null as function_call))"
    made = made.select("conv_id", F.expr(message).alias("messages"))

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = shuffled()
    once = made.write.format("noop").mode("overwrite").save() or shuffled() - before
    got = evaluation.evaluate(made).first()
    assert (got["n_conversations"], got["n_messages"]) == (400, 1600)
    assert 0 < shuffled() - before - once < 1.3 * once


def test_chunks_are_cut_by_rows_and_tokens(spark, monkeypatch):
    rows = talks(random.Random(5), 60)
    kept = similarity.written(similarity.firsts(frame(spark, rows), "conv_id"), "first_messages").coalesce(1)
    parts = [{(r["block"], r["part"]) for r in similarity._dealt(kept, most).select("block", "part").collect()} for most in (1024, 4)]
    assert len(parts[0]) < len(parts[1])
    table = pa.table({"block": pa.array([0] * 5, pa.int32()), "id": range(5), "n": [2] * 5, "size": [9] * 5, "tokens": [[1, 2, 2], [2, 1 << 40], [3] * 9, [1], [2]]})
    monkeypatch.setattr(similarity, "HELD", 5)
    chunks = [similarity._Chunk(b.column("data")[0]) for b in similarity._chunks(3)(iter(table.to_batches()))]
    assert [c.ids.to_pylist() for c in chunks] == [[0, 1], [2], [3, 4]]
    entries = [sorted((c.ids[int(k)].as_py(), int(p), int(t)) for k, p, t in zip(c.row, c.tokens.repeat(c.counts), c.times, strict=True)) for c in chunks]
    assert entries == [[(0, 1, 1), (0, 2, 2), (1, 2, 1), (1, 1 << 40, 1)], [(2, 3, 9)], [(3, 1, 1), (4, 2, 1)]]


def test_frequent_and_rare_tokens_of_two_chunks(monkeypatch):
    """Both ways of counting, in one go and in many, against a loop."""
    rng = random.Random(11)
    sides = [[[rng.randrange(4) if rng.random() < 0.3 else rng.randrange(4, 900) for _ in range(rng.randint(1, 30))] for _ in range(70)] for _ in range(2)]
    a, b = (
        similarity._Chunk(next(similarity._chunks(1024)(iter(pa.table({"block": pa.array([0] * 70, pa.int32()), "id": range(70), "n": [2] * 70, "size": [30] * 70, "tokens": rows}).to_batches()))).column("data")[0])
        for rows in sides
    )
    before = np.array([[rng.random() < 0.5 for _ in range(70)] for _ in range(70)])
    want = [[sum(w in (y if before[i, j] else x) for w in (x if before[i, j] else y)) for j, y in enumerate(sides[1])] for i, x in enumerate(sides[0])]
    assert similarity._shared(a, b, before).tolist() == want
    monkeypatch.setattr(similarity, "TOKENS", 2)
    monkeypatch.setattr(similarity, "MEETINGS", 7)
    assert similarity._shared(a, b, before).tolist() == want


def test_all_of_the_one_chunk_come_first(monkeypatch):
    rng = random.Random(3)
    sides = [[[rng.randrange(4) if rng.random() < 0.3 else rng.randrange(4, 300) for _ in range(rng.randint(1, 30))] for _ in range(40)] for _ in range(2)]
    a, b = (
        similarity._Chunk(next(similarity._chunks(1024)(iter(pa.table({"block": pa.array([0] * 40, pa.int32()), "id": range(40), "n": [2] * 40, "size": [30] * 40, "tokens": rows}).to_batches()))).column("data")[0])
        for rows in sides
    )
    want = [[sum(w in y for w in x) for y in sides[1]] for x in sides[0]]
    assert similarity._shared(a, b, True).tolist() == want
    monkeypatch.setattr(similarity, "TOKENS", 2)
    monkeypatch.setattr(similarity, "MEETINGS", 7)
    assert similarity._shared(a, b, True).tolist() == want


@pytest.mark.parametrize("kind", ["long", "string"])
def test_blocks_are_ranges_of_keys(spark, kind):
    """One key has half of the rows: it is dealt to the blocks that it fills, all others are in one block."""
    key = F.when(F.col("id") % 2 == 0, F.lit(1500)).otherwise(F.col("id")).cast(kind)
    rows = spark.range(4000).select(key.alias("conv_id"), F.array(F.struct(F.lit("user").alias("role"), F.lit("so").alias("content"))).alias("messages"))
    kept = similarity.written(similarity.firsts(rows, "conv_id"), "first_messages")
    found = {}
    for r in similarity._dealt(kept, 1024).select("block", "part", "data").distinct().collect():
        found.setdefault(r["block"], []).extend(similarity._Chunk(pa.scalar(bytes(r["data"]), pa.binary())).ids.to_pylist())
    blocks = [found[b] for b in sorted(found)]
    assert sum(map(len, blocks)) == 4000 and max(map(len, blocks)) < 1.5 * 4000 / 3
    assert all(max(x) <= min(y) for x, y in zip(blocks, blocks[1:], strict=False))
    total = similarity.pairs(rows).agg(F.count("*"), F.min("similarity"), F.sum((F.col("a") < F.col("b")).cast("long"))).first()
    assert tuple(total) == (2000 * 2000 + 1000 * 1999, 1.0, 2000 * 2000 + 1000 * 1999)


def test_python_hands_on_a_list_for_each_conversation(spark):
    """A row for each pair is dear where rows come from Python."""
    rows = spark.createDataFrame([(k, f"so t{k % 5}", 2) for k in range(50)], "conv_id long, text string, n int")
    made = rows.select("conv_id", F.array_repeat(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")), 2).alias("messages"))
    kept = similarity.written(similarity.firsts(made, "conv_id"), "first_messages")
    batches = [r.asDict() for r in similarity._dealt(kept, 16).where("group.low = group.high").collect()]
    table = pa.Table.from_pylist([b | {"group": b["group"].asDict(), "data": bytes(b["data"])} for b in batches if b["group"]["low"] == 0])
    lists = [b for b in similarity._listed(iter(table.to_batches()))]
    assert all(b.num_rows <= 16 for b in lists)
    n = sum(len(x) for b in lists for x in b.column("b").to_pylist())
    k = sum(len(similarity._Chunk(x).ids) for x in table.column("data"))
    assert n == k * (k - 1) // 2 > 16
