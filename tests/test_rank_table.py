import math
import random

import pytest

from quarrymill.operators import state
from quarrymill.sources import shared
from quarrymill.sources.rank_table import RankTable

SCHEMA = "k string, v double, at long"


def make(spark, path, most):
    return RankTable(spark, str(path), SCHEMA, ["k"], "v", "at", most)


def plain(log):
    """Ranks by a walk through the log and a sort."""
    held = {}
    for k, v, at in sorted(log, key=lambda r: r[2]):
        if v is None:
            held.pop(k, None)
        else:
            held[k] = (v, held.get(k, (0, at))[1])
    rows = sorted(held.items(), key=lambda r: (not math.isnan(r[1][0]), 0 if math.isnan(r[1][0]) else -r[1][0], r[1][1]))
    return [(k, str(v), at, i + 1) for i, (k, (v, at)) in enumerate(rows)]


def shown(df):
    return sorted(((r["k"], str(r["v"]), r["ord"], r["rank"]) for r in df.collect()), key=lambda r: r[3])


def changes(rng, n, start):
    """A third of all scores is one half; NaN, deletions and a null key occur."""
    score = lambda: rng.choice([0.5, None, float("nan"), *(round(rng.random(), 2) for _ in range(6))]) if rng.random() > 0.33 else 0.5
    return [(None if rng.random() < 0.02 else f"k{rng.randrange(150)}", score(), start + i) for i in range(n)]


def test_ranks_equal_a_recount_after_each_of_20_batches(spark, tmp_path):
    rng, table, log = random.Random(3), make(spark, tmp_path / "t", 20), []
    assert table.ranks().collect() == [] and table.vacuum() == 0
    for batch in range(20):
        rows = changes(rng, rng.choice([0, 1, 3, 40]) if batch else 120, 1000 * batch)
        assert table.append(spark.createDataFrame(rows, SCHEMA), batch)
        log += rows
        assert shown(table.ranks()) == plain(log), batch
        if batch in (7, 15):
            table.vacuum()
            assert not table.append(spark.createDataFrame(changes(rng, 3, 0), SCHEMA), batch)  # sent again: nothing happens
            assert shown(table.ranks()) == plain(log)
    parts = table._manifest()[2]
    assert len(parts) > 5 and sum(r["n"] for r in parts) == len(plain(log))
    held = table.ranks().where("k IS NOT NULL").withColumnRenamed("rank", "kept")
    again = state.ranked(table.ranks().drop("rank"), "v", "ord")
    assert shown(again) == plain(log) and held.join(again, "k").where("kept <> rank").count() == 0


def test_a_batch_rewrites_the_ranges_that_it_touches(spark, tmp_path):
    table = make(spark, tmp_path / "t", 50)
    table.append(spark.createDataFrame([(f"k{i}", i / 1000, i) for i in range(1000)], SCHEMA), 0)
    before = table._manifest()[2]
    assert len(before) >= 20 and max(r["n"] for r in before) < 200
    table.append(spark.createDataFrame([("new", 0.0105, 2000)], SCHEMA), 1)
    after = table._manifest()[2]
    assert sum(r["batch"] == 1 for r in after) == 1 and len(after) == len(before)
    table.append(spark.createDataFrame([("k3", 0.9995, 3000)], SCHEMA), 2)  # from the last range to the first
    assert sum(r["batch"] == 2 for r in table._manifest()[2]) == 2
    assert [r["k"] for r in table.top(3).collect()] == ["k3", "k999", "k998"]
    assert [(r["k"], r["rank"]) for r in table.top(2, 990).collect()] == [("new", 991), ("k10", 992)]
    assert len(table.top(3).inputFiles()) == 1  # one range of over 20


def test_reading_ranks_neither_sorts_nor_shuffles(spark, tmp_path):
    table = make(spark, tmp_path / "t", 10)
    table.append(spark.createDataFrame([(f"k{i}", i % 7 / 7, i) for i in range(100)], SCHEMA), 0)
    plan = table.ranks()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "Sort" not in plan and "Window" not in plan


def test_empty_batches_deletion_of_all_ties_and_old_changes(spark, tmp_path):
    table = make(spark, tmp_path / "t", 10)
    assert table.append(spark.createDataFrame([], SCHEMA), 0) and table.ranks().count() == 0
    # one seq twice for a key: the largest score counts, a deletion before any; no seq: no change
    table.append(spark.createDataFrame([("a", 0.1, 5), ("a", 0.3, 5), ("b", 0.9, 6), ("b", None, 6), ("c", 0.2, None), ("d", 0.3, 5)], SCHEMA), 1)
    assert shown(table.ranks()) == [("a", "0.3", 5, 1), ("d", "0.3", 5, 2)]
    with pytest.raises(ValueError, match="older than the table"):
        table.append(spark.createDataFrame([("a", 0.4, 6)], SCHEMA), 2)
    table.append(spark.createDataFrame([("a", None, 7), ("d", None, 8)], SCHEMA), 2)
    assert table.ranks().count() == 0
    table.append(spark.createDataFrame([("a", 0.5, 9)], SCHEMA), 4)
    assert shown(table.ranks()) == [("a", "0.5", 9, 1)]
    (tmp_path / "t/manifests/batch=9").mkdir()  # never finished
    assert table._manifest()[0] == 4 and shared.children(spark, str(tmp_path / "t/stage")) == []
    with pytest.raises(ValueError):
        table.append(spark.createDataFrame([], SCHEMA), -1)
    with pytest.raises(ValueError):
        RankTable(spark, str(tmp_path / "x"), "rank string, v double, at long", ["rank"], "v", "at")


def test_a_stream_folds_each_batch_once(spark, tmp_path):
    table, rng, log = make(spark, tmp_path / "t", 15), random.Random(4), []
    for i in range(3):
        rows = changes(rng, 40, 100 * i)
        log += rows
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for check in ("one", "two"):  # the second stream has lost its checkpoint and sends all batches again
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(table.sink()).option("checkpointLocation", str(tmp_path / check)).trigger(availableNow=True).start().awaitTermination()
        assert shown(table.ranks()) == plain(log)
