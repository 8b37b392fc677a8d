import random

import pytest

from quarrymill.operators import reads, state
from quarrymill.sources import shared
from quarrymill.sources.state_table import StateTable

SCHEMA = "k string, ns int, v double, at long"


def make(spark, path):
    return StateTable(spark, str(path), SCHEMA, ["k", "ns"], "v", "at")


def changes(rng, n, start):
    rows = [(rng.choice(["a", "b", "c", None, "e"]), rng.randrange(3), None if rng.random() < 0.2 else rng.random(), start + i) for i in range(n)]
    rng.shuffle(rows)
    return rows


def shown(df):
    return sorted((str(r["k"]), r["ns"], r["v"], r["ord"]) for r in df.collect())


def plain(log):
    """By a walk through the log."""
    out = {}
    for k, ns, v, at in sorted(log, key=lambda r: r[3]):
        if v is None:
            out.pop((k, ns), None)
        else:
            out[k, ns] = (v, out.get((k, ns), (0, at))[1])
    return sorted((str(k), ns, v, at) for (k, ns), (v, at) in out.items())


def test_snapshots_and_tails_equal_the_whole_log(spark, tmp_path):
    rng = random.Random(1)
    table, log = make(spark, tmp_path / "t"), []
    assert table.read().collect() == [] and table.compact() == -1
    for batch in range(12):
        rows = changes(rng, 25, 1000 * batch)
        assert table.append(spark.createDataFrame(rows, SCHEMA), batch)
        assert not table.append(spark.createDataFrame(changes(rng, 3, 0), SCHEMA), batch)  # sent again: nothing happens
        log += rows
        assert shown(table.read()) == plain(log)
        if batch in (3, 7, 10):
            assert table.compact(batch - 1 if batch == 7 else None) == (6 if batch == 7 else batch)
            assert shown(table.read()) == plain(log)
        if batch == 8:
            table.vacuum()
    whole = state.latest(spark.createDataFrame([r for r in log if r[0] is not None], SCHEMA), ["k", "ns"], "at", "v")
    assert [r for r in shown(table.read()) if r[0] != "None"] == shown(whole)


def test_a_read_scans_the_snapshot_and_the_tail_only(spark, tmp_path):
    table = make(spark, tmp_path / "t")
    for batch in range(20):
        table.append(spark.createDataFrame([("a", 0, float(batch), batch), (f"k{batch % 4}", 1, 1.0, batch)], SCHEMA), batch)
    table.compact(17)
    files = {f.rpartition("/")[0].rpartition("/t/")[2] for f in table.read().inputFiles()}
    assert files == {"snapshots/upto=17", "log/batch=18", "log/batch=19"}
    assert table._parts()[0].count() == 5 + 4  # keys alive in the snapshot, rows of two batches; not the 40 rows of the log
    assert len(table.vacuum()) == 18 and shown(table.read())[0] == ("a", 0, 19.0, 0)
    assert not table.append(spark.createDataFrame([("a", 0, 9.0, 99)], SCHEMA), 3)  # part of the snapshot


def test_old_changes_and_unfinished_files(spark, tmp_path):
    table = make(spark, tmp_path / "t")
    table.append(spark.createDataFrame([("a", 0, 1.0, 10)], SCHEMA), 0)
    table.compact()
    table.append(spark.createDataFrame([("a", 0, 2.0, 10)], SCHEMA), 1)
    with pytest.raises(ValueError, match="older than the snapshot"):
        table.compact()
    # a snapshot and a batch that were never finished don't count
    for name in ("snapshots/upto=5", "log/batch=4"):
        (tmp_path / "t" / name).mkdir(parents=True)
    assert table._numbers("snapshots") == [0] and table._numbers("log") == [0, 1]
    with pytest.raises(ValueError):
        table.append(spark.createDataFrame([("a", 0, 2.0, 10)], SCHEMA), -1)
    assert shared.children(spark, str(tmp_path / "none")) == []


def test_a_stream_writes_each_batch_once(spark, tmp_path):
    table, rng, log = make(spark, tmp_path / "t"), random.Random(2), []
    for i in range(3):
        rows = changes(rng, 10, 100 * i)
        log += rows
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for check in ("one", "two"):  # the second stream has lost its checkpoint and sends all batches again
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(table.sink()).option("checkpointLocation", str(tmp_path / check)).trigger(availableNow=True).start().awaitTermination()
        assert shown(table.read()) == plain(log)
    assert table._numbers("log") == [0, 1, 2]


def test_reads_of_bucketed_state_dont_shuffle(spark):
    rows = [(f"h{i}", f"k{i % 40}", i / 50, i) for i in range(50)]
    tables = {
        "scores": spark.createDataFrame(rows, "hash string, hotkey string, score double, ord int"), "epochs": spark.createDataFrame([(f"k{i}", i) for i in range(30)], "hotkey string, epoch long"),
        "statuses": spark.createDataFrame([(f"k{i}", 5, "s") for i in range(20)], "hotkey string, epoch long, status string"), "hashes": spark.createDataFrame([(f"k{i}", 5, f"x{i}") for i in range(10)], "hotkey string, epoch long, hash string"),
    }
    kept = {name: shared.bucketed(df, name, "hotkey", 4) for name, df in tables.items()}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for read in (lambda t: reads.submissions(t["scores"], t["epochs"], t["statuses"], 5), lambda t: reads.agents(t["scores"].select("hotkey"), t["scores"], t["epochs"], t["statuses"], t["hashes"], 5), lambda t: reads.logs(t["scores"], t["hashes"].selectExpr("hotkey", "array(hash) AS logs"), 5)):
            out = read(kept)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Bucketed: true" in plan, plan
            assert sorted(map(str, out.collect())) == sorted(map(str, read(tables).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
