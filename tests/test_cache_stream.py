import random

from pyspark.sql import functions as F

from quarrymill.streaming import cache_stream, ttl_cache

SCHEMA = "key string, at double, ord long, is_insert boolean"


def write(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, ttl, late):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return cache_stream.replay(spark, cache_stream.hits(stream, "key", "at", "ord", "is_insert", ttl, late), f"{folder}/out", f"{folder}/check")


def states(spark, folder, variable):
    return spark.read.format("statestore").option("path", f"{folder}/check").option("stateVarName", variable).load().count()


def test_stream_equals_the_batch_with_late_events_and_null_times(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None, "c"]), float(t) + rng.choice((0, 0.25, 0.0001)), t, rng.random() < 0.3) for t in range(400)]
    rows += [("a", None, 1000, True), ("a", None, 1001, False), ("b", float("nan"), 1002, False), ("a", 5.0, 1003, True), ("a", 5.0, 1004, False), (None, 6.0, 1005, None), ("c", 7.0, None, False)]
    # each comes up to 40 seconds after its time
    order = sorted(rows, key=lambda r: (r[1] if r[1] == r[1] and r[1] is not None else 0.0) + rng.random() * 40)
    batches = [order[i : i + 80] for i in range(0, len(order), 80)] + [[("end", 1e6, 5000, True)]]
    write(spark, tmp_path, batches)
    got = run(spark, tmp_path, 10.0, 41.0)
    clean = [(k, None if t != t else t, o, bool(i)) for k, t, o, i in rows]
    want = ttl_cache.hits(spark.createDataFrame(clean, SCHEMA), "key", "at", "ord", F.col("is_insert"), 10.0)
    found = sorted((str(r["key"]), str(r["ord"]), r["hit"]) for r in got.collect())
    assert found == sorted((str(r["key"]), str(r["ord"]), r["hit"]) for r in want.collect())
    assert len({hit for *_, hit in found}) == 2
    # what the watermark has passed is no state any more: only the last key is left
    assert states(spark, tmp_path, "last") <= 1 and states(spark, tmp_path, "pending") <= 1


def test_state_falls_to_nothing_after_the_ttl(spark, tmp_path):
    keys = [(f"k{i}", float(i), i, True) for i in range(50)]
    write(spark, tmp_path, [keys, [("k1", 60.0, 100, False), ("tick", 70.0, 101, False)]])
    got = run(spark, tmp_path, 100.0, 1.0).collect()
    assert [(r["key"], r["hit"]) for r in got] == [("k1", True)]
    assert states(spark, tmp_path, "last") == 50
    write(spark, tmp_path, [[("tick", 1000.0, 102, False)], [("late", 3.0, 103, False), ("tick", 1000.5, 104, False)]])
    got = run(spark, tmp_path, 100.0, 1.0).collect()
    assert sorted((r["key"], r["ord"], r["hit"]) for r in got) == [("k1", 100, True), ("tick", 101, False)]
    assert states(spark, tmp_path, "last") == 0
