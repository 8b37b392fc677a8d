import math
import random

import pytest

from quarrymill.operators import evaluation
from quarrymill.sources.consensus_table import ConsensusTable

SCHEMA = "g string, s double, at long"


def shown(df):
    """Rows by group, numbers to rounding."""
    number = lambda x: None if x is None else "nan" if math.isnan(x) else round(x, 9)
    return sorted(((str(r["g"]), number(r["final_score"]), number(r["agreement"]), r["n_scores"], r["outliers"]) for r in df.collect()), key=str)


def test_equals_the_consensus_over_all_rows_after_each_batch(spark, tmp_path):
    rng, log = random.Random(5), []
    table = ConsensusTable(spark, str(tmp_path / "t"), SCHEMA, "g", "s", "at")
    assert table.read().collect() == [] and table.compact() == -1
    for batch in range(8):
        n = 0 if batch == 3 else rng.randrange(1, 60)
        groups = ["hot", "hot", "hot", "a", "b", None] + (["new"] if batch > 4 else [])
        rows = [(rng.choice(groups), rng.choice([None, 0.5, round(rng.random(), 3)]), 100 * batch + i) for i in range(n)]
        if batch == 6:
            rows += [("odd", float("nan"), 690), ("odd", 0.5, 691), ("none", None, 692)]
        rng.shuffle(rows)
        assert table.append(spark.createDataFrame(rows, SCHEMA), batch)
        assert not table.append(spark.createDataFrame(rows, SCHEMA), batch)  # sent again: nothing happens
        log += rows
        assert shown(table.read()) == shown(evaluation.consensus(spark.createDataFrame(log, SCHEMA), "g", "s", "at")), batch
        if batch in (2, 6):
            assert table.compact() == batch
            assert shown(table.read()) == shown(evaluation.consensus(spark.createDataFrame(log, SCHEMA), "g", "s", "at"))
    assert [r for r in shown(table.read()) if r[0] in ("odd", "none")] == [("none", None, 0.0, 1, []), ("odd", "nan", 0.0, 2, [0, 1])]
    # files that were never finished don't count
    spark.createDataFrame([("a", 0, 9.0)], "g string, place long, s double").write.parquet(str(tmp_path / "t/rows/batch=8"))
    assert shown(table.read()) == shown(evaluation.consensus(spark.createDataFrame(log, SCHEMA), "g", "s", "at"))
    with pytest.raises(ValueError):
        table.append(spark.createDataFrame([], SCHEMA), -1)


def test_a_read_sorts_no_rows(spark, tmp_path):
    table = ConsensusTable(spark, str(tmp_path / "t"), SCHEMA, "g", "s", "at")
    table.append(spark.createDataFrame([("a", 0.1, 1), ("a", 0.9, 2)], SCHEMA), 0)
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
