"""Queries against their SQL on rows that the driver's small tables lack."""

import duckdb
import pytest

from quarrymill.plans import registry


@pytest.fixture
def agree(spark, tmp_path):
    """Writes tables (name to rows and schema) and compares a query over them with its SQL, row by row."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        df = registry.QUERIES[name](spark, str(tmp_path))
        found = con.execute(registry.ORACLE_SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        got = sorted(str(tuple(r[c] for c in names)) for r in df.collect())
        assert got == sorted(map(str, found.fetchall()))
        return got

    return run


TALK = "conv_id long, turn long, role string, text string"


def test_nodes_of_a_program_that_is_not_python(agree):
    words = ["abcdefghi", "bcdefghijk", "cdefghijklm", "defghijklmno"]
    rows = [(k, 0, "user", " ".join(words[:k])) for k in range(5)] + [(k, 1, "assistant", "so") for k in range(5)]
    got = agree("program_nodes", conversations=(rows, TALK))
    assert sum("None" in r for r in got) == 1


def test_scores_of_replies_are_rounded_as_stored(agree):
    rows = [(k, f"Supplier#{k}", 1 + k % 24, b) for k, b in enumerate((6395.5, 7151.5, 3000.5, 2999.5, 4000.25, 9999.5))]
    agree("status_views", supplier=(rows, "s_suppkey long, s_name string, s_nationkey long, s_acctbal double"))


def test_evaluation_of_talks_with_a_common_token(agree):
    rows = [(k, t, ("user", "assistant")[t % 2], " ".join(f"{'pqrstu'[t] * 3}{i * k % 11}" for i in range(8)) + (" so" if t == 0 else "")) for k in range(60) for t in range(2 + k % 4)]
    agree("dataset_evaluation", conversations=(rows, TALK))
    agree("conversation_pairs", conversations=(rows, TALK))


def test_similarity_of_a_half_is_rounded_as_in_the_sql(agree):
    """41 / 640 is 0.0640625; the double's product with 10 ** 6 is below the half."""
    words = [f"w{i}" for i in range(640)]
    rows = [(k, t, ("user", "assistant")[t], " ".join(words[:n])) for k, n in ((1, 41), (2, 640), (3, 5)) for t in range(2)]
    got = agree("conversation_pairs", conversations=(rows, TALK))
    assert len(got) == 3 and "(1, 2, 0.064062)" in got
