import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) > 160


def test_entry(spark):
    assert entry(spark).count() == 15


@pytest.mark.parametrize("key", ["f02_scores_by_language", "g10_locked_halves", "j02_best_threshold", "m18_merge_chunks"])
def test_against_oracle(spark, key):
    con = duckdb.connect()
    for name in ("documents", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    df = queries()[key](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    want = sorted(map(str, con.sql(oracle_sql()[key]).project(", ".join(f'"{c}"' for c in cols)).fetchall()))
    assert got == want


def test_plans_have_no_cartesian_product(spark):
    for key in ("e09_policy_grid", "f02_scores_by_language", "g01_max_confidence"):
        assert "CartesianProduct" not in queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
