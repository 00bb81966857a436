import os

import pytest

import __spark_entry__ as driver

SMALL = "/root/testdata/sf0.001"


def test_every_query_has_a_name_and_sql():
    base = {n for n in driver.queries() if n not in driver.MORE_QUERIES}
    assert base == set(driver.oracle_sql()) - set(driver.MORE_SQL)
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize(
    "name",
    ["topk_exact", "topk_upto", "lsh_candidates", "lsh_append", "keyword_extract", "pairs_keyword", "global_stats", "coverage"]
    + ["whole_stats", "sweep_topn", "sweep_size_perm", "error_stages", "external_without_first", "sink_signing_stats", "metric_summary"],
)
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    base = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got = driver.queries()[name](spark, SMALL)
    want = base.sql(driver.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(repr, (tuple(r) for r in got.select(*columns).collect())))
    assert rows == sorted(map(repr, want.select(", ".join(f'"{c}"' for c in columns)).fetchall()))
