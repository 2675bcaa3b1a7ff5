"""Every registered query that has SQL gives the same rows as DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from searchlake import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    own = duckdb.connect()
    for t in TABLES:
        own.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return own


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = con.sql(catalog.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        if want[c].dtype.kind == "f":
            assert ((got[c].astype(float) - want[c].astype(float)).abs() <= 1e-9 * want[c].abs().clip(lower=1)).all(), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_term_scan_is_pruned(spark):
    """Terms and fields reach the scan of the stored postings, and only needed columns are read."""
    plan = catalog.q_match_or(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan or "term IN" in plan
    assert "locs" not in plan
