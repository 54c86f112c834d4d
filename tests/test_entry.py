"""Every query with SQL is held against DuckDB on the smallest tables."""

import glob
import os

import pytest

from quillspark import catalogue

DATA = "/root/testdata/sf0.001"
def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rows = con.execute(catalogue.oracle_sql()[name])
    at = [d[0] for d in rows.description]
    assert sorted(at) == cols
    expected = sorted(tuple(plain(r[at.index(c)]) for c in cols) for r in rows.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == expected


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
