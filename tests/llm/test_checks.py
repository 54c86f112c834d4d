"""The columns that SQL can express, held against DuckDB on the smallest tables."""

import glob
import os

import pytest

from quillspark.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_columns_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rows = con.execute(queries.oracle_sql()[name])
    at = [d[0] for d in rows.description]
    assert sorted(at) == cols
    expected = sorted(str(tuple(r[at.index(c)] for c in cols)) for r in rows.fetchall())
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == expected
