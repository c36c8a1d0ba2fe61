import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
OWN = sorted(n for p in entry.PLANS for n in p.QUERIES)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", OWN)
def test_query_against_sql(spark, name):
    rows = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(rows.columns)
        return
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    expected = con.sql(sql).df()
    assert sorted(rows.columns) == sorted(expected.columns) and len(rows) == len(expected)

    def plain(df):
        df = df[sorted(df.columns)]
        return sorted(tuple("" if v is None or v is pd.NA or v != v else f"{float(v):.6g}" if isinstance(
            v, (int, float)
        ) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v) for v in r) for r in df.itertuples(index=False))

    assert plain(rows) == plain(expected)
