"""Every registered core query runs on the smallest data and equals its SQL there."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CORE = {k: f for k, f in entry.queries().items() if "llm" not in f.__module__}
ORACLE = entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def _plain(df: pd.DataFrame) -> list[tuple]:
    def cell(x: object) -> str:
        if x is None or not hasattr(x, "__len__") and pd.isna(x):
            return "NULL"
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return repr(round(float(x), 6))
        return str(getattr(x, "replace", lambda **k: x)(tzinfo=None) if isinstance(x, pd.Timestamp) else x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    got = CORE[name](spark, DATA).toPandas()
    if name in ORACLE:
        want = duck.execute(ORACLE[name]).fetch_df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _plain(got) == _plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_takes_empty_tables(spark, tmp_path):
    for p in glob.glob(f"{DATA}/*.parquet"):
        spark.read.parquet(p).filter("false").coalesce(1).write.parquet(f"{tmp_path}/{os.path.basename(p)}")
    failed = {}
    for name in sorted(CORE):
        try:
            CORE[name](spark, str(tmp_path)).toPandas()
        except Exception as e:
            failed[name] = str(e)[:200]
    assert not failed
