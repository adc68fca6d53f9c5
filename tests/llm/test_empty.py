"""Every registered query of the subpackage takes empty tables."""

import glob
import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_every_query_takes_empty_tables(spark, tmp_path):
    from kildestrom.llm.queries import QUERIES

    for p in glob.glob(f"{DATA}/*.parquet"):
        spark.read.parquet(p).filter("false").coalesce(1).write.parquet(f"{tmp_path}/{os.path.basename(p)}")
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
