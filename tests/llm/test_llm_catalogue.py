"""The training-data queries that have SQL against it, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from folioforge.llm import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(row):
    return [None if v is None or v != v else round(float(v), 9) if isinstance(v, (int, float)) else str(v) for v in row]


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLE[name]})")
    rows = sorted(str(plain(r)) for r in got.select(*columns).collect())
    assert rows and rows == sorted(str(plain(r)) for r in want.fetchall())
