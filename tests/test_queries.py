"""Every query of the reference's operators with SQL, against DuckDB on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from quarry import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in catalog.ORACLE_SQL:
        r = duck.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        assert got == Counter(tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())
