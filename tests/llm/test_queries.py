"""The queries of the ten operators on the driver's small tables, against SQL where there is some."""

import os

import duckdb
import pytest

from gleaner.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, DIR).toPandas()
    if name not in ORACLE_SQL:
        assert len(found)
        return
    duck = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    expected = duck.execute(ORACLE_SQL[name]).df()
    rows = lambda f: sorted(str([str(v) for v in r]) for r in f[sorted(f.columns)].itertuples(index=False))
    assert sorted(found.columns) == sorted(expected.columns) and rows(found) == rows(expected)
