"""Every registered query against its SQL, where the driver's tables are there."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return made


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str([str(v) for v in r]) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", OWN)
def test_query_agrees_with_its_sql(spark, duck, name):
    mine, theirs = entry.queries()[name](spark, DIR).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("op") and n not in ("pipeline", "training_rows")])
def test_queries_without_sql_have_rows(spark, name):
    found = entry.queries()[name](spark, DIR)
    assert found.columns and found.count() >= (0 if name == "hit_chunks" else 1)


def test_all_pushes_literals_to_the_scan(spark):
    plan = entry.queries()["scan_substring"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(text,of the)" in plan and "n_chars" not in plan


def test_chunks_against_the_spans_of_each_text(spark):
    from gleaner.operators.chunking import chunk_spans

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    expected = {(i, k, *span) for i, t in texts.items() for k, span in enumerate(chunk_spans(t.encode()))}
    got = entry.queries()["chunk_table"](spark, DIR).collect()
    assert {(r["wal_entry_id"], r["chunk_id"], r["byte_start"], r["byte_end"], r["line_start"], r["line_end"]) for r in got} == expected
    assert all(r["text"] == texts[r["wal_entry_id"]].encode()[r["byte_start"] : r["byte_end"]].decode() for r in got)
