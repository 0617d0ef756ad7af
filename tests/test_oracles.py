"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("part", "documents", "orders", "lineitem", "conversations", "pages", "benchmark", "customer", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda x: f"{x:.4f}" if isinstance(x, float) else str(x)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), sorted(names)


OWN = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")


@pytest.mark.parametrize("name", OWN)
def test_matches_sql(spark, db, name):
    ours = entry.queries()[name](spark, SF)
    theirs = db.execute(entry.oracle_sql()[name])
    assert plain(ours.collect(), ours.columns) == plain(theirs.fetchall(), [d[0] for d in theirs.description])


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "score"]
