import duckdb
import pytest

SF = "/root/testdata/sf0.001"
llm = pytest.importorskip("siftline.llm.queries")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    ours = llm.queries()[name](spark, SF)
    theirs = con.execute(llm.oracle_sql()[name])
    cols = sorted(ours.columns)
    assert cols == sorted(d[0] for d in theirs.description)
    at = {d[0]: i for i, d in enumerate(theirs.description)}
    assert sorted(str([r[c] for c in cols]) for r in ours.collect()) == sorted(str([r[at[c]] for c in cols]) for r in theirs.fetchall())
