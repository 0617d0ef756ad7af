"""Index tables at odd inputs, and how the work grows."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from siftline.functions import text
from siftline.operators import combine, match, search, tables
from siftline.operators.config import Config
from siftline.operators.flatten import SCHEMA
from siftline.operators.index import Index
from siftline.plans.request import Part


def test_pairs_of_a_long_text_take_no_quadratic_time(spark):
    """40,000 words without a repeated pair; comparing each pair with each took minutes."""
    rows = spark.range(1).select(F.lit("t").alias("path"), F.col("id").alias("doc_id"), F.array().cast("array<int>").alias("pos"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: F.concat(F.lit("w"), i.cast("string")))).alias("value"))
    began = time.monotonic()
    assert tables.phrase_pairs(rows, Config()).count() == 39_999 and time.monotonic() - began < 20


def test_tables_of_odd_values(spark):
    """F1, F8: repeated places, empty values, arrays, own separators and fields that aren't cut."""
    rows = [("t", 1, [], "a b a"), ("t", 1, [], "b a"), ("t", 2, [], ""), ("t", 3, [], "a"), ("x[]", 4, [0], "a b"), ("x[]", 4, [1], "a"), ("u", 5, [], "a/b"), ("n", 6, [], "a b"), ("t", 7, [], None), ("t", 8, [], " – é")]
    leafs = spark.createDataFrame(rows, SCHEMA)
    config = Config.parse('{"u": {"fulltext": {"tokenize_on_chars": ["/"]}}, "n": {"fulltext": {"tokenize": false}}}')
    found = {(r["path"], r["doc_id"], tuple(r["pos"]), r["term"], r["at"], r["n_tokens"], r["times"], r["exact"]) for r in tables.entries(leafs, config).collect()}
    assert {("t", 1, (), "a", 0, 5, 2, False), ("t", 1, (), "b a", 0, 1, 1, True), ("t", 2, (), "", 0, 1, 1, True), ("x[]", 4, (0,), "b", 2, 3, 1, False), ("u", 5, (), "/", 1, 3, 1, False), ("t", 8, (), "é", 3, 4, 1, False)} <= found
    assert {x[3] for x in found if x[0] == "n"} == {"a b"}
    terms = {(r["path"], r["term"]): r["num_occ"] for r in tables.terms(leafs, config).collect()}
    assert terms["t", "a"] == 4 and terms["t", " "] == 5 and terms["x[]", "a"] == 2 and terms["t", ""] == 1
    assert {(r["path"], r["t1"], r["t2"], r["doc_id"]) for r in tables.phrase_pairs(leafs, config).collect()} == {("t", "a", "b", 1), ("t", "b", "a", 1), ("x[]", "a", "b", 4), ("u", "a", "b", 5), ("t", "–", "é", 8)}
    assert sorted(r["token"] for r in tables.token_texts(leafs.unionByName(leafs), config).where("path = 'u'").collect()) == ["/", "a", "b"]
    # in the array "a" has two places; the repeated place of document 1 counts once
    a = {(r["path"], r["doc_id"]): r["score"] for r in tables.postings(leafs, config).where("term = 'a'").collect()}
    one = {(r["path"], r["doc_id"]): r["score"] for r in tables.postings(leafs.where("value is null or value != 'b a'"), config).where("term = 'a'").collect()}
    assert a["t", 1] == one["t", 1] and a["x[]", 4] == one["x[]", 4]
    assert set(a) == {("t", 1), ("t", 3), ("x[]", 4), ("u", 5)}


def test_rows_of_a_term_stay_where_they_are(spark):
    """a join that shuffles by term sends all rows of a frequent one to one task."""
    rows = spark.range(50).select("id", F.array(F.struct(F.lit("R").alias("flag"), F.lit(2.0).alias("n"))).alias("lines"))
    index = Index.from_table(spark, rows, "id", config='{"lines[].n": {"boost": true}}')
    assert index.paths == ["lines[].flag", "lines[].n"]
    part = Part("lines[].flag", ("r",))
    found = match.posted(index, part)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and found.count() == 50
    # only the wanted field is taken apart
    assert "lines[].n" not in index.leafs_of("lines[].flag")._jdf.queryExecution().optimizedPlan().toString()
    assert {r["value"] for r in index.leafs_of("lines[].n").collect()} == {"2"} and index.leafs_of("absent").count() == 0


def test_equal_sums_are_equal_to_the_last_bit(spark):
    """F2: 0.1 + 0.2 + 0.3 ends in another bit than 0.3 + 0.2 + 0.1; terms are summed in their own order."""
    rows = lambda x: spark.createDataFrame([(i, x) for i in range(40)], "doc_id long, score double")
    frames = [("c", rows(0.3)), ("b", rows(0.2)), ("a", rows(0.1))]
    for order in (frames, frames[::-1]):
        assert {r["score"] for r in combine.union_scored(order).collect()} == {(0.1 + 0.2 + 0.3) * 3 * 3}


def test_texts_are_cut_some_bytes_at_a_time(monkeypatch):
    """a batch of long texts isn't cut as a whole, whose arrays take several times its bytes."""
    texts = pa.array(["aaaa", None, "b c", "", "d" * 30, "e", None])
    monkeypatch.setattr(text, "PIECE", 8)
    cut = list(text.pieces(texts))
    assert cut == [(0, 4), (4, 1), (5, 2)] and list(text.pieces(texts.slice(4))) == [(0, 1), (1, 2)] and list(text.pieces(texts.slice(0, 0))) == [(0, 0)]
    assert [x for lo, n in cut for x in text.split_batch(texts.slice(lo, n), text.SEPARATORS).to_pylist()] == text.split_batch(texts, text.SEPARATORS).to_pylist()


def test_a_page_of_texts_is_cut_before_it_is_sorted(spark):
    """snippets were made below the limit, so that all texts were sorted by ranges, whose samples went to the driver."""
    rows = spark.range(40).select("id", F.concat(F.lit("thwh word "), F.lpad(F.col("id").cast("string"), 2, "0")).alias("text"))
    found = search.highlight(Index.from_table(spark, rows, "id"), Part("text", ("thwh",), top=3, skip=2))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
    assert [(r["text"], r["snippet"]) for r in found.collect()] == [(f"thwh word {i:02}", f"<b>thwh</b> word {i:02}") for i in (2, 3, 4)]


def test_documents_of_one_value_are_not_grouped(spark, monkeypatch):
    """F8: entries of a term go through one shuffle in lists; with a document of two values they are grouped, as before."""
    rows = [("t", 1, [], "a b a"), ("t", 2, [], ""), ("t", 3, [], "a"), ("t", 4, [], "b a"), ("u", 1, [], "a/b"), ("u", 2, [], "a/b"), ("n", 6, [], "a b"), ("t", 7, [], None), ("t", 8, [], " – é"), ("t", 9, [], "a " * 60), ("t", 10, [], "a")]
    config = Config.parse('{"u": {"fulltext": {"tokenize_on_chars": ["/"]}}, "n": {"fulltext": {"tokenize": false}}}')
    leafs = spark.createDataFrame(rows, SCHEMA)
    found = lambda df: sorted((r["path"], r["term"], r["doc_id"], r["score"]) for r in df.collect())
    made = tables.postings(leafs, config)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate" in x and "doc_id#" in x] and "docs#" in plan
    monkeypatch.setattr(tables, "one_value_each", lambda leafs, ids: False)
    assert found(made) == found(tables.postings(leafs, config))
    monkeypatch.undo()
    assert tables.one_value_each(leafs) and not tables.one_value_each(leafs.unionByName(leafs.where("doc_id = 4")))
    empty = tables.postings(leafs.where("value is null"), config)
    assert empty.count() == 0 and empty.columns == ["path", "term", "doc_id", "score"]
    twice = spark.createDataFrame([(1, "a b"), (1, "b"), (2, "a")], "id long, t string")
    for rows, direct in ((twice, False), (twice.where("t != 'b'"), True)):
        index = Index.from_table(spark, rows, "id")
        assert ("docs#" in index.table("postings", "t")._jdf.queryExecution().executedPlan().toString()) == direct
        assert found(index.table("postings", "t")) == found(Index(spark, index.leafs).postings)
