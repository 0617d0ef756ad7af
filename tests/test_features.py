"""Features around searching: saved indices, parameters, settings of fields, rebuilt documents, tools."""

import json

import pytest
from pyspark.sql import functions as F

from siftline import cli
from siftline.functions.highlight import highlight_text, snippet
from siftline.functions.stopwords import stopword_set
from siftline.operators import combine, flatten, match
from siftline.operators import search as S
from siftline.operators.index import Index
from siftline.plans.errors import FieldNotFound, InvalidConfig, InvalidRequest
from siftline.plans.generator import search_params, search_request
from siftline.plans.language import ParserOptions, parse, tokenize
from siftline.plans.request import Boost, Options, Part, Request, SearchParams, SnippetInfo, Tree
from siftline.sources import readers

DOCS = [
    {"title": "green garden", "tags": ["fresh", "tall"], "rooms": [{"name": "hall", "doors": ["oak", "ash"]}, {"name": "attic"}], "size": 3},
    {"title": "Green house", "tags": ["fresh"], "rooms": [{"name": "cellar", "doors": ["pine"]}], "size": 12.5, "open": True},
    {"title": "a red barn", "size": -4},
]
CONFIG = json.dumps({"size": {"boost": True}, "title": {"features": ["Search", "Select"]}, "tags[]": {"disabled_features": ["Facets", "Select"]}})


@pytest.fixture(scope="module")
def index(spark):
    return Index.from_lines(spark, [json.dumps(d) for d in DOCS], CONFIG)


@pytest.fixture(scope="module")
def saved(spark, index, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("saved") / "index")
    index.save(path)
    return Index.load(spark, path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_saved_dictionary_and_postings_get_pushed_filters(saved):
    assert "EqualTo(term_lc,green)" in plan(match.matched_terms(saved, Part("title", ("Green",))))
    assert "StringStartsWith(term_lc,gre)" in plan(match.matched_terms(saved, Part("title", ("gre",), starts_with=True)))
    case = plan(match.matched_terms(saved, Part("title", ("Green",), ignore_case=False)))
    assert "EqualTo(term_lc,green)" in case and "EqualTo(term,Green)" in case
    found = plan(match.posted(saved, Part("title", ("green",))))
    assert "In(term, [Green,green])" in found and "path=title" in found.replace(" ", "").replace("path#", "path=") or "title" in found
    assert {r["doc_id"] for r in match.leaf_hits(saved, Part("title", ("green",))).collect()} == {0, 1}


def test_more_terms_than_listed_are_joined(saved, monkeypatch):
    part = Part("title", (".*",), is_regex=True)
    listed = {tuple(r) for r in match.leaf_hits(saved, part).collect()}
    monkeypatch.setattr(match, "MAX_LISTED_TERMS", 1)
    assert {tuple(r) for r in match.leaf_hits(saved, part).collect()} == listed and len(listed) == 3


def test_rebuilt_documents(index, saved):
    want = {"title": "green garden", "tags": ["fresh", "tall"], "rooms": [{"name": "hall", "doors": ["oak", "ash"]}, {"name": "attic"}], "size": "3"}
    assert index.get_rebuilt(0) == want and saved.get_rebuilt(0) == want and index.get_rebuilt(99) == {}
    assert {r["doc_id"] for r in index.rebuilt().collect()} == {0, 1, 2}
    assert flatten.assemble([("a[][]", [0, 1], "x"), ("a[][]", [0, 0], "y"), ("b", [], "z")]) == {"a": [["y", "x"]], "b": "z"}


def test_select_leaves_out_unknown_and_unselectable_fields(index):
    row = S.search(index, Request(search_req=Part("title", ("garden",)), select=("rooms[].doors[]", "nope", "tags[]", "size"))).data.first()
    assert json.loads(row["doc"]) == {"rooms": [{"doors": ["oak", "ash"]}], "size": "3"}
    with pytest.raises(FieldNotFound):
        S.facet_counts(index, S.search(index, Request(search_req=Part("title", ("green",)))).found, (S.Facet("tags[]"),))
    with pytest.raises(InvalidConfig):
        Index.create(index.spark).config.parse('{"a": {"features": ["Search"], "disabled_features": ["Facets"]}}')


def test_explanations_by_request(index):
    tree = Tree("or", (Part("title", ("green",)), Part("tags[]", ("fresh",))))
    rows = S.search(index, Request(search_req=tree, explain=True)).data.collect()
    assert [len(r["explain"]) for r in rows] == [5, 5]
    one = S.search(index, Request(search_req=Part("title", ("garden",), options=Options(explain=True)))).data.first()
    assert [e["kind"] for e in one["explain"]] == ["LevenshteinScore", "TermToAnchor"]
    assert "explain" not in S.search(index, Request(search_req=tree)).data.columns
    shown = S.highlight(index, Part("title", ("garden",), options=Options(explain=True))).first()
    assert [e["kind"] for e in shown["explain"]] == ["MaxTokenToTextId"] and shown["explain"][0]["value"] == pytest.approx(10)


def test_filters_of_both_kinds_and_empty_trees(index):
    ids = lambda node: {r["doc_id"] for r in combine.filter_ids(index, node).collect()}
    fresh, tall = Part("tags[]", ("fresh",)), Part("tags[]", ("tall",))
    assert ids(Tree("and", (fresh, tall))) == {0} and ids(Tree("or", (fresh, tall))) == {0, 1} and ids(Tree("or", ())) == set()
    assert combine.scored(index, Tree("and", ())).count() == 0
    with pytest.raises(InvalidRequest):
        S.search(index, "{}")


def test_boost_terms_are_kept_and_dropped_in_turn(spark):
    index = Index.from_lines(spark, [json.dumps(d) for d in DOCS])
    part = Part("title", ("green",))
    for n in range(12):
        S.search(index, Request(search_req=part, boost_term=(Part("tags[]", ("fresh" if n == 0 else f"x{n}",)),)))
    assert len(index._boost_terms) == 10
    twice = Request(search_req=part, boost_term=(Part("title", ("green house",), boost=3.0),))
    first, again = ({r["doc_id"]: r["score"] for r in S.search(index, twice).found.collect()} for _ in range(2))
    assert first == again and first[1] > first[0]
    index._boost_terms[next(iter(index._boost_terms))] = (-1e9, spark.range(1))
    S.search(index, Request(search_req=part, boost_term=(Part("tags[]", ("y",)),)))
    assert all(since > -1e9 for since, _ in index._boost_terms.values())


def test_url_and_json_parameters(index):
    given = search_params("?query=green&fields=title,tags[]&levenshtein=0&top=5&boost_fields=title->2.5&boost_terms=tags[]:fresh->3,tall&why_found=true&phrase_pairs=TRUE&explain=false&stopwords=a,b&filter=x&select=title&unknown=1")
    assert given.search_term == "green" and given.fields == ("title", "tags[]") and given.levenshtein == 0 and given.top == 5 and given.boost_fields == {"title": 2.5}
    assert given.boost_terms == {"tags[]:fresh": 3.0, "tall": 2.0} and given.why_found and given.phrase_pairs and given.explain is False and given.stopwords == {"a", "b"} and given.select == ("title",)
    raw = search_params({"search_term": "x", "boost_queries": '[{"path": "size", "boost_fun": "Add"}]', "parser_options": {"no_levensthein": True}, "facetlimit": 2})
    assert raw.boost_queries == (Boost("size", "Add"),) and raw.parser_options == ParserOptions(no_levenshtein=True) and raw.facetlimit == 2
    for wrong in ("query=a&top=x", "query=a&boost_fields=title->y", "query=a&boost_queries=[", "{"):
        with pytest.raises(InvalidRequest):
            search_params(wrong)
    found = S.search(index, search_params("query=green&fields=title&levenshtein=0"))
    assert set(found.ids) == {0, 1}
    with pytest.raises(FieldNotFound):
        search_request(index.info, SearchParams(search_term="green", facets=("nope",)))


def test_parser_options_and_tokens():
    assert str(parse("a:b~1", ParserOptions(no_attributes=True))) == '"a:b"~1'
    assert str(parse("(a~1", ParserOptions(no_parentheses=True))) == '"(a"~1'
    assert str(parse("a~1 b", ParserOptions(no_levenshtein=True))) == '("a~1" OR "b")'
    assert [(t.kind, t.text) for t in tokenize('f:"x y" AND (z~2)')] == [("attribute", "f"), ("literal", "x y"), ("and", "AND"), ("(", "("), ("literal", "z"), ("~", "~"), ("literal", "2"), (")", ")")]


def test_snippets_and_stop_words():
    tokens = [x for n in range(40) for x in (f"w{n}", " ")]
    info = SnippetInfo(num_words_around_snippet=1, snippet_start_tag="[", snippet_end_tag="]")
    assert snippet(tokens, [40], info) == " ... w19 [w20] w21 ... " and snippet(tokens, [0], info) == "[w0] w1 ... "
    # hits ten tokens apart, here two, have windows of their own, and each window tags all hits in it
    assert snippet(tokens, [0, 2, 40], info) == "[w0] [w1] ... [w0] [w1] w2 ... w19 [w20] w21 ... "
    assert highlight_text("one two", {"one two"}) == "<b>one two</b>" and highlight_text("one two", {"three"}) is None
    assert highlight_text("a/b", {"b"}, chars="/") == "a/<b>b</b>" and highlight_text("a b", {"b"}, tokenize=False) is None
    assert {"upon", "mr", "men"} <= stopword_set("en") and len(stopword_set("en")) == 100 and "siehe" in stopword_set("de")
    with pytest.raises(InvalidRequest):
        stopword_set("xx")


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(' [ {"x": 1, "y": [1, 2]},\n {"x": "ü"} ] ')
    (tmp_path / "b.json").write_text('{"x": 2}\n{"x": 3}')
    (tmp_path / "c.csv").write_text("x,y\n1,one\n2,\n")
    docs = readers.read_json_array(spark, str(tmp_path / "a.json"))
    assert [json.loads(r["doc"]) for r in docs.orderBy("doc_id").collect()] == [{"x": 1, "y": [1, 2]}, {"x": "ü"}]
    assert [r["doc_id"] for r in readers.read_json_array(spark, str(tmp_path / "b.json")).orderBy("doc_id").collect()] == [0, 1]
    assert [json.loads(r["doc"]) for r in readers.read_csv(spark, str(tmp_path / "c.csv")).orderBy("doc_id").collect()] == [{"x": "1", "y": "one"}, {"x": "2"}]
    given = readers.from_dataframe(spark.range(5).select(F.lit("t").alias("t")))
    assert sorted(r["doc_id"] for r in given.collect()) == list(range(5))
    assert readers.read_json_lines(spark, str(tmp_path / "b.json")).count() == 2


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in.json").write_text(json.dumps(DOCS))
    (tmp_path / "conf.toml").write_text('["title"]\nfacet = true\n')
    cli.main(["convert-json", "--input", str(tmp_path / "in.json"), "--output", str(tmp_path / "lines")], spark)
    cli.main(["create-index", "-d", str(tmp_path / "lines"), "-t", str(tmp_path / "idx"), "-c", str(tmp_path / "conf.toml")], spark)
    assert Index.load(spark, str(tmp_path / "idx")).config.of("title").facet
    capsys.readouterr()
    cli.main(["search", str(tmp_path / "idx"), "query=title:barn&levenshtein=0"], spark)
    assert [json.loads(x)["doc"]["title"] for x in capsys.readouterr().out.splitlines() if x.startswith("{")] == ["a red barn"]


def test_term_ids_and_numbers_of_elements(index, spark):
    ids = {r["term"]: r["term_id"] for r in index.term_ids.where("path = 'title'").collect()}
    assert sorted(ids, key=lambda t: t.encode()) == sorted(ids, key=ids.get) and sorted(ids.values()) == list(range(len(ids)))
    assert index.term_texts("title", [ids["red"]]) == {ids["red"]: "red"}
    rows = flatten.element_ids(index.leafs.where("path = 'rooms[].doors[]'"), span=1).orderBy("value_id").collect()
    assert [(r["value_id"], r["value"]) for r in rows] == [(0, "oak"), (1, "ash"), (2, "pine")]
