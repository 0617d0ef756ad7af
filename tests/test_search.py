import json

import pytest

from siftline.operators import search as S
from siftline.operators.index import Index
from siftline.plans.errors import FieldNotFound
from siftline.plans.request import Boost, Part, PhraseBoost, Request, SearchParams, SnippetInfo, Tree

DOCS = [
    {"commonness": 20, "ent": "A", "tags": ["nice", "cool"], "meanings": {"eng": ["the urge to go", "desire"]}, "addr": [{"line": ["one", "two"]}], "flag": True, "num": 5.123},
    {"commonness": 551, "ent": "B", "tags": ["nice"], "meanings": {"eng": ["majestic view", "Majestät"]}, "nested": [{"t": "high", "rank": 9}, {"t": "low", "rank": 1}]},
    {"commonness": 1, "ent": "C", "meanings": {"eng": ["urgent matter", "the will"]}, "nested": [{"t": "high", "rank": 2}]},
    {"ent": "D", "mixed": [{"x": 1}, "plain"], "meanings": {"eng": None}},
]
CONFIG = json.dumps({"commonness": {"boost": True}, "nested[].rank": {"boost": True}, "ent": {"fulltext": {"tokenize": False}}})
ENG = "meanings.eng[]"


@pytest.fixture(scope="module")
def index(spark):
    return Index.from_lines(spark, [json.dumps(d) for d in DOCS], CONFIG)


def ids(index, node, **more):
    return S.search(index, Request(search_req=node, **more)).ids


def score(index, node, **more):
    return {r["doc_id"]: r["score"] for r in S.search(index, Request(search_req=node, **more)).found.collect()}


def test_exact_case_and_missing_field(index):
    assert ids(index, Part(ENG, ("urge",))) == [0]
    assert ids(index, Part(ENG, ("Urge",))) == [0] and ids(index, Part(ENG, ("Urge",), ignore_case=False)) == []
    assert ids(index, Part("flag", ("true",))) == [0] and ids(index, Part("num", ("5.123",))) == [0]
    assert ids(index, Part("addr[].line[]", ("two",))) == [0] and ids(index, Part("mixed[]", ("plain",))) == [3]
    with pytest.raises(FieldNotFound):
        ids(index, Part("nope", ("x",)))


def test_fuzzy_prefix_regex_swap(index):
    assert set(ids(index, Part(ENG, ("urgf",), levenshtein_distance=1))) == {0}
    assert set(ids(index, Part(ENG, ("majes",), starts_with=True))) == {1}
    assert set(ids(index, Part(ENG, (".*gent",), is_regex=True))) == {2}
    assert ids(index, Part(ENG, ("ugre",), levenshtein_distance=1, ignore_case=True)) == [0]
    assert ids(index, Part(ENG, ("ugre",), levenshtein_distance=1)) == []


def test_set_operations_and_filters(index):
    the, urge = Part(ENG, ("the",)), Part(ENG, ("urge",))
    assert set(ids(index, Tree("or", (the, urge)))) == {0, 2} and ids(index, Tree("and", (the, urge))) == [0]
    assert ids(index, the, filter=Part("ent", ("C",))) == [2]
    both, one = score(index, Tree("or", (the, urge)))[0], score(index, the)[0] + score(index, urge)[0]
    assert both == pytest.approx(4 * one)
    assert ids(index, Tree("or", (the, urge)), top=1) == [0] and ids(index, the, skip=100) == []


def test_boosts(index):
    plain = score(index, Part("tags[]", ("nice",)))
    log = score(index, Part("tags[]", ("nice",)), boost=(Boost("commonness", "Add", 2.0),))
    assert log[0] == pytest.approx(plain[0] + 22) and log[1] == pytest.approx(plain[1] + 553)
    assert ids(index, Part("tags[]", ("nice",)), boost=(Boost("commonness", "Replace"),)) == [1, 0]
    low, high = score(index, Part("nested[].t", ("high",))), score(index, Part("nested[].t", ("high",)), boost=(Boost("nested[].rank", "Add"),))
    assert high[1] - low[1] == pytest.approx(9) and high[2] - low[2] == pytest.approx(2)
    term = score(index, Part("tags[]", ("nice",)), boost_term=(Part("ent", ("B",)),))
    assert term[1] == pytest.approx(2 * plain[1]) and term[0] == pytest.approx(plain[0])


def test_phrase_and_locality(index):
    a, b = Part(ENG, ("the",)), Part(ENG, ("urge",))
    base = score(index, Tree("or", (a, b)))
    assert score(index, Tree("or", (a, b)), phrase_boosts=(PhraseBoost(a, b),))[0] == pytest.approx(5 * base[0])
    near = score(index, Tree("or", (a, b)), text_locality=True)
    assert near[0] == pytest.approx(8 * base[0]) and near[2] == pytest.approx(base[2])


def test_facets_suggest_select_explain_highlight(index):
    result = S.search(index, SearchParams(search_term="nice", fields=("tags[]",), facets=("tags[]",)))
    assert result.num_hits == 2 and result.facets == {"tags[]": [("nice", 2), ("cool", 1)]}
    assert [r["text"] for r in S.suggest_text(index, "maj", fields=(ENG,)).collect()][0].startswith("maj")
    row = S.search(index, Request(search_req=Part(ENG, ("urge",)), select=("ent", "commonness"), why_found=True)).data.first()
    assert json.loads(row["doc"]) == {"commonness": "20", "ent": "A"} and row["why_found"][ENG] == ["the <b>urge</b> to go"]
    kinds = {r["kind"] for r in S.explain(index, Request(search_req=Tree("or", (Part(ENG, ("urge",)), Part(ENG, ("the",)))))).collect()}
    assert {"LevenshteinScore", "TermToAnchor", "OrSumOverDistinctTerms"} <= kinds
    assert S.highlight(index, Part(ENG, ("urge",), snippet_info=SnippetInfo(snippet_start_tag="[", snippet_end_tag="]"))).first()["snippet"] == "the [urge] to go"
    assert "FieldSearch" in S.explain_plan(index, Request(search_req=Part(ENG, ("urge",))))


def test_stored_index_gives_the_same(index, spark, tmp_path):
    index.add_token_values(ENG, [{"text": "urge", "value": 20}, {"text": "absent", "value": 1}])
    index.save(str(tmp_path / "idx"))
    other = Index.load(spark, str(tmp_path / "idx"))
    node = Tree("or", (Part(ENG, ("urge",), levenshtein_distance=1), Part(ENG, ("the",))))
    assert score(other, node) == score(index, node)
    boosted = Part(ENG, ("urge",), token_value=Boost("", "Multiply"))
    assert score(other, boosted)[0] == pytest.approx(20 * score(other, Part(ENG, ("urge",)))[0])
    assert other.num_docs() == 4 and other.get_document(3)["ent"] == "D"


def test_empty_index(spark):
    index = Index.create(spark)
    assert index.num_docs() == 0 and index.paths == []
