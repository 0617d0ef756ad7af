"""Search queries over the driver's tables, one for each kind of operator, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import flatten, search
from .operators.index import Index
from .plans.generator import search_request
from .plans.request import Boost, Facet, Part, PhraseBoost, Request, SearchParams, Tree

Query = Callable[[SparkSession, str], DataFrame]
_PART = '{"p_retailprice": {"boost": true}, "p_brand": {"facet": true}}'
_ORDERS = '{"lines[].quantity": {"boost": true}}'


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_index(spark: SparkSession, sf_dir: str) -> Index:
    return Index.from_table(spark, table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand", "p_type", "p_retailprice"], _PART)


def document_index(spark: SparkSession, sf_dir: str) -> Index:
    return Index.from_table(spark, table(spark, sf_dir, "documents"), "doc_id", ["text", "source"])


def order_index(spark: SparkSession, sf_dir: str) -> Index:
    """Orders with their lines as a nested array."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity")).alias("line")
    )
    nested = lines.groupBy("o_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    nested = nested.select("o_orderkey", F.transform("lines", lambda x: F.struct(x["flag"].alias("flag"), x["quantity"].alias("quantity"))).alias("lines"))
    return Index.from_table(spark, nested, "o_orderkey", config=_ORDERS)


def chat_index(spark: SparkSession, sf_dir: str) -> Index:
    """Conversations with their turns as a nested array."""
    turn = F.struct("turn", "role", "text")
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return Index.from_table(spark, nested, "conv_id")


_INDEX = {"part": part_index, "documents": document_index, "orders": order_index, "conversations": chat_index}


def rounded(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.round("score", 4).alias("score"))


def _hits(table: str, request: Request) -> Query:
    """All documents that a request finds, or its page if it names ``top``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = search.search(_INDEX[table](spark, sf_dir), request)
        return rounded(result.found if request.top is None else search.page(result.found, request.top, request.skip))

    return run


def _one(part: Part, **more: object) -> Request:
    return Request(search_req=part, **more)


def _or(*queries: Part | Tree) -> Tree:
    return Tree("or", queries)


def _and(*queries: Part | Tree) -> Tree:
    return Tree("and", queries)


NAME_BLUE = Part("p_name", ("blue",))
NAME_BOLT = Part("p_name", ("bolt",))
#: Scores of ``blue`` in names at the scales of the tables.
SKIPPED = (13.0, 14.0, 15.0, 16.0)
_BOOSTS = {
    "boost_log10": Boost("p_retailprice", "Log10", 1.0),
    "boost_log2": Boost("p_retailprice", "Log2", 1.0),
    "boost_multiply": Boost("p_retailprice", "Multiply"),
    "boost_add": Boost("p_retailprice", "Add", 2.0),
    "boost_replace": Boost("p_retailprice", "Replace"),
    "boost_expression": Boost("p_retailprice", expression="$SCORE / 2"),
    "boost_skip_when_score": Boost("p_retailprice", "Add", skip_when_score=SKIPPED),
}
_LANGUAGE = SearchParams(search_term="p_name:blue AND p_type:ECONOMY OR p_name:green~1", levenshtein=0)
_SUGGEST = Request(suggest=(Part("p_name", ("bo",), starts_with=True), Part("p_type", ("s",), starts_with=True)), top=10)

REQUESTS: dict[str, tuple[str, Request]] = {
    "search_exact": ("documents", _one(Part("text", ("the",)), top=10)),
    "search_case_sensitive": ("documents", _one(Part("text", ("The",), ignore_case=False))),
    "search_fuzzy": ("part", _one(Part("p_name", ("bolts",), levenshtein_distance=2))),
    "search_prefix": ("part", _one(Part("p_name", ("bo",), starts_with=True))),
    "search_fuzzy_prefix": ("part", _one(Part("p_name", ("bru",), levenshtein_distance=1, starts_with=True))),
    "search_regex": ("part", _one(Part("p_name", (".*B[LO].*",), is_regex=True))),
    "search_part_boost": ("part", _one(Part("p_name", ("blue",), boost=3.0))),
    "search_or": ("documents", Request(search_req=_or(Part("text", ("the",)), Part("text", ("and",)), Part("source", ("src1",))), top=10)),
    "search_and": ("documents", Request(search_req=_and(Part("text", ("the",)), Part("source", ("src1",))))),
    "search_nested_tree": ("part", Request(search_req=_or(_and(NAME_BLUE, NAME_BOLT), Part("p_type", ("ECONOMY",))))),
    "paging": ("documents", _one(Part("text", ("and",)), top=10, skip=20)),
    "filter_ids": ("part", _one(NAME_BLUE, filter=_or(Part("p_brand", ("Brand#11",)), Part("p_brand", ("Brand#12",))))),
    **{name: ("part", _one(NAME_BLUE, boost=(b,))) for name, b in _BOOSTS.items() if name != "boost_skip_when_score"},
    # one of the two words leaves a score that is skipped, both together don't
    "boost_skip_when_score": ("part", Request(search_req=_or(NAME_BLUE, NAME_BOLT), boost=(_BOOSTS["boost_skip_when_score"],))),
    "boost_terms": ("part", _one(NAME_BLUE, boost_term=(Part("p_brand", ("Brand#11",), boost=4.0), Part("p_name", ("blue bolt",))))),
    "phrase_boost": ("part", Request(search_req=_or(NAME_BLUE, NAME_BOLT), phrase_boosts=(PhraseBoost(NAME_BLUE, NAME_BOLT),))),
    "text_locality": ("documents", Request(search_req=_or(Part("text", ("the",)), Part("text", ("and",))), text_locality=True)),
    "boost_sub_element": ("orders", _one(Part("lines[].flag", ("R",)), boost=(Boost("lines[].quantity", "Add"),))),
}


def search_query_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = part_index(spark, sf_dir)
    return rounded(search.search(index, search_request(index.info, _LANGUAGE)).found)


def stopword_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = document_index(spark, sf_dir)
    params = SearchParams(search_term="the OR que", stopword_lists=("en",), fields=("text",), levenshtein=0)
    return rounded(search.search(index, params).found)


def tokenize_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.tokens("text")).alias("at", "token"))
    return runs.groupBy("token").agg(F.count("*").alias("times"), F.countDistinct("doc_id").alias("docs"), F.sum(F.col("at").cast("long")).alias("places"))


def term_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_index(spark, sf_dir).table("terms", "p_name").select("term", "num_occ")


def anchor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted = document_index(spark, sf_dir).table("postings", "text")
    return posted.groupBy("term").agg(F.count("*").alias("docs"), F.sum("score").alias("total"), F.max("score").alias("best"))


def phrase_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_index(spark, sf_dir).table("phrase_pairs", "p_name").select("t1", "t2", "doc_id")


def facet_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = part_index(spark, sf_dir)
    return search.facet_counts(index, search.search(index, _one(NAME_BLUE)).found, (Facet("p_brand", 5), Facet("p_type", 5)))


def facet_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = chat_index(spark, sf_dir)
    return search.facet_counts(index, search.search(index, _one(Part("turns[].role", ("assistant",)))).found, (Facet("turns[].role", 10),))


def suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.suggest(part_index(spark, sf_dir), _SUGGEST).select("text", F.round("score", 4).alias("score"))


def nested_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flatten.element_ids(chat_index(spark, sf_dir).leafs.where("path = 'turns[].role'"))
    return rows.select("value_id", "doc_id", F.element_at("pos", 1).alias("at"), "value")


def select_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(part_index(spark, sf_dir), _one(NAME_BLUE, select=("p_name", "p_brand"), top=10)).data
    return found.select("doc_id", F.get_json_object("doc", "$.p_name").alias("p_name"), F.get_json_object("doc", "$.p_brand").alias("p_brand"))


def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.highlight(part_index(spark, sf_dir), NAME_BLUE)


def why_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(part_index(spark, sf_dir), _one(NAME_BLUE, why_found=True, top=10)).data
    return found.select("doc_id", F.round("score", 4).alias("score"), F.to_json("why_found").alias("why_found"))


def explain_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The explanation as a column of the documents found, asked for in the request."""
    request = Request(search_req=_or(NAME_BLUE, NAME_BOLT), explain=True, top=10)
    found = search.search(part_index(spark, sf_dir), request).data.select("doc_id", F.explode("explain").alias("e"))
    return found.select("doc_id", "e.kind", "e.path", "e.term", F.round("e.value", 4).alias("value"))


def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = Request(search_req=_or(NAME_BLUE, NAME_BOLT), boost=(_BOOSTS["boost_log10"],), top=10)
    return search.explain(part_index(spark, sf_dir), request).withColumn("value", F.round("value", 4))


def queries() -> dict[str, Query]:
    """The queries of this module; those of the other features are in :mod:`feature_queries`."""
    own = (search_query_language, stopword_query, tokenize_runs, term_dictionary, anchor_scores, phrase_pairs, facet_root, facet_nested, suggest, nested_flatten, select_fields, highlight, why_found, explain, explain_column)
    return {name: _hits(table, request) for name, (table, request) in REQUESTS.items()} | {f.__name__: f for f in own}


# --- the same in SQL

def class_sql(chars: str | None = None) -> str:
    return text.separator_class(chars).replace("'", "''")


def runs_sql(chars: str | None = None, grouped: bool = True) -> str:
    sep = class_sql(chars)
    return f"regexp_extract_all(value, '{sep}{'+' if grouped else ''}|[^{sep[1:]}+')"


_CLASS, _RUNS = class_sql(), runs_sql()
_PART_FIELDS = {"p_name": "p_name", "p_brand": "p_brand", "p_type": "p_type"}


def index_sql(table: str, key: str, fields: dict[str, str], chars: str | None = None) -> str:
    """CTEs leafs, toks, terms and postings of scalar columns of a table."""
    leafs = " UNION ALL ".join(f"SELECT '{path}' AS path, {key} AS doc_id, {column} AS value FROM {table} WHERE {column} IS NOT NULL" for path, column in fields.items())
    return f"""
WITH leafs AS ({leafs}),
runs AS (SELECT *, {runs_sql(chars)} AS r FROM leafs),
toks AS (SELECT path, doc_id, value, CASE WHEN len(r) >= 2 THEN r ELSE [] END AS toks FROM runs),
places AS (SELECT path, doc_id, unnest(toks) AS term, unnest(range(len(toks))) AS pos, len(toks) AS n FROM toks),
entries AS (
  SELECT path, doc_id, value AS term, 0 AS pos, 1 AS n, true AS exact FROM toks WHERE strlen(value) <= 64
  UNION ALL SELECT path, doc_id, term, min(pos), any_value(n), false FROM places GROUP BY path, doc_id, term),
terms AS (SELECT path, term, count(*) AS occ FROM (SELECT path, value AS term FROM toks WHERE strlen(value) <= 64 UNION ALL SELECT path, term FROM places) GROUP BY path, term),
factors AS (
  SELECT path, doc_id, term, CASE WHEN exact THEN 400.0::DOUBLE ELSE 2000.0::DOUBLE / (log2(pos + 10.0::DOUBLE) + 10.0::DOUBLE) END AS base,
    log10(occ + 1000.0::DOUBLE) - 2.0::DOUBLE AS m, log10(n + 10.0::DOUBLE) AS l FROM entries JOIN terms USING (path, term)),
scored AS (SELECT path, doc_id, term, floor(base / (m - 0.7::DOUBLE * (m - 1.0::DOUBLE)) / (l - 0.7::DOUBLE * (l - 1.0::DOUBLE)))::INTEGER AS s FROM factors),
postings AS (SELECT path, term, doc_id, CASE WHEN count(*) > 1 THEN max(s) + least(count(*), 5) ELSE max(s) END AS score FROM scored GROUP BY path, term, doc_id)"""


PARTS_SQL = index_sql("part", "p_partkey", _PART_FIELDS)
DOCS_SQL = index_sql("documents", "doc_id", {"text": "text", "source": "source"})


def fit_sql(term: str, prefix: bool = False) -> str:
    d = f"(CASE WHEN strlen(term) >= 255 THEN 255 ELSE levenshtein(lower(term), '{term.lower()}') END)::DOUBLE"
    near, far = f"2.0::DOUBLE / (log2({d} + 1.0::DOUBLE) + 0.2::DOUBLE)", f"2.0::DOUBLE / ({d} + 0.2::DOUBLE)"
    return f"CASE WHEN starts_with(lower(term), '{term.lower()}') THEN {near} ELSE {far} END" if prefix else far


def leaf_sql(path: str, term: str, where: str | None = None, prefix: bool = False, boost: float = 1.0) -> str:
    where = where or f"lower(term) = '{term.lower()}'"
    return f"(SELECT doc_id, max(fit * score / 100.0::DOUBLE) AS score FROM (SELECT term, ({fit_sql(term, prefix)}) * {boost}::DOUBLE AS fit FROM terms WHERE path = '{path}' AND {where}) JOIN (SELECT * FROM postings WHERE path = '{path}') USING (term) GROUP BY doc_id)"


def any_sql(*inputs: tuple[str, str]) -> str:
    rows = " UNION ALL ".join(f"SELECT doc_id, '{key}' AS k, score FROM {leaf}" for key, leaf in inputs)
    return f"(SELECT doc_id, sum(m) * count(*) FILTER (m >= 1e-5) * count(*) FILTER (m >= 1e-5) AS score FROM (SELECT doc_id, k, max(score) AS m FROM ({rows}) GROUP BY doc_id, k) GROUP BY doc_id)"


def all_sql(*leaves: str) -> str:
    rows = " UNION ALL ".join(f"SELECT doc_id, score FROM {leaf}" for leaf in leaves)
    return f"(SELECT doc_id, sum(score) AS score FROM ({rows}) GROUP BY doc_id HAVING count(*) = {len(leaves)})"


def scores_sql(base: str, found: str, tail: str = "", score: str = "score") -> str:
    return f"{base}\nSELECT doc_id, round({score}, 4) AS score FROM {found} AS found {tail}"


def _boosted(score: str) -> str:
    return scores_sql(PARTS_SQL, f"(SELECT doc_id, score, CAST(p_retailprice AS FLOAT)::DOUBLE AS v FROM {_BLUE} JOIN part ON doc_id = p_partkey)", score=score)


_BLUE, _BOLT = leaf_sql("p_name", "blue"), leaf_sql("p_name", "bolt")
_BEST = "ORDER BY found.score DESC, doc_id DESC LIMIT 10"
_THE, _AND, _SRC1 = leaf_sql("text", "the"), leaf_sql("text", "and"), leaf_sql("source", "src1")
_WORDS = f"(SELECT path, doc_id, list_filter(toks, lambda x: NOT regexp_matches(x, '^{_CLASS}')) AS w FROM toks)"
PAIRS_SQL = f"(SELECT DISTINCT path, t1, t2, doc_id FROM (SELECT path, doc_id, unnest(w[:-2]) AS t1, unnest(w[2:]) AS t2 FROM {_WORDS} WHERE len(w) >= 2))"
FLAG_HITS_SQL = """
WITH flags AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
occ AS (SELECT count(*) AS c FROM lineitem WHERE l_returnflag = 'R'),
anchor AS (SELECT floor(400.0::DOUBLE / (m - 0.7::DOUBLE * (m - 1.0::DOUBLE)) / (l - 0.7::DOUBLE * (l - 1.0::DOUBLE)))::INTEGER AS s FROM (SELECT log10(c + 1000.0::DOUBLE) - 2.0::DOUBLE AS m, log10(11.0::DOUBLE) AS l FROM occ)),
sums AS (SELECT l_orderkey AS doc_id, sum(CAST(l_quantity AS FLOAT)::DOUBLE) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT flags.doc_id, 10.0::DOUBLE * (s + CASE WHEN n > 1 THEN least(n, 5) ELSE 0 END) / 100.0::DOUBLE AS score, sums.q FROM flags JOIN sums USING (doc_id), anchor
"""


def _explained(boost: str, steps: tuple[str, ...]) -> str:
    """Steps of the scores of the best ten documents with ``blue`` or ``bolt``; ``boost`` makes the final score."""
    leaves = " UNION ALL ".join(
        f"SELECT doc_id, term, ({fit_sql(t)}) AS fit, score AS anchor FROM (SELECT * FROM terms WHERE path = 'p_name' AND lower(term) = '{t}') JOIN (SELECT * FROM postings WHERE path = 'p_name') USING (term)" for t in ("blue", "bolt")
    )
    rows = {
        "LevenshteinScore": "SELECT doc_id, 'LevenshteinScore' AS kind, 'p_name' AS path, term, fit AS value FROM leaves SEMI JOIN best USING (doc_id)",
        "TermToAnchor": "SELECT doc_id, 'TermToAnchor', 'p_name', term, fit * anchor / 100.0::DOUBLE FROM leaves SEMI JOIN best USING (doc_id)",
        "OrSumOverDistinctTerms": "SELECT doc_id, 'OrSumOverDistinctTerms', NULL, NULL, score FROM best",
        "Boost": "SELECT doc_id, 'Boost', NULL, NULL, final / score FROM best WHERE abs(final - score) > 1e-9",
    }
    return (
        f"{PARTS_SQL}, leaves AS ({leaves}), tree AS (SELECT doc_id, score FROM {any_sql(('blue', _BLUE), ('bolt', _BOLT))}),"
        f" best AS (SELECT doc_id, score, {boost} AS final FROM tree JOIN part ON doc_id = p_partkey ORDER BY final DESC, doc_id DESC LIMIT 10)"
        f" SELECT doc_id, kind, path, term, round(value, 4) AS value FROM ({' UNION ALL '.join(rows[s] for s in steps)})"
    )


def oracle_sql() -> dict[str, str]:
    prefixes = "list_bool_or(list_transform(range(2, least(5, length(term) + 1)), lambda k: levenshtein(left(lower(term), k), 'bru') <= 1)) AND length(term) >= 2"
    return {
        "search_exact": scores_sql(DOCS_SQL, _THE, _BEST),
        "search_case_sensitive": scores_sql(DOCS_SQL, leaf_sql("text", "The", "term = 'The'")),
        "search_fuzzy": scores_sql(PARTS_SQL, leaf_sql("p_name", "bolts", "levenshtein(lower(term), 'bolts') <= 2", True)),
        "search_prefix": scores_sql(PARTS_SQL, leaf_sql("p_name", "bo", "starts_with(lower(term), 'bo')", True)),
        "search_fuzzy_prefix": scores_sql(PARTS_SQL, leaf_sql("p_name", "bru", prefixes, True)),
        "search_regex": scores_sql(PARTS_SQL, leaf_sql("p_name", ".*B[LO].*", "regexp_full_match(term, '(?i).*B[LO].*')")),
        "search_part_boost": scores_sql(PARTS_SQL, leaf_sql("p_name", "blue", boost=3.0)),
        "search_or": scores_sql(DOCS_SQL, any_sql(("the", _THE), ("and", _AND), ("src1", _SRC1)), _BEST),
        "search_and": scores_sql(DOCS_SQL, all_sql(_THE, _SRC1)),
        "search_nested_tree": scores_sql(PARTS_SQL, any_sql(("blue", all_sql(_BLUE, _BOLT)), ("ECONOMY", leaf_sql("p_type", "ECONOMY")))),
        "paging": scores_sql(DOCS_SQL, _AND, _BEST + " OFFSET 20"),
        "filter_ids": scores_sql(PARTS_SQL, _BLUE, "WHERE doc_id IN (SELECT p_partkey FROM part WHERE lower(p_brand) IN ('brand#11', 'brand#12'))"),
        "boost_log10": _boosted("score * log10(v + 1.0::DOUBLE)"),
        "boost_log2": _boosted("score * log2(v + 1.0::DOUBLE)"),
        "boost_multiply": _boosted("score * v"),
        "boost_add": _boosted("score + (v + 2.0::DOUBLE)"),
        "boost_replace": _boosted("v"),
        "boost_expression": _boosted("score + v / 2.0::DOUBLE"),
        "boost_skip_when_score": scores_sql(
            PARTS_SQL,
            f"(SELECT doc_id, CASE WHEN list_bool_or(list_transform({list(SKIPPED)}, lambda x: abs(score - x) < 1e-5)) THEN score ELSE score + CAST(p_retailprice AS FLOAT)::DOUBLE END AS score "
            f"FROM {any_sql(('blue', _BLUE), ('bolt', _BOLT))} JOIN part ON doc_id = p_partkey)",
        ),
        "boost_terms": scores_sql(PARTS_SQL, f"(SELECT doc_id, score * CASE WHEN lower(p_brand) = 'brand#11' THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN lower(p_name) = 'blue bolt' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM {_BLUE} JOIN part ON doc_id = p_partkey)"),
        "phrase_boost": scores_sql(PARTS_SQL, f"(SELECT f.doc_id, f.score * CASE WHEN p.doc_id IS NULL THEN 1.0::DOUBLE ELSE 5.0::DOUBLE END AS score FROM {any_sql(('blue', _BLUE), ('bolt', _BOLT))} f LEFT JOIN (SELECT DISTINCT doc_id FROM {PAIRS_SQL} WHERE path = 'p_name' AND lower(t1) = 'blue' AND lower(t2) = 'bolt') p USING (doc_id))"),
        "text_locality": scores_sql(
            DOCS_SQL,
            f"(SELECT f.doc_id, f.score * CASE WHEN n > 1 THEN 2.0::DOUBLE * n * n ELSE 1.0::DOUBLE END AS score FROM {any_sql(('the', _THE), ('and', _AND))} f LEFT JOIN "
            "(SELECT doc_id, count(DISTINCT term) AS n FROM places WHERE path = 'text' AND lower(term) IN ('the', 'and') GROUP BY doc_id) t USING (doc_id))",
        ),
        "boost_sub_element": f"SELECT doc_id, round(score + q, 4) AS score FROM ({FLAG_HITS_SQL})",
        "search_query_language": scores_sql(
            PARTS_SQL, all_sql(_BLUE, any_sql(("ECONOMY", leaf_sql("p_type", "ECONOMY")), ("green", leaf_sql("p_name", "green", "levenshtein(lower(term), 'green') <= 1", True))))
        ),
        "stopword_query": scores_sql(DOCS_SQL, leaf_sql("text", "que")),
        "tokenize_runs": f"SELECT token, count(*) AS times, count(DISTINCT doc_id) AS docs, CAST(sum(pos) AS BIGINT) AS places FROM (SELECT doc_id, unnest(r) AS token, unnest(range(len(r))) AS pos FROM (SELECT doc_id, {_RUNS} AS r FROM (SELECT doc_id, text AS value FROM documents))) GROUP BY token",
        "term_dictionary": f"{PARTS_SQL} SELECT term, occ AS num_occ FROM terms WHERE path = 'p_name'",
        "anchor_scores": f"{DOCS_SQL} SELECT term, count(*) AS docs, CAST(sum(score) AS BIGINT) AS total, CAST(max(score) AS INTEGER) AS best FROM postings WHERE path = 'text' GROUP BY term",
        "phrase_pairs": f"{PARTS_SQL} SELECT t1, t2, doc_id FROM {PAIRS_SQL} WHERE path = 'p_name'",
        "facet_root": f"{PARTS_SQL} " + " UNION ALL ".join(
            f"(SELECT '{c}' AS field, {c} AS value, count(*) AS count FROM part WHERE p_partkey IN (SELECT doc_id FROM {_BLUE}) GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 5)" for c in ("p_brand", "p_type")
        ),
        "facet_nested": "SELECT 'turns[].role' AS field, role AS value, count(*) AS count FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE lower(role) = 'assistant') GROUP BY role ORDER BY count DESC, value LIMIT 10",
        "suggest": f"{PARTS_SQL} SELECT text, round(max(score), 4) AS score FROM (SELECT lower(term) AS text, {fit_sql('bo', True)} AS score FROM terms WHERE path = 'p_name' AND starts_with(lower(term), 'bo') "
        f"UNION ALL SELECT lower(term), {fit_sql('s', True)} FROM terms WHERE path = 'p_type' AND starts_with(lower(term), 's')) GROUP BY text ORDER BY max(score) DESC, text LIMIT 10",
        "nested_flatten": "SELECT row_number() OVER (ORDER BY conv_id, pos) - 1 AS value_id, conv_id AS doc_id, CAST(pos AS INTEGER) AS \"at\", role AS value FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos FROM conversations)",
        "highlight": "SELECT p_name AS text, replace(p_name, 'blue', '<b>blue</b>') AS snippet, 10.0::DOUBLE AS score FROM (SELECT DISTINCT p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'blue')) ORDER BY p_name LIMIT 10",
        "why_found": f"{PARTS_SQL} SELECT doc_id, round(f.score, 4) AS score, '{{\"p_name\":[\"' || replace(p_name, 'blue', '<b>blue</b>') || '\"]}}' AS why_found FROM (SELECT * FROM {_BLUE} ORDER BY score DESC, doc_id DESC LIMIT 10) f JOIN part ON doc_id = p_partkey",
        "explain": _explained("score * log10(CAST(p_retailprice AS FLOAT)::DOUBLE + 1.0::DOUBLE)", ("LevenshteinScore", "TermToAnchor", "OrSumOverDistinctTerms", "Boost")),
        "explain_column": _explained("score", ("LevenshteinScore", "TermToAnchor", "OrSumOverDistinctTerms")),
        "select_fields": f"{PARTS_SQL} SELECT p_partkey AS doc_id, p_name, p_brand FROM part WHERE p_partkey IN (SELECT doc_id FROM {_BLUE} ORDER BY score DESC, doc_id DESC LIMIT 10)",
    }
