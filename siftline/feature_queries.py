"""More queries over the driver's tables, one for each feature that the main ones don't reach, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as main
from .functions import text
from .operators import flatten, search
from .operators.index import Index
from .plans.generator import search_params, search_request
from .plans.request import Boost, Facet, Options, Part, Request, SearchParams, SnippetInfo, Tree
from .queries import NAME_BLUE, NAME_BOLT, document_index, order_index, part_index, rounded, table
from .sources import readers
from .sources.shared import new_folder

Query = Callable[[SparkSession, str], DataFrame]
_URL_CHARS = "/:."
_URLS = '{"url": {"fulltext": {"tokenize_on_chars": ["/", ":", "."]}}}'
_JSON = """{"search_req": {"or": {"queries": [
    {"or": {"queries": [{"search": {"path": "p_name", "terms": ["blue"]}}, {"search": {"path": "p_type", "terms": ["promo"], "boost": 2.0}}]}},
    {"search": {"path": "p_name", "terms": ["bolt"]}}]}},
  "filter": {"search": {"path": "p_brand", "terms": ["Brand#1"], "starts_with": true}},
  "boost": [{"path": "p_retailprice", "boost_fun": "Log10", "param": 1.0}], "top": 20, "skip": 5, "unknown": 1}"""
_URL = "query=p_name:blue+OR+p_type:PROMO&levenshtein=0&boost_fields=p_type->3.0&top=15&facets=p_brand"


def _found(index: Index, request: Request | SearchParams | str) -> DataFrame:
    return rounded(search.search(index, request).found)


def _part(name: str, request: Request | SearchParams) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _found(part_index(spark, sf_dir), request)

    run.__name__ = name
    return run


def _names(term: str, **more: object) -> Request:
    return Request(search_req=Part("p_name", (term,), **more))


def _params(term: str, **more: object) -> SearchParams:
    return SearchParams(search_term=term, **more)


PART_REQUESTS: dict[str, Request | SearchParams] = {
    "search_swaps": _names("blot", levenshtein_distance=1, ignore_case=True),
    "search_regex_prefix": _names("B[LO]", is_regex=True, starts_with=True),
    "search_regex_case": _names(".*b[lo].*", is_regex=True, ignore_case=False),
    "search_prefix_case": _names("bo", starts_with=True, ignore_case=False),
    "search_leaf_top": _names("b", starts_with=True, top=3),
    "filter_and": Request(search_req=NAME_BLUE, filter=Tree("and", (Part("p_brand", ("Brand#1",), starts_with=True), Part("p_type", ("PROMO",))))),
    "tree_flattening": Request(search_req=Tree("or", (Tree("or", (NAME_BLUE, NAME_BOLT)), Part("p_type", ("PROMO",))))),
    "search_single_or": Request(search_req=Tree("or", (NAME_BLUE,))),
    "search_nothing": Request(search_req=Tree("and", (NAME_BLUE, Part("p_name", ("absent",))))),
    "generator_wildcard": _params("bl* OR *dget", fields=("p_name",), levenshtein=0),
    "generator_phrases": _params("blue bolt", fields=("p_name",), levenshtein=0, phrase_pairs=True),
    "generator_boost_terms": _params("p_name:blue", levenshtein=0, boost_terms={"p_brand:Brand#11": 4.0, "blue bolt": 3.0}),
    "generator_boost_fields": _params("blue", fields=("p_name", "p_brand"), levenshtein=0, boost_fields={"p_name": 2.5}),
    "generator_filter": _params("p_name:blue", levenshtein=0, filter="p_brand:Brand#11 OR p_type:PROMO"),
    "generator_auto_levenshtein": _params("p_name:bolts"),
    "generator_auto_limit": _params("p_name:widgats", levenshtein_auto_limit=2),
    "generator_group": _params("p_type:(PROMO OR LARGE) AND p_name:blue", levenshtein=0),
}


def token_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = part_index(spark, sf_dir)
    index.add_token_values("p_name", [{"text": "blue", "value": 20}, {"text": "bolt", "value": 3.5}, {"text": "absent", "value": 1}])
    return _found(index, _names("b", starts_with=True, token_value=Boost("", "Multiply")))


def tree_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = lambda flag: Part("lines[].flag", (flag,))
    tree = Tree("or", (leaf("R"), leaf("A")), Options(boost=(Boost("lines[].quantity", "Add"),)))
    return _found(order_index(spark, sf_dir), Request(search_req=tree))


def tokenize_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.tokens("text", grouped=False)).alias("at", "token"))
    return runs.groupBy("token").agg(F.count("*").alias("times"), F.sum(F.col("at").cast("long")).alias("places"))


def separators_of_a_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = Index.from_table(spark, table(spark, sf_dir, "pages"), "page_id", ["url"], _URLS)
    return _found(index, Request(search_req=Part("url", ("example",))))


def normalize_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalized("text").alias("normal"))


def json_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = search.search(part_index(spark, sf_dir), _JSON)
    return rounded(search.page(result.found, result.request.top, result.request.skip))


def url_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = part_index(spark, sf_dir)
    request = search_request(index.info, search_params(_URL))
    return rounded(search.page(search.search(index, request).found, request.top, request.skip))


def default_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.page(search.search(part_index(spark, sf_dir), Request(search_req=NAME_BLUE)).found))


def num_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.search(part_index(spark, sf_dir), Request(search_req=NAME_BLUE, top=3)).num_hits
    return spark.createDataFrame([(hits,)], "num_hits long")


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = part_index(spark, sf_dir)
    return spark.createDataFrame([(index.num_docs(), index.bytes_indexed())], "num_docs long, bytes_indexed long")


def term_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_index(spark, sf_dir).term_ids.select("path", "term", "term_id")


def inspect_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_index(spark, sf_dir).inspect("postings", path="p_name", term="blue").select("term", "doc_id", "score")


def doc_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = part_index(spark, sf_dir)
    found = [(i, index.get_document(i)) for i in (3, 7, -1)]
    return spark.createDataFrame([(i, d["p_name"], float(d["p_retailprice"])) for i, d in found if d], "doc_id long, p_name string, price double")


def no_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.search(part_index(spark, sf_dir), Request(search_req=NAME_BLUE, top=10)).data
    return rows.select("doc_id", F.get_json_object("doc", "$.p_type").alias("p_type"), F.get_json_object("doc", "$.p_retailprice").cast("double").alias("price"))


def select_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = Request(search_req=Part("lines[].flag", ("R",)), select=("lines[].flag", "no.such.field"), top=10)
    return search.search(order_index(spark, sf_dir), request).data.select("doc_id", "doc")


def rebuilt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_index(spark, sf_dir).rebuilt()


def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON texts of nested documents, walked leaf by leaf."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    rows = flatten.flatten_json(nested.select(F.col("conv_id").alias("doc_id"), F.to_json(F.struct("turns")).alias("doc")))
    return rows.select("path", "doc_id", F.element_at("pos", 1).alias("at"), "value")


def _leaves(index: Index) -> DataFrame:
    return index.leafs.groupBy("path", "value").agg(F.count("*").alias("n"))


def json_lines_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = new_folder(spark, "lines"), table(spark, sf_dir, "part")
    readers.write_json_lines(rows.select(F.col("p_partkey").alias("doc_id"), F.to_json(F.struct("p_name", "p_brand", "p_size")).alias("doc")), path)
    return _leaves(Index.from_file(spark, path))


def json_array_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "array")
    table(spark, sf_dir, "nation").select(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value")).write.text(path)
    docs = readers.read_json_array(spark, path)
    return _leaves(Index.from_docs(spark, docs))


def csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "csv")
    table(spark, sf_dir, "customer").select("c_name", "c_mktsegment").write.option("header", True).csv(path)
    return _leaves(Index.from_docs(spark, readers.read_csv(spark, path)))


def facet_all_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = part_index(spark, sf_dir)
    found = search.search(index, Request(search_req=NAME_BLUE)).found
    return search.facet_counts(index, found, (Facet("p_brand", None), Facet("p_name", 3)))


def stopwords_german(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(document_index(spark, sf_dir), _params("die OR que OR siehe", stopword_lists=("de",), fields=("text",), levenshtein=0))


def suggest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = Request(suggest=(Part("p_name", ("blut",), starts_with=True, levenshtein_distance=1),), top=4, skip=2)
    return search.suggest(part_index(spark, sf_dir), request).select("text", F.round("score", 4).alias("score"))


def highlight_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets out of long texts, the second page."""
    part = Part("text", ("thwh",), top=12, skip=3, snippet_info=SnippetInfo(snippet_start_tag="[", snippet_end_tag="]", max_snippets=3))
    return search.highlight(document_index(spark, sf_dir), part).select("text", "snippet", F.round("score", 4).alias("score"))


def _stored(spark: SparkSession, index: Index) -> Index:
    path = new_folder(spark, "index")
    index.save(path)
    return Index.load(spark, path)


def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written to Parquet and read back answers a tree of exact, prefix and fuzzy parts."""
    tree = Tree("or", (NAME_BLUE, Part("p_name", ("bo",), starts_with=True), Part("p_type", ("ECONOMI",), levenshtein_distance=1)))
    return _found(_stored(spark, part_index(spark, sf_dir)), Request(search_req=tree, boost=(Boost("p_retailprice", "Log10", 1.0),)))


def stored_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _stored(spark, document_index(spark, sf_dir))
    return _found(index, Request(search_req=Tree("and", (Part("text", ("the",)), Part("source", ("src1",)))), text_locality=True))


def memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index kept in memory."""
    return _found(part_index(spark, sf_dir).in_memory(), Request(search_req=Tree("or", (NAME_BLUE, NAME_BOLT))))


def index_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index over JSON lines given as one string."""
    rows = table(spark, sf_dir, "nation").select(F.to_json(F.struct("n_name", "n_regionkey")).alias("doc")).orderBy("n_nationkey").collect()
    index = Index.from_lines(spark, "\n".join(r["doc"] for r in rows) + "\n\n")
    return index.leafs.select("path", "doc_id", "value")


def select_long_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts longer than what a dictionary holds come back whole."""
    rows = search.search(document_index(spark, sf_dir), Request(search_req=Part("source", ("src1",)), select=("text",), top=5)).data
    return rows.select("doc_id", F.get_json_object("doc", "$.text").alias("text"), F.size(F.json_object_keys("doc")).alias("fields"))


def why_found_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = Request(search_req=Tree("or", (NAME_BLUE, Part("p_type", ("PROMO",)))), select=("p_brand",), why_found=True, top=10)
    rows = search.search(part_index(spark, sf_dir), request).data
    return rows.select("doc_id", "doc", F.element_at(F.col("why_found")["p_name"], 1).alias("name"), F.element_at(F.col("why_found")["p_type"], 1).alias("type"))


def stored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table of a saved index."""
    index = _stored(spark, part_index(spark, sf_dir))
    rows = [getattr(index, n).groupBy("path").agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "path", "n") for n in ("leafs", "terms", "postings", "phrase_pairs", "token_texts", "boosts")]
    out = rows[0]
    for df in rows[1:]:
        out = out.unionByName(df)
    return out


_OWN = (
    token_values, tree_options, tokenize_single, separators_of_a_field, normalize_texts, json_request, url_parameters, default_top, num_hits, counters, term_ids, inspect_postings, doc_by_id, no_select,
    select_nested, rebuilt_documents, json_flatten, json_lines_file, json_array_file, csv_file, facet_all_values, stopwords_german, suggest_page, highlight_page, stored_search, stored_search_text, memory_search, index_from_text, select_long_text, why_found_select, stored_tables,
)


def queries() -> dict[str, Query]:
    return {name: _part(name, request) for name, request in PART_REQUESTS.items()} | {f.__name__: f for f in _OWN}


# --- the same in SQL ---


def _names_leaf(fit: str, where: str) -> str:
    return f"(SELECT doc_id, max(fit * score / 100.0::DOUBLE) AS score FROM (SELECT term, {fit} AS fit FROM terms WHERE path = 'p_name' AND {where}) JOIN (SELECT * FROM postings WHERE path = 'p_name') USING (term) GROUP BY doc_id)"


_JSON_TEXT = "'{{\"p_name\":\"' || p_name || '\",\"p_brand\":\"' || p_brand || '\",\"p_type\":\"' || p_type || '\",\"p_size\":' || p_size || ',\"p_retailprice\":' || p_retailprice || '}}'".replace("{{", "{").replace("}}", "}")
_LINES = "SELECT l_orderkey AS doc_id, string_agg('{\"flag\": \"' || l_returnflag || '\"%s}', ', ' ORDER BY l_linenumber, l_returnflag, l_quantity) AS lines FROM lineitem GROUP BY 1"
_ANCHOR = "floor(400.0::DOUBLE / (m - 0.7::DOUBLE * (m - 1.0::DOUBLE)) / (l - 0.7::DOUBLE * (l - 1.0::DOUBLE)))::INTEGER"
_TREE_OPTIONS = f"""
WITH flags AS (SELECT l_orderkey AS doc_id, l_returnflag AS flag, count(*) AS n, sum(CAST(l_quantity AS FLOAT)::DOUBLE) AS q FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL),
anchors AS (SELECT flag, {_ANCHOR} AS s FROM (SELECT l_returnflag AS flag, log10(count(*) + 1000.0::DOUBLE) - 2.0::DOUBLE AS m, log10(11.0::DOUBLE) AS l FROM lineitem GROUP BY 1)),
scored AS (SELECT doc_id, 10.0::DOUBLE * (s + CASE WHEN n > 1 THEN least(n, 5) ELSE 0 END) / 100.0::DOUBLE + q AS score FROM flags JOIN anchors USING (flag))
SELECT doc_id, round(sum(score) * count(*) * count(*), 4) AS score FROM scored GROUP BY doc_id
"""
_SNIPPETS = r"""
WITH texts AS (SELECT DISTINCT text AS value FROM documents WHERE text IS NOT NULL),
runs AS (SELECT value, RUNS AS r FROM texts),
toks AS (SELECT value, r, len(r) AS n, unnest(r) AS tok, unnest(range(len(r))) AS place FROM runs WHERE len(r) >= 2),
hits AS (SELECT value, n, place, CASE WHEN place - lag(place) OVER (PARTITION BY value ORDER BY place) < 10 THEN 0 ELSE 1 END AS new FROM toks WHERE lower(tok) = 'thwh'),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY value ORDER BY place) AS g FROM hits),
windows AS (SELECT value, g, min(place) AS first, max(place) AS last, greatest(0, min(place) - 10) AS lo, least(max(n), max(place) + 11) AS hi FROM grouped GROUP BY value, g),
pieces AS (SELECT w.value, w.g, string_agg(CASE WHEN lower(t.tok) = 'thwh' THEN '[' || t.tok || ']' ELSE t.tok END, '' ORDER BY t.place) AS piece FROM windows w JOIN toks t ON t.value = w.value AND t.place >= w.lo AND t.place < w.hi GROUP BY ALL),
joined AS (SELECT value, string_agg(piece, ' ... ' ORDER BY g) FILTER (g <= 3) AS body FROM pieces GROUP BY value),
ends AS (SELECT value, min(place) AS first, max(place) AS last, max(n) AS n FROM grouped GROUP BY value)
SELECT value AS text, CASE WHEN first > 10 THEN ' ... ' ELSE '' END || body || CASE WHEN last < n - 10 THEN ' ... ' ELSE '' END AS snippet, 10.0::DOUBLE AS score
FROM joined JOIN ends USING (value) ORDER BY value LIMIT 12 OFFSET 3
"""
_STORED_TABLES = """,
w AS (SELECT path, doc_id, list_filter(toks, lambda x: NOT regexp_matches(x, '^CLASS')) AS w FROM toks),
pairs AS (SELECT DISTINCT path, t1, t2, doc_id FROM (SELECT path, doc_id, unnest(w[:-2]) AS t1, unnest(w[2:]) AS t2 FROM w WHERE len(w) >= 2))
SELECT 'leafs' AS name, path, count(*) AS n FROM leafs GROUP BY path
UNION ALL SELECT 'terms', path, count(*) FROM terms GROUP BY path
UNION ALL SELECT 'postings', path, count(*) FROM postings GROUP BY path
UNION ALL SELECT 'phrase_pairs', path, count(*) FROM pairs GROUP BY path
UNION ALL SELECT 'token_texts', path, count(*) FROM (SELECT DISTINCT path, value, unnest(toks) AS t FROM toks) GROUP BY path
UNION ALL SELECT 'boosts', 'p_retailprice', count(*) FROM part
"""


def oracle_sql() -> dict[str, str]:
    parts, scores, leaf, any_of, all_of, docs = main.PARTS_SQL, main.scores_sql, main.leaf_sql, main.any_sql, main.all_sql, main.DOCS_SQL
    blue, bolt, promo = leaf("p_name", "blue"), leaf("p_name", "bolt"), leaf("p_type", "PROMO")
    prefix = lambda t: leaf("p_name", t, f"starts_with(lower(term), '{t}')", True)
    fuzzy = lambda t, d, path="p_name": leaf(path, t, f"levenshtein(lower(term), '{t.lower()}') <= {d}", True)
    regex = lambda where, t: leaf("p_name", t, where)
    swap = "damerau_levenshtein(lower(term), 'blot')"
    keyed = "JOIN part ON doc_id = p_partkey"
    price = "CAST(p_retailprice AS FLOAT)::DOUBLE"
    all_parts = main.index_sql("part", "p_partkey", {"p_name": "p_name", "p_brand": "p_brand", "p_type": "p_type", "p_retailprice": "regexp_replace(CAST(p_retailprice AS VARCHAR), '\\.0$', '')"})
    suggestions = "list_bool_or(list_transform(range(3, least(6, length(term) + 1)), lambda k: levenshtein(left(lower(term), k), 'blut') <= 1)) AND length(term) >= 3"
    either = any_of(("blue", blue), ("bolt", bolt))
    flat = any_of(("PROMO", promo), ("blue", blue), ("bolt", bolt))
    economy = leaf("p_type", "ECONOMI", "levenshtein(lower(term), 'economi') <= 1", True)
    urls = main.index_sql("pages", "page_id", {"url": "url"}, _URL_CHARS)
    single = main.runs_sql(grouped=False).replace("value", "text")
    normal = "text"
    for pattern, to in text.NORMAL:
        normal = f"regexp_replace({normal}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return {
        "search_swaps": scores(parts, _names_leaf(f"2.0::DOUBLE / ({swap} + 0.2::DOUBLE)", f"{swap} <= 1")),
        "search_regex_prefix": scores(parts, leaf("p_name", "B[LO]", "regexp_matches(term, '(?i)B[LO]')", True)),
        "search_regex_case": scores(parts, regex("regexp_full_match(term, '.*b[lo].*')", ".*b[lo].*")),
        "search_prefix_case": scores(parts, leaf("p_name", "bo", "starts_with(term, 'bo')", True)),
        "search_leaf_top": scores(parts, _names_leaf("fit", f"true AND term IN (SELECT term FROM (SELECT term, {main.fit_sql('b', True)} AS fit FROM terms WHERE path = 'p_name' AND starts_with(lower(term), 'b') ORDER BY fit DESC, term DESC LIMIT 3))").replace("SELECT term, fit AS fit FROM terms", f"SELECT term, {main.fit_sql('b', True)} AS fit FROM terms", 1)),
        "filter_and": scores(parts, blue, "WHERE doc_id IN (SELECT p_partkey FROM part WHERE starts_with(lower(p_brand), 'brand#1') AND p_type = 'PROMO')"),
        "tree_flattening": scores(parts, flat),
        "search_single_or": scores(parts, blue),
        "search_nothing": scores(parts, blue, "WHERE false"),
        "generator_wildcard": scores(parts, any_of(("bl", prefix("bl")), (".*dget", regex("regexp_full_match(term, '(?i).*dget')", ".*dget")))),
        "generator_phrases": scores(parts, f"(SELECT f.doc_id, f.score * CASE WHEN p.doc_id IS NULL THEN 1.0::DOUBLE ELSE 5.0::DOUBLE END AS score FROM {either} f LEFT JOIN (SELECT DISTINCT doc_id FROM {main.PAIRS_SQL} WHERE path = 'p_name' AND lower(t1) = 'blue' AND lower(t2) = 'bolt') p USING (doc_id))"),
        "generator_boost_terms": scores(parts, f"(SELECT doc_id, score * CASE WHEN lower(p_brand) = 'brand#11' THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN lower(p_name) = 'blue bolt' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM {blue} {keyed})"),
        "generator_boost_fields": scores(parts, any_of(("blue", leaf("p_name", "blue", boost=2.5)), ("blue", leaf("p_brand", "blue")))),
        "generator_filter": scores(parts, blue, "WHERE doc_id IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' OR p_type = 'PROMO')"),
        "generator_auto_levenshtein": scores(parts, fuzzy("bolts", 1)),
        "generator_auto_limit": scores(parts, fuzzy("widgats", 2)),
        "generator_group": scores(parts, all_of(any_of(("PROMO", promo), ("LARGE", leaf("p_type", "LARGE"))), blue)),
        "token_values": scores(parts, _names_leaf(f"({main.fit_sql('b', True)}) * CASE term WHEN 'blue' THEN 20.0::DOUBLE WHEN 'bolt' THEN 3.5::DOUBLE ELSE 1.0::DOUBLE END", "starts_with(lower(term), 'b')")),
        "tree_options": _TREE_OPTIONS,
        "tokenize_single": f"SELECT token, count(*) AS times, CAST(sum(pos) AS BIGINT) AS places FROM (SELECT unnest(r) AS token, unnest(range(len(r))) AS pos FROM (SELECT {single} AS r FROM documents)) GROUP BY token",
        "separators_of_a_field": scores(urls, leaf("url", "example")),
        "normalize_texts": f"SELECT doc_id, trim(lower({normal})) AS normal FROM documents",
        "json_request": f"{parts} SELECT doc_id, round(score, 4) AS score FROM (SELECT doc_id, score * log10({price} + 1.0::DOUBLE) AS score FROM {any_of(('blue', blue), ('promo', leaf('p_type', 'promo', boost=2.0)), ('bolt', bolt))} {keyed} WHERE starts_with(lower(p_brand), 'brand#1')) f ORDER BY f.score DESC, doc_id DESC LIMIT 20 OFFSET 5",
        "url_parameters": scores(parts, any_of(("blue", blue), ("PROMO", leaf("p_type", "PROMO", boost=3.0))), "ORDER BY found.score DESC, doc_id DESC LIMIT 15"),
        "default_top": scores(parts, blue, "ORDER BY found.score DESC, doc_id DESC LIMIT 10"),
        "num_hits": f"{parts} SELECT count(*) AS num_hits FROM {blue}",
        "counters": f"SELECT count(*) AS num_docs, CAST(sum(strlen({_JSON_TEXT})) AS BIGINT) AS bytes_indexed FROM part",
        "term_ids": f"{all_parts} SELECT path, term, row_number() OVER (PARTITION BY path ORDER BY term) - 1 AS term_id FROM terms",
        "inspect_postings": f"{parts} SELECT term, doc_id, score FROM postings WHERE path = 'p_name' AND term = 'blue'",
        "doc_by_id": "SELECT p_partkey AS doc_id, p_name, p_retailprice AS price FROM part WHERE p_partkey IN (3, 7, -1)",
        "no_select": f"{parts} SELECT p_partkey AS doc_id, p_type, p_retailprice AS price FROM part WHERE p_partkey IN (SELECT doc_id FROM {blue} ORDER BY score DESC, doc_id DESC LIMIT 10)",
        "select_nested": f"WITH found AS ({main.FLAG_HITS_SQL}), lines AS ({_LINES % ''}) SELECT doc_id, '{{\"lines\": [' || lines || ']}}' AS doc FROM found JOIN lines USING (doc_id) ORDER BY found.score DESC, doc_id DESC LIMIT 10",
        "rebuilt_documents": "WITH lines AS (" + _LINES % ", \"quantity\": \"' || regexp_replace(CAST(l_quantity AS VARCHAR), '\\.0$', '') || '\"" + ") SELECT doc_id, '{\"lines\": [' || lines || ']}' AS doc FROM lines",
        "json_flatten": "WITH t AS (SELECT conv_id AS doc_id, turn, role, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS \"at\" FROM conversations) "
        "SELECT 'turns[].turn' AS path, doc_id, \"at\", CAST(turn AS VARCHAR) AS value FROM t UNION ALL SELECT 'turns[].role', doc_id, \"at\", role FROM t WHERE role IS NOT NULL UNION ALL SELECT 'turns[].text', doc_id, \"at\", text FROM t WHERE text IS NOT NULL",
        "json_lines_file": "SELECT path, value, count(*) AS n FROM (SELECT 'p_name' AS path, p_name AS value FROM part UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part) GROUP BY ALL",
        "json_array_file": "SELECT path, value, count(*) AS n FROM (SELECT 'n_nationkey' AS path, CAST(n_nationkey AS VARCHAR) AS value FROM nation UNION ALL SELECT 'n_name', n_name FROM nation) GROUP BY ALL",
        "csv_file": "SELECT path, value, count(*) AS n FROM (SELECT 'c_name' AS path, c_name AS value FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer) GROUP BY ALL",
        "facet_all_values": f"{parts} (SELECT 'p_brand' AS field, p_brand AS value, count(*) AS count FROM part WHERE p_partkey IN (SELECT doc_id FROM {blue}) GROUP BY p_brand) UNION ALL (SELECT 'p_name', p_name, count(*) FROM part WHERE p_partkey IN (SELECT doc_id FROM {blue}) GROUP BY p_name ORDER BY count(*) DESC, p_name LIMIT 3)",
        "stopwords_german": scores(docs, leaf("text", "que")),
        "suggest_page": f"{parts} SELECT text, round(max(score), 4) AS score FROM (SELECT lower(term) AS text, {main.fit_sql('blut', True)} AS score FROM terms WHERE path = 'p_name' AND {suggestions}) GROUP BY text ORDER BY max(score) DESC, text LIMIT 4 OFFSET 2",
        "highlight_page": _SNIPPETS.replace("RUNS", main.runs_sql()),
        "stored_search": scores(parts, f"(SELECT doc_id, score * log10({price} + 1.0::DOUBLE) AS score FROM {any_of(('blue', blue), ('bo', prefix('bo')), ('ECONOMI', economy))} {keyed})"),
        "stored_search_text": scores(docs, all_of(leaf("text", "the"), leaf("source", "src1"))),
        "memory_search": scores(parts, either),
        "index_from_text": "SELECT 'n_name' AS path, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS doc_id, n_name AS value FROM nation UNION ALL SELECT 'n_regionkey', row_number() OVER (ORDER BY n_nationkey) - 1, CAST(n_regionkey AS VARCHAR) FROM nation",
        "select_long_text": f"{docs} SELECT doc_id, text, 1 AS fields FROM documents WHERE doc_id IN (SELECT doc_id FROM {leaf('source', 'src1')} ORDER BY score DESC, doc_id DESC LIMIT 5)",
        "why_found_select": f"{parts} SELECT doc_id, '{{\"p_brand\": \"' || p_brand || '\"}}' AS doc, CASE WHEN list_contains(string_split(p_name, ' '), 'blue') THEN replace(p_name, 'blue', '<b>blue</b>') END AS name, CASE WHEN p_type = 'PROMO' THEN '<b>PROMO</b>' END AS type "
        f"FROM (SELECT * FROM {any_of(('blue', blue), ('PROMO', promo))} ORDER BY score DESC, doc_id DESC LIMIT 10) f JOIN part ON doc_id = p_partkey",
        "stored_tables": all_parts + _STORED_TABLES.replace("CLASS", main.class_sql()),
    }
