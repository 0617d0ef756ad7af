"""Running requests: hits, pages, facets, suggestions, documents, snippets and explanations."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.highlight import highlight_text
from ..functions.text import normalize_text
from ..plans import generator
from ..plans.errors import InvalidRequest
from ..plans.request import Facet, Node, Part, Request, SearchParams, SnippetInfo, Tree, from_json, parts, simplify
from . import combine
from .flatten import leaf_text, leaves
from .index import Index
from .match import allowed_distance, few_terms, fitting_entries, matched_terms, posted

DEFAULT_TOP = 10


def hits(index: Index, request: Request) -> DataFrame:
    """(doc_id, score) of all documents found, in the fixed order of steps: tree, filter, document boosts, phrase
    boosts, boosts by term, text locality. Not ordered, not cut."""
    if request.search_req is None:
        raise InvalidRequest("search_req is missing")
    only = combine.filter_ids(index, request.filter) if request.filter is not None else None
    own = request.search_req.options.boost if isinstance(request.search_req, Tree) and request.search_req.options else ()
    out = combine.scored(index, request.search_req, only, request.boost + own)
    for boost in request.boost:
        if "[]" not in boost.path:
            out = combine.document_boost(index, out, boost)
    out = combine.phrase_boosts(index, out, request.phrase_boosts)
    out = combine.term_boosts(index, out, request.boost_term)
    return combine.text_locality(index, out, request.search_req) if request.text_locality else out


def page(found: DataFrame, top: int | None = None, skip: int | None = None) -> DataFrame:
    """Best first, the higher id first among equals; Spark keeps only top + skip rows of each partition."""
    ordered = found.orderBy(F.desc("score"), F.desc("doc_id"))
    return ordered.offset(skip).limit(DEFAULT_TOP if top is None else top) if skip else ordered.limit(DEFAULT_TOP if top is None else top)


def facet_counts(index: Index, found: DataFrame, facets: tuple[Facet, ...]) -> DataFrame:
    """(field, value, count): occurrences of each value among all documents found, most frequent first."""
    for f in facets:
        index.check(f.field, "Facets", "Select")
    # one search and one scan for all fields; ranks are cut before they are shuffled
    values = index.leafs.where(F.col("path").isin([f.field for f in facets])).select("path", "doc_id", "value").join(found.select("doc_id"), "doc_id", "left_semi")
    counted = values.groupBy("path", "value").agg(F.count("*").alias("count"))
    most = max((f.top for f in facets if f.top is not None), default=0)
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("count"), "value"))
    if any(f.top is None for f in facets):
        most = 2**31 - 1
    ranked = counted.withColumn("rank", rank).where(F.col("rank") <= most)
    within = reduce(lambda a, b: a | b, [(F.col("path") == f.field) & (F.lit(True) if f.top is None else F.col("rank") <= f.top) for f in facets], F.lit(False))
    return ranked.where(within).select(F.col("path").alias("field"), "value", "count")


def suggest(index: Index, request: Request) -> DataFrame:
    """(text, score): terms that complete the input, equal texts of several fields merged, best first."""
    if not request.suggest:
        raise InvalidRequest("suggest is missing")
    found = reduce(DataFrame.unionByName, [matched_terms(index, p).select(F.lower("term").alias("text"), "score") for p in request.suggest])
    best = found.groupBy("text").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "text")
    if request.skip:
        best = best.offset(request.skip)
    return best.limit(DEFAULT_TOP if request.top is None else request.top)


def suggest_text(index: Index, text: str, **options: Any) -> DataFrame:
    return suggest(index, generator.suggest_request(index.info, text, **options))


def highlight(index: Index, part: Part) -> DataFrame:
    """(text, snippet, score): texts of a field with what was found in them, best first; ``skip`` and ``top`` (10) of
    the part. With its option ``explain`` a column of that name tells the score that the tokens found gave the text."""
    part = replace(part, terms=(normalize_text(part.term),))
    index.check(part.path, "Highlight", "WhyFound", "Select")
    settings, info = index.config.of(part.path), part.snippet_info or SnippetInfo()
    entries = fitting_entries(index, part, keep=("value",)).select("term", "value")
    found = entries.join(few_terms(index, part)[0], "term").groupBy("value").agg(F.max("score").alias("score"), F.collect_set("term").alias("found"))
    cut = found.orderBy(F.desc("score"), "value")
    cut = (cut.offset(part.skip) if part.skip else cut).limit(DEFAULT_TOP if part.top is None else part.top)

    # not a column: Spark would move it below the limit, and then sort all texts by ranges, whose samples go to the driver
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, terms = b.column("value"), b.column("found").to_pylist()
            snippets = [highlight_text(t, set(f), info, settings.tokenize_on_chars, settings.tokenize) for t, f in zip(texts.to_pylist(), terms, strict=True)]
            yield pa.RecordBatch.from_arrays([texts, pa.array(snippets, pa.string()), b.column("score")], ["text", "snippet", "score"])

    out = cut.mapInArrow(make, "text string, snippet string, score double").where("snippet is not null")
    if part.options is not None and part.options.explain:
        out = out.withColumn("explain", F.array(F.struct(F.lit("MaxTokenToTextId").alias("kind"), F.col("score").alias("value"))))
    return out


def select_fields(document: Any, wanted: tuple[str, ...]) -> Any:
    """The chosen paths of a document, every leaf as text, absent ones left out."""

    def walk(value: Any, path: str) -> Any:
        if value is None:
            return None
        if isinstance(value, dict):
            inner = {k: x for k, v in value.items() if (x := walk(v, f"{path}.{k}" if path else k)) is not None}
            return inner or None
        if isinstance(value, list):
            inner = [x for v in value if (x := walk(v, path + "[]")) is not None]
            return inner or None
        return leaf_text(value) if path in wanted or any(path.startswith(w) and path[len(w) : len(w) + 1] in (".", "[") for w in wanted) else None

    return walk(document, "") or {}


def _found_terms(index: Index, node: Node) -> DataFrame:
    """(path, terms): the dictionary terms that the parts of a query matched; few, since fuzziness is bounded."""
    rows = [matched_terms(index, p).select(F.lit(p.path).alias("path"), "term") for p in dict.fromkeys(parts(node))]
    return reduce(DataFrame.unionByName, rows).groupBy("path").agg(F.collect_set("term").alias("terms"))


def documents(index: Index, request: Request, found: DataFrame | None = None) -> DataFrame:
    """(doc_id, score, doc, why_found): one page of documents. ``doc`` is JSON, cut down to ``select`` if given;
    ``why_found`` maps fields to snippets when asked for, and a column ``explain`` is added when that is asked for.
    Only the rows of the page are looked at."""
    top = page(hits(index, request) if found is None else found, request.top, request.skip)
    rows = index.docs.join(F.broadcast(top), "doc_id").select("doc_id", "score", "doc")  # a page: top rows at most
    wanted = None
    if request.why_found and request.search_req is not None:
        terms = _found_terms(index, request.search_req).agg(F.map_from_entries(F.collect_list(F.struct("path", "terms"))).alias("found"))
        rows = rows.crossJoin(terms)
        wanted = True
    else:
        rows = rows.withColumn("found", F.lit(None).cast("map<string,array<string>>"))
    select, config = None if request.select is None else index.selectable(request.select), index.config

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, why = [], []
            for text, found in zip(b.column("doc").to_pylist(), b.column("found").to_pylist(), strict=True):
                value = json.loads(text)
                snippets: dict[str, list[str]] = {}
                if wanted:
                    by = {k: set(v) for k, v in found or []}
                    for path, _, leaf in leaves(value):
                        own = config.of(path)
                        if path in by and (s := highlight_text(leaf, by[path], SnippetInfo(), own.tokenize_on_chars, own.tokenize)) is not None:
                            snippets.setdefault(path, []).append(s)
                docs.append(text if select is None else json.dumps(select_fields(value, select), ensure_ascii=False))
                why.append(list(snippets.items()))
            kind = pa.map_(pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("score"), pa.array(docs, pa.string()), pa.array(why, kind)], ["doc_id", "score", "doc", "why_found"])

    out = rows.mapInArrow(make, "doc_id long, score double, doc string, why_found map<string,array<string>>")
    if explained(request):
        steps = explain(index, request).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("kind", "path", "term", "value"))).alias("explain"))
        out = out.join(F.broadcast(steps), "doc_id", "left")  # steps of a page
    return out.orderBy(F.desc("score"), F.desc("doc_id"))


def explained(request: Request) -> bool:
    """The request or one of its parts asks for an explanation."""
    node = request.search_req
    asked = [p.options for p in parts(node)] if node is not None else []
    return request.explain or any(o is not None and o.explain for o in asked)


def explain(index: Index, request: Request) -> DataFrame:
    """(doc_id, kind, path, term, value): how the scores of one page came about.

    ``LevenshteinScore`` is a term's fit, ``TermToAnchor`` its score in the document, ``OrSumOverDistinctTerms`` the
    combined score of the tree and ``Boost`` the factor that all boosts made of it.
    """
    if request.search_req is None:
        raise InvalidRequest("search_req is missing")
    # one page of ids and scores, which every step below starts from
    rows = page(hits(index, request), request.top, request.skip).collect()
    top = index.spark.createDataFrame([(r["doc_id"], r["score"]) for r in rows], "doc_id long, final double")
    steps = []
    for p in dict.fromkeys(parts(request.search_req)):
        found = posted(index, p, F.broadcast(top.select("doc_id"))).select("doc_id", F.lit(p.path).alias("path"), "term", "score", "anchor")
        steps.append(found.select("doc_id", F.lit("LevenshteinScore").alias("kind"), "path", "term", F.col("score").alias("value")))
        steps.append(found.select("doc_id", F.lit("TermToAnchor").alias("kind"), "path", "term", (F.col("score") * F.col("anchor") / 100.0).alias("value")))
    tree = combine.scored(index, request.search_req, top.select("doc_id"))
    none = F.lit(None).cast("string")
    if isinstance(request.search_req, Tree) and request.search_req.operator == "or":
        steps.append(tree.select("doc_id", F.lit("OrSumOverDistinctTerms").alias("kind"), none.alias("path"), none.alias("term"), F.col("score").alias("value")))
    made = tree.join(top, "doc_id").where(F.abs(F.col("final") - F.col("score")) > 1e-9)
    steps.append(made.select("doc_id", F.lit("Boost").alias("kind"), none.alias("path"), none.alias("term"), (F.col("final") / F.col("score")).alias("value")))
    return reduce(DataFrame.unionByName, steps)


def explain_plan(index: Index, request: Request, dot: bool = False) -> str:
    """The steps of a request, as indented text or as a DOT graph; nothing is run."""
    lines: list[tuple[int, int | None, str]] = []

    def add(label: str, below: int | None) -> int:
        lines.append((len(lines), below, label))
        return len(lines) - 1

    def walk(node: Node, below: int) -> None:
        if isinstance(node, Part):
            add(f"FieldSearch {node.path} {node.term!r} distance {allowed_distance(node)}", add("TermToAnchor", below))
        else:
            at = add("Union" if node.operator == "or" else "Intersect", below)
            for q in node.queries:
                walk(q, at)

    top = add("TopK", None)
    for label, there in (("TextLocality", request.text_locality), ("BoostTerms", request.boost_term), ("PhraseBoosts", request.phrase_boosts), ("DocumentBoosts", request.boost)):
        top = add(label, top) if there else top
    if request.filter is not None:
        top = add("IntersectScoresWithIds", top)
        walk(request.filter, add("Filter", top))
    if request.search_req is not None:
        walk(request.search_req, top)
    if dot:
        return "digraph plan {\n" + "".join(f'  n{i} [label="{label}"];\n' + (f"  n{i} -> n{up};\n" if up is not None else "") for i, up, label in lines) + "}\n"
    depth: dict[int, int] = {}
    text = []
    for i, up, label in lines:
        depth[i] = 0 if up is None else depth[up] + 1
        text.append("  " * depth[i] + label)
    return "\n".join(text)


@dataclass
class Result:
    """What a search gives: lazy pages and facets, and the number of hits when asked."""

    index: Index
    request: Request
    found: DataFrame

    @property
    def num_hits(self) -> int:
        return self.found.count()

    @property
    def data(self) -> DataFrame:
        return documents(self.index, self.request, self.found)

    @property
    def ids(self) -> list[int]:
        return [r["doc_id"] for r in page(self.found, self.request.top, self.request.skip).collect()]

    @property
    def facets(self) -> dict[str, list[tuple[str, int]]]:
        out: dict[str, list[tuple[str, int]]] = {f.field: [] for f in self.request.facets}
        if out:
            for r in facet_counts(self.index, self.found, self.request.facets).collect():
                out[r["field"]].append((r["value"], r["count"]))
        return {k: sorted(v, key=lambda x: (-x[1], x[0])) for k, v in out.items()}


def search(index: Index, request: Request | SearchParams | str | dict[str, Any]) -> Result:
    """Run a request: the request object or its JSON, parameters, or query text alone."""
    if isinstance(request, str) and not request.lstrip().startswith("{"):
        request = SearchParams(search_term=request)
    if isinstance(request, SearchParams):
        request = generator.search_request(index.info, request)
    if not isinstance(request, Request):
        request = from_json(request)
    if request.search_req is None and request.suggest is None:
        raise InvalidRequest("a request needs search_req or suggest")
    if request.search_req is not None:
        request = replace(request, search_req=simplify(request.search_req))
    if request.filter is not None:
        request = replace(request, filter=simplify(request.filter))
    return Result(index, request, hits(index, request))
