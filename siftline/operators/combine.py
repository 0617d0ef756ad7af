"""Boolean combination, filters and boosts over hits (doc_id, score)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..plans.request import Boost, Node, Part, PhraseBoost, parts, term_key
from .flatten import array_prefix
from .index import Index
from .match import few_terms, fits, fitting_entries, leaf_hits, matched_terms, swaps, whole_value_docs
from .tables import text_id, with_tokens

#: Of the locality boosts that reach a document the least is applied.
LOCALITY_PICKS_LEAST = True


def union_scored(inputs: list[tuple[str, DataFrame]]) -> DataFrame:
    """OR: best score per distinct term, summed, times the square of the number of terms that score.

    Sums run in the order of terms: in the order of arrival, equal scores would differ in their last bit from document to
    document and from run to run, and pages with them.
    """
    if len(inputs) == 1:
        return inputs[0][1]
    rows = reduce(DataFrame.unionByName, [df.select("doc_id", F.lit(key).alias("key"), "score") for key, df in inputs])
    each = F.array(*[F.max(F.when(F.col("key") == key, F.col("score"))) for key in sorted({key for key, _ in inputs})])
    best = rows.groupBy("doc_id").agg(each.alias("best"))
    n = F.size(F.filter("best", lambda m: m >= 1e-5)).cast("double")
    return best.select("doc_id", (F.aggregate("best", F.lit(0.0), lambda total, m: total + F.coalesce(m, F.lit(0.0))) * n * n).alias("score"))


def intersect_scored(inputs: list[DataFrame]) -> DataFrame:
    """AND: documents of all inputs, scores summed. One aggregate instead of a chain of joins."""
    if len(inputs) == 1:
        return inputs[0]
    rows = reduce(DataFrame.unionByName, [df.select("doc_id", "score") for df in inputs])
    return rows.groupBy("doc_id").agg(F.sum("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == len(inputs)).select("doc_id", "score")


def _empty(index: Index, schema: str) -> DataFrame:
    return index.spark.createDataFrame([], schema)


def filter_ids(index: Index, node: Node) -> DataFrame:
    """(doc_id) of a filter tree: no scores, whole values."""
    if isinstance(node, Part):
        return whole_value_docs(index, node)
    inputs = [filter_ids(index, q) for q in node.queries]
    if not inputs:
        return _empty(index, "doc_id long")
    if node.operator == "or":
        return reduce(DataFrame.union, inputs).distinct() if len(inputs) > 1 else inputs[0]
    return reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), inputs)


def scored(index: Index, node: Node, only: DataFrame | None = None, boosts: tuple[Boost, ...] = (), leaves: dict | None = None) -> DataFrame:
    """(doc_id, score) of a search tree. Equal leaves are planned once."""
    leaves = {} if leaves is None else leaves
    if isinstance(node, Part):
        key = (node, boosts)
        if key not in leaves:
            leaves[key] = _boosted_leaf(index, node, only, boosts)
        return leaves[key]
    inherited = lambda q: boosts + (q.options.boost if q.options else ())
    inputs = [(term_key(q), scored(index, q, only, inherited(q), leaves)) for q in node.queries]
    if not inputs:
        return _empty(index, "doc_id long, score double")
    return union_scored(inputs) if node.operator == "or" else intersect_scored([df for _, df in inputs])


def _boosted_leaf(index: Index, part: Part, only: DataFrame | None, boosts: tuple[Boost, ...]) -> DataFrame:
    """A leaf with boosts held by the array elements that its matches lie in."""
    hits = leaf_hits(index, part, only)
    for boost in boosts:
        prefix = array_prefix(boost.path)
        if prefix and prefix == array_prefix(part.path):
            depth = prefix.count("[]")
            element = lambda pos: F.slice(pos, 1, depth)
            places = fitting_entries(index, part).join(few_terms(index, part)[0].select("term"), "term", "left_semi")
            places = places.select("doc_id", element(F.col("pos")).alias("at")).distinct()
            values = index.table("boosts", boost.path).select("doc_id", element(F.col("pos")).alias("at"), "boost")
            found = values.join(places, ["doc_id", "at"], "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "boost"))).alias("bs"))
            each = F.aggregate("bs", F.col("score"), _applying(boost))
            hits = hits.join(found, "doc_id", "left").select("doc_id", F.when(F.col("bs").isNull(), F.col("score")).otherwise(each).alias("score"))
    return hits


def _applying(boost: Boost) -> Callable[[Column, Column], Column]:
    return lambda score, x: scoring.boosted(score, x["boost"], boost)


def document_boost(index: Index, hits: DataFrame, boost: Boost) -> DataFrame:
    """A boost by a number of the document itself; documents without it keep their score."""
    values = index.table("boosts", boost.path).groupBy("doc_id").agg(F.first("boost").alias("boost"))
    return hits.join(values, "doc_id", "left").select("doc_id", scoring.boosted(F.col("score"), F.col("boost"), boost).alias("score"))


def _multiplied(hits: DataFrame, factors: DataFrame) -> DataFrame:
    """hits times the product of the factors (doc_id, factor)."""
    product: Column = F.aggregate(F.array_sort(F.collect_list("factor")), F.lit(1.0), lambda a, x: a * x)
    return hits.join(factors.groupBy("doc_id").agg(product.alias("by")), "doc_id", "left").select("doc_id", (F.col("score") * F.coalesce("by", F.lit(1.0))).alias("score"))


def phrase_boosts(index: Index, hits: DataFrame, boosts: tuple[PhraseBoost, ...]) -> DataFrame:
    """Times 5 for each distinct pair of terms that stands side by side in some field."""
    found = []
    for b in boosts:
        if b.search1.path != b.search2.path:
            continue
        pairs = index.table("phrase_pairs", b.search1.path)
        for column, part in (("t1", b.search1), ("t2", b.search2)):
            pairs = pairs.join(few_terms(index, part)[0].select(F.col("term").alias(column)), column, "left_semi")
        found.append(pairs.select(F.lit(b.search1.term).alias("a"), F.lit(b.search2.term).alias("b"), "doc_id"))
    if not found:
        return hits
    return _multiplied(hits, reduce(DataFrame.unionByName, found).distinct().select("doc_id", F.lit(5.0).alias("factor")))


def term_boosts(index: Index, hits: DataFrame, boosts: tuple[Part, ...]) -> DataFrame:
    """Times ``boost`` (2 unless given) for each part that a whole value fits. Results of parts are kept for reuse."""
    found = []
    for part in boosts:
        plain = replace(part, boost=None)
        docs = index.boost_term(plain, lambda plain=plain: whole_value_docs(index, plain))
        found.append(docs.select("doc_id", F.lit(float(2.0 if part.boost is None else part.boost)).alias("factor")))
    return _multiplied(hits, reduce(DataFrame.unionByName, found)) if found else hits


def _fitting(part: Part) -> Callable[[Column], Column]:
    return lambda token: fits(part, token)


def text_locality(index: Index, hits: DataFrame, node: Node) -> DataFrame:
    """Documents in which several query terms stand in one text: times 2 n**2 for n matches in that text."""
    by_path: dict[str, list[Part]] = {}
    for part in dict.fromkeys(parts(node)):
        by_path.setdefault(part.path, []).append(part)
    found = []
    for path, own in by_path.items():
        if len({p.term for p in own}) < 2:
            continue
        rows = index.leafs_of(path)
        if any(p.top is not None or swaps(p) for p in own):
            # terms that only the dictionary can tell: texts are found by them, and documents by the texts' ids
            words = reduce(DataFrame.unionByName, [matched_terms(index, p).select(F.lit(i).alias("i"), F.col("term").alias("token")) for i, p in enumerate(own)]).distinct()
            texts = index.table("token_texts", path).join(words, "token").groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
            at = rows.select("doc_id", *text_id()).join(texts, ["h1", "h2"])
        else:
            # the same count inside each text: distinct tokens that fit, for each part
            counts = [F.size(F.array_distinct(F.filter("tokens", _fitting(p)))) for p in own]
            at = with_tokens(rows, index.config).select("doc_id", reduce(lambda a, b: a + b, counts).alias("n")).where("n > 1")
        found.append(at.select("doc_id", (F.lit(2.0) * F.col("n") * F.col("n")).alias("factor")))
    if not found:
        return hits
    pick = F.min if LOCALITY_PICKS_LEAST else F.max
    least = reduce(DataFrame.unionByName, found).groupBy("doc_id").agg(pick("factor").alias("factor"))
    return hits.join(least, "doc_id", "left").select("doc_id", (F.col("score") * F.coalesce("factor", F.lit(1.0))).alias("score"))
