"""Leaf search: terms of a field's dictionary that fit a search part, with their scores, and the documents they lead to.

A saved index answers from its dictionary: equality and prefixes are pushed to its sorted lower-case column, the few
terms that fit are fetched first, and the postings scan gets them as a pushed list. Without a saved index the condition
is applied to the tokens inside each row, before anything is exploded. Few terms are always fetched first, so that rows
are joined with them where they are: by a shuffle all rows of a frequent term would go to one task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance, scoring
from ..plans.request import Part
from . import tables
from .index import Index

MAX_DISTANCE = 4
#: Up to this many fitting terms are fetched, and listed in the filter of a saved index's postings; more are joined.
MAX_LISTED_TERMS = 1000


def allowed_distance(part: Part) -> int:
    return max(0, min(part.levenshtein_distance or 0, len(part.term) - 1, MAX_DISTANCE))


def _folds(part: Part) -> bool:
    return part.ignore_case is not False


def swaps(part: Part) -> bool:
    """With an explicit ignore_case swaps of neighbours cost 1."""
    return part.ignore_case is True and allowed_distance(part) > 0 and not part.is_regex and not part.starts_with


def fits(part: Part, column: Column, lower: Column | None = None) -> Column:
    """Does a dictionary key fit? ``lower`` is its lower-case form where that is stored. Candidates for swaps are wider."""
    fold, term, d = _folds(part), part.term, allowed_distance(part)
    key = (F.lower(column) if lower is None else lower) if fold else column
    wanted = term.lower() if fold else term
    if part.is_regex:
        return F.rlike(column, F.lit(f"{'(?i)' if fold else ''}(?:{term}){'' if part.starts_with else chr(92) + 'z'}"))
    n = len(wanted)
    if part.starts_with:
        if d == 0:
            return key.startswith(wanted)
        near = F.exists(F.sequence(F.lit(max(0, n - d)), F.least(F.lit(n + d), F.length(key))), lambda k: F.levenshtein(F.substring(key, F.lit(1), k), F.lit(wanted)) <= d)
        return (F.length(key) >= n - d) & near
    if d == 0:
        return key == wanted
    reach = 2 * d if swaps(part) else d
    return F.length(key).between(n - d, n + d) & (F.levenshtein(key, F.lit(wanted), reach) >= 0)


def _holds(part: Part) -> Column | None:
    """What a whole value with a fitting token contains, if that can be said without cutting it."""
    if part.is_regex or allowed_distance(part):
        return None
    return F.contains(F.lower("value"), F.lit(part.term.lower()))


def fitting_entries(index: Index, part: Part, feature: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    return tables.fitting_entries(index.leafs_of(part.path, feature), index.config, lambda c: fits(part, c), _holds(part), keep)


def _dictionary(index: Index, part: Part) -> DataFrame:
    """(term, term_lc, num_occ) of the terms that fit."""
    if not index.stored:
        return tables.occurrences(fitting_entries(index, part)).drop("path")
    rows = index.terms.where(F.col("path") == part.path)
    if not _folds(part) and not part.is_regex and not allowed_distance(part):
        low = part.term.lower()  # the table is sorted by lower case, so this is what skips its pages
        rows = rows.where(F.col("term_lc").startswith(low) if part.starts_with else F.col("term_lc") == low)
    return rows.where(fits(part, F.col("term"), F.col("term_lc"))).select("term", "term_lc", "num_occ")


def matched_terms(index: Index, part: Part, limit: bool = True) -> DataFrame:
    """(term, score, num_occ) of the dictionary entries of ``part.path`` that fit."""
    index.check(part.path)
    rows, wanted = _dictionary(index, part), part.term.lower()
    far = distance.distance_to(F.col("term_lc"), wanted)
    if swaps(part):
        rows = rows.withColumn("swapped", distance.with_swaps(F.col("term_lc"), wanted)).where(F.col("swapped") <= allowed_distance(part))
        far = F.col("swapped")
    prefix = F.col("term_lc").startswith(wanted) if part.starts_with or allowed_distance(part) > 0 else F.lit(False)
    score = scoring.fit_score(far, prefix)
    if part.boost is not None:
        score = score * F.lit(float(part.boost))
    rows = rows.select("term", score.alias("score"), "num_occ")
    if limit and part.top is not None:
        rows = rows.orderBy(F.desc("score"), F.desc("term")).limit(part.top + (part.skip or 0))
    if part.token_value is not None:
        values = index.token_values.where(F.col("path") == part.path).select("term", "value")
        rows = rows.join(values, "term", "left").select("term", scoring.boosted(F.col("score"), F.col("value"), part.token_value).alias("score"), "num_occ")
    return rows


def few_terms(index: Index, part: Part, limit: bool = True) -> tuple[DataFrame, list[str] | None]:
    """:func:`matched_terms` to join with, and their texts if they are few. They are looked up once for an index."""
    key = (part, limit, MAX_LISTED_TERMS)
    if key not in index.few:
        found = matched_terms(index, part, limit)
        rows = found.limit(MAX_LISTED_TERMS + 1).collect()
        if len(rows) <= MAX_LISTED_TERMS:
            shape = pa.schema([("term", pa.string()), ("score", pa.float64()), ("num_occ", pa.int64())])
            local = index.spark.createDataFrame(pa.Table.from_pylist([r.asDict() for r in rows], shape))
            index.few[key] = F.broadcast(local), [r["term"] for r in rows]
        else:
            index.few[key] = found, None
    return index.few[key]


def posted(index: Index, part: Part, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, score, anchor): fitting terms of each document, with their fit and their score in the document.

    ``only`` (doc_id) is applied below the aggregate, so documents that the filter excludes are never grouped.
    """
    found, few = few_terms(index, part)
    if index.stored:
        postings = index.postings.where(F.col("path") == part.path)
        if few is not None:
            postings = postings.where(F.col("term").isin(few))
        postings = postings.select("term", "doc_id", F.col("score").alias("anchor"))
        if only is not None:
            postings = postings.join(only, "doc_id", "left_semi")
        return postings.join(found, "term").select("doc_id", "term", "score", "anchor")
    rows = fitting_entries(index, part, "Search").select("term", "doc_id", "at", "n_tokens", "exact")
    if only is not None:
        rows = rows.join(only, "doc_id", "left_semi")
    scored = rows.join(found, "term").withColumn("s", scoring.anchor_score(F.col("at"), F.col("num_occ"), F.col("n_tokens"), F.col("exact")))
    if few is None:
        scored = scored.repartition("doc_id")  # else groups rest on the join's partitions, and those of frequent terms can't be split
    best = scored.groupBy("doc_id", "term").agg(F.max("s").alias("best"), F.count("*").alias("n"), F.first("score").alias("score"))
    return best.select("doc_id", "term", "score", scoring.merged_score(F.col("best"), F.col("n")).alias("anchor"))


def leaf_hits(index: Index, part: Part, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, score): best of the matching terms of the field, each weighted by its score in the document."""
    found = posted(index, part, only)
    return found.select("doc_id", (F.col("score") * F.col("anchor") / F.lit(100.0)).alias("s")).groupBy("doc_id").agg(F.max("s").alias("score"))


def whole_value_docs(index: Index, part: Part) -> DataFrame:
    """(doc_id): documents with a whole value that fits; filters and boosts by term work on whole values."""
    index.check(part.path)
    values = index.leafs_of(part.path).select(F.col("value").alias("term"), "doc_id").where(fits(part, F.col("term")))
    # a value is in the dictionary if it isn't too long for it, or as a token of its own
    return values.join(few_terms(index, part, limit=False)[0].select("term"), "term", "left_semi").select("doc_id").distinct()
