"""Operators as filtering steps: each takes documents and returns documents.

Each decides on rows by id and text, so rows that repeat both share their fate, except that near dedup and the mixture
keep one of them. Null ids and texts, empty tables and ties are as the operators define them; rows that an operator
doesn't judge stay, but for the mixture, which draws.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .decontaminate import contaminated
from .linededup import drop_repeated_lines
from .mixing import mix
from .quality import quality_scores
from .rows import free_name, row_key, without
from .scratch import materialise
from .simhash import drop_near_duplicates

#: Share of tokens wanted from each source: the crawl is held to a fifth, the rest is split evenly.
TARGETS = {"src0": 0.2, **{f"src{n}": 0.8 / 19 for n in range(1, 20)}}

__all__ = ["TARGETS", "drop_low_quality", "drop_near_duplicates", "drop_repeated_lines", "drop_contaminated", "draw_mixture"]


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose posterior quality is below the threshold."""
    return without(docs, materialise(quality_scores(docs).where("not keep").select("doc_id", "k"), "rejected"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    return without(docs, materialise(contaminated(docs, items).select("doc_id", "k").distinct(), "leaked"))


def draw_mixture(docs: DataFrame, weights: Mapping[str, float] = TARGETS, seed: int = 0) -> DataFrame:
    """The chosen rows of ``docs`` with ``mix_source`` and ``mix_uses``: a text shared by sources has a row for each
    source it is spent for. Columns of ``docs`` with these two names are replaced. Of rows that repeat a text the one
    with the smallest doc_id is used, of rows that repeat that id and text the one with the least source and then the
    least JSON of all columns. Rows with null id, source or text, or a text without words, are never drawn; an empty
    table gives an empty result."""
    docs = docs.drop("mix_source", "mix_uses")
    key, copies, place = (free_name(docs, x) for x in ("__row_key", "__copies", "__place"))
    chosen = materialise(mix(docs, weights, seed=seed).select("doc_id", "k", F.col("source").alias("mix_source"), F.col("uses").alias("mix_uses")), "chosen")
    chosen = chosen.withColumnRenamed("k", key)
    drawn = docs.where("text is not null and source is not null").withColumn(key, row_key()).join(chosen, ["doc_id", key])
    out = [*docs.columns, "mix_source", "mix_uses"]
    repeated = drawn.groupBy(key, "mix_source").agg(F.count("*").alias(copies)).where(F.col(copies) > 1).select(key).distinct()
    if repeated.isEmpty():
        return drawn.select(out)
    again = drawn.join(repeated, key, "left_semi")
    order = Window.partitionBy("doc_id", key, "mix_source").orderBy("source", F.to_json(F.struct(*docs.columns)))
    again = again.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return drawn.join(repeated, key, "left_anti").select(out).union(again.select(out))
