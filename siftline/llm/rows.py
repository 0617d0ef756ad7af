"""Row identity and size-checked anti-joins shared by the filtering operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this many ids with keys (16 bytes each) are broadcast; larger sets are shuffled.
MAX_BROADCAST_KEYS = 1_000_000


def row_key() -> Column:
    """64-bit key of a row's id and text; rows that repeat both are one document. Defined for nulls."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(docs: DataFrame, gone: DataFrame, limit: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """``docs`` without the rows whose id and key are among ``gone`` (``doc_id``, ``k``, already materialised); columns unchanged."""
    keys = gone.select(F.col("k").alias("gone_key"), F.col("doc_id").cast("long").alias("gone_id")).distinct()
    if keys.limit(limit + 1).count() <= limit:
        keys = F.broadcast(keys)
    name = free_name(docs, "__row_key")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), row_key().alias(name), F.col("doc_id").cast("long").alias("own_id"))
    # ids are compared as well, so that equal keys of different documents do no harm
    left = keyed.join(keys, (F.col(name) == F.col("gone_key")) & F.col("own_id").eqNullSafe(F.col("gone_id")), "left_anti")
    return left.select("row.*")
