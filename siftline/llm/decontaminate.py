"""Benchmark decontamination as a prefix-filtered set-containment join.

An item is its set of ``N``-word shingles (items with fewer words are one shingle of all their words). A document is
contaminated by an item if some window of the item's length holds at least ``THRESHOLD`` of that set. Steps:

1. Documents are scanned once; only shingles that occur in the benchmark leave the scan (``hits``).
2. Each item's shingles are ordered by rarity, that is by how many documents hold them, over all documents. An item
   of s shingles that needs r of them shares one of its s - r + 1 rarest with every document that matches, so only
   those prefix tokens are joined. Bounds: the document has r shingles at least (length), and after the first token
   that both share r - 1 more are to come in the item and among the document's own hits, both in order of rarity
   (position).
3. Candidates are verified exactly by sliding a window of the item's length over the hits.

Defined cases: null or word-free texts neither match nor are matched; a null doc_id takes part and is returned as
null; rows that repeat id and text are one document; two items with the same text both match; items with a null id take part, and items that share an id
but not the text are separate, each with its own row (rows that repeat id and text are one item). Empty tables give an
empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as tx
from .rows import row_key
from .scratch import materialise

N = 5
THRESHOLD = 0.6
#: Benchmarks up to this many distinct shingles are broadcast as one sorted array (8 bytes each); larger ones are joined by shuffle.
MAX_BROADCAST_SHINGLES = 4_000_000


def benchmark_shingles(items: DataFrame, n: int = N) -> DataFrame:
    """(item, item_id, h, width, length), item being the hash of id and text: distinct shingles of each item, words in a shingle, shingle positions in the item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, items, out = b.column("item_id").to_pylist(), b.column("item").to_pylist(), []
            for lo, hi, data, off in tx.chunks(b, "text"):
                h, row = tx.words(data, off)
                for r in range(hi - lo):
                    own = h[row == r]
                    width = min(n, len(own))
                    if width:
                        s, _ = tx.shingles(own, np.zeros(len(own), dtype=np.int64), width)
                        out += [(items[lo + r], ids[lo + r], x, width, len(s)) for x in np.unique(tx.signed(s)).tolist()]
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int32())], ["item", "item_id", "h", "width", "length"])

    item = F.col("item_id").cast("long")
    return items.select(F.xxhash64(item, "text").alias("item"), item.alias("item_id"), "text").where("text is not null").mapInArrow(cut, "item long, item_id long, h long, width int, length int").distinct()


def _scan(docs: DataFrame, widths: list[int], keep: np.ndarray | None) -> DataFrame:
    """(k, doc_id, pos, h, n): shingles of the given widths; only those in the sorted array ``keep`` unless it is None."""
    table = docs.sparkSession.sparkContext.broadcast(keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = table.value
        low = None
        if wanted is not None:
            low = np.zeros(1 << 22, dtype=bool)
            low[(wanted & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for b in batches:
            for first, hi, data, off in tx.chunks(b, "text"):
                h, row = tx.words(data, off)
                starts = np.searchsorted(row, np.arange(hi - first + 1))
                for width in widths:
                    s, at = tx.shingles(h, row, width)
                    if wanted is not None:
                        maybe = low[(s & np.uint64((1 << 22) - 1)).astype(np.int64)]
                        s, at = s[maybe], at[maybe]
                        found = wanted[np.minimum(np.searchsorted(wanted, s), len(wanted) - 1)] == s
                        s, at = s[found], at[found]
                    if not len(s):
                        continue
                    r = row[at]
                    pick = pa.array(r + first)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("k").take(pick), b.column("doc_id").take(pick), pa.array((at - starts[r]).astype(np.int32)), pa.array(tx.signed(s)), pa.array((starts[r + 1] - starts[r]).astype(np.int32))],
                        ["k", "doc_id", "pos", "h", "n"],
                    )

    rows = docs.where("text is not null").select(row_key().alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, "k long, doc_id long, pos int, h long, n int")


def _best_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        most, where = [], []
        for hits, length in zip(b.column("hits").to_pylist(), b.column("length").to_pylist(), strict=True):
            lo, held, best = 0, {}, (0, 0)
            for hit in hits:
                held[hit["h"]] = held.get(hit["h"], 0) + 1
                while hits[lo]["pos"] <= hit["pos"] - length:
                    x = hits[lo]["h"]
                    held[x] -= 1
                    if not held[x]:
                        del held[x]
                    lo += 1
                best = max(best, (len(held), -hits[lo]["pos"]))
            most.append(best[0])
            where.append(-best[1])
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("k", "doc_id", "item", "item_id", "size", "need")], pa.array(most, pa.int32()), pa.array(where, pa.int32())], ["k", "doc_id", "item", "item_id", "size", "need", "most", "at"])


def contaminated(docs: DataFrame, items: DataFrame, n: int = N, threshold: float = THRESHOLD, limit: int = MAX_BROADCAST_SHINGLES) -> DataFrame:
    """(k, doc_id, item_id, containment, at): each document and item that match, with the best window's first word."""
    grams = materialise(benchmark_shingles(items, n), "items")
    widths = sorted(r[0] for r in grams.select("width").distinct().collect())
    known = grams.select("h").distinct()
    head = known.limit(limit + 1).toPandas()["h"].to_numpy(np.int64)
    if len(head) <= limit:
        hits = _scan(docs, widths, np.sort(head.view(np.uint64))) if len(head) else _scan(docs.limit(0), widths, None)
    else:
        hits = _scan(docs, widths, None).join(known, "h", "left_semi").select("k", "doc_id", "pos", "h", "n")
    hits = materialise(hits.distinct(), "hits")
    spread = hits.groupBy("h").agg(F.countDistinct("k").alias("df"))
    order = Window.partitionBy("item").orderBy(F.coalesce("df", F.lit(0)), "h")
    ranked = (
        grams.join(spread, "h", "left")
        .withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("size", F.count("*").over(Window.partitionBy("item")))
        .withColumn("need", F.greatest(F.lit(1), F.ceil(F.round(F.col("size") * threshold, 9)).cast("int")))
    )
    prefix = ranked.where("rank <= size - need")
    mine = Window.partitionBy("k").orderBy("df", "h")
    own = hits.select("k", "h", "n").distinct().join(spread, "h")
    own = own.withColumn("place", F.row_number().over(mine) - 1).withColumn("held", F.count("*").over(Window.partitionBy("k")))
    # all that a document and an item share comes from their first common token on, and that lies in the prefix
    first = F.min(F.struct("rank", "place")).alias("first")
    candidates = (
        own.join(prefix.select("h", "item", "item_id", "rank", "size", "need", "length", "width"), "h")
        .where("n - width + 1 >= need")
        .groupBy("k", "item", "item_id", "size", "need", "length", "held")
        .agg(first)
        .where("1 + least(size - first.rank - 1, held - first.place - 1) >= need")
        .select("k", "item", "item_id", "size", "need", "length")
    )
    matched = hits.join(candidates, "k").join(grams.select("item", "h"), ["item", "h"])
    whole = matched.groupBy("k", "doc_id", "item", "item_id", "size", "need", "length").agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("hits"))
    found = whole.mapInArrow(_best_window, "k long, doc_id long, item long, item_id long, size long, need int, most int, at int")
    return found.where("most >= need").select("k", "doc_id", "item_id", F.round(F.col("most") / F.col("size"), 6).alias("containment"), "at")
