"""Line-level deduplication by pairwise alignment.

1. A line with ``MIN_WORDS`` words has a key, its hash; a shorter line has the hash of each least block of lines around
   it that has them, so every run that can be deleted holds a key of each of its lines.
2. Overlapping documents are found through shared rare keys: those that up to ``RARE`` documents hold link all their
   holders. Each pair is aligned with patience diff: common ends, then lines unique in both as anchors (longest
   increasing subsequence), then the same between anchors. Runs of aligned lines with at least ``MIN_WORDS`` words are
   deleted from the later document (order: doc_id, then text hash).
3. A key that more documents hold is boilerplate and links nobody: its lines are deleted from all holders but the
   first, wherever they stand. So a group of copies of any size makes no more than ``RARE`` pairs a document and key,
   and no repeat is left for being too frequent.

Lines are cut at newlines and compared without surrounding blanks; blank lines are skipped in alignment and stay.
Defined cases: rows with null id or text come back unchanged; rows that repeat id and text are one document and all
lose the same lines; repeats inside one document stay unless an earlier document holds them; the first holder of a key
keeps it; an empty table gives an empty result. Columns other than text are untouched.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .cdc import word_starts
from .rows import free_name, row_key
from .scratch import materialise

RARE = 8
MIN_WORDS = 5


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned index pairs of two sequences, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        in_a, in_b = Counter(a[i0:i1]), Counter(b[j0:j1])
        place = {x: j for j, x in enumerate(b[j0:j1], j0) if in_b[x] == 1}
        anchors = [(i, place[x]) for i, x in enumerate(a[i0:i1], i0) if in_a[x] == 1 and x in place]
        if not anchors:
            continue
        tops: list[int] = []
        heads: list[int] = []
        back: list[int] = []
        for n, (_, j) in enumerate(anchors):
            at = bisect_left(tops, j)
            back.append(heads[at - 1] if at else -1)
            if at == len(tops):
                tops.append(j)
                heads.append(n)
            else:
                tops[at], heads[at] = j, n
        n, chain = heads[-1], []
        while n >= 0:
            chain.append(anchors[n])
            n = back[n]
        lo = (i0, j0)
        for i, j in reversed(chain):
            out.append((i, j))
            todo.append((lo[0], i, lo[1], j))
            lo = (i + 1, j + 1)
        todo.append((lo[0], i1, lo[1], j1))
    return sorted(out)


def repeated_lines(a: list[int], b: list[int], words: list[int], least: int = MIN_WORDS) -> list[int]:
    """Indices into ``b`` of aligned runs that hold at least ``least`` words."""
    out: list[int] = []
    run: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[x] for x in run) >= least:
                out += run
            run = []
        run.append(j)
        last = (i, j)
    return out


def block_keys(h: list[int], words: list[int], short: list[int], least: int = MIN_WORDS) -> Iterator[tuple[int, int]]:
    """(key, index) of lines with fewer than ``least`` words: one for every least block around the line that has them."""
    for p in short:
        start, held = p, words[p]
        while True:
            end, n = p, held
            while n < least and end + 1 < len(h):
                end += 1
                n += words[end]
            if n >= least:
                yield hash(tuple(h[start : end + 1])), p
            if held >= least or not start:
                break
            start -= 1
            held += words[start]


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number in the row, hash, words) of every line that isn't blank."""
    breaks = np.flatnonzero(data == 10)
    start, end = np.sort(np.concatenate([breaks + 1, off[:-1]])), np.sort(np.concatenate([breaks, off[1:]]))
    row = np.searchsorted(off, start, side="right") - 1
    # rows without text share their start with the next one: each line goes to the row of its own place in order
    row = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(breaks, off)) + 1) if len(off) > 1 else row
    number = np.arange(len(row)) - np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(off) - 1))])[row]
    counted = word_starts(data, off)
    words = counted[end] - counted[start]
    said = words > 0
    row, number, start, end, words = row[said], number[said], start[said], end[said], words[said]
    place, solid = np.arange(len(data)), data != 32
    if len(data):
        first = np.minimum.accumulate(np.where(solid, place, len(data))[::-1])[::-1]
        last = np.maximum.accumulate(np.where(solid, place, -1))
        start, end = first[start], last[end - 1] + 1
    return row, number, tx.signed(tx.span_hashes(tx.prefix_sums(data), start, end)), words


def _keyed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in tx.chunks(b, "text", lower=False):
                row, number, h, words = lines(data, off)
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                long = np.flatnonzero(words >= least)
                found, where = [h[long]], [long]
                short = np.flatnonzero(words < least)
                cut = np.searchsorted(short, at)
                for r in np.flatnonzero(np.diff(cut)):
                    s, e = at[r], at[r + 1]
                    own = list(block_keys(h[s:e].tolist(), words[s:e].tolist(), (short[cut[r] : cut[r + 1]] - s).tolist(), least))
                    if own:
                        key, p = zip(*own, strict=True)
                        found.append(np.array(key, dtype=np.int64))
                        where.append(np.array(p, dtype=np.int64) + s)
                key, place = np.concatenate(found), np.concatenate(where)
                order = np.argsort(row[place], kind="stable")
                key, place = key[order], place[order]
                ends = np.searchsorted(row[place], np.arange(hi - lo + 1))
                listed = lambda o, x, kind: pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(x, kind))
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).slice(lo, hi - lo) for c in ("doc_id", "k")], listed(at, number, pa.int32()), listed(at, h, pa.int64()), listed(at, words, pa.int32()), listed(ends, key, pa.int64()), listed(ends, number[place], pa.int32())],
                    ["doc_id", "k", "i", "h", "w", "key", "line"],
                )

    return run


def _align(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = []
            for x, y, w, at in zip(b.column("ah").to_pylist(), b.column("bh").to_pylist(), b.column("bw").to_pylist(), b.column("bi").to_pylist(), strict=True):
                gone.append([at[n] for n in repeated_lines(x, y, w, least)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k"), pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "k", "gone"])

    return run


def _once(cut: DataFrame) -> DataFrame:
    """Each document once. Arrays are shuffled only for those that are there more often."""
    again = cut.groupBy("doc_id", "k").count().where("count > 1").select("doc_id", "k")
    if again.isEmpty():
        return cut
    return cut.join(again, ["doc_id", "k"], "left_anti").unionByName(cut.join(again, ["doc_id", "k"], "left_semi").dropDuplicates(["doc_id", "k"]))


def deletions(docs: DataFrame, rare: int = RARE, least: int = MIN_WORDS) -> DataFrame:
    """(k, gone): line numbers to delete from the document with row key k."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("k"), F.col("text").cast("string").alias("text"))
    cut = texts.mapInArrow(_keyed(least), "doc_id long, k long, i array<int>, h array<bigint>, w array<int>, key array<bigint>, line array<int>").where("size(h) > 0")
    cut = _once(materialise(cut, "lines"))
    held = cut.select(F.explode(F.array_distinct("key")).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    places = cut.select("doc_id", "k", F.explode(F.arrays_zip("key", "line")).alias("x")).select("doc_id", "k", F.col("x.key").alias("key"), F.col("x.line").alias("line"))
    shared = materialise(places.join(held, "key"), "shared")
    often = shared.where(F.col("n") > rare)
    least_id = often.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    # of rows that share the least id the one with the least key is the first
    first = often.select("key", "doc_id", "k").join(least_id, ["key", "doc_id"]).groupBy("key").agg(F.min("doc_id").alias("least"), F.min("k").alias("least_k"))
    boiler = often.join(first, "key").where("doc_id != least or k != least_k").select("k", "line")
    one = F.struct("doc_id", "k")
    sets = shared.where(F.col("n") <= rare).groupBy("key").agg(F.array_sort(F.collect_set(one)).alias("ds"))
    pairs = sets.select(F.explode(F.expr("flatten(transform(ds, (x, i) -> transform(slice(ds, i + 2, size(ds)), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b").distinct()
    pairs = pairs.select(*[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "ab" for c in ("doc_id", "k")])
    a = cut.select(F.col("doc_id").alias("a_doc_id"), F.col("k").alias("a_k"), F.col("h").alias("ah"))
    b = cut.select(F.col("doc_id").alias("b_doc_id"), F.col("k").alias("b_k"), F.col("h").alias("bh"), F.col("w").alias("bw"), F.col("i").alias("bi"))
    both = pairs.join(a, ["a_doc_id", "a_k"]).join(b, ["b_doc_id", "b_k"]).select(F.col("b_doc_id").alias("doc_id"), F.col("b_k").alias("k"), "ah", "bh", "bw", "bi")
    gone = both.mapInArrow(_align(least), "doc_id long, k long, gone array<int>").select("k", F.explode("gone").alias("line"))
    return gone.union(boiler).groupBy("k").agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, rare: int = RARE, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated blocks removed from ``text``, and a column ``lines_removed`` (replaced where there is one)."""
    return _deduped(docs.drop("lines_removed"), "lines_removed", rare, least)


def _deduped(docs: DataFrame, count: str, rare: int, least: int) -> DataFrame:
    key, cut = free_name(docs, "__row_key"), free_name(docs, "__gone")
    found = deletions(docs, rare, least).withColumnRenamed("k", key).withColumnRenamed("gone", cut)
    kept = F.expr(f"array_join(filter(split(text, '\\n'), (x, i) -> not array_contains({cut}, i)), '\\n')")
    # a row without deletions keeps a null list, so its text passes through as it is
    joined = docs.withColumn(key, row_key()).join(found, key, "left")
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(kept)
    return joined.withColumn("text", text).select(*docs.columns, F.coalesce(F.size(cut), F.lit(0)).alias(count))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` after line dedup; ``n_chars`` follows the text, documents left with no words go."""
    count = free_name(docs, "lines_removed")
    out = _deduped(docs, count, RARE, MIN_WORDS)
    out = out.where((F.col(count) == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
