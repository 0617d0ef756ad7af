"""Passages repeated across documents, by content-defined chunking.

Chunks
    A gear rolling hash runs over the bytes of a text: h = (h << 1) + gear[byte], so it depends on the last 32 bytes. A
    chunk ends where the hash is greater than at the ``REACH`` positions before and at none after it within ``REACH``
    less. Boundaries depend on 32 + 2 * ``REACH`` nearby bytes only, hence an insertion shifts no chunk beyond its
    surroundings, and chunks have more than ``REACH`` bytes.
Anchors
    Chunks are deduplicated by digest: a chunk that several documents hold is an anchor to the document that holds it
    first (least doc_id, then row key). So is a pair of neighbouring chunks: where a chunk alone leads to a document
    that shares no more than it, a pair leads to one that does.
Runs
    Anchors that are neighbours in both documents form a run. Runs are extended byte by byte to both sides as long as
    the two texts agree; for this only windows around the ends of runs leave the texts, larger ones in a next round
    for the few runs that agree throughout. Extended runs of ``MIN_WORDS`` words and more are the result, without
    those inside another one. A false anchor by equal digests would have to be continued by as many words.

Defined cases: null ids and null or empty texts give no rows; rows that repeat id and text are one document; rows that
share an id but not the text are two; repeats inside one document don't count; the first holder keeps its passage. A
text without a boundary is one chunk. Offsets are in UTF-8 bytes, never inside a character, but they may be inside a
word whose first letters agree as well; words are runs of bytes
above the blank, counted where they begin. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as tx
from .rows import free_name, row_key
from .scratch import materialise

REACH = 32
MIN_WORDS = 50
WINDOW = 192
#: Up to this many places (20 bytes each) where runs end are broadcast to the texts; for more the texts are shuffled.
MAX_BROADCAST_PLACES = 1_000_000
_GEAR = np.random.default_rng(977).integers(0, 1 << 32, 256, dtype=np.uint32)
_FAR = 1 << 30


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte, over the 32 bytes that end there."""
    with np.errstate(over="ignore"):
        h = _GEAR[data]
        for step in (1, 2, 4, 8, 16):  # windows of 2, 4 ... 32 bytes by doubling
            if len(h) > step:
                h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def cut(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the chunks of every row."""
    ends = off[1:][np.diff(off) > 0]
    n, w = len(data), REACH
    if n > 32 + 2 * w:
        h = gear(data)
        top, step = h, 1
        while step < w:  # top[i] = greatest of h[i : i + w]
            top = np.maximum(top[:-step], top[step:])
            step *= 2
        p = np.arange(w, n - w)
        ok = (h[w : n - w] > top[: n - 2 * w]) & (h[w : n - w] >= top[w + 1 : n - w + 1])
        p = p[ok]
        row = np.searchsorted(off, p, side="right") - 1
        # the whole neighbourhood lies in the row, and the cut isn't inside a character
        p = p[(p - off[row] >= 31 + w) & (off[row + 1] - p > w)]
        p = p[(data[p + 1] & 0xC0) != 0x80]
        ends = np.sort(np.concatenate([p + 1, ends]))
    return np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends, ends


def word_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """S with S[i] = number of words that begin before byte i; a word never crosses a row."""
    black = data > 32
    start = black.copy()
    start[1:] &= ~black[:-1]
    first = off[:-1][off[:-1] < len(data)]
    start[first] = black[first]
    return np.concatenate([[0], np.cumsum(start)])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, _, data, off in tx.chunks(b, "text", lower=False):
            s, e = cut(data, off)
            if not len(s):
                continue
            row = np.searchsorted(off, s, side="right") - 1
            digest, words, pick = tx.span_hashes(tx.prefix_sums(data), s, e), word_starts(data, off), pa.array(row + first)
            base = words[off[row]]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pick), b.column("k").take(pick), *[pa.array(x.astype(np.int32)) for x in (s - off[row], e - off[row], words[s] - base, words[e] - base)], pa.array(tx.signed(digest))],
                ["doc_id", "k", "start", "end", "w0", "w1", "digest"],
            )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("k"), F.col("text").cast("string").alias("text"))


def chunk_table(docs: DataFrame) -> DataFrame:
    """(doc_id, k, start, end, w0, w1, digest) of all chunks; w0 and w1 count the words that begin before start and end."""
    return _texts(docs).mapInArrow(_chunks, "doc_id long, k long, start int, end int, w0 int, w1 int, digest long")


_RUN = ("k", "doc_id", "sk", "source")


def anchored_runs(chunks: DataFrame) -> DataFrame:
    """(k, doc_id, sk, source, shift, start, end, words): runs of chunks that an earlier document holds ``shift`` bytes before."""
    often = chunks.groupBy("digest").count().where("count > 1").select("digest")
    again = materialise(chunks.join(often, "digest"), "shared")
    # one shuffle by document serves both steps; rows that repeat id and text are one document
    again = again.repartition("k").dropDuplicates(["k", "start"])
    order = Window.partitionBy("k").orderBy("start")
    ahead = again.withColumn("next", F.lead(F.struct("digest", "start", "end", "w1")).over(order))
    span = lambda key, end, w1: F.struct(key.alias("key"), F.col(end).alias("end"), F.col(w1).alias("w1"))
    pair = F.when(F.col("next.start") == F.col("end"), span(F.xxhash64("digest", "next.digest"), "next.end", "next.w1"))
    rows = ahead.select("k", "doc_id", "start", "w0", F.explode(F.array_compact(F.array(span(F.col("digest"), "end", "w1"), pair))).alias("b"))
    rows = rows.select("k", "doc_id", "start", "w0", "b.*")
    first = rows.groupBy("key").agg(F.min(F.struct("doc_id", "k", "start")).alias("first"))
    hits = rows.join(first, "key").where("k != first.k")
    hits = hits.select("k", "doc_id", F.col("first.k").alias("sk"), F.col("first.doc_id").alias("source"), (F.col("start") - F.col("first.start")).alias("shift"), "start", "end", "w0", "w1")
    return _linked(hits).groupBy(*_RUN, "shift", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("w1") - F.min("w0")).alias("words")).drop("run")


def _linked(rows: DataFrame) -> DataFrame:
    """``rows`` with the number of their ``run``: those that touch or overlap on one diagonal of two documents have the same."""
    line = Window.partitionBy("k", "sk", "shift").orderBy("start")
    rows = rows.withColumn("last", F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.withColumn("new", F.coalesce((F.col("start") > F.col("last")).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(line))


def _joined(rows: DataFrame) -> DataFrame:
    """Extended runs that touch or overlap become one; ``left`` are the words by which a run was extended to its left."""
    # a gap that agrees was walked from both of its ends
    words = F.col("words") - F.when((F.col("new") == 0) & (F.col("start") < F.col("last")), F.col("left")).otherwise(0)
    return _linked(rows).groupBy(*_RUN, "shift", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum(words).alias("words")).drop("run")


def _cut_windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            texts = b.column("text").cast(pa.large_binary())
            for k, places, text in zip(b.column("k").to_pylist(), b.column("places").to_pylist(), texts, strict=True):
                raw = text.as_buffer()
                for x in places:
                    at, side = x["pos"], x["side"]
                    # one more byte before, which tells whether a word begins at the first one
                    out.append((k, at, side, raw[max(0, at - size - 1) : at].to_pybytes() if side < 0 else raw[at - 1 : at + size].to_pybytes()))
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary())], ["k", "pos", "side", "window"])

    return run


def agreement(mine: bytes, other: bytes, side: int, room: int, size: int) -> tuple[int, int, bool]:
    """(bytes, words that begin in them, whether there may be more) by which two texts agree from a point on.

    To the left windows end at the point; to the right they begin one byte before it. A window that is shorter than
    asked for ends with its text.
    """
    a, b = np.frombuffer(mine, dtype=np.uint8), np.frombuffer(other, dtype=np.uint8)
    x, y = (a[::-1], b[::-1]) if side < 0 else (a[1:], b[1:])
    most = min(len(x), len(y), room, size)
    differ = np.flatnonzero(x[:most] != y[:most])
    n = int(differ[0]) if len(differ) else most
    more = not len(differ) and n < room and n == size
    if side < 0:
        while n and not more and (x[n - 1] & 0xC0) == 0x80:
            n -= 1
        piece = a[len(a) - n :]
        before = a[len(a) - n - 1] if n < len(a) else 0
    else:
        while n and not more and n < len(x) and (x[n] & 0xC0) == 0x80:
            n -= 1
        piece, before = a[1 : n + 1], a[0]
    black = np.concatenate([[before], piece]) > 32
    return n, int((black[1:] & ~black[:-1]).sum()), more


def _extend(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [agreement(x, y, side, room, size) for x, y, side, room in zip(*[b.column(c).to_pylist() for c in ("mine", "other", "side", "room")], strict=True)]
            if found:
                n, w, more = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in _EDGE], pa.array(n, pa.int32()), pa.array(w, pa.int32()), pa.array(more, pa.bool_())], [*_EDGE, "bytes", "found", "more"])

    return run


_EDGE = ("k", "sk", "shift", "start", "side", "pos", "room")


def _extended(texts: DataFrame, runs: DataFrame, size: int) -> DataFrame:
    """``runs`` with both ends moved as far as the texts agree."""
    line = Window.partitionBy("k", "sk", "shift").orderBy("start")
    left = F.least(F.col("start"), F.col("start") - F.col("shift"), F.coalesce(F.col("start") - F.lag("end").over(line), F.lit(_FAR)))
    right = F.coalesce(F.lead("start").over(line) - F.col("end"), F.lit(_FAR))
    ends = F.array(F.struct(F.lit(-1).alias("side"), F.col("start").alias("pos"), left.alias("room")), F.struct(F.lit(1).alias("side"), F.col("end").alias("pos"), right.alias("room")))
    edges = runs.select("k", "sk", "shift", "start", ends.alias("e")).select("k", "sk", "shift", "start", F.explode("e").alias("e")).select("k", "sk", "shift", "start", "e.*").where("room > 0")
    done = None
    while True:
        edges = materialise(edges, "edges")
        if done is not None and edges.isEmpty():
            break
        ask = edges.select("k", "pos", "side").union(edges.select("sk", F.col("pos") - F.col("shift"), "side")).distinct()
        places = ask.groupBy("k").agg(F.collect_list(F.struct("pos", "side")).alias("places"))
        if ask.limit(MAX_BROADCAST_PLACES + 1).count() <= MAX_BROADCAST_PLACES:
            places = F.broadcast(places)
        cut = texts.select("k", "text").join(places, "k").mapInArrow(_cut_windows(size), "k long, pos int, side int, window binary")
        cut = cut.groupBy("k", "pos", "side").agg(F.first("window").alias("window"))
        own = cut.withColumnRenamed("window", "mine")
        other = cut.select(F.col("k").alias("sk"), F.col("pos").alias("spos"), "side", F.col("window").alias("other"))
        both = edges.join(own, ["k", "pos", "side"]).withColumn("spos", F.col("pos") - F.col("shift")).join(other, ["sk", "spos", "side"])
        moved = materialise(both.select(*_EDGE, "mine", "other").mapInArrow(_extend(size), "k long, sk long, shift int, start int, side int, pos int, room int, bytes int, found int, more boolean"), "moved")
        done = moved if done is None else done.union(moved)
        edges = moved.where("more").select("k", "sk", "shift", "start", "side", (F.col("pos") + F.col("side") * F.col("bytes")).alias("pos"), (F.col("room") - F.col("bytes")).alias("room"))
        size *= 8
    side = lambda name, x: F.sum(F.when(F.col("side") == x, F.col(name)).otherwise(0))
    sums = done.groupBy("k", "sk", "shift", "start").agg(side("bytes", -1).alias("before"), side("bytes", 1).alias("after"), side("found", -1).alias("left"), F.sum("found").alias("more"))
    whole = runs.join(sums, ["k", "sk", "shift", "start"], "left").na.fill(0, ["before", "after", "left", "more"])
    whole = whole.select(*_RUN, "shift", (F.col("start") - F.col("before")).alias("start"), (F.col("end") + F.col("after")).alias("end"), (F.col("words") + F.col("more")).alias("words"), "left")
    return _joined(whole)


def repeats(docs: DataFrame, least: int = MIN_WORDS, size: int = WINDOW) -> DataFrame:
    """(doc_id, k, start, end, words, first_doc_id): each passage of ``least`` words that an earlier document holds."""
    chunks = materialise(chunk_table(docs), "chunks")
    runs = materialise(anchored_runs(chunks), "runs")
    runs = _extended(_texts(docs), runs, size).where(F.col("words") >= least)
    order = Window.partitionBy("k").orderBy("start", F.desc("end"), "source", "sk", "shift").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("covered", F.max("end").over(order)).where("covered is null or end > covered")
    return runs.select("doc_id", "k", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("words").cast("int").alias("words"), F.col("source").alias("first_doc_id"))


def strip_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the byte ranges of ``found`` (from :func:`repeats`) taken out of ``text``; rows without any, null
    ids and texts among them, come back as they are, and so do all other columns."""
    key, spans = free_name(docs, "__row_key"), free_name(docs, "__spans")
    cut = found.groupBy("k").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(spans)).withColumnRenamed("k", key)
    joined = docs.withColumn(key, row_key()).join(cut, key, "left")
    piece = "substring(cast(text as binary), s.at + 1, greatest(0, x.start - s.at))"
    raw = F.expr(
        f"decode(aggregate({spans}, named_struct('at', 0, 'out', cast('' as binary)), (s, x) -> named_struct('at', greatest(s.at, x.end), 'out', concat(s.out, {piece})),"
        " s -> concat(s.out, substring(cast(text as binary), s.at + 1, octet_length(text)))), 'UTF-8')"
    )
    return joined.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(raw)).select(docs.columns)
