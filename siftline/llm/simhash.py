"""Near-duplicate documents by SimHash and a binary-trie self-join.

Fingerprint
    128 signs of a sum of word vectors. A word counts once per occurrence, weighted by squared inverse document
    frequency. Frequencies are counted over every document; only words in at least ``COMMON`` of all documents
    are sent to the workers (there are at most words-per-document / COMMON of these, however large the corpus),
    all rarer words share the top weight.
Search
    Exact for the budget: two fingerprints are neighbours if their first 64 bits differ in at most ``budget``
    places and all 128 in at most ``total``. Both are walked as binary tries over sorted arrays: pairs of nodes
    go down together, differing bits add up, and a pair of nodes is dropped once it has used up its error budget.
    The walk is made in four rotations by 16 bits. Among four blocks with at most ``budget`` errors in all, one
    has at most ``budget // 4``, so that smaller budget holds for the first 16 levels of one rotation at least,
    and every neighbour is met. Tasks are pairs of subtries below a common prefix length, which grows with the
    number of fingerprints.
Groups
    Connected components of neighbours; the smallest doc_id of each stands for it.

Defined cases: rows with null id or null text, and texts without a word, are never compared and form groups of
their own (``group_id`` equals ``doc_id``, ``keep`` is true). Rows that repeat an id are one document where their
texts agree. Ties go to the smallest id. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as tx
from .rows import free_name
from .scratch import materialise

COMMON = 0.001
BUDGET = 11
TOTAL = 24
BLOCK = 16
_FP = "doc_id long, f1 long, f2 long"


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(w, n): number of texts holding each word, from one pass with partial counts per task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for _, _, data, off in tx.chunks(batch, "text"):
                h, row = tx.words(data, off)
                pairs = np.unique((row.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
                u, n = np.unique(pairs & np.uint64((1 << 48) - 1), return_counts=True)
                keys.append(u)
                counts.append(n)
                held += len(u)
                if held > 4_000_000:
                    keys, counts = _merge(keys, counts)
                    if (held := len(keys[0])) > 2_000_000:
                        yield _counts(keys[0], counts[0])
                        keys, counts, held = [], [], 0
        if keys:
            keys, counts = _merge(keys, counts)
            yield _counts(keys[0], counts[0])

    return docs.select("text").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    u, at = np.unique(np.concatenate(keys), return_inverse=True)
    return [u], [np.bincount(at, np.concatenate(counts)).astype(np.int64)]


def _counts(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(tx.signed(keys)), pa.array(counts)], ["w", "n"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f1, f2) of every row with an id and at least one word. Runs a job for the word weights."""
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    total = docs.count()
    common = document_frequencies(docs).where(F.col("n") >= F.lit(total * COMMON)).toPandas()
    order = np.argsort(common["w"].to_numpy(np.int64).view(np.uint64))
    keys = common["w"].to_numpy(np.int64).view(np.uint64)[order]
    share = common["n"].to_numpy(np.float64)[order] / max(1, total)
    weights = np.clip((np.log(np.maximum(share, COMMON)) / np.log(COMMON)) ** 2, 0.003, 1).astype(np.float32)
    table = docs.sparkSession.sparkContext.broadcast((keys, weights))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights = table.value
        for batch in batches:
            ids, out = batch.column("doc_id"), ([], [], [])
            for first, _, data, off in tx.chunks(batch, "text"):
                h, row = tx.words(data, off)
                pairs, tf = np.unique((row.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)), return_counts=True)
                if not len(pairs):
                    continue
                rows, word = (pairs >> np.uint64(48)).astype(np.int64), pairs & np.uint64((1 << 48) - 1)
                w = np.ones(len(word), dtype=np.float32)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, word), len(keys) - 1)
                    w = np.where(keys[at] == word, weights[at], w)
                starts = np.flatnonzero(np.diff(rows, prepend=-1))
                sums = _sign_sums(word, w * tf, starts)
                packed = np.packbits(sums > 0, axis=1).view(np.uint64)
                out[0].append(rows[starts] + first)
                out[1].append(packed[:, 0])
                out[2].append(packed[:, 1])
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.concatenate(out[0]))), pa.array(tx.signed(np.concatenate(out[1]))), pa.array(tx.signed(np.concatenate(out[2])))],
                    ["doc_id", "f1", "f2"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, _FP)


def _sign_sums(word: np.ndarray, weight: np.ndarray, starts: np.ndarray, step: int = 20_000) -> np.ndarray:
    """Rows of 128 sums of weights, plus half of each where the word's bit is set and minus half where it isn't; a
    row's words begin at starts[i]."""
    sums = np.zeros((len(starts), 128), dtype=np.float32)
    ends = np.append(starts[1:], len(word))
    for lo in range(0, len(word), step):
        w = word[lo : lo + step]
        bits = np.unpackbits(np.stack([tx.mix(w), tx.mix(w ^ np.uint64(0x5DEECE66D1234567))], axis=1).view(np.uint8).reshape(len(w), 16), axis=1).astype(np.float32)
        a = np.searchsorted(starts, lo, side="right") - 1
        b = np.searchsorted(starts, lo + len(w), side="left")
        for r in range(a, b):  # one product of a vector and a matrix for each text
            s, e = max(starts[r], lo), min(ends[r], lo + len(w))
            own = weight[s:e].astype(np.float32)
            sums[r] += own @ bits[s - lo : e - lo] - np.float32(0.5) * own.sum()
    return sums


# --- trie self-join


def trie_pairs(a: np.ndarray, b: np.ndarray | None, depth: int, budget: int, block: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sorted uint64 arrays whose first ``depth`` bits differ in at most ``budget`` places.

    ``b`` None: a self-join, each unordered pair once. Nodes are ranges of the sorted arrays.
    """
    own = b is None
    other = a if own else b
    if not len(a) or not len(other):
        return
    al, ah, bl, bh, err = (np.array([x], dtype=np.int64) for x in (0, len(a), 0, len(other), 0))
    for d in range(depth):
        shift = np.uint64(63 - d)
        ones_a = np.concatenate([[0], np.cumsum((a >> shift) & np.uint64(1), dtype=np.int64)])
        ones_b = ones_a if own else np.concatenate([[0], np.cumsum((other >> shift) & np.uint64(1), dtype=np.int64)])
        am, bm = ah - (ones_a[ah] - ones_a[al]), bh - (ones_b[bh] - ones_b[bl])
        same = (al == bl) & (ah == bh) if own else np.zeros(len(al), dtype=bool)
        parts = [
            (al, am, bl, bm, err, None),
            (am, ah, bm, bh, err, None),
            (al, am, bm, bh, err + 1, None),
            (am, ah, bl, bm, err + 1, same),
        ]
        kept = []
        for x0, x1, y0, y1, e, skip in parts:
            ok = (x1 > x0) & (y1 > y0) & (e <= budget)
            if skip is not None:
                ok &= ~skip
            kept.append([v[ok] for v in (x0, x1, y0, y1, e)])
        al, ah, bl, bh, err = (np.concatenate(v) for v in zip(*kept, strict=True))
        if not len(al):
            return
    width, sizes = bh - bl, (ah - al) * (bh - bl)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + block, side="right")))
        # one node pair may hold more than a block: it is cut into slices of rows of its product
        for s in range(0, int(ends[hi - 1] - base), block):
            k = np.arange(base + s, min(base + s + block, ends[hi - 1]))
            node = np.searchsorted(ends, k, side="right")
            inner = k - (ends[node] - sizes[node])
            i, j = al[node] + inner // width[node], bl[node] + inner % width[node]
            if own:
                ok = i < j
                i, j = i[ok], j[ok]
            yield i, j
        lo = hi


class _Forest:
    """Union-find that takes arrays of pairs and keeps a spanning forest."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)
        self.edges: list[np.ndarray] = []

    def roots(self) -> np.ndarray:
        while True:
            higher = self.up[self.up]
            if np.array_equal(higher, self.up):
                return self.up
            self.up = higher

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            r = self.roots()
            x, y = np.minimum(r[i], r[j]), np.maximum(r[i], r[j])
            new = x != y
            i, j, x, y = i[new], j[new], x[new], y[new]
            _, at = np.unique(y, return_index=True)  # one parent for each root in a turn
            self.up[y[at]] = x[at]
            self.edges.append(np.stack([i[at], j[at]], axis=1))


def _rotated(f: np.ndarray, turn: int) -> np.ndarray:
    return f if not turn else (f << np.uint64(BLOCK * turn)) | (f >> np.uint64(64 - BLOCK * turn))


def _prefix_edges(budget: int, total: int):
    def join(table: pa.Table) -> pa.Table:
        turn = int(table.column("turn")[0].as_py())
        f1, f2, ids, side = (table.column(c).to_numpy() for c in ("f1", "f2", "rep", "side"))
        f1, f2 = _rotated(f1.astype(np.int64).view(np.uint64), turn), f2.astype(np.int64).view(np.uint64)
        home, probe = side == 0, side == 1
        order = np.concatenate([np.flatnonzero(m)[np.argsort(f1[m], kind="stable")] for m in (home, probe)])
        f1, f2, ids, n = f1[order], f2[order], ids[order], int(home.sum())
        forest = _Forest(len(f1))
        for left, right, shift in ((f1[:n], None, 0), (f1[:n], f1[n:], n)):
            for i, j in trie_pairs(left, right, BLOCK, budget // (64 // BLOCK)):
                j = j + shift
                near = np.bitwise_count(f1[i] ^ f1[j]).astype(np.int64)
                ok = near <= budget
                i, j, near = i[ok], j[ok], near[ok]
                ok = near + np.bitwise_count(f2[i] ^ f2[j]) <= total
                forest.add(i[ok], j[ok])
        e = np.concatenate(forest.edges) if forest.edges else np.zeros((0, 2), dtype=np.int64)
        return pa.table({"a": ids[e[:, 0]].astype(np.int64), "b": ids[e[:, 1]].astype(np.int64)})

    return join


def neighbour_edges(reps: DataFrame, count: int, budget: int = BUDGET, total: int = TOTAL, prefix: int | None = None) -> DataFrame:
    """(a, b): edges that connect all neighbours among ``reps`` (rep, f1, f2), of which there are ``count``."""
    p = prefix if prefix is not None else int(np.clip(np.ceil(np.log2(max(1, count) / (1 << 17))), 3, BLOCK))
    flips = [sum(1 << x for x in c) for k in range(1, budget // (64 // BLOCK) + 1) for c in combinations(range(p), k)]
    turned = lambda t: F.expr(f"(shiftleft(f1, {BLOCK * t}) | shiftrightunsigned(f1, {64 - BLOCK * t}))") if t else F.col("f1")
    # a fingerprint is at home in its own bucket, and a probe in those neighbouring buckets that come before it
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), F.shiftrightunsigned(turned(t), 64 - p).alias("own")) for t in range(64 // BLOCK)]))
    at = reps.select("rep", "f1", "f2", rows.alias("r")).select("rep", "f1", "f2", "r.turn", "r.own")
    xor = F.array(F.lit(0).cast("long"), *[F.lit(x).cast("long") for x in flips])
    spread = (
        at.select("*", F.explode(xor).alias("x"))
        .select("rep", "f1", "f2", "turn", F.col("own").bitwiseXOR(F.col("x")).alias("bucket"), "own", (F.col("x") != 0).cast("int").alias("side"))
        .where("side = 0 or bucket < own")
        .drop("own")
    )
    return spread.groupBy("turn", "bucket").applyInArrow(_prefix_edges(budget, total), "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component.

    Large-star and small-star steps in turn; each round is written to the shared folder.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi != lo").distinct(), "edges")
    for _ in range(rounds):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        done = materialise(small.select("e.hi", "e.lo").where("hi != lo").distinct(), "edges")
        moved = done.join(edges, ["hi", "lo"], "left_anti").limit(1).count() + edges.join(done, ["hi", "lo"], "left_anti").limit(1).count()
        edges = done
        if not moved:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, budget: int = BUDGET, total: int = TOTAL) -> DataFrame:
    """(doc_id, group_id, keep) for every row of ``docs``; see the module text for the defined cases."""
    prints = materialise(fingerprints(docs), "fingerprints")
    reps = materialise(prints.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")), "reps")
    edges = neighbour_edges(reps, reps.count(), budget, total)
    # a document whose rows have several texts joins the groups of all of them
    links = edges.union(prints.join(reps, ["f1", "f2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    roots = components(links)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.coalesce("root", "doc_id").alias("group_id"), F.coalesce(F.col("root") == F.col("doc_id"), F.lit(True)).alias("keep")
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group; columns unchanged."""
    found = materialise(near_duplicates(docs), "groups")
    gone = found.where("not keep").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    repeated = found.where("keep and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return left.select(docs.columns)
    again = left.join(repeated, "doc_id", "left_semi")
    rank = free_name(docs, "__rank")
    once = again.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))).where(F.col(rank) == 1)
    return left.join(repeated, "doc_id", "left_anti").select(docs.columns).union(once.select(docs.columns))
