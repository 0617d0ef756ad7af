"""Interpolated modified Kneser-Ney n-gram model over words, for perplexity.

A first job counts all words and gives them dense numbers, frequent words first, kept as sorted hash arrays. The second
counts n-grams. Workers turn their documents into distinct n-grams with counts and pack these into one compressed
block for each bucket of the context's hash; blocks are shuffled, not rows. Each bucket is merged into
sorted hash arrays and written to one file in the shared folder; its distinct suffixes go on to the next lower order,
where they give continuation counts, and so on down to single words. Counts and statistics cover all documents.

A file holds, for one order and bucket: the sorted hashes and counts of the n-grams, those of contexts and their
statistics; as few statistics differ, each distinct row of them is stored once and contexts hold its number. A sorted
array of hashes is stored as 32 bits each below a table of cells: bits that the bucket and the cell tell aren't stored
again, so a lookup compares 40 bits and more (of n hashes a bucket, 32 + log2(n) - 3 beyond the bucket's own). Counts
are bytes with a list of the larger ones. Workers map these files into memory read-only, so the page cache of a node
holds one copy; a file that is missing there is an error. All n-grams are stored. Only if a caller raises ``min_counts`` are those below it left out; their probability mass then goes to the lower
order, so that each distribution still sums to one, and discounts still come from counts of counts over everything.

A document is ``order - 1`` start marks, its words and an end mark; a word not seen in training is one unknown word.
Defined cases: null texts and texts without words have null perplexity; a null id stays null; repeated rows are counted
and scored as often as they are there; an empty training table gives the uniform model. Extra columns are not read.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .scratch import bound_parts, file_system, new_path

ORDER = 3
MIN_COUNTS = (1, 1, 1)
START, END, UNKNOWN, FIRST = 0, 1, 2, 3
CLASSES = 48
_BLOCK = 2_000_000
#: Tokens for which one bucket of n-grams is made; a bucket is merged in one task.
BUCKET_TOKENS = 4_000_000
_U = np.uint64
_ROWS = "bucket int, kind int, blob binary"
_NGRAMS, _CONTEXTS, _STATS = 0, 1, 2


def chain(columns: Sequence[np.ndarray]) -> np.ndarray:
    """Hash of an n-gram from its word ids."""
    acc = np.zeros(len(columns[0]), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            acc = tx.mix(acc * _U(0x9E3779B97F4A7C15) + c.astype(np.uint64) + _U(0x632BE59BD9B4E019))
    return acc


def keys(columns: Sequence[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray | None]:
    """(key, context key). From order 3 on a key's top bits are its context's, so both lie in the same bucket."""
    full = chain(columns)
    if len(columns) == 1:
        return full, None
    context, _ = keys(columns[:-1], bits)
    if len(columns) > 2:
        full = (context >> _U(64 - bits) << _U(64 - bits)) | (full >> _U(bits))
    return full, context


def cells(key: np.ndarray, bits: int) -> list[np.ndarray]:
    """A bucket's sorted keys as [head, first key of each cell, 32 bits of each key below bucket and cell]."""
    deep = max(0, int(len(key)).bit_length() - 4)
    inside = key << _U(bits)
    start = np.searchsorted(inside >> _U(64 - deep) if deep else np.zeros(len(key), dtype=np.uint64), np.arange((1 << deep) + 1, dtype=np.uint64))
    return [np.array([len(key), deep], dtype=np.int64), start.astype(np.uint32), (inside << _U(deep) >> _U(32)).astype(np.uint32)]


def places(wanted: np.ndarray, bits: int, deep: int, start: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Index of each wanted key in a bucket's arrays, -1 where it isn't there: bisection inside cells, all keys at once."""
    inside = wanted << _U(bits)
    cell = (inside >> _U(64 - deep)).astype(np.int64) if deep else np.zeros(len(wanted), dtype=np.int64)
    key = (inside << _U(deep) >> _U(32)).astype(np.uint32)
    lo, hi = start[cell].astype(np.int64), start[cell + 1].astype(np.int64)
    end, last = hi.copy(), max(0, len(low) - 1)
    for _ in range(int((hi - lo).max(initial=0)).bit_length()):
        mid = (lo + hi) >> 1
        less = (mid < hi) & (low[np.minimum(mid, last)] < key)
        lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
    found = (lo < end) & (low[np.minimum(lo, last)] == key) if len(low) else np.zeros(len(wanted), dtype=bool)
    return np.where(found, lo, -1)


def sequences(words: np.ndarray, row: np.ndarray, rows: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, row, is predicted) of all rows with a word: start marks, words, end mark."""
    per = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, dtype=np.int64)
    length = np.where(per > 0, per + order, 0)
    begin = np.cumsum(length) - length
    ids = np.full(int(length.sum()), START, dtype=words.dtype)
    first = np.cumsum(per) - per
    ids[begin[row] + order - 1 + np.arange(len(words)) - first[row]] = words
    some = per > 0
    ids[(begin + length - 1)[some]] = END
    said = np.ones(len(ids), dtype=bool)
    for j in range(order - 1):
        said[begin[some] + j] = False
    return ids, np.repeat(np.arange(rows), length), said


def windows(ids: np.ndarray, said: np.ndarray, order: int) -> list[np.ndarray]:
    at = np.flatnonzero(said)
    return [ids[at - (order - 1) + j] for j in range(order)]


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplane(raw: memoryview, kind: np.dtype, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n)


def _by_words(columns: Sequence[np.ndarray]) -> np.ndarray:
    """Order of n-grams by first, second ... word."""
    wide = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(wide) > 64:
        return np.lexsort(columns[::-1])
    acc = np.zeros(len(columns[0]), dtype=np.uint64)
    for c, w in zip(columns, wide, strict=True):
        acc = (acc << _U(w)) | c.astype(np.uint64)
    return np.argsort(acc)


def _restarts(columns: Sequence[np.ndarray]) -> np.ndarray:
    """Where any of the columns changes, the first row included."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def pack(columns: Sequence[np.ndarray], counts: np.ndarray) -> bytes:
    """Sorted n-grams, each word as its distance from the one above it while the words before agree, as compressed byte
    planes. Frequent words have small numbers."""
    order = _by_words(columns)
    columns, steps = [c[order].astype(np.int64) for c in columns], []
    for i, c in enumerate(columns):
        step = np.diff(c, prepend=0)
        new = _restarts(columns[:i]) if i else np.zeros(len(c), dtype=bool)
        step[new] = c[new]
        steps.append(_narrow(step.astype(np.uint64)))
    counts = _narrow(counts[order])
    head = np.array([len(counts), counts.itemsize, len(steps), *[c.itemsize for c in steps]], dtype=np.int64).tobytes()
    return head + zstandard.ZstdCompressor(level=3).compress(b"".join(map(_planes, [*steps, counts])))


def unpack(blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    n, deep, k = (int(x) for x in np.frombuffer(blob, dtype=np.int64, count=3))
    wide = [int(x) for x in np.frombuffer(blob, dtype=np.int64, count=k, offset=24)]
    body = memoryview(zstandard.ZstdDecompressor().decompress(blob[24 + 8 * k :], max_output_size=n * (sum(wide) + deep) + 64))
    at, columns = 0, []
    for w in wide:
        c = np.cumsum(_unplane(body[at : at + n * w], np.dtype(f"u{w}"), n).astype(np.int64))
        if columns:
            start = np.flatnonzero(_restarts(columns))
            c -= np.repeat(np.concatenate([[0], c[start[1:] - 1]]), np.diff(start, append=n))
        columns.append(c)
        at += n * w
    top = max((int(c.max(initial=0)) for c in columns), default=0)
    return [c.astype(np.uint32 if top < 1 << 32 else np.uint64) for c in columns], _unplane(body[at : at + n * deep], np.dtype(f"u{deep}"), n).astype(np.int64)


def _unique(key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted keys, an index of each, summed counts)."""
    order = np.argsort(key)
    k = key[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, dtype=np.int64)
    return k[start], order[start], np.add.reduceat(counts[order], start) if len(k) else counts


def _rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, x = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], ["bucket", "kind", "blob"])


def _by_bucket(key: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, lo, hi) over sorted keys."""
    edges = np.searchsorted(key >> _U(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for b in range(1 << bits):
        if edges[b] < edges[b + 1]:
            yield b, int(edges[b]), int(edges[b + 1])


def _emit(columns: list[np.ndarray], counts: np.ndarray | None, bits: int) -> Iterator[tuple[int, int, bytes]]:
    key, _ = keys(columns, bits)
    key, at, n = _unique(key, np.ones(len(key), dtype=np.int64) if counts is None else counts)
    for b, lo, hi in _by_bucket(key, bits):
        yield b, _NGRAMS, pack([c[at[lo:hi]] for c in columns], n[lo:hi])


@dataclass
class Vocabulary:
    """Word numbers: classes of like counts, most frequent first, then bucket, then place in the bucket's array."""

    folder: str
    bits: int
    base: np.ndarray  # (CLASSES, buckets): first number of a class in a bucket
    filled: np.ndarray  # buckets that have a file
    _maps: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_maps": {}}

    @property
    def kind(self) -> type:
        return np.uint32 if self.base.max(initial=0) < 1 << 31 else np.uint64

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        u, inverse = np.unique(hashes, return_inverse=True)
        out = np.full(len(u), UNKNOWN, dtype=self.kind)
        for b, lo, hi in _by_bucket(u, self.bits):
            if b not in self._maps:
                raw: mmap.mmap | bytes = bytes(8)
                if self.filled[b]:
                    with open(f"{self.folder}/words-{b}", "rb") as f:
                        raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
                n = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
                self._maps[b] = tuple(np.frombuffer(raw, dtype=k, count=n, offset=o) for k, o in ((np.uint64, 8), (np.uint32, 8 + 8 * n), (np.uint8, 8 + 12 * n)))
            known, place, kinds = self._maps[b]
            if len(known):
                at = np.minimum(np.searchsorted(known, u[lo:hi]), len(known) - 1)
                ok = known[at] == u[lo:hi]
                at = at[ok]
                out[lo:hi][ok] = self.base[kinds[at], b] + place[at]
        return out[inverse]


def _count_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            u, n = np.unique(np.concatenate(held), return_counts=True)
            return _rows([(b, _NGRAMS, np.array([hi - lo], dtype=np.int64).tobytes() + u[lo:hi].tobytes() + zstandard.compress(_planes(n[lo:hi]), 1)) for b, lo, hi in _by_bucket(u, bits)])

        for batch in batches:
            for _, _, data, off in tx.chunks(batch, "text"):
                held.append(tx.words(data, off)[0])
                size += len(held[-1])
                if size >= 2 * _BLOCK:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _merge_words(bits: int, folder: str):
    def run(table: pa.Table) -> pa.Table:
        bucket, words, counts = int(table.column("bucket")[0].as_py()), [], []
        for x in table.column("blob"):
            blob = x.as_py()
            n = int(np.frombuffer(blob, dtype=np.int64, count=1)[0])
            words.append(np.frombuffer(blob, dtype=np.uint64, count=n, offset=8))
            counts.append(_unplane(memoryview(zstandard.decompress(blob[8 + 8 * n :], max_output_size=8 * n)), np.dtype(np.int64), n))
        key, _, n = _unique(np.concatenate(words), np.concatenate(counts))
        kinds = CLASSES - 1 - np.minimum(np.log2(n).astype(np.int64), CLASSES - 1)
        order = np.argsort(kinds, kind="stable")
        per = np.bincount(kinds, minlength=CLASSES)
        place = np.empty(len(key), dtype=np.uint32)
        place[order] = np.arange(len(key)) - np.repeat(np.cumsum(per) - per, per)
        _write_file(folder, f"words-{bucket}", [np.array([len(key)], dtype=np.int64), key, place, kinds.astype(np.uint8)])
        return pa.Table.from_batches([_rows([(bucket, _STATS, np.append(per, n.sum()).astype(np.int64).tobytes())])])

    return run


def _first_level(order: int, bits: int, vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            words = known.numbers(np.concatenate([h for h, _, _ in held]))
            row, rows = np.concatenate([r + sum(x[2] for x in held[:i]) for i, (_, r, _) in enumerate(held)]), sum(x[2] for x in held)
            ids, _, said = sequences(words, row, rows, order)
            return _rows(list(_emit(windows(ids, said, order), None, bits)))

        for batch in batches:
            for lo, hi, data, off in tx.chunks(batch, "text"):
                h, row = tx.words(data, off)
                if len(h):
                    held.append((h, row, hi - lo))
                    size += len(h)
                if size >= _BLOCK:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _statistics(context: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts with (all counts, kept counts, kept ones of count 1, 2, 3 or more)."""
    order = np.argsort(context, kind="stable")
    c, n = context[order], counts[order]
    start = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, dtype=np.int64)
    kept = n >= least
    cols = [n, n * kept, kept & (n == 1), kept & (n == 2), kept & (n >= 3)]
    return c[start], np.stack([np.add.reduceat(x.astype(np.float64), start) for x in cols], axis=1) if len(c) else np.zeros((0, 5))


def _write_file(folder: str, name: str, arrays: Sequence[np.ndarray]) -> None:
    """Atomic, and the same bytes from every attempt."""
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.{uuid.uuid4().hex}", "wb") as f:
        for x in arrays:
            f.write(np.ascontiguousarray(x).data if x.size else b"")
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, f"{folder}/{name}")


def _write(folder: str, level: int, bucket: int, bits: int, key: np.ndarray, counts: np.ndarray, ckey: np.ndarray, stats: np.ndarray) -> None:
    _, first, code = np.unique(chain(stats.T), return_index=True, return_inverse=True)
    many = np.flatnonzero(counts >= 255)
    code = _narrow(code)
    head = np.array([len(many), len(first), code.itemsize], dtype=np.int64)
    arrays = [head, *cells(key.astype(np.uint64), bits), *cells(ckey.astype(np.uint64), bits), np.minimum(counts, 255).astype(np.uint8), many.astype(np.uint32), counts[many].astype(np.uint64), stats[first].astype(np.float32), code]
    # every array begins at a multiple of eight bytes
    _write_file(folder, f"{level}-{bucket}", [x for a in arrays for x in (a, np.zeros(-a.nbytes % 8, dtype=np.uint8))])


def _count_of_counts(level: int, bucket: int, counts: np.ndarray) -> tuple[int, int, bytes]:
    n = [level, bucket, *[int((counts == k).sum()) for k in (1, 2, 3, 4)], int((counts >= 3).sum()), int(counts.sum()), len(counts)]
    return 0, _STATS, np.array(n, dtype=np.int64).tobytes()


def _level(level: int, bits: int, least: int, folder: str):
    """Merge the blocks of one bucket, write its arrays, send suffixes down."""

    def run(table: pa.Table) -> pa.Table:
        bucket = int(table.column("bucket")[0].as_py())
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob")
        out = [(0, _STATS, blobs[i].as_py()) for i, k in enumerate(kinds) if k == _STATS]
        parts = [unpack(blobs[i].as_py()) for i, k in enumerate(kinds) if k == _NGRAMS]
        contexts = [np.frombuffer(blobs[i].as_py(), dtype=np.float64).reshape(-1, 6) for i, k in enumerate(kinds) if k == _CONTEXTS]
        ckey, stats = np.zeros(0, dtype=np.uint64), np.zeros((0, 5))
        if contexts:  # statistics of order 2, gathered by word
            rows = np.concatenate(contexts)
            ckey, _, _ = _unique(rows[:, 0].copy().view(np.uint64), np.ones(len(rows), dtype=np.int64))
            stats = np.zeros((len(ckey), 5))
            np.add.at(stats, np.searchsorted(ckey, rows[:, 0].copy().view(np.uint64)), rows[:, 1:])
        if parts:
            columns = [np.concatenate(c) for c in zip(*[p[0] for p in parts], strict=True)]
            counts = np.concatenate([p[1] for p in parts])
            del parts
            key, context = keys(columns, bits)
            key, at, n = _unique(key, counts)
            out.append(_count_of_counts(level, bucket, n))
            keep = n >= least
            if level > 1:
                c, s = _statistics(context[at], n, least)
                if level > 2:
                    some = s[:, 1] > 0
                    ckey, stats = c[some], s[some]
                else:
                    packed = np.column_stack([c.view(np.float64), s])
                    out += [(b, _CONTEXTS, packed[lo:hi].tobytes()) for b, lo, hi in _by_bucket(c, bits)]
                out += _emit([x[at] for x in columns[1:]], None, bits)
            key, n = key[keep], n[keep]
        else:
            key, n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
            if contexts:
                out.append(_count_of_counts(level, bucket, n))
        some = stats[:, 1] > 0
        _write(folder, level, bucket, bits, key, n, ckey[some], stats[some])
        return pa.Table.from_batches([_rows(out or [(0, _STATS, b"")])])

    return run


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(float(np.clip(d, 0.05, k - 0.05)) for k, d in enumerate(raw, 1))


@dataclass
class Model:
    """Where the arrays lie, and what is global to them."""

    vocabulary: Vocabulary
    folder: str
    order: int
    bits: int
    discounts: dict[int, tuple[float, float, float]]
    total: float
    kinds: int
    base: float
    filled: dict[int, np.ndarray]  # for each level the buckets that have a file
    _maps: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_maps": {}}

    def arrays(self, level: int, bucket: int) -> tuple | None:
        """Arrays of one file, mapped on first use; None for a bucket without n-grams."""
        if (level, bucket) not in self._maps:
            self._maps[level, bucket] = None
            if self.filled[level][bucket]:
                with open(f"{self.folder}/{level}-{bucket}", "rb") as f:
                    raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
                at = 0

                def read(kind: object, n: int) -> np.ndarray:
                    nonlocal at
                    x = np.frombuffer(raw, dtype=kind, count=n, offset=at)
                    at += x.nbytes + -x.nbytes % 8
                    return x

                many, rows, wide = (int(x) for x in read(np.int64, 3))
                sides = []
                for _ in range(2):
                    n, deep = (int(x) for x in read(np.int64, 2))
                    sides.append((deep, read(np.uint32, (1 << deep) + 1), read(np.uint32, n)))
                n, m = (len(x[2]) for x in sides)
                self._maps[level, bucket] = (*sides, read(np.uint8, n), read(np.uint32, many), read(np.uint64, many), read(np.float32, 5 * rows).reshape(rows, 5), read(f"u{wide}", m))
        return self._maps[level, bucket]

    def _find(self, level: int, key: np.ndarray, contexts: bool) -> np.ndarray:
        """Counts (n) or context statistics (n, 5) of keys; zero where absent."""
        u, inverse = np.unique(key, return_inverse=True)
        out = np.zeros((len(u), 5) if contexts else len(u), dtype=np.float32)
        for b, lo, hi in _by_bucket(u, self.bits):
            if (arrays := self.arrays(level, b)) is None:
                continue
            grams, heads, counts, many, large, stats, code = arrays
            at = places(u[lo:hi], self.bits, *(heads if contexts else grams))
            ok = at >= 0
            at = at[ok]
            if contexts:
                out[lo:hi][ok] = stats[code[at]]
            else:
                n = counts[at].astype(np.float32)
                if len(many):
                    n[n == 255] = large[np.searchsorted(many, at[n == 255])]
                out[lo:hi][ok] = n
        return out[inverse]

    def probabilities(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """P(last word | the ones before) of each n-gram."""
        d1, d2, d3 = self.discounts[1]
        c = self._find(1, chain(columns[-1:]), False).astype(np.float64)
        p = self.base / (self.kinds + 1) + np.where(c > 0, np.maximum(c - np.select([c == 1, c == 2, c >= 3], [d1, d2, d3], 0.0), 0), 0) / max(1.0, self.total)
        for level in range(2, self.order + 1):
            d1, d2, d3 = self.discounts[level]
            key, context = keys(columns[-level:], self.bits)
            s = self._find(level if level > 2 else 1, context, True).astype(np.float64)
            c = self._find(level, key, False).astype(np.float64)
            whole = np.maximum(s[:, 0], 1e-9)
            own = np.where(c > 0, c - np.select([c == 1, c == 2, c >= 3], [d1, d2, d3], 0.0), 0) / whole
            rest = 1 - (s[:, 1] - d1 * s[:, 2] - d2 * s[:, 3] - d3 * s[:, 4]) / whole
            p = np.where(s[:, 0] > 0, own + rest * p, p)
        return p


def train(docs: DataFrame, order: int = ORDER, min_counts: Sequence[int] = MIN_COUNTS, buckets: int | None = None) -> Model:
    """Count all of ``docs`` (column text). The number of buckets follows the number of words, unless it is given."""
    if order < 2 or len(min_counts) != order:
        raise ValueError("order is 2 at least, with one minimum count for each order")
    spark = docs.sparkSession
    path = new_path(spark, "lm")
    if file_system(spark, path) != "file":
        raise RuntimeError("memory mapping needs a shared folder that is mounted as a file system (file://)")
    folder = path.removeprefix("file://").removeprefix("file:")
    bits = max(2, int(np.ceil(np.log2(buckets or bound_parts(spark)))))
    texts = docs.where("text is not null").select(F.col("text").cast("string").alias("text"))
    sizes, tokens = np.zeros((CLASSES, 1 << bits), dtype=np.int64), 0
    for r in texts.mapInArrow(_count_words(bits), _ROWS).groupBy("bucket").applyInArrow(_merge_words(bits, folder), _ROWS).collect():
        *per, n = np.frombuffer(bytes(r["blob"]), dtype=np.int64)
        sizes[:, r["bucket"]] = per
        tokens += int(n)
    known = Vocabulary(folder, bits, FIRST + (np.cumsum(sizes.reshape(-1)) - sizes.reshape(-1)).reshape(sizes.shape), sizes.sum(axis=0) > 0)
    if not buckets:
        bits = max(bits, int(np.ceil(np.log2(max(1, tokens) / BUCKET_TOKENS))))
    rows = texts.mapInArrow(_first_level(order, bits, spark.sparkContext.broadcast(known)), _ROWS)
    for level in range(order, 0, -1):
        rows = rows.groupBy("bucket").applyInArrow(_level(level, bits, min_counts[level - 1], folder), _ROWS)
    counts, filled = {n: np.zeros(7, dtype=np.int64) for n in range(1, order + 1)}, {n: np.zeros(1 << bits, dtype=bool) for n in range(1, order + 1)}
    for r in rows.where(F.col("kind") == _STATS).collect():
        if r["blob"]:
            x = np.frombuffer(bytes(r["blob"]), dtype=np.int64)
            counts[int(x[0])] += x[2:]
            filled[int(x[0])][x[1]] = True
    discounts = {n: _discounts(*(int(v) for v in c[:4])) for n, c in counts.items()}
    one, total, kinds = counts[1], float(counts[1][5]), int(counts[1][6])
    d1, d2, d3 = discounts[1]
    kept = [one[k] if k + 1 >= min_counts[0] else 0 for k in (0, 1)]
    heavy = one[4]
    # what the stored words don't take is spread over all words and the unknown one
    lost = total - sum((k + 1) * v for k, v in enumerate(kept)) - (total - one[0] - 2 * one[1])
    base = (d1 * kept[0] + d2 * kept[1] + d3 * heavy + lost) / total if total else 1.0
    return Model(known, folder, order, bits, discounts, total, kinds, float(base), filled)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, tokens, logprob, perplexity) of every row; tokens include the end mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in tx.chunks(batch, "text", size=4 << 20):
                h, row = tx.words(data, off)
                ids, rows, said = sequences(model.vocabulary.numbers(h), row, hi - lo, model.order)
                total, n = np.zeros(hi - lo), np.zeros(hi - lo, dtype=np.int64)
                if len(ids):
                    row = rows[said]
                    total = np.bincount(row, np.log(model.probabilities(windows(ids, said, model.order))), minlength=hi - lo)
                    n = np.bincount(row, minlength=hi - lo)
                empty = n == 0
                with np.errstate(over="ignore"):
                    ppl = np.exp(-total / np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(total, mask=empty), pa.array(ppl, mask=empty)], ["doc_id", "tokens", "logprob", "perplexity"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, tokens long, logprob double, perplexity double")
