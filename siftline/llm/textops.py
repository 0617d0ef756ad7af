"""Vectorised text primitives over Arrow string buffers; no Python object is made per word.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased text.
Hashes are 64-bit: a polynomial in prefix sums modulo 2**64, so that any substring's hash costs O(1), then
a finalising mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_WORD = np.zeros(256, dtype=bool)
for _lo, _hi in ((48, 58), (97, 123), (65, 91), (128, 256)):
    _WORD[_lo:_hi] = True
_powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables of base**i and base**-i for i < n, grown on demand."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, _BASE, dtype=np.uint64)]))
            down = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, _INV, dtype=np.uint64)]))
        if n > 1 << 24:
            return up, down
        _powers = (up, down)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of byte-code * base**j for j < i."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each pair, from prefix sums."""
    _, down = powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def string_buffers(column: pa.Array | pa.ChunkedArray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, dtype=np.uint8)
    return raw, off - off[0]


def chunks(batch: pa.RecordBatch, text: str, lower: bool = True, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into pieces of whole rows of about ``size`` bytes: (first row, end row, bytes, offsets)."""
    data, off = string_buffers(batch.column(text), lower)
    row, n = 0, batch.num_rows
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + size, side="right")) - 1)
        end = min(end, n, row + 60_000)
        yield row, end, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the words; a word never crosses a row."""
    n = len(data)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = _WORD[data]
    start, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    start[cut] |= inside[1:-1][cut]
    end[cut - 1] |= inside[1:-1][cut - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word in order."""
    starts, ends, row = word_spans(data, off)
    return span_hashes(prefix_sums(data), starts, ends), row


def shingles(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of each run of n words inside one row."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    acc = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            acc = acc * U64(_BASE) + hashes[j : len(hashes) - n + 1 + j]
    at = np.flatnonzero(row[: len(acc)] == row[n - 1 :])
    return mix(acc[at]), at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def hash_words(text: str | None) -> list[int]:
    """Word hashes of one text, for fixtures and small driver-side tables."""
    data, off = string_buffers(pa.array([text], pa.string()), True)
    return [int(h) for h in words(data, off)[0]]
