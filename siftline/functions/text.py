"""Tokenizing and normalising as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that separate tokens unless a field names its own.
SEPARATORS = " \t\n\r:(),.…;・’—-\\[]{}<>'\"“™"


def separator_class(chars: str | None = None) -> str:
    return "[" + "".join("\\" + c if c in r"\[]^-&~" else c for c in (SEPARATORS if chars is None else chars)) + "]"


def tokens(value: Column | str, chars: str | None = None, grouped: bool = True) -> Column:
    """All runs of separators and of other characters in order; ungrouped, each separator is a token of its own.

    Tokens tile their text, so a batch of lists is the batch of texts with more offsets: they are found in whole
    Arrow batches and no token is copied. Regular expressions take ten times as long for this.
    """
    wanted = SEPARATORS if chars is None else chars

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for lo, n in pieces(texts):
                yield split_batch(texts.slice(lo, n), wanted, grouped)

    return cut(F.col(value) if isinstance(value, str) else value)


#: Bytes of text that are cut at a time; a batch of Spark's holds a number of rows, whatever their length.
PIECE = 4 << 20


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Starts and lengths of runs of rows with about ``PIECE`` bytes of text each, a longer text being one of its own."""
    if not len(texts):
        yield 0, 0
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE, side="right")))
        yield lo, hi - lo
        lo = hi


def split_batch(texts: pa.Array, chars: str, grouped: bool = True) -> pa.ListArray:
    """Lists of the tokens of texts; a null text has a null list, an empty one an empty list."""
    missing = texts.is_null()
    filled = pc.fill_null(texts.cast(pa.string()), "")
    off = np.frombuffer(filled.buffers()[1], dtype=np.int32)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, dtype=np.int32)
    raw = filled.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, dtype=np.uint8)
    off = off - off[0]
    one = np.zeros(256, dtype=bool)
    one[[ord(c) for c in chars if ord(c) < 128]] = True
    sep = one[data]
    starts = sep.copy()  # where a separator begins
    for c in {c for c in chars if ord(c) >= 128}:
        code = c.encode()
        at = np.flatnonzero(data[: len(data) - len(code) + 1] == code[0])
        for i in range(1, len(code)):
            at = at[data[at + i] == code[i]]
        starts[at] = True
        for i in range(len(code)):
            sep[at + i] = True
    begin = np.zeros(len(data), dtype=bool)
    begin[1:] = sep[1:] != sep[:-1]
    if not grouped:
        begin |= starts
        begin[1:] |= sep[:-1] & (starts[1:] | ~sep[1:])
    first = off[:-1]
    begin[first[first < len(data)]] = True
    cuts = np.flatnonzero(begin)
    tokens = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(np.append(cuts, len(data)).astype(np.int32)), pa.py_buffer(data))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(cuts, off), pa.int32()), tokens, mask=missing if missing.true_count else None)


def split_tokens(text: str, chars: str | None = None) -> list[str]:
    """The same runs for one Python string."""
    sep = separator_class(chars)
    return re.findall(f"{sep}+|[^{sep[1:]}+", text)


NORMAL = ((r"\([fmn\d]\)", " "), (r"[()]", " "), (r"[{}'\"“]", ""), (r"\s+", " "), (r"[,.…;・’\-]", ""))


def normalize_text(text: str) -> str:
    """Terms as highlighting looks them up: no brackets, quotes or punctuation, single blanks, lower case."""
    for pattern, to in NORMAL:
        text = re.sub(pattern, to, text)
    return text.lower().strip()


def normalized(value: Column | str) -> Column:
    """The same as a column expression."""
    out = F.col(value) if isinstance(value, str) else value
    for pattern, to in NORMAL:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(F.lower(out))

