"""Chat formatting with a black-box template: turn spans from renderings of successive prefixes.

``render`` maps a list of {role, text} to a string. Every prefix of a conversation's turns is rendered. Where a
rendering starts with the one before it, the rest is the new turn's span. Where it doesn't, the template rewrote
history: the turn is marked, its span starts after the longest common prefix, and offsets of earlier turns that the
change reaches into are void (null) since they no longer hold in the final rendering.

Defined cases: turns sort by (turn, role, text), nulls first, so ties and repeated rows have a fixed order; a null
role or text is rendered as empty; rows with a null conv_id belong to no conversation and come back with status
``no_conversation`` and null spans; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Render = Callable[[list[dict[str, str]]], str]
SCHEMA = "conv_id long, turn long, role string, start long, end long, span string, status string"


def chatml(turns: list[dict[str, str]]) -> str:
    return "".join(f"<|im_start|>{t['role']}\n{t['text']}<|im_end|>\n" for t in turns)


def last_only(turns: list[dict[str, str]]) -> str:
    """A template that rewrites history: only the last assistant answer is kept in full."""
    last = max((i for i, t in enumerate(turns) if t["role"] == "assistant"), default=-1)
    return "".join(f"[{t['role']}] {t['text'] if t['role'] != 'assistant' or i == last else '...'}\n" for i, t in enumerate(turns))


def spans(turns: list[dict[str, str]], render: Render) -> list[tuple[int | None, int | None, str]]:
    """(start, end, status) of each turn, offsets in characters of the final rendering."""
    out: list[tuple[int | None, int | None, str]] = []
    before = render([])
    for n in range(1, len(turns) + 1):
        now = render(turns[:n])
        if now.startswith(before):
            out.append((len(before), len(now), "ok"))
        else:
            lo, hi = 0, min(len(before), len(now))
            while lo < hi:  # longest common prefix by bisection
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if before[:mid] == now[:mid] else (lo, mid - 1)
            out = [x if x[1] is not None and x[1] <= lo else (None, None, x[2]) for x in out]
            out.append((lo, len(now), "rewrites_history"))
        before = now
    return out


def format_chats(turns: DataFrame, render: Render = chatml) -> DataFrame:
    """One row per turn: conv_id, turn, role, start, end, span (the rendered piece), status."""
    cols = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    whole = cols.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["conv_id", "turn", "role", "start", "end", "span", "status"]
        for b in batches:
            rows: list[tuple] = []
            for conv, said in zip(b.column("conv_id").to_pylist(), b.column("turns").to_pylist(), strict=True):
                texts = [{"role": t["role"] or "", "text": t["text"] or ""} for t in said]
                final = render(texts)
                for t, (lo, hi, status) in zip(said, spans(texts, render), strict=True):
                    rows.append((conv, t["turn"], t["role"], lo, hi, None if lo is None else final[lo:hi], status))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)

    lost = cols.where("conv_id is null").select("conv_id", "turn", "role", *[F.lit(None).cast(k).alias(c) for c, k in (("start", "long"), ("end", "long"), ("span", "string"))], F.lit("no_conversation").alias("status"))
    return whole.mapInArrow(run, SCHEMA).unionByName(lost)
