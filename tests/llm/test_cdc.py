"""Repeated passages against a comparison of all pairs of texts, byte by byte."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import cdc

from llm_fixtures import CLASH, empty, frame, odd_rows, prose


def words(text, lo, hi):
    return sum(text[i] > 32 and (i == 0 or text[i - 1] <= 32) for i in range(lo, hi))


def common(a, b, least):
    """Spans of ``b`` that stand in ``a`` as well, can't be extended and hold ``least`` words."""
    x, y, out = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8), []
    for shift in range(-len(a) + 1, len(b)):
        lo, hi = max(0, shift), min(len(b), len(a) + shift)
        same = np.concatenate([[False], y[lo:hi] == x[lo - shift : hi - shift], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edges[::2] + lo, edges[1::2] + lo, strict=True):
            while s < e and b[s] & 0xC0 == 0x80:
                s += 1
            while e > s and e < len(b) and b[e] & 0xC0 == 0x80:
                e -= 1
            if e - s > least and words(b, s, e) >= least:
                out.append((int(s), int(e)))
    return out


def texts(seed):
    """Prose with passages of 20 to 90 words copied from earlier texts to others, some twice, some with one changed letter."""
    rng = np.random.default_rng(seed)
    out = [prose(int(rng.integers(40, 200)), rng) for _ in range(4)]
    for _ in range(10):
        own = prose(int(rng.integers(20, 120)), rng).split(" ")
        for _ in range(int(rng.integers(0, 3))):
            source = out[int(rng.integers(len(out)))].split(" ")
            n = int(rng.choice([20, 49, 51, 55, 70, 90]))
            at = int(rng.integers(0, max(1, len(source) - n)))
            piece = source[at : at + n]
            if rng.random() < 0.3:
                piece[len(piece) // 2] = "é" + piece[len(piece) // 2][1:]
            place = int(rng.integers(0, len(own) + 1))
            own[place:place] = piece
        out.append(" ".join(own))
    out[-1] = out[5]
    return out


@pytest.mark.parametrize(("seed", "size"), [(1, 512), (2, 16), (3, 40)])
def test_every_long_passage_of_an_earlier_text_is_found(spark, seed, size):
    docs = texts(seed)
    found = {}
    for r in cdc.repeats(frame(spark, docs), size=size).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["words"], r["first_doc_id"]))
    for d, text in enumerate(docs):
        raw = text.encode()
        spans = [x for s in range(d) for x in common(docs[s].encode(), raw, cdc.MIN_WORDS)]
        want = {p for lo, hi in spans for p in range(lo, hi)}
        assert {p for lo, hi, _, _ in found.get(d, []) for p in range(lo, hi)} == want, d
        for lo, hi, n, source in found.get(d, []):
            assert source < d and raw[lo:hi] in docs[source].encode() and words(raw, lo, hi) == n
            assert (lo, hi) in spans


def test_extension_stops_at_characters_and_text_ends():
    assert cdc.agreement("xé".encode(), "xè".encode(), 1, 99, 10) == (0, 0, False)
    a, b = "aé b".encode(), "aè b".encode()
    assert cdc.agreement(a, b, -1, 99, 10) == (2, 1, False)
    assert cdc.agreement(b"one two", b"one two", -1, 99, 10) == (7, 2, False)
    assert cdc.agreement(b"one two", b"one two", -1, 3, 10) == (3, 1, False)
    assert cdc.agreement(b" abcd", b" abcd", 1, 99, 4) == (4, 1, True)


def test_chunks_are_whole_and_boundaries_local():
    rng = np.random.default_rng(4)
    raw = [(prose(n, rng) + " é中").encode() for n in (3, 200, 0, 1000)] + [b"", b"a" * 5000]
    data, off = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])
    s, e = cdc.cut(data, off)
    assert s[0] == 0 and e[-1] == len(data) and (s[1:] == e[:-1]).all() and set(off[1:]) <= set(e)
    assert all((data[x] & 0xC0) != 0x80 for x in e[:-1]) and (e - s)[np.isin(e, off, invert=True)].min() > cdc.REACH
    for i, text in enumerate(raw):  # each text is cut alike among others and alone
        alone = cdc.cut(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))[1] if text else np.zeros(0)
        assert (e[(e > off[i]) & (e <= off[i + 1])] - off[i]).tolist() == alone.tolist()
    long = np.frombuffer(raw[3], dtype=np.uint8)
    moved = np.concatenate([np.frombuffer(b"inserted ", dtype=np.uint8), long])
    ends = cdc.cut(long, np.array([0, len(long)]))[1]
    again = cdc.cut(moved, np.array([0, len(moved)]))[1] - 9
    assert len(set(ends.tolist()) - set(again.tolist())) <= 2


def test_copies_clean_texts_and_removal(spark):
    rng = np.random.default_rng(10)
    passage = prose(60, rng)
    docs = [f"{prose(50, rng)} {passage} {prose(40, rng)}", f"{prose(33, rng)} {passage} {prose(10, rng)}", prose(300, rng), None, ""]
    docs = frame(spark, docs + [docs[0], f"{passage} {passage}"])
    found = cdc.repeats(docs)
    rows = found.collect()
    assert {(r["doc_id"], r["first_doc_id"]) for r in rows} == {(1, 0), (5, 0), (6, 0)}
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = {r["doc_id"]: r["text"] for r in cdc.strip_repeats(docs.withColumn("__spans", F.lit("mine")), found).collect()}
    (lo, hi) = next((r["start"], r["end"]) for r in rows if r["doc_id"] == 1)
    assert passage in given[1][lo:hi] and hi - lo < len(passage) + 12
    assert out[1] == given[1][:lo] + given[1][hi:] and out[5] == "" and len(out[6]) < 12
    assert all(out[i] == given[i] for i in (0, 2, 3, 4))


def test_odd_rows(spark):
    docs = odd_rows(spark)
    found = cdc.repeats(docs)
    rows = found.collect()
    long = docs.where("doc_id = 7").first()["text"]
    # rows 6 and 7 share one text; nothing else repeats 50 words, copies of a row are one document
    assert [(r["doc_id"], r["start"], r["end"], r["first_doc_id"]) for r in rows] == [(7, 0, len(long.encode()), 6)]
    out = cdc.strip_repeats(docs, found)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r["doc_id"]: r["text"] for r in out.collect()}[7] == ""
    assert out.select(*CLASH).distinct().collect() == [tuple("x" * len(CLASH))]
    none = cdc.repeats(empty(spark))
    assert none.count() == 0 and cdc.strip_repeats(empty(spark), none).count() == 0
