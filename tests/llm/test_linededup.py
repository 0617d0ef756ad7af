"""Line dedup against an alignment of all pairs of documents that share a rare key, and the definition of frequent ones."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import CLASH, empty, frame, odd_rows, prose
from pyspark.sql import functions as F

from siftline.llm import linededup, stages
from siftline.llm import textops as tx


def parsed(text):
    """(numbers, lines, words) of the lines that aren't blank."""
    own = [(n, x.strip(" "), len(x.split())) for n, x in enumerate(text.split("\n"))]
    return [list(c) for c in zip(*[x for x in own if x[2]], strict=True)] or [[], [], []]


def blocks(lines, words, least):
    """Every least block that holds ``least`` words, around each line, as (block, line); a line with as many is its own."""
    out = set()
    for p, w in enumerate(words):
        if w >= least:
            out.add(((lines[p],), p))
            continue
        for start in range(p + 1):
            for end in range(p, len(lines)):
                if sum(words[start : end + 1]) >= least:
                    if sum(words[start : p + 1]) < least or start == p or sum(words[start + 1 : p + 1]) < least:
                        out.add((tuple(lines[start : end + 1]), p))
                    break
    return out


def brute(texts, rare=linededup.RARE, least=linededup.MIN_WORDS):
    docs = [parsed(t) for t in texts]
    keys = [blocks(x[1], x[2], least) for x in docs]
    holders = {}
    for d, own in enumerate(keys):
        for key, _ in own:
            holders.setdefault(key, set()).add(d)
    pairs = {p for ds in holders.values() if len(ds) <= rare for p in combinations(sorted(ds), 2)}
    gone = [set() for _ in texts]
    for a, b in pairs:
        gone[b] |= {docs[b][0][n] for n in linededup.repeated_lines(docs[a][1], docs[b][1], docs[b][2], least)}
    for d, own in enumerate(keys):
        gone[d] |= {docs[d][0][p] for key, p in own if len(holders[key]) > rare and min(holders[key]) != d}
    return ["\n".join(x for n, x in enumerate(t.split("\n")) if n not in g) for t, g in zip(texts, gone, strict=True)]


def mixed(seed, n=60):
    rng = np.random.default_rng(seed)
    common = [prose(6, rng) for _ in range(5)] + ["two words", "and three more", "yes", "no no"]
    some = [prose(7, rng) for _ in range(40)] + [prose(2, rng) for _ in range(10)]
    texts = []
    for _ in range(n):
        own = [prose(8, rng) for _ in range(2)] + [some[i] for i in rng.integers(0, len(some), 4)]
        own += [*rng.permutation(common)[: rng.integers(0, 9)], "", "  ", *common[: rng.integers(0, 2)]]
        texts.append("\n".join(own[i] for i in rng.permutation(len(own))))
    return texts


@pytest.mark.parametrize(("seed", "rare"), [(12, 8), (13, 3), (14, 1000)])
def test_matches_the_alignment_of_all_pairs(spark, seed, rare):
    texts = mixed(seed)
    found = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(frame(spark, texts), rare).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts, rare)


def test_frequent_lines_fall_to_any_earlier_holder(spark):
    """Whatever an alignment with some earlier document deletes is deleted."""
    texts = mixed(15)
    found = {r["doc_id"]: r["text"].split("\n") for r in linededup.dedup_lines(frame(spark, texts)).collect()}
    for j, b in enumerate(texts):
        number, lines, words = parsed(b)
        for a in texts[:j]:
            for n in linededup.repeated_lines(parsed(a)[1], lines, words):
                assert found[j].count(b.split("\n")[number[n]]) < b.split("\n").count(b.split("\n")[number[n]])


def test_block_of_short_lines_that_many_share(spark):
    """Lines that each occur elsewhere before, and together in twelve documents."""
    short = ["one two", "three four", "five six", "seven eight"]
    texts = [f"{prose(9)}\n{x}\n{prose(9)}" for x in short] + [f"{prose(9)}\n" + "\n".join(short) for _ in range(12)]
    out = {r["doc_id"]: r["lines_removed"] for r in linededup.dedup_lines(frame(spark, texts)).collect()}
    assert [out[i] for i in range(16)] == [0] * 5 + [4] * 11


def test_repeated_blocks_go_from_later_documents(spark):
    block = "this is a long shared passage of many words\nand its second line goes on as well"
    texts = [f"first own line here\n{block}\nend one", f"{block}\nother text that is only here", "unrelated words that nobody repeats", "end one", None, "", f"x y\n{block}"]
    out = {r["doc_id"]: r for r in linededup.dedup_lines(frame(spark, texts)).collect()}
    assert out[0]["text"] == texts[0] and out[1]["text"] == "other text that is only here" and out[6]["text"] == "x y"
    assert out[3]["text"] == "end one" and out[4]["text"] is None and out[2]["lines_removed"] == 0
    kept = stages.drop_repeated_lines(frame(spark, [texts[0], texts[0], texts[2]]))
    assert {r["doc_id"] for r in kept.collect()} == {0, 2}


def test_frequent_lines_reach_every_later_holder(spark):
    line = "one line that very many documents hold in common"
    out = linededup.dedup_lines(frame(spark, [f"{prose(6)}\n{line}" for _ in range(40)])).collect()
    assert sorted(r["lines_removed"] for r in out) == [0] + [1] * 39


def longest(pairs):
    """Length of the longest chain of pairs that rise on both sides."""
    best = [0] * len(pairs)
    for n, (i, j) in enumerate(pairs):
        best[n] = 1 + max((best[m] for m in range(n) if pairs[m][0] < i and pairs[m][1] < j), default=0)
    return max(best, default=0)


def test_patience_keeps_a_longest_chain_of_unique_lines():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = rng.integers(0, 14, rng.integers(0, 20)).tolist(), rng.integers(0, 14, rng.integers(0, 20)).tolist()
        pairs = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
        lo = 0
        while lo < min(len(a), len(b)) and a[lo] == b[lo]:
            lo += 1
        hi = 0
        while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
            hi += 1
        x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
        unique = [(i, y.index(v)) for i, v in enumerate(x) if x.count(v) == 1 == y.count(v)]
        assert len(pairs) >= lo + hi + longest(unique)
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert len(pairs) == longest([(i, b.index(v)) for i, v in enumerate(a) if v in b])
    a = rng.permutation(60).tolist()
    b = rng.permutation(60).tolist()
    assert len(linededup.patience(a, b)) == longest([(i, b.index(v)) for i, v in enumerate(a)])


def test_lines_of_rows():
    texts = ["", "a b\n\n c ", "\n", "é x", "", "last\n"]
    data, off = tx.string_buffers(pa.array(texts), False)
    row, number, h, words = linededup.lines(data, off)
    assert row.tolist() == [1, 1, 3, 5] and number.tolist() == [0, 2, 0, 0] and words.tolist() == [2, 1, 2, 1]
    again = linededup.lines(*tx.string_buffers(pa.array(["x\nc\nlast"]), False))[2]
    assert h[1] == again[1] and h[3] == again[2] and len(set(h.tolist())) == 4


def test_odd_rows_and_clashing_columns(spark):
    docs = odd_rows(spark)
    kept = linededup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.select(*CLASH).distinct().collect() == [tuple("x" * len(CLASH))]
    out = linededup.dedup_lines(docs)
    assert out.count() == docs.count() and out.where("text is null").count() == 2
    # the copies of row 4 are one document and keep their lines, the second long text loses all of its own
    assert out.where("doc_id = 4 and lines_removed = 0").count() == 2
    assert out.where(F.col("doc_id") == 7).first()["lines_removed"] == 1500
    assert linededup.dedup_lines(empty(spark)).count() == 0
