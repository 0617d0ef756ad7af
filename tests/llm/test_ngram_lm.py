"""Storage of the language model: sorted hash arrays, blocks on the wire, lost files."""

import os

import numpy as np
import pytest
from llm_fixtures import WORDS, frame
from pyspark.errors import PythonException
from test_operators import brute_kneser_ney

from siftline.llm import ngram_lm as lm


@pytest.mark.parametrize(("n", "bits"), [(0, 3), (1, 3), (9, 2), (5000, 2), (70_000, 7)])
def test_sorted_hashes_find_their_own_and_no_others(n, bits):
    rng = np.random.default_rng(n)
    key = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) >> np.uint64(bits) | np.uint64(1 << (64 - bits))
    (size, deep), start, low = lm.cells(key, bits)
    assert size == n and low.nbytes + start.nbytes <= 5 * n + 8
    assert lm.places(key, bits, int(deep), start, low).tolist() == list(range(n))
    other = np.setdiff1d(np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64)) >> np.uint64(bits) | np.uint64(1 << (64 - bits)), key)
    assert (lm.places(other, bits, int(deep), start, low) == -1).all()


@pytest.mark.parametrize("top", [3, 1 << 20, 1 << 31])
def test_blocks_round_trip(top):
    rng = np.random.default_rng(top)
    columns = [rng.integers(0, top, 2000).astype(np.uint32) for _ in range(3)]
    counts = rng.integers(1, 70_000, 2000)
    back, n = lm.unpack(lm.pack(columns, counts))
    assert sorted(zip(*columns, counts, strict=True)) == sorted(zip(*back, n, strict=True))


@pytest.mark.parametrize(("order", "buckets"), [(2, 4), (3, 64), (4, 16)])
def test_orders_and_buckets(spark, order, buckets):
    rng = np.random.default_rng(order)
    # frequent enough that counts exceed a byte
    texts = [" ".join(rng.choice(WORDS[:6], rng.integers(1, 30))) for _ in range(60)] + [" ".join([WORDS[0]] * 700)]
    docs = frame(spark, texts)
    found = {r["doc_id"]: r["logprob"] for r in lm.score(docs, lm.train(docs, order, (1,) * order, buckets)).collect()}
    for i, want in enumerate(brute_kneser_ney(texts, order)):
        assert found[i] == pytest.approx(want, rel=1e-4), i


def test_lost_file_is_an_error(spark):
    docs = frame(spark, [WORDS[0]] * 3)
    model = lm.train(docs)
    level, bucket = next((n, b) for n, f in model.filled.items() for b in np.flatnonzero(f))
    os.remove(f"{model.folder}/{level}-{bucket}")
    with pytest.raises(PythonException, match="FileNotFoundError|No such file"):
        lm.score(docs, model).collect()
