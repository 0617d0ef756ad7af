"""The corpus pipeline against its five stages in plain Python, each over what the one before kept."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_brute import brute_groups, brute_mixture
from test_linededup import brute as brute_lines
from test_quality import brute as brute_counts

from siftline.llm import decontaminate, quality, stages
from siftline.llm import textops as tx

SF = "/root/testdata/sf0.001"
pipeline = pytest.importorskip("corpus_pipeline")


def good(spark, rows):
    """Rows whose posterior quality reaches the threshold."""
    counts = [(i, *[brute_counts(r["text"] or "")[x] for x in quality.FEATURES]) for i, r in enumerate(rows)]
    table = spark.createDataFrame(counts, "i long, " + ", ".join(f"{x} int" for x in quality.FEATURES))
    votes = {r["i"]: [r[x] for x in quality.rules()] for r in table.select("i", *[v.alias(n) for n, v in quality.rules().items()]).collect()}
    some = [i for i in range(len(rows)) if (rows[i]["text"] or "").split()]
    patterns = sorted({tuple(votes[i]) for i in some})
    n = np.array([sum(tuple(votes[i]) == p for i in some) for p in patterns], dtype=float)
    post = dict(zip(patterns, quality.fit(np.array(patterns), n).posterior(np.array(patterns)), strict=True))
    return [rows[i] for i in some if round(post[tuple(votes[i])], 9) >= quality.THRESHOLD]


def without_lines(rows):
    rows = sorted(rows, key=lambda r: r["doc_id"])
    texts = brute_lines([r["text"] for r in rows])
    return [{**r, "text": t, "n_chars": r["n_chars"] if t == r["text"] else len(t)} for r, t in zip(rows, texts, strict=True) if t == r["text"] or t.split()]


def without_copies(rows):
    groups = brute_groups([r["text"] for r in rows])
    return [r for i, r in enumerate(rows) if groups[i] == i]


def without_benchmark(rows, items):
    def grams(words, n):
        return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]

    def leaks(words):
        for item in items:
            n = min(decontaminate.N, len(item))
            own = grams(item, n) if n else []
            need = max(1, math.ceil(round(len(set(own)) * decontaminate.THRESHOLD, 9)))
            said = grams(words, n) if n else []
            if own and any(len(set(said[i : i + len(own)]) & set(own)) >= need for i in range(len(said))):
                return True
        return False

    return [r for r in rows if not leaks(tx.hash_words(r["text"]))]


def test_pipeline_matches_its_stages_in_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tx.hash_words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r.asDict() for r in docs.orderBy("doc_id").collect()]
    assert len({r["doc_id"] for r in rows}) == len(rows)
    sizes = [len(rows)]
    for stage in (lambda x: good(spark, x), without_lines, without_copies, lambda x: without_benchmark(x, items)):
        rows = stage(rows)
        sizes.append(len(rows))
    assert all(a >= b for a, b in zip(sizes, sizes[1:], strict=False)) and sizes[-1] > 0 and sizes[-1] < sizes[0]
    left = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    order = left.select("doc_id", F.xxhash64(F.lit(0), F.col("doc_id"), F.xxhash64("text")).alias("u")).collect()
    keys = {r["doc_id"]: (r["u"] >> 52 & 0xFFF, r["u"]) for r in order}
    uses = brute_mixture([(r["doc_id"], r["source"], r["text"]) for r in rows], stages.TARGETS, keys)
    by = {r["doc_id"]: r for r in rows}
    want = sorted((d, by[d]["text"], by[d]["lang"], by[d]["source"], by[d]["n_chars"], s, n) for (d, s), n in uses.items())
    out = pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "mix_source", "mix_uses"]
    assert sorted((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], r["mix_source"], r["mix_uses"]) for r in out.collect()) == want
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "source_mix"]


def test_each_stage_takes_clashing_columns_and_returns_those_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).withColumn("k", F.lit("mine")).withColumn("row", F.lit(1))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.where("k != 'mine'").count() == 0, name
