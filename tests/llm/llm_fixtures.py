"""Small tables for the tests of the training-data operators."""

import numpy as np
from pyspark.sql import functions as F

RNG = np.random.default_rng(5)
WORDS = ["w" + "".join(RNG.choice(list("abcdefghij"), 6)) for _ in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["k", "h", "n", "keep", "__row_key", "__gone", "__rank", "group_id", "quality", "votes", "mix_source", "lines_removed", "start", "bucket"]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS, n))


def frame(spark, texts, **more):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_rows(spark, extra=True):
    """Nulls in every column, empty and very long texts, repeated rows, repeated ids, clashing extra columns."""
    long = "\n".join(prose(40) for _ in range(1500))
    rows = [
        (1, None, "en", "src0", None), (None, "no id but text here", "en", "src0", 3), (2, "", "en", "src1", 0), (3, "   \n ", "en", "src1", 5), (4, "a good line of words.\nanother good line of words.", None, "src2", 7),
        (4, "a good line of words.\nanother good line of words.", None, "src2", 7), (5, "same id one text", "en", None, 1), (5, "same id other text", "en", "src0", 1), (6, long, "de", "src0", None), (7, long, "de", "src1", None),
        (None, None, None, None, None), (8, "...!!! ???", "en", "src9", 1), (9, "üñ中文 \U0001f600 café", "fr", "src1", 2),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH]) if extra else df


def empty(spark):
    return spark.createDataFrame([], DOCS)
