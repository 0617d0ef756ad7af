"""Documents from JSON lines, JSON arrays, CSV, and any DataFrame, with stable ids in input order."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def from_lines(spark: SparkSession, lines: str | Iterable[str]) -> DataFrame:
    """(doc_id, doc) from newline-delimited JSON or an iterable of JSON texts; blank lines are skipped."""
    found = [x for x in (lines.splitlines() if isinstance(lines, str) else lines) if x.strip()]
    return spark.createDataFrame(list(enumerate(found)), "doc_id long, doc string")


def _numbered(lines: DataFrame) -> DataFrame:
    """Dense ids in file order: counts per file partition are added up, and these few rows are broadcast."""
    tagged = lines.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    counts = tagged.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    # one row for each partition of files
    moved = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") - F.col("low")).alias("by"))
    return tagged.join(F.broadcast(moved), "part").select((F.col("at") + F.col("by")).cast("long").alias("doc_id"), "doc")


def spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns over all cores where a scan has fewer splits than there are cores; large inputs stay as they are.

    A plan with a shuffle of its own is left to adaptive execution: asking for its partitions would run it.
    """
    df = df.select(*[F.col(f"`{c}`") for c in columns])
    if "Adaptive" in df._jdf.queryExecution().executedPlan().nodeName():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document per line, from any number of files."""
    return _numbered(spark.read.text(path).where("trim(value) != ''").withColumnRenamed("value", "doc"))


def split_json(text: str) -> Iterator[str]:
    """Single JSON objects out of an array or of objects one after the other."""
    decoder, at = json.JSONDecoder(), 0
    while True:
        while at < len(text) and (text[at].isspace() or text[at] == ","):
            at += 1
        if at >= len(text):
            return
        value, at = decoder.raw_decode(text, at)
        for item in value if isinstance(value, list) else [value]:
            yield json.dumps(item, ensure_ascii=False)


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """Documents of files that each hold a JSON array, or objects one after the other, over several lines.

    A file is one value: such arrays can't be split. Large data comes as lines.
    """
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: list(split_json(text)))

    whole = spark.read.text(path, wholetext=True)
    return _numbered(whole.select(F.explode(split("value")).alias("doc")))


def write_json_lines(docs: DataFrame, path: str) -> None:
    docs.orderBy("doc_id").select(F.col("doc").alias("value")).write.text(path)


def read_csv(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A document per row, keys from the header."""
    rows = spark.read.option("header", True).options(**options).csv(path)
    return _numbered(rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("doc")))


def from_dataframe(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """Documents from rows; ids from a column, else in partition order."""
    doc = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != id_col])).alias("doc")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), doc) if id_col else _numbered(df.select(doc))
