"""An index: documents and the tables derived from them, made on demand or loaded from Parquet."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from functools import cached_property
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.errors import FieldNotFound, InvalidConfig
from ..plans.request import FieldInfo
from ..sources import readers
from . import flatten, tables
from .config import Config

#: Tables that are written, with the columns they are sorted by inside each path.
STORED = {"leafs": ["doc_id"], "terms": ["term_lc"], "postings": ["term", "doc_id"], "phrase_pairs": ["t1", "t2", "doc_id"], "token_texts": ["token", "h1"], "boosts": ["doc_id"], "token_values": ["term"]}
BOOST_CACHE, BOOST_CACHE_SECONDS = 10, 3600


class Index:
    """Tables over leaves of documents. Every table is lazy; a search reads the ones it needs, pruned by path."""

    def __init__(self, spark: SparkSession, leafs: DataFrame, docs: DataFrame | None = None, config: Config | None = None, paths: list[str] | None = None) -> None:
        self.spark, self.leafs, self._docs, self.config, self._paths = spark, leafs, docs, config or Config(), paths
        self.token_values = spark.range(0).selectExpr("'' AS path", "'' AS term", "CAST(0 AS double) AS value")
        self.few: dict[Any, Any] = {}
        self._made: Callable[[str], DataFrame] | None = None
        self._ids: DataFrame | None = None  # of a table's rows, if a row has one value of a path at most
        self._boost_terms: dict[Any, tuple[float, DataFrame]] = {}
        self.raw_config: str | None = None
        self.stored = False

    # --- making

    @staticmethod
    def from_docs(spark: SparkSession, docs: DataFrame, config: str | None = None) -> Index:
        """From (doc_id, doc) with JSON texts."""
        index = Index(spark, flatten.flatten_json(docs), docs, Config.parse(config))
        index.raw_config = config
        return index

    @staticmethod
    def from_lines(spark: SparkSession, lines: str | list[str], config: str | None = None) -> Index:
        return Index.from_docs(spark, readers.from_lines(spark, lines), config)

    @staticmethod
    def from_file(spark: SparkSession, path: str, config: str | None = None) -> Index:
        return Index.from_docs(spark, readers.read_json_lines(spark, path), config)

    @staticmethod
    def from_table(spark: SparkSession, df: DataFrame, id_col: str, columns: list[str] | None = None, config: str | None = None) -> Index:
        """From a typed table: no JSON on the way, only the named columns are read."""
        names = [c for c in df.columns if c != id_col and (columns is None or c in columns)]
        docs, ids = readers.from_dataframe(df, id_col), df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"))
        df = readers.spread(df, [id_col, *names])
        paths = sorted({p for c in names for p in flatten.schema_paths(df.schema[c].dataType, c)})
        index = Index(spark, flatten.flatten_columns(df, id_col, columns), docs, Config.parse(config), paths)
        index._ids = None if any("[]" in p for p in paths) else ids
        index._made = lambda path: flatten.flatten_columns(df, id_col, columns, path)
        return index

    @staticmethod
    def create(spark: SparkSession) -> Index:
        """An empty index."""
        return Index.from_docs(spark, spark.createDataFrame([], "doc_id long, doc string"))

    def add_token_values(self, path: str, values: list[dict[str, Any]] | DataFrame) -> None:
        """Numbers attached to dictionary terms, for boosts by matched term; texts that aren't terms are skipped."""
        given = values if isinstance(values, DataFrame) else self.spark.createDataFrame([(str(v["text"]), float(v["value"])) for v in values if v.get("value") is not None], "term string, value double")
        known = self.table("terms", path).select("term")
        rows = given.join(known, "term", "left_semi").groupBy("term").agg(F.first("value").alias("value"))
        self.few.clear()
        self.token_values = self.token_values.unionByName(rows.select(F.lit(path).alias("path"), "term", "value"))

    # --- tables

    @property
    def docs(self) -> DataFrame:
        if self._docs is None:
            raise InvalidConfig("this index was made without documents")
        return self._docs

    def _with(self, *features: str) -> DataFrame:
        """Leaves of the fields that have one of the features."""
        has = lambda f: any(f.has(x) for x in features)
        off = [n for n, f in self.config.fields.items() if not has(f)]
        if not has(self.config.default):
            return self.leafs.where(F.col("path").isin([n for n, f in self.config.fields.items() if has(f)]))
        return self.leafs.where(~F.col("path").isin(off)) if off else self.leafs

    def leafs_of(self, path: str, feature: str | None = None) -> DataFrame:
        """Leaves of one field, if it has the feature; of a table's rows the other fields aren't taken apart."""
        rows = (self.leafs if self._made is None or path not in self.paths else self._made(path)).where(F.col("path") == path)
        return rows if feature is None or self.config.of(path).has(feature) else rows.where(F.lit(False))

    def table(self, name: str, path: str) -> DataFrame:
        """Rows of one field of a table, made of this field's leaves alone unless the table is there already."""
        if self.stored or name in self.__dict__:
            return getattr(self, name).where(F.col("path") == path)
        own = Index(self.spark, self.leafs_of(path), None, self.config, self._paths)
        own._ids = self._ids
        return getattr(own, name)

    @cached_property
    def terms(self) -> DataFrame:
        return tables.terms(self.leafs, self.config)

    @cached_property
    def postings(self) -> DataFrame:
        return tables.postings(self.search_leafs, self.config, self.terms, self._ids)

    @cached_property
    def phrase_pairs(self) -> DataFrame:
        return tables.phrase_pairs(self._with("PhraseBoost"), self.config)

    @cached_property
    def token_texts(self) -> DataFrame:
        return tables.token_texts(self._with("TokensToTextID", "BoostTextLocality", "Highlight", "BoostingFieldData"), self.config)

    @cached_property
    def boosts(self) -> DataFrame:
        return tables.boosts(self.leafs, self.config)

    @cached_property
    def entries(self) -> DataFrame:
        return tables.entries(self.leafs, self.config)

    @cached_property
    def term_ids(self) -> DataFrame:
        """(path, term, num_occ, term_id): place of each term in the byte order of its field.

        Terms are numbered among those with the same first two characters; only counts of these are added up.
        """
        rows = self.terms.select("path", "term", "num_occ", F.substring("term", 1, 2).alias("head"))
        counts = rows.groupBy("path", "head").agg(F.count("*").alias("n"))
        before = counts.select("path", "head", (F.sum("n").over(Window.partitionBy("path").orderBy("head")) - F.col("n")).alias("before"))
        at = F.row_number().over(Window.partitionBy("path", "head").orderBy("term")) - 1
        return rows.withColumn("at", at).join(before, ["path", "head"]).select("path", "term", "num_occ", (F.col("before") + F.col("at")).cast("long").alias("term_id"))

    def term_texts(self, path: str, ids: list[int]) -> dict[int, str]:
        """Texts of term ids."""
        return {r["term_id"]: r["term"] for r in self.term_ids.where((F.col("path") == path) & F.col("term_id").isin(ids)).collect()}

    @cached_property
    def search_leafs(self) -> DataFrame:
        return self._with("Search")

    def boost_term(self, key: Any, make: Callable[[], DataFrame]) -> DataFrame:
        """Documents of a boost by term, kept by the executors for the next requests: ten of them, an hour at most."""
        now = time.monotonic()
        for old, (since, df) in list(self._boost_terms.items()):
            if now - since > BOOST_CACHE_SECONDS:
                self._boost_terms.pop(old)
                df.unpersist()
        if key in self._boost_terms:
            self._boost_terms[key] = self._boost_terms.pop(key)  # the last one used is dropped last
        else:
            if len(self._boost_terms) >= BOOST_CACHE:
                self._boost_terms.pop(next(iter(self._boost_terms)))[1].unpersist()
            self._boost_terms[key] = now, make().persist(StorageLevel.MEMORY_AND_DISK)
        return self._boost_terms[key][1]

    # --- metadata

    @cached_property
    def paths(self) -> list[str]:
        """All leaf paths; one small job unless the schema or the metadata already tells."""
        if self._paths is not None:
            return self._paths
        return sorted(r["path"] for r in self.leafs.select("path").distinct().collect())

    @property
    def info(self) -> FieldInfo:
        return FieldInfo(self.paths, [p for p in self.paths if self.config.of(p).has("Search")])

    def check(self, path: str, *features: str) -> None:
        """The field exists and has at least one of the features."""
        if path not in self.paths or (features and not any(self.config.of(path).has(f) for f in features)):
            raise FieldNotFound(path, [p for p in self.paths if not features or any(self.config.of(p).has(f) for f in features)])

    def selectable(self, wanted: tuple[str, ...]) -> tuple[str, ...]:
        """Those of the paths, or objects and arrays above paths, that documents can be cut down to; others are left out."""
        known = [p for p in self.paths if self.config.of(p).has("Select") or self.config.of(p).has("Facets")]
        return tuple(w for w in wanted if any(p == w or p.startswith((f"{w}.", f"{w}[")) for p in known))

    def num_docs(self) -> int:
        return self.docs.count()

    def bytes_indexed(self) -> int:
        return self.docs.agg(F.sum(F.octet_length("doc"))).first()[0] or 0

    def get_document(self, doc_id: int) -> dict[str, Any] | None:
        row = self.docs.where(F.col("doc_id") == doc_id).first()
        return row and json.loads(row["doc"])

    def rebuilt(self) -> DataFrame:
        """(doc_id, doc): documents put together again from the leaves of all fields; every leaf is text."""
        return flatten.rebuild(self.leafs)

    def get_rebuilt(self, doc_id: int) -> dict[str, Any]:
        row = flatten.rebuild(self.leafs.where(F.col("doc_id") == doc_id)).first()
        return json.loads(row["doc"]) if row else {}

    def inspect(self, table: str, **keys: Any) -> DataFrame:
        """Rows of one index table, filtered by equality."""
        rows = self.table(table, keys.pop("path")) if "path" in keys and table in STORED else getattr(self, table)
        for name, value in keys.items():
            rows = rows.where(F.col(name) == F.lit(value))
        return rows

    # --- storage

    def in_memory(self) -> Index:
        """The same index with its tables kept by the executors, on disk where memory is short; searches read them."""
        kept = Index(self.spark, self.leafs.persist(StorageLevel.MEMORY_AND_DISK), self._docs, self.config, self.paths)
        kept.raw_config, kept.token_values, kept.stored = self.raw_config, self.token_values, True
        kept.terms = kept.terms.persist(StorageLevel.MEMORY_AND_DISK)
        kept.postings = kept.postings.persist(StorageLevel.MEMORY_AND_DISK)
        return kept

    def release(self) -> None:
        """Give back what :meth:`in_memory` keeps."""
        for table in (self.postings, self.terms, self.leafs):
            table.unpersist()

    def save(self, path: str) -> None:
        """Write all tables, each split by field and sorted by term so that row groups prune, and the metadata.

        Documents are flattened once: the other tables are made from the leaves and terms as written. Ranges by the
        whole order split a large field, and the postings of a frequent term, over many files. Finding the ranges runs
        a table's last step once more, so postings are kept on disk until they are written; pairs become distinct in
        their ranges, which spares a shuffle.
        """
        made = self
        for name, order in STORED.items():
            table = tables.repeated_pairs(made._with("PhraseBoost"), made.config) if name == "phrase_pairs" else getattr(made, name)
            if name == "postings":
                table = table.persist(StorageLevel.DISK_ONLY)
            ranges = table.repartitionByRange("path", *order)
            ranges = ranges.distinct() if name == "phrase_pairs" else ranges
            ranges.sortWithinPartitions("path", *order).write.partitionBy("path").mode("overwrite").parquet(f"{path}/{name}")
            if name == "postings":
                table.unpersist()
            if name == "leafs":
                made = Index(self.spark, self._read(self.spark, path, name), self._docs, self.config, self.paths)
                made.token_values = self.token_values
            elif name == "terms":
                made.terms = self._read(self.spark, path, name)
        self.docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/docs")
        made._docs = self.spark.read.schema("doc_id long, doc string").parquet(f"{path}/docs")
        meta = {"columns": self.paths, "num_docs": made.num_docs(), "bytes_indexed": made.bytes_indexed(), "config": self.raw_config}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @staticmethod
    def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
        shapes = {
            "leafs": flatten.SCHEMA, "terms": "path string, term string, term_lc string, num_occ long", "postings": "path string, term string, doc_id long, score int",
            "phrase_pairs": "path string, t1 string, t2 string, doc_id long", "token_texts": "path string, token string, h1 long, h2 long",
            "boosts": "path string, doc_id long, pos array<int>, boost float", "token_values": "path string, term string, value double",
        }
        return spark.read.schema(shapes[name]).parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        meta = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/metadata").collect()))
        index = Index(spark, Index._read(spark, path, "leafs"), spark.read.parquet(f"{path}/docs"), Config.parse(meta["config"]), meta["columns"])
        index.raw_config, index.stored = meta["config"], True
        for name in STORED:
            if name != "leafs":
                setattr(index, name, Index._read(spark, path, name))
        return index
