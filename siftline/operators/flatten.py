"""Nested documents to one row per leaf value: (path, doc_id, pos, value).

``path`` names objects with dots and arrays with ``[]``; ``pos`` holds the index in each array on the way, so an
element is (doc_id, array path, prefix of pos). Nulls give no row. Every value is text: numbers as written, booleans
as true and false; floats without fraction lose it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "path string, doc_id long, pos array<int>, value string"


def leaves(value: object, path: str = "", pos: tuple[int, ...] = ()) -> Iterator[tuple[str, tuple[int, ...], str]]:
    """(path, pos, text) of each leaf of one parsed document, in order."""
    if value is None:
        return
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from leaves(inner, f"{path}.{key}" if path else key, pos)
    elif isinstance(value, list):
        for i, inner in enumerate(value):
            yield from leaves(inner, path + "[]", (*pos, i))
    else:
        yield path, pos, leaf_text(value)


def leaf_text(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        text = repr(value)
        return text.removesuffix(".0")
    return str(value)


def flatten_json(docs: DataFrame) -> DataFrame:
    """Leaves of (doc_id, doc) where doc is JSON text of any shape, also with mixed types under one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, d, list(x), v) for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if text for p, x, v in leaves(json.loads(text))]
            if rows:
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.string()), strict=True)], ["path", "doc_id", "pos", "value"])

    return docs.select("doc_id", "doc").mapInArrow(run, SCHEMA)


def _text(column: Column, kind: T.DataType) -> Column:
    text = column.cast("string")
    return F.regexp_replace(text, r"\.0$", "") if isinstance(kind, T.DoubleType | T.FloatType) else text


def schema_paths(kind: T.DataType, path: str) -> list[str]:
    """Paths of the leaves below a column of this type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{path}.{f.name}")]
    return schema_paths(kind.elementType, path + "[]") if isinstance(kind, T.ArrayType) else [path]


def flatten_columns(df: DataFrame, id_col: str, columns: list[str] | None = None, only: str | None = None) -> DataFrame:
    """Leaves of typed rows. One scan: scalar leaves come from one explode, each array adds one more level.

    ``columns`` limits which top-level columns are read, ``only`` names the one path that is wanted.
    """
    leads = lambda kind, path: only is None or only in schema_paths(kind, path)
    wanted = [f for f in df.schema.fields if f.name != id_col and (columns is None or f.name in columns)]
    found: list[Column] = []

    def walk(column: Column, kind: T.DataType, path: str, pos: Column) -> Column:
        """An array of (path, pos, value) structs for everything below."""
        if isinstance(kind, T.StructType):
            below = [walk(column[f.name], f.dataType, f"{path}.{f.name}", pos) for f in kind.fields if leads(f.dataType, f"{path}.{f.name}")]
            return below[0] if len(below) == 1 else F.flatten(F.array(*below))
        if isinstance(kind, T.ArrayType):
            inner = F.transform(column, lambda x, i: walk(x, kind.elementType, path + "[]", F.concat(pos, F.array(i))))
            return F.coalesce(F.flatten(inner), _none())
        row = F.struct(F.lit(path).alias("path"), pos.alias("pos"), _text(column, kind).alias("value"))
        return F.when(column.isNotNull(), F.array(row)).otherwise(_none())

    def _none() -> Column:
        return F.array().cast("array<struct<path:string,pos:array<int>,value:string>>")

    for f in (f for f in wanted if leads(f.dataType, f.name)):
        found.append(walk(F.col(f"`{f.name}`"), f.dataType, f.name, F.array().cast("array<int>")))
    if not found:
        return df.sparkSession.createDataFrame([], SCHEMA)
    each = found[0] if len(found) == 1 else F.concat(*found)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.explode(each).alias("x")).select("x.path", "doc_id", "x.pos", "x.value")


def element_ids(leafs: DataFrame, span: int = 1 << 16) -> DataFrame:
    """(path, value_id, doc_id, pos, value): running number of each leaf within its path, in document order.

    Numbers run inside blocks of ``span`` document ids; only the blocks' counts are added up along a path.
    """
    block = F.floor(F.col("doc_id") / span)
    rows = leafs.withColumn("block", block)
    counts = rows.groupBy("path", "block").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("path").orderBy("block")) - F.col("n")).drop("n")
    inside = Window.partitionBy("path", "block").orderBy("doc_id", "pos")
    placed = rows.withColumn("at", F.row_number().over(inside) - 1).join(before, ["path", "block"])
    return placed.select("path", (F.col("before") + F.col("at")).cast("long").alias("value_id"), "doc_id", "pos", "value")


def _steps(path: str) -> list[str]:
    """``a[].b`` as keys and arrays: a, [], b."""
    return [x for part in path.split(".") for x in (part.rstrip("[]"), *["[]"] * part.count("[]"))]


def assemble(rows: list[tuple[str, list[int], str]], steps: dict[str, list[str]] | None = None) -> object:
    """A nested document from (path, pos, value); elements that aren't there are skipped, keys come in order of paths.

    ``steps`` keeps the steps of paths from one document to the next.
    """
    top: dict = {}
    known = {} if steps is None else steps
    for path, pos, value in sorted(rows):
        own = known.get(path)
        if own is None:
            own = known[path] = _steps(path)
        node, at, last = top, 0, len(own) - 1
        for i, s in enumerate(own):
            if s == "[]":
                s = pos[at]
                at += 1
            node = node.setdefault(s, value if i == last else {})
            if not isinstance(node, dict):
                break
    return _shaped(top)


def _shaped(node: dict) -> object:
    if node and all(isinstance(k, int) for k in node):
        return [_shaped(node[k]) if isinstance(node[k], dict) else node[k] for k in sorted(node)]
    return {str(k): _shaped(v) if isinstance(v, dict) else v for k, v in node.items()}


def rebuild(leafs: DataFrame) -> DataFrame:
    """(doc_id, doc) from leaves: one group holds the leaves of one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps: dict[str, list[str]] = {}
        for b in batches:
            lists = b.column("rows")
            ends, all_rows = lists.offsets.to_pylist(), lists.values
            # columns are turned into Python's values whole, not leaf by leaf as dictionaries
            paths, values, pos = (all_rows.field(n) for n in ("path", "value", "pos"))
            places, cuts = pos.values.to_pylist(), pos.offsets.to_pylist()
            leaf = list(zip(paths.to_pylist(), [places[i:j] for i, j in zip(cuts, cuts[1:])], values.to_pylist(), strict=True))
            docs = [json.dumps(assemble(leaf[i:j], steps), ensure_ascii=False) for i, j in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(docs, pa.string())], ["doc_id", "doc"])

    return leafs.groupBy("doc_id").agg(F.collect_list(F.struct("path", "pos", "value")).alias("rows")).mapInArrow(run, "doc_id long, doc string")


def array_prefix(path: str) -> str:
    """The innermost array that a path lies in: ``a[].b[].c`` gives ``a[].b[]``; empty outside arrays."""
    return path[: path.rfind("[]") + 2] if "[]" in path else ""
