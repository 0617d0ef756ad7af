"""Index tables derived from leaves, each one or two shuffles keyed by (path, term)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from .config import Config, FieldConfig


def _per_field(config: Config, make, default) -> Column:
    """A column that differs by field settings, without a branch for fields that follow the default."""
    out = default(config.default)
    special = sorted(config.fields.items(), key=lambda x: repr(make(x[1])))
    for key, group in groupby(special, key=lambda x: repr(make(x[1]))):
        names = list(group)
        if key != repr(make(config.default)):
            out = F.when(F.col("path").isin([n for n, _ in names]), default(names[0][1])).otherwise(out)
    return out


def with_tokens(leafs: DataFrame, config: Config) -> DataFrame:
    """Leaves with ``tokens``: runs of the value, fewer than two runs count as not tokenized (an empty list)."""

    def make(f: FieldConfig) -> Column:
        runs = text.tokens("value", f.tokenize_on_chars)
        return runs if f.tokenize else F.array().cast("array<string>")

    runs = _per_field(config, lambda f: (f.tokenize, f.tokenize_on_chars), make)
    out = leafs.withColumn("tokens", runs)
    return out.withColumn("tokens", F.when(F.size("tokens") >= 2, F.col("tokens")).otherwise(F.array().cast("array<string>")))


def _fits(config: Config) -> Column:
    limit = _per_field(config, lambda f: f.do_not_store_text_longer_than, lambda f: F.lit(f.do_not_store_text_longer_than))
    return F.octet_length("value") <= limit


class _Cut:
    """Tokens of some values of one field, as numbers of distinct ones; values of fewer than two have none.

    ``row`` is the value that a token lies in, ``at`` its place there, ``code`` its place in ``known``, ``size`` the
    number of tokens of each value.
    """

    def __init__(self, values: pa.Array, f: FieldConfig) -> None:
        self.values, chars = values, text.SEPARATORS if f.tokenize_on_chars is None else f.tokenize_on_chars
        lists = text.split_batch(values if f.tokenize else values.slice(0, 0), chars)
        off = lists.offsets.to_numpy()
        size = np.diff(off) if f.tokenize else np.zeros(len(values), dtype=np.int32)
        coded = lists.values.dictionary_encode()
        code, row = coded.indices.to_numpy(), np.repeat(np.arange(len(size)), size)
        kept = np.repeat(size >= 2, size)
        at = np.arange(len(code)) - np.repeat(off[:-1], size) if len(code) else np.zeros(0, dtype=np.int64)
        self.code, self.row, self.at, self.known = code[kept].astype(np.int64), row[kept], at[kept], coded.dictionary
        self.size, self.chars = np.where(size >= 2, size, 0), chars
        self.whole = np.flatnonzero(pc.binary_length(values).to_numpy() <= f.do_not_store_text_longer_than)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Value, token, first place and times of each distinct token of each value."""
        key, first, times = np.unique(self.row * max(1, len(self.known)) + self.code, return_index=True, return_counts=True)
        return self.row[first], self.code[first], self.at[first], times


def _from_values(rows: DataFrame, config: Config, schema: str, make: Callable[[_Cut, pa.RecordBatch], list]) -> DataFrame:
    """Rows of ``schema`` (after ``path``) made of the values of a field, some MB at a time; ``rows`` has path and value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, n in text.pieces(b.column("value")):
                piece = b.slice(lo, n)
                paths = piece.column("path").dictionary_encode()
                for k, path in enumerate(paths.dictionary.to_pylist()):
                    own = piece.take(pa.array(np.flatnonzero(paths.indices.to_numpy() == k)))
                    made = make(_Cut(own.column("value"), config.of(path)), own)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(made[0]), pa.string()), *made], [x.split()[0] for x in ("path string", *schema.split(", "))])

    return rows.where("value is not null").mapInArrow(run, f"path string, {schema}")


def entries(leafs: DataFrame, config: Config) -> DataFrame:
    """(path, doc_id, pos, term, at, n_tokens, times, exact): each value as a whole, and each distinct token of it, found
    inside the value so that each distinct one leaves Python once."""

    def make(cut: _Cut, b: pa.RecordBatch) -> list:
        row, code, at, times = cut.distinct()
        n, rows = len(cut.whole), pa.array(np.concatenate([cut.whole, row]))
        with_ones = lambda x, first: np.concatenate([np.full(n, first), x])
        return [
            b.column("doc_id").take(rows), b.column("pos").take(rows), pa.concat_arrays([cut.values.take(pa.array(cut.whole)), cut.known.take(pa.array(code))]),
            pa.array(with_ones(at, 0), pa.int32()), pa.array(with_ones(cut.size[row], 1), pa.int32()), pa.array(with_ones(times, 1), pa.int64()), pa.array(np.arange(len(rows)) < n),
        ]

    return _from_values(leafs.select("path", "doc_id", "pos", "value"), config, "doc_id long, pos array<int>, term string, at int, n_tokens int, times long, exact boolean", make)


def packed_entries(leafs: DataFrame, config: Config) -> DataFrame:
    """(path, term, exact, docs, at, n_tokens): the same by term, with a place in the three lists for each value that has
    it. A row leaves Python for each term of some MB of text, not for each term of each value."""

    def make(cut: _Cut, b: pa.RecordBatch) -> list:
        values = cut.values.take(pa.array(cut.whole)).dictionary_encode()
        by = np.argsort(values.indices.to_numpy(), kind="stable")
        n, size = len(by), max(1, len(cut.size))
        key, first = np.unique(cut.code * size + cut.row, return_index=True)
        row, code = key % size, key // size
        starts = lambda x: np.flatnonzero(np.diff(x, prepend=-1))
        wholes, tokens = starts(values.indices.to_numpy()[by]), starts(code)
        off = pa.array(np.concatenate([wholes, n + tokens, [n + len(row)]]), pa.int32())
        lists = lambda x: pa.ListArray.from_arrays(off, x)
        with_first = lambda x, one: pa.array(np.concatenate([np.full(n, one), x]), pa.int32())
        return [
            pa.concat_arrays([values.dictionary, cut.known.take(pa.array(code[tokens]))]), pa.array(np.arange(len(off) - 1) < len(wholes)),
            lists(b.column("doc_id").take(pa.array(np.concatenate([cut.whole[by], row])))), lists(with_first(cut.at[first], 0)), lists(with_first(cut.size[row], 1)),
        ]

    return _from_values(leafs.select("path", "doc_id", "value"), config, "term string, exact boolean, docs array<long>, at array<int>, n_tokens array<int>", make)


Fits = Callable[[Column], Column]


def fitting_entries(leafs: DataFrame, config: Config, fits: Fits, holds: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same for one path and the terms that ``fits`` accepts only, found inside each row before it is exploded.

    ``holds`` is a cheap condition on ``value`` that every value with a fitting term meets, ``keep`` names columns to
    carry along.
    """
    cut = with_tokens(leafs if holds is None else leafs.where(holds), config)
    kinds = "array<struct<term:string,at:int,n_tokens:int,times:bigint,exact:boolean>>"
    whole = F.struct(F.col("value").alias("term"), F.lit(0).alias("at"), F.lit(1).alias("n_tokens"), F.lit(1).cast("long").alias("times"), F.lit(True).alias("exact"))
    first = F.when(_fits(config) & fits(F.col("value")), F.array(whole).cast(kinds)).otherwise(F.array().cast(kinds))
    cut = cut.select("path", "doc_id", "pos", *keep, "tokens", first.alias("first"), F.filter("tokens", fits).alias("hits"))
    one = lambda t: F.struct(
        t.alias("term"), (F.array_position("tokens", t) - 1).cast("int").alias("at"), F.size("tokens").alias("n_tokens"), F.size(F.filter("hits", lambda x: x == t)).cast("long").alias("times"), F.lit(False).alias("exact")
    )
    rest = F.transform(F.array_distinct("hits"), one).cast(kinds)
    return cut.select("path", "doc_id", "pos", *keep, F.explode(F.concat("first", rest)).alias("e")).select("path", "doc_id", "pos", *keep, "e.*")


def occurrences(found: DataFrame) -> DataFrame:
    """(path, term, term_lc, num_occ) of rows of :func:`entries`."""
    return found.groupBy("path", "term").agg(F.sum("times").alias("num_occ")).select("path", "term", F.lower("term").alias("term_lc"), "num_occ")


def terms(leafs: DataFrame, config: Config) -> DataFrame:
    """(path, term, term_lc, num_occ): occurrences of whole values up to the length limit and of every token, separators too."""

    def make(cut: _Cut, b: pa.RecordBatch) -> list:
        times = np.bincount(cut.code, minlength=len(cut.known))
        there = np.flatnonzero(times)
        whole = cut.values.take(pa.array(cut.whole)).value_counts()
        return [pa.concat_arrays([whole.field("values"), cut.known.take(pa.array(there))]), pa.concat_arrays([whole.field("counts"), pa.array(times[there], pa.int64())])]

    counted = _from_values(leafs.select("path", "value"), config, "term string, times long", make).groupBy("path", "term").agg(F.sum("times").alias("num_occ"))
    return counted.select("path", "term", F.lower("term").alias("term_lc"), "num_occ")


def one_value_each(leafs: DataFrame, ids: DataFrame | None = None) -> bool:
    """Does no document have two values of one path? ``ids`` tells without the values, if rows with them have one each."""
    rows = leafs.groupBy("path", "doc_id") if ids is None else ids.groupBy("doc_id")
    return rows.count().where("count > 1").isEmpty()


def postings(leafs: DataFrame, config: Config, known: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(path, term, doc_id, score): one scored entry for each term of a document's field.

    Occurrences (``known``, or counted here) are joined back by (path, term), so both sides share one partitioning; no
    side is sorted, a partition's terms are looked up in a table. Tokens at one place of a document are one entry, if
    rows repeat the place: the first token counts, and the longer value.

    Where a document has one value of a path at most, no term has two entries: a whole value is none of its tokens. One
    job tells, and entries are then sent by term in lists and need no grouping by document.
    """
    known = terms(leafs, config) if known is None else known
    if one_value_each(leafs, ids):
        packed = packed_entries(leafs, config).join(known.select("path", "term", "num_occ").hint("shuffle_hash"), ["path", "term"])
        each = packed.select("path", "term", "num_occ", "exact", "at", "n_tokens", F.posexplode("docs").alias("i", "doc_id"))
        return each.select("path", "term", "doc_id", scoring.anchor_score(F.get("at", "i"), F.col("num_occ"), F.get("n_tokens", "i"), F.col("exact")).alias("score"))
    place = F.when(~F.col("exact"), F.xxhash64("pos"))
    rows = entries(leafs, config).select("path", "term", "doc_id", place.alias("place"), "at", "n_tokens", "exact")
    found = rows.join(known.select("path", "term", "num_occ").hint("shuffle_hash"), ["path", "term"])
    each = scoring.anchor_score(F.col("at"), F.col("num_occ"), F.col("n_tokens"), F.col("exact"))
    token = F.col("place").isNotNull()
    best = found.groupBy("path", "term", "doc_id").agg(
        F.max(each).alias("best"), F.max(F.when(~token, each)).alias("whole"), F.count("*").alias("n"), F.count("place").alias("tokens"),
        F.min("place").alias("low"), F.max("place").alias("high"), F.min(F.when(token, F.col("at"))).alias("at"), F.max(F.when(token, F.col("n_tokens"))).alias("n_tokens"), F.max("num_occ").alias("num_occ"),
    )
    again = (F.col("tokens") > 1) & (F.col("low") == F.col("high"))
    merged = F.greatest("whole", scoring.anchor_score(F.col("at"), F.col("num_occ"), F.col("n_tokens"), F.lit(False)))
    score = scoring.merged_score(F.when(again, merged).otherwise(F.col("best")), F.when(again, F.col("n") - F.col("tokens") + 1).otherwise(F.col("n")))
    return best.select("path", "term", "doc_id", score.alias("score"))


def phrase_pairs(leafs: DataFrame, config: Config) -> DataFrame:
    """(path, t1, t2, doc_id): neighbouring tokens, separators skipped."""
    return repeated_pairs(leafs, config).distinct()


def repeated_pairs(leafs: DataFrame, config: Config) -> DataFrame:
    """The same, each once for every value that has it."""

    def make(cut: _Cut, b: pa.RecordBatch) -> list:
        word = ~pc.is_in(pc.utf8_slice_codeunits(cut.known, 0, 1), value_set=pa.array(list(cut.chars), pa.string())).to_numpy(zero_copy_only=False)[cut.code]
        row, code, n = cut.row[word], cut.code[word], max(1, len(cut.known))
        beside = row[:-1] == row[1:]
        key = np.unique((row[:-1][beside] * n + code[:-1][beside]) * n + code[1:][beside])
        return [cut.known.take(pa.array(key // n % n)), cut.known.take(pa.array(key % n)), b.column("doc_id").take(pa.array(key // n // n))]

    return _from_values(leafs.select("path", "doc_id", "value"), config, "t1 string, t2 string, doc_id long", make)


def text_id(value: str = "value") -> list[Column]:
    """Two 64-bit hashes that stand for a whole text."""
    return [F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(1), value).alias("h2")]


def token_texts(leafs: DataFrame, config: Config) -> DataFrame:
    """(path, token, h1, h2): which texts hold a token, by the ids of the texts. Equal texts are cut once."""

    def make(cut: _Cut, b: pa.RecordBatch) -> list:
        row, code, _, _ = cut.distinct()
        return [cut.known.take(pa.array(code)), b.column("h1").take(pa.array(row)), b.column("h2").take(pa.array(row))]

    texts = leafs.select("path", "value").distinct().select("path", "value", *text_id())
    return _from_values(texts, config, "token string, h1 long, h2 long", make)


def boosts(leafs: DataFrame, config: Config) -> DataFrame:
    """(path, doc_id, pos, boost): numbers of the fields marked as boosts; other texts are skipped."""
    names = [n for n, f in config.fields.items() if f.boost]
    number = F.expr("try_cast(value as float)")
    rows = leafs.where(F.col("path").isin(names)) if names else leafs.limit(0)
    return rows.select("path", "doc_id", "pos", number.alias("boost")).where("boost is not null and not isnan(boost)")
