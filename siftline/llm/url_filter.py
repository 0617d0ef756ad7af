"""URL allow and block lists as a trie over reversed host labels, each with a trie of path segments.

A rule is ``host`` or ``host/segment/...``. It covers that host, all its subdomains, and all paths below. Of the
rules that cover a URL the longest wins: most host labels plus path segments, then most host labels; block beats
allow where the same pattern is in both lists. Scheme, user, port, query and fragment are ignored, the host is
compared in lower case without a final dot, empty path segments are skipped.

Defined cases: a null URL, or one without ``//host``, is matched by no rule (decision ``none``). ``keep`` is false
for ``block`` only. Rows are neither dropped nor merged; repeated rows are decided alike. White space around patterns
is ignored, so are rules without a host, whatever their kind; another kind than allow and block, null too, is an
error. Rules are brought
to one form before they become a trie or, beyond ``MAX_BROADCAST_RULES``, a table to join, which answers alike. An
empty table gives an empty result, no rules give ``none`` throughout.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this count are broadcast as a trie; beyond it the same answer comes from a shuffled join.
MAX_BROADCAST_RULES = 500_000

_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)"


def host_column(url: str) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", "")


def normalised(rules: DataFrame) -> DataFrame:
    """(rule, is_block): distinct rules as ``host/segment/...``; a kind other than allow and block is an error."""
    pattern = F.regexp_replace("pattern", r"^\s+|\s+$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(pattern, r"^([^/]*)", 1)), r"\.+$", "")
    parts = F.filter(F.split(F.regexp_extract(pattern, r"(?s)^[^/]*(.*)$", 1), "/"), lambda x: x != "")
    wrong = F.raise_error(F.concat(F.lit("a rule is allow or block, not "), F.coalesce(F.col("kind"), F.lit("null"))))
    is_block = F.when(F.col("kind").isin("allow", "block"), F.col("kind") == "block").otherwise(wrong.cast("boolean"))
    rows = rules.select(F.when(host != "", F.concat_ws("/", F.array(host), parts)).alias("rule"), is_block.alias("is_block"))
    return rows.groupBy("rule").agg(F.max("is_block").alias("is_block")).where("rule is not null and is_block is not null")


class Trie:
    """Nodes are [label children, segment children, rule ended here]; a rule is (is block, pattern)."""

    def __init__(self, rules: Iterable[tuple[str, bool]]) -> None:
        self.top: list = [{}, {}, None]
        for rule, is_block in rules:
            host, *segments = rule.split("/")
            node = self.top
            for depth, part in ((0, reversed(host.split("."))), (1, segments)):
                for x in part:
                    node = node[depth].setdefault(x, [{}, {}, None])
            node[2] = (is_block, rule)

    def find(self, labels: list[str], segments: list[str]) -> tuple[bool, str] | None:
        best, rank, node = None, (0, 0), self.top
        for n, label in enumerate(reversed(labels), 1):
            node = node[0].get(label)
            if node is None:
                break
            if node[2] and (n, n) > rank:
                best, rank = node[2], (n, n)
            below = node
            for m, segment in enumerate(segments, 1):
                below = below[1].get(segment)
                if below is None:
                    break
                if below[2] and (n + m, n) > rank:
                    best, rank = below[2], (n + m, n)
        return best


def _parsed(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    segments = F.filter(F.split(F.regexp_extract(url_col, _PATH, 1), "/"), lambda x: x != "")
    host = host_column(url_col)
    return pages.select(
        F.col(id_col), F.col(url_col), F.when(host != "", F.split(host, r"\.")).alias("labels"), F.when(host != "", segments).alias("segments")
    )


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", limit: int = MAX_BROADCAST_RULES) -> DataFrame:
    """(id, url, decision, rule, keep) for every row of ``pages``; ``rules`` has pattern and kind (allow, block)."""
    listed = normalised(rules)
    head = listed.limit(limit + 1).collect()
    if len(head) > limit:
        return _by_join(pages, listed, id_col, url_col)
    trie = pages.sparkSession.sparkContext.broadcast(Trie((r[0], r[1]) for r in head))
    schema = _parsed(pages, id_col, url_col).drop("labels", "segments").schema.simpleString()[7:-1]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for b in batches:
            found = [find(x, y) if x else None for x, y in zip(b.column("labels").to_pylist(), b.column("segments").to_pylist(), strict=True)]
            decision = ["none" if f is None else "block" if f[0] else "allow" for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(decision, pa.string()), pa.array([f and f[1] for f in found], pa.string()), pa.array([x != "block" for x in decision], pa.bool_())],
                [id_col, url_col, "decision", "rule", "keep"],
            )

    return _parsed(pages, id_col, url_col).mapInArrow(decide, f"{schema},decision:string,rule:string,keep:boolean")


def _by_join(pages: DataFrame, rules: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """The same for lists too long to broadcast: each distinct URL's host suffixes and path prefixes meet the rules in a join."""
    urls = _parsed(pages, id_col, url_col).where("labels is not null").select(F.col(url_col).alias("u"), "labels", "segments").distinct()
    keys = urls.select(
        "u",
        F.explode(
            F.expr(
                "flatten(transform(sequence(1, size(labels)), n -> transform(sequence(0, size(segments)), m -> struct("
                "n + m as total, n as n, concat_ws('/', array(concat_ws('.', slice(labels, size(labels) - n + 1, n))), slice(segments, 1, m)) as rule))))"
            )
        ).alias("k"),
    ).select("u", "k.*")
    best = keys.join(rules, "rule").groupBy("u").agg(F.max_by(F.struct("is_block", "rule"), F.struct("total", "n")).alias("best"))
    return pages.select(id_col, url_col).join(best, F.col(url_col) == F.col("u"), "left").select(
        id_col, url_col,
        F.when(F.col("best").isNull(), "none").when(F.col("best.is_block"), "block").otherwise("allow").alias("decision"),
        F.col("best.rule").alias("rule"),
        (~F.coalesce("best.is_block", F.lit(False))).alias("keep"),
    )
