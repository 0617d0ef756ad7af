"""Mixing overlapping sources to target weights by min-cost flow.

A text found in several sources may be spent for any of them. Documents are grouped by text, then aggregated by
membership pattern (the set of sources that hold the text). The driver holds one row per pattern that occurs, whatever
the number of documents. Tokens flow from patterns to the quotas of their sources.
A pattern's tokens can be used once at no cost, a second time at cost 1, a third time at cost 2 and so on (convex
repetition costs, up to ``MAX_REPEATS`` uses); what a quota can't get counts as shortfall at a cost above all of
these. The solution's flows give each pattern a number of uses per source, and documents are chosen in the order of a
seeded hash until these tokens are reached.

Defined cases: texts that are null or without words, and rows without source or id, are never selected; a source
without a target weight has no quota, and weights of absent sources go to shortfall; rows that repeat a text count
once, the smallest doc_id stands for it. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping
from heapq import heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import row_key
from .scratch import materialise

MAX_REPEATS = 4
BUCKETS = 1 << 12
SHORT = 1000.0


def solve(supply: list[float], members: list[tuple[int, ...]], quota: list[float], repeats: int = MAX_REPEATS) -> list[dict[int, float]]:
    """Min-cost flow: tokens of pattern p spent for source s.

    Successive shortest augmenting paths. Paths run over sources only: a step from source s to t moves flow of some
    pattern from s to t, a path ends at a pattern with room at its present marginal cost; so each search visits the
    few sources, and patterns are looked at in bulk.
    """
    flow: list[dict[int, float]] = [{} for _ in supply]
    used = [0.0] * len(supply)
    of: list[list[int]] = [[] for _ in quota]
    for p, m in enumerate(members):
        for s in m:
            of[s].append(p)
    holders: dict[tuple[int, int], dict[int, None]] = {}
    need = [float(q) for q in quota]

    def room(p: int) -> tuple[float, float]:
        """(cost, tokens) of the next use of p."""
        if supply[p] <= 0:
            return SHORT, 0.0
        level = int(used[p] / supply[p] + 1e-9)
        return (float(level), supply[p] * (level + 1) - used[p]) if level < repeats else (SHORT, 0.0)

    free: list[list[tuple[float, int]]] = [[] for _ in quota]
    for s in range(len(quota)):
        for p in of[s]:
            heappush(free[s], (room(p)[0], p))

    def best(s: int) -> tuple[float, int]:
        while free[s]:
            cost, p = free[s][0]
            now, left = room(p)
            if left <= 1e-6:
                heappop(free[s])
            elif now != cost:
                heappop(free[s])
                heappush(free[s], (now, p))
            else:
                return cost, p
        return SHORT, -1

    def put(p: int, s: int, x: float) -> None:
        before = flow[p].get(s, 0.0)
        after = before + x
        if after <= 1e-6:
            flow[p].pop(s, None)
        else:
            flow[p][s] = after
        if (before > 1e-6) != (after > 1e-6):
            for t in members[p]:
                if t != s:
                    (holders.setdefault((s, t), {}).__setitem__(p, None) if after > 1e-6 else holders.get((s, t), {}).pop(p, None))

    while True:
        # all sources with open quotas are starts at distance 0; moving flow between sources is free of cost, so the
        # cheapest path leads to the reachable source whose free pattern is cheapest
        start = [s for s in range(len(quota)) if need[s] > 1e-6]
        if not start:
            break
        found = None
        for s0 in start:
            came: dict[int, tuple[int, int] | None] = {s0: None}
            queue = [s0]
            for s in queue:
                cost, p = best(s)
                if p >= 0 and (found is None or cost < found[0]):
                    found = (cost, p, s, s0, came)
                # s wants a token: take it from t that spends a pattern which s holds as well
                for t in range(len(quota)):
                    if t not in came and holders.get((t, s)):
                        came[t] = (s, next(iter(holders[t, s])))
                        queue.append(t)
        if found is None or found[0] >= SHORT:
            break
        _, p, s, s0, came = found
        path, x = [], min(room(p)[1], need[s0])
        at = s
        while came[at] is not None:
            to, via = came[at]
            path.append((via, at, to))
            x = min(x, flow[via][at])
            at = to
        put(p, s, x)
        used[p] += x
        for via, giver, taker in path:
            put(via, giver, -x)
            put(via, taker, x)
        need[s0] -= x
    return flow


def _units(docs: DataFrame) -> DataFrame:
    """(h, g, doc_id, k, tokens, members): one row per distinct text."""
    rows = docs.where("doc_id is not null and source is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("tokens"),
        F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"), row_key().alias("k"),
    )
    rows = rows.where("tokens > 0")
    # each pair of text and source once, then a set that is no larger than the number of sources
    rows = rows.groupBy("h", "g", "source").agg(F.min("doc_id").alias("doc_id"), F.min_by("k", "doc_id").alias("k"), F.max("tokens").alias("tokens"))
    return rows.groupBy("h", "g").agg(F.min("doc_id").alias("doc_id"), F.min_by("k", "doc_id").alias("k"), F.max("tokens").alias("tokens"), F.array_sort(F.collect_list("source")).alias("members"))


def mix(docs: DataFrame, weights: Mapping[str, float], budget: float | None = None, seed: int = 0, repeats: int = MAX_REPEATS) -> DataFrame:
    """(doc_id, k, source, uses, tokens): chosen documents, the source each is spent for, how often.

    ``budget`` is the number of tokens wanted in all; by default that of the distinct texts.
    """
    units = _units(docs).select("doc_id", "k", "tokens", "members", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("h")).alias("u"))
    units = materialise(units.withColumn("bucket", F.shiftrightunsigned("u", 52).cast("int")), "units")
    # tokens of each pattern by bucket of the seeded hash: bounded by patterns x BUCKETS
    table = units.groupBy("members").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("texts"))
    known = table.orderBy(F.desc("tokens"), "members").collect()
    total = float(sum(r["tokens"] for r in known))
    names = sorted(weights)
    at, whole = {s: i for i, s in enumerate(names)}, sum(weights.values()) or 1.0
    members = [tuple(at[s] for s in r["members"] if s in at) for r in known]
    quota = [weights[s] / whole * (total if budget is None else budget) for s in names]
    flow = solve([float(r["tokens"]) for r in known], members, quota, repeats)
    # a pattern's uses lie on a line [0, tokens * repeats); each source owns an interval of it
    plan = []
    for r, f in zip(known, flow, strict=True):
        lo = 0.0
        for s in sorted(f):
            plan.append((r["members"], names[s], lo, lo + f[s], float(r["tokens"])))
            lo += f[s]
    plan_df = docs.sparkSession.createDataFrame(plan, "members array<string>, source string, lo double, hi double, supply double")
    # a text's place in its pattern: tokens of earlier buckets plus those before it in its own bucket
    order = Window.partitionBy("members").orderBy("bucket")
    offsets = units.groupBy("members", "bucket").agg(F.sum("tokens").alias("here")).withColumn("before", F.sum("here").over(order) - F.col("here")).drop("here")
    inside = Window.partitionBy("members", "bucket").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = units.withColumn("earlier", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(offsets, ["members", "bucket"]).withColumn("place", (F.col("before") + F.col("earlier")).cast("double"))
    # in pass j of the pattern the text stands at place + j * supply: it is used for the interval that holds this point
    hits = placed.join(F.broadcast(plan_df), "members").withColumn("uses", _points_inside())
    return hits.where("uses > 0").select("doc_id", "k", "source", F.col("uses").cast("int").alias("uses"), "tokens")


def _points_inside():
    """How many of the points place + j * supply (j = 0, 1 ...) lie in [lo, hi)."""
    below = lambda x: F.greatest(F.lit(0), F.ceil((F.col(x) - F.col("place")) / F.col("supply")))
    return below("hi") - below("lo")
