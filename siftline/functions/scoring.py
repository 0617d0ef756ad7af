"""Score formulas as column expressions: how well a term fits, how central it is to a document, and boosts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.errors import InvalidRequest
from ..plans.request import Boost


def anchor_score(position: Column, occurrences: Column, n_tokens: Column, exact: Column) -> Column:
    """Whole-number score of a term in a document: early, rare terms in short texts and whole values score high."""
    base = F.when(exact, F.lit(400.0)).otherwise(F.lit(2000.0) / (F.log2(position + F.lit(10.0)) + F.lit(10.0)))
    damp = lambda x: x - F.lit(0.7) * (x - F.lit(1.0))
    rare = damp(F.log10(occurrences + F.lit(1000.0)) - F.lit(2.0))
    short = damp(F.log10(n_tokens + F.lit(10.0)))
    return F.floor(base / rare / short).cast("int")


def merged_score(best: Column, entries: Column) -> Column:
    """A term met n times in a document has its best score plus n, five at most."""
    return F.when(entries > 1, best + F.least(entries, F.lit(5))).otherwise(best).cast("int")


def fit_score(distance: Column, prefix_rule: Column) -> Column:
    """Score of a term by edit distance; a term that goes on after the wanted prefix is judged more mildly."""
    d = distance.cast("double")
    return F.when(prefix_rule, F.lit(2.0) / (F.log2(d + 1.0) + F.lit(0.2))).otherwise(F.lit(2.0) / (d + F.lit(0.2)))


def boosted(score: Column, value: Column, boost: Boost) -> Column:
    """``score`` after one boost with ``value``; unchanged where the value is missing or the score is to be skipped."""
    v, p = value.cast("double"), F.lit(float(boost.param or 0.0))
    out = score
    if boost.boost_fun is not None:
        out = {"Log10": score * F.log10(v + p), "Log2": score * F.log2(v + p), "Multiply": score * (v + p), "Add": score + (v + p), "Replace": v + p}[boost.boost_fun]
    if boost.expression is not None:
        out = out + expression(boost.expression, v)
    skipped = F.lit(False)
    for x in boost.skip_when_score:
        skipped = skipped | (F.abs(score - F.lit(float(x))) < 1e-5)
    return F.when(value.isNull() | skipped, score).otherwise(out)


_OPERAND = r"(\$SCORE|[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)"
_EXPRESSION = re.compile(rf"\s*{_OPERAND}\s*([-+*/])\s*{_OPERAND}\s*")


def expression(text: str, value: Column) -> Column:
    """``x op y`` where x and y are numbers or ``$SCORE``, which stands for the boost value."""
    found = _EXPRESSION.fullmatch(text)
    if not found:
        raise InvalidRequest(f"a boost expression is 'x op y', not {text!r}")
    x, y = (value if g == "$SCORE" else F.lit(float(g)) for g in (found[1], found[3]))
    match found[2]:
        case "+":
            return x + y
        case "-":
            return x - y
        case "*":
            return x * y
    return F.try_divide(x, y)
