"""Quality filtering by weak supervision.

Each rule votes good (1) or bad (-1) on a document, or abstains (0). A label model explains the votes: a document is
good with probability ``prior``; a rule that votes is right with its own accuracy on good and on bad documents.
Expectation-maximisation estimates prior and accuracies from the counts of vote patterns over all documents (at most
3 ** rules patterns, whatever the number of documents). ``quality`` is the posterior probability of good; documents
below ``THRESHOLD`` are rejected. No rule can reject on its own unless its estimated accuracy carries it.

Defined cases: null, empty or blank texts get quality 0 and are rejected; a document on which all rules abstain gets
the prior. Repeated rows are judged alike and all returned. An empty table gives an empty result. Extra columns are
not read.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .rows import row_key
from .scratch import materialise

THRESHOLD = 0.5
STOP = (
    "the of and to in a is that for it was with as on be at by from this are or an la le les des du que et un une en est pour dans qui sur pas avec el los las del se por con no una su para es"
    " der die und das den von zu mit sich ist nicht ein eine auf dem für im auch als"
).split()


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _vote(good: Column, bad: Column, votes: Column | None = None) -> Column:
    out = F.when(bad, -1).when(good, 1).otherwise(0)
    return (F.when(votes, out).otherwise(0) if votes is not None else out).cast("tinyint")


def rules() -> dict[str, Column]:
    """Votes as columns over what :func:`features` counts."""
    f = F.col
    words, chars, lines = f("words"), f("chars"), f("lines")
    symbols, upper, alpha = _share(f("symbols"), words), _share(f("upper"), f("letters")), _share(f("alpha_words"), words)
    mean, closed, stop = _share(f("letters"), words), _share(f("closed"), lines), _share(f("stops"), words)
    fresh, lines_fresh = _share(f("kinds"), words), _share(f("line_kinds"), lines)
    return {
        "symbols": _vote(symbols < 0.02, symbols > 0.1),
        "capitals": _vote(upper < 0.15, upper > 0.4),
        "alphabetic": _vote(alpha > 0.9, alpha < 0.7),
        "word_length": _vote(mean.between(2.5, 9), (mean < 2) | (mean > 12)),
        "stop_words": _vote(stop > 0.08, stop < 0.01, words >= 15),
        "closed_lines": _vote(closed > 0.6, closed < 0.15, lines >= 2),
        "repeated_lines": _vote(lines_fresh > 0.9, lines_fresh < 0.6, lines >= 4),
        "repeated_words": _vote(fresh > 0.2, fresh < 0.08, words.between(50, 5000)),
        "exclamation": _vote(_share(f("bangs"), words) < 0.02, _share(f("bangs"), words) > 0.1),
        "letters": _vote(_share(f("letters"), chars) > 0.72, _share(f("letters"), chars) < 0.6),
    }


FEATURES = ("chars", "words", "kinds", "stops", "lines", "line_kinds", "closed", "symbols", "bangs", "letters", "upper", "alpha_words")
_LETTER, _UPPER, _SPACE, _SYMBOL, _BANG, _CLOSER, _TAIL, _IN_WORD = (1 << n for n in range(8))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: kinds of character as bits, its lower-case form, and a number for hashing."""
    kinds = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        category = unicodedata.category(chr(c))
        if category[0] == "L":
            kinds[c] = _LETTER | _IN_WORD | (_UPPER if category == "Lu" else 0)
            low = chr(c).lower()
            lower[c] = ord(low) if len(low) == 1 else c
    for bit, chars in ((_SPACE, " \t\n\x0b\f\r"), (_SYMBOL, "#$%&*|@^~<>=+\\{}[]_"), (_BANG, "!"), (_CLOSER, ".!?:;\"”…"), (_TAIL, ".,;:!?"), (_IN_WORD, "'’-")):
        for c in chars:
            kinds[ord(c)] |= bit
    return kinds, lower, tx.mix(np.arange(sys.maxunicode + 1, dtype=np.uint64) + np.uint64(1)) | np.uint64(1)


def _sums(codes: np.ndarray) -> np.ndarray:
    up, _ = tx.powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_tables()[2][codes] * up[: len(codes)], out=out[1:])
    return out


def _distinct(row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """Number of distinct hashes of each of at most 60,000 rows, by 48 bits of them."""
    pairs = np.sort((row.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16)))
    new = np.ones(len(pairs), dtype=bool)
    new[1:] = pairs[1:] != pairs[:-1]
    return np.bincount((pairs[new] >> np.uint64(48)).astype(np.int64), minlength=rows)


def features(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Counts over whole texts, given as UTF-8 bytes and offsets of rows.

    A word is a run without white space, compared in lower case; a stop word may end in full stops and commas. A line
    ends at a newline and is blank without anything but blanks. A line is closed if its last sign besides blanks and
    tabs closes a sentence. An alphabetic word holds letters, apostrophes and hyphens, and one sign after them at most.
    """
    kinds, lower, _ = _tables()
    rows, n_bytes = len(off) - 1, np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    if len(codes) != n_bytes[-1]:
        raise ValueError("texts are not valid UTF-8")
    at, n = n_bytes[off], len(codes)
    row = np.repeat(np.arange(rows), np.diff(at))
    kind = kinds[codes]
    first = np.zeros(n + 1, dtype=bool)
    first[at] = True
    count = lambda where: np.bincount(row[where], minlength=rows)

    def runs(where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of runs of true values inside rows."""
        on = np.zeros(n + 2, dtype=bool)
        on[1:-1] = where
        return np.flatnonzero(on[1:-1] & (~on[:-2] | first[:-1])), np.flatnonzero(on[1:-1] & (~on[2:] | first[1:])) + 1

    start, end = runs((kind & _SPACE) == 0)
    place = np.arange(n)
    low = _sums(lower[codes])
    words = row[start]
    # the last sign of a word that is no full stop or comma
    full = np.maximum.accumulate(np.where((codes == 46) | (codes == 44), -1, place)) if n else place
    bare = np.maximum(full[end - 1] + 1, start)
    short = (bare - start > 0) & (bare - start <= max(map(len, STOP)))
    stop = np.isin(tx.span_hashes(low, start[short], bare[short]), _stop_hashes())
    wrong = np.concatenate([[0], np.cumsum((kind & _IN_WORD) == 0)])
    tail = end - ((kind[end - 1] & _TAIL) != 0)
    alphabetic = (tail > start) & (wrong[tail] == wrong[start])
    # lines: cut at newlines and rows; the newline belongs to none
    breaks = np.flatnonzero(codes == 10)
    line_start = np.sort(np.concatenate([breaks + 1, at[:-1]]))
    line_end = np.sort(np.concatenate([breaks, at[1:]]))
    solid = np.concatenate([[0], np.cumsum((codes != 32) & (codes != 10))])
    said = solid[line_end] > solid[line_start]
    line_start, line_end = line_start[said], line_end[said]
    seen = np.maximum.accumulate(np.where((codes == 32) | (codes == 9) | (codes == 10), -1, place)) if n else place
    last = seen[line_end - 1]
    closed = (last >= line_start) & ((kind[last] & _CLOSER) != 0)
    lines = row[line_start]
    return {
        "chars": np.diff(at), "words": np.bincount(words, minlength=rows), "kinds": _distinct(words, tx.span_hashes(low, start, end), rows), "stops": np.bincount(words[short][stop], minlength=rows),
        "lines": np.bincount(lines, minlength=rows), "line_kinds": _distinct(lines, tx.span_hashes(_sums(codes), line_start, line_end), rows), "closed": np.bincount(lines[closed], minlength=rows),
        "symbols": np.bincount(row[runs((kind & _SYMBOL) != 0)[0]], minlength=rows), "bangs": np.bincount(row[runs((kind & _BANG) != 0)[0]], minlength=rows),
        "letters": count((kind & _LETTER) != 0), "upper": count((kind & _UPPER) != 0), "alpha_words": np.bincount(words[alphabetic], minlength=rows),
    }


@cache
def _stop_hashes() -> np.ndarray:
    out = []
    for w in STOP:
        codes = np.array([ord(c) for c in w], dtype=np.uint32)
        out.append(tx.span_hashes(_sums(codes), np.array([0]), np.array([len(codes)]))[0])
    return np.array(out, dtype=np.uint64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, off in tx.chunks(b, "text", lower=False):
            f = features(data, off)
            yield pa.RecordBatch.from_arrays([*[b.column(c).slice(lo, hi - lo) for c in ("k", "doc_id")], *[pa.array(f[x].astype(np.int32)) for x in FEATURES]], ["k", "doc_id", *FEATURES])


@dataclass
class LabelModel:
    prior: float
    good: np.ndarray  # P(vote is good | document good, rule votes)
    bad: np.ndarray  # P(vote is bad | document bad, rule votes)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        up, down = votes > 0, votes < 0
        odds = np.log(self.prior) - np.log1p(-self.prior)
        odds = odds + up @ (np.log(self.good) - np.log1p(-self.bad)) + down @ (np.log1p(-self.good) - np.log(self.bad))
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 200, strength: float = 2.0) -> LabelModel:
    """EM over vote patterns; accuracies start from the majority vote and are smoothed towards 0.7."""
    n = max(1.0, float(counts.sum()))
    post = np.clip(0.5 + 0.45 * np.sign(votes.sum(axis=1) - votes.shape[1] * 0.15), 0.05, 0.95)
    model = LabelModel(0.5, np.full(votes.shape[1], 0.7), np.full(votes.shape[1], 0.7))
    for _ in range(rounds):
        g, b = counts * post, counts * (1 - post)
        good = (g @ (votes > 0) + 0.7 * strength) / (g @ (votes != 0) + strength)
        bad = (b @ (votes < 0) + 0.7 * strength) / (b @ (votes != 0) + strength)
        last, model = model, LabelModel(float(np.clip(g.sum() / n, 0.02, 0.98)), np.clip(good, 0.02, 0.995), np.clip(bad, 0.02, 0.995))
        new = model.posterior(votes)
        post = new
        if abs(model.prior - last.prior) + np.abs(model.good - last.good).max() + np.abs(model.bad - last.bad).max() < 1e-9:
            break
    return model


def vote_table(docs: DataFrame) -> DataFrame:
    """(k, doc_id, votes): one digit 0, 1 or 2 per rule (vote + 1); null votes for texts without content."""
    text = F.col("text").cast("string")
    judged = docs.select(row_key().alias("k"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    counted = judged.mapInArrow(_counted, "k long, doc_id long, " + ", ".join(f"{x} int" for x in FEATURES))
    code = F.concat(*[(v + 1).cast("string") for v in rules().values()])
    return counted.select("k", "doc_id", F.when(F.col("words") > 0, code).alias("votes"))


def _patterns(table: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    rows = table.where("votes is not null").groupBy("votes").count().orderBy("votes").collect()
    codes = [r["votes"] for r in rows]
    votes = np.array([[int(c) - 1 for c in x] for x in codes], dtype=np.int64).reshape(len(codes), len(rules()))
    return codes, votes, np.array([r["count"] for r in rows], dtype=np.float64)


def quality_scores(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(k, doc_id, votes, quality, keep) for every row."""
    table = materialise(vote_table(docs), "votes")
    codes, votes, counts = _patterns(table)
    post = fit(votes, counts).posterior(votes) if codes else np.zeros(0)
    known = docs.sparkSession.createDataFrame([(c, float(p)) for c, p in zip(codes, post, strict=True)], "votes string, quality double")
    # at most 3 ** rules rows, so always small
    scored = table.join(F.broadcast(known), "votes", "left")
    quality = F.round(F.coalesce("quality", F.lit(0.0)), 9)
    return scored.select("k", "doc_id", "votes", quality.alias("quality"), (quality >= threshold).alias("keep"))
