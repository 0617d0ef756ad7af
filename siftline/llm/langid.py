"""Language identification by nearest centroid.

Features are 1- to 4-grams of bytes of the lower-cased text, hashed to ``DIMS`` buckets, weighted by log-damped
term frequency and inverse document frequency, and scaled to length one. Each language has ``CENTROIDS`` centroids
from spherical k-means. A text takes the language of the nearest centroid by cosine; if the cosine distance is above
that language's rejection radius for texts of this size it becomes ``und``. Radii come from held-out distances, with
centroids fitted on one half of the rows and measured on the other: of own texts, and of texts of other languages that
come nearest once their own language is left out, and of words of random letters. The radius is where the fewest own
texts are rejected and others accepted, in shares; as short texts lie further out, it is set for the first 16, 32 ...
1024 bytes of texts and for whole texts by size, and interpolated by number of grams.

Fitting uses at most ``PER_LANGUAGE`` labelled rows of each language, those with the smallest hash of id and text;
this bound is a parameter. Prediction covers all rows and whole texts.

Defined cases: a null or empty text, or one without letters, is ``und`` with null score. Rows with null language or
text are not used in fitting. Ties go to the first language in alphabetical order. No labelled rows: all ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx

DIMS = 1 << 12
PER_LANGUAGE = 600
CENTROIDS = 4
PREFIXES = (16, 32, 64, 128, 256, 512, 1024)


def gram_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows of counts of hashed byte 1- to 4-grams that hold letters and inner single blanks only.

    Other bytes (digits, signs, repeated blanks) end a run, so they don't shape the vector.
    """
    n = len(off) - 1
    out = np.zeros((n, DIMS), dtype=np.float32)
    if not len(data):
        return out
    code = _CODE[data].astype(np.uint32)
    row = np.repeat(np.arange(n), np.diff(off))
    h = np.zeros(len(data), dtype=np.uint32)
    good = np.ones(len(data), dtype=bool)
    for size in (1, 2, 3, 4):
        if len(data) < size:
            break
        with np.errstate(over="ignore"):
            h = h[: len(data) - size + 1] * np.uint32(0x01000193) + code[size - 1 :]
        good = good[: len(h)] & (code[size - 1 :] > 0)
        ok = good & (row[: len(h)] == row[size - 1 :])
        if size == 1:
            ok &= code > 1
        with np.errstate(over="ignore"):
            bucket = ((h[ok] * np.uint32(size * 2 + 1) * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
        out += np.bincount(row[: len(h)][ok] * DIMS + bucket, minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)
    return out


_CODE = np.zeros(256, dtype=np.uint8)
_CODE[32] = _CODE[10] = 1
_CODE[97:123] = np.arange(97, 123)
_CODE[128:256] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    radius: np.ndarray  # (languages, sizes)
    sizes: np.ndarray  # logarithms of gram counts, ascending

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language index or -1, cosine) for each row of counts."""
        if not len(self.languages):
            return np.full(len(counts), -1), np.zeros(len(counts))
        cos = self.vectors(counts) @ self.centroids.T
        best = cos.argmax(axis=1)
        score = cos[np.arange(len(cos)), best]
        lang = self.owner[best]
        place = np.interp(np.log(np.maximum(counts.sum(axis=1), 1)), self.sizes, np.arange(len(self.sizes)))
        low = place.astype(int)
        high = np.minimum(low + 1, len(self.sizes) - 1)
        room = 1 - score <= self.radius[lang, low] + (place - low) * (self.radius[lang, high] - self.radius[lang, low])
        return np.where(room & (counts.sum(axis=1) > 0), lang, -1), score


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    centres = x[[int(rng.integers(len(x)))]]
    for _ in range(k - 1):
        far = np.maximum(0, 1 - (x @ centres.T).max(axis=1)) ** 2
        centres = np.vstack([centres, x[int(rng.choice(len(x), p=far / far.sum())) if far.sum() > 0 else 0]])
    for _ in range(12):
        own = (x @ centres.T).argmax(axis=1)
        centres = np.stack([x[own == i].mean(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def _noise(size: int, n: int, rng: np.random.Generator) -> np.ndarray:
    """Counts of ``n`` texts of ``size`` bytes, words of random letters."""
    data = np.where(rng.random(n * size) < 1 / 7, 32, rng.integers(97, 123, n * size)).astype(np.uint8)
    return gram_counts(data, np.arange(n + 1) * size)


def _between(own: np.ndarray, *others: np.ndarray) -> float:
    """The distance with the least sum of the share of own texts rejected and of each other kind accepted."""
    own, others = np.sort(own), [np.sort(x) for x in others if len(x)]
    at = np.sort(np.concatenate([own, *others]))
    wrong = 1 - np.searchsorted(own, at, side="right") / len(own) + sum(np.searchsorted(x, at, side="right") / len(x) for x in others)
    best = int(wrong.argmin())
    return float(at[best] + at[min(best + 1, len(at) - 1)]) / 2


def _radii(model: Model, counts: np.ndarray, heads: list[bytes], lang: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(radius of each language and size, log sizes) from distances to centroids fitted without the text."""
    own, x = np.searchsorted(model.languages, lang), model.vectors(counts)
    half = rng.permutation(len(x)) % 2
    fitted = []
    for side in (0, 1):
        parts = []
        for n in range(len(model.languages)):
            rows = (own == n) & (half != side)
            parts.append(_kmeans(x[rows if rows.any() else own == n], k, rng))
        fitted.append(parts)
    long, whole = np.array([len(h) for h in heads]), counts.sum(axis=1)
    least = 20 * len(model.languages)
    levels = [(size, np.flatnonzero(long > size)) for size in PREFIXES]
    levels += [(0, np.flatnonzero((long > PREFIXES[-1]) & (whole >= lo) & (whole < lo * 2))) for lo in 4 * PREFIXES[-1] * 2 ** np.arange(8)]
    levels = [(size, pick) for size, pick in levels if len(pick) >= least] or [(0, np.arange(len(x)))]
    radius, sizes = [], []
    for size, pick in levels:
        if not size:
            some = counts[pick]
        else:
            data = np.frombuffer(b"".join(heads[i][:size] for i in pick), dtype=np.uint8)
            some = gram_counts(data, np.arange(len(pick) + 1) * size)
        grams = some.sum(axis=1)
        v = model.vectors(some)
        far = np.empty((len(pick), len(model.languages)))
        for side in (0, 1):
            rows = half[pick] == side
            far[rows] = np.stack([1 - (v[rows] @ c.T).max(axis=1) for c in fitted[side]], axis=1)
        noise = 1 - model.vectors(_noise(size or max(1, int(np.median(grams) / 3.5)), 40, rng)) @ np.vstack([c for parts in fitted for c in parts]).T
        owner = np.concatenate([np.full(len(c), n) for parts in fitted for n, c in enumerate(parts)])
        others = far.copy()
        others[np.arange(len(pick)), own[pick]] = np.inf
        nearest = others.argmin(axis=1)
        level = []
        for n in range(len(model.languages)):
            mine, rest = (own[pick] == n) & (grams > 0), (own[pick] != n) & (grams > 0)
            close = rest & (nearest == n)
            level.append(np.nan if mine.sum() < (10 if len(levels) > 1 else 1) else _between(far[mine, n], far[close if close.sum() >= 20 else rest, n], noise[:, owner == n].min(axis=1)))
        radius.append(level)
        sizes.append(np.log(max(1.0, float(np.median(grams)))))
    order = np.argsort(sizes, kind="stable")
    out, at = np.array(radius)[order].T, np.array(sizes)[order]
    # a size at which a language has too few texts takes the radius between its other sizes, a language without any the mean
    known = ~np.isnan(out)
    for n in np.flatnonzero(known.any(axis=1)):
        out[n] = np.interp(at, at[known[n]], out[n, known[n]])
    out[~known.any(axis=1)] = out[known.any(axis=1)].mean(axis=0) if known.any() else 1.0
    return out, at


def _training_rows(docs: DataFrame, per_language: int) -> DataFrame:
    """The ``per_language`` rows of least hash of each language, found without shuffling texts."""
    hashed = docs.select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).where("lang is not null and length(text) > 0")
    counts = {r["lang"]: r["count"] for r in docs.where("lang is not null").groupBy("lang").count().collect()}
    cut = F.lit(False)
    for lang, n in sorted(counts.items()):
        share = min(1.0, (per_language + 6 * per_language**0.5 + 20) / n)
        cut = cut | ((F.col("lang") == lang) & (F.col("h") <= min(2**63 - 1, int(-(2**63) + share * 2**64))))
    return hashed.where(cut)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, k: int = CENTROIDS, seed: int = 7) -> Model:
    """Fit on labelled rows (doc_id, text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in tx.chunks(b, "text", size=1 << 19):
                packed = gram_counts(data, off).astype(np.uint16 if np.diff(off).max(initial=0) < 65_536 else np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[b.column(c).slice(lo, hi - lo) for c in ("lang", "h")], pa.array([r.astype(np.uint32).tobytes() for r in packed], pa.binary()),
                        pa.array([data[x : min(y, x + PREFIXES[-1] + 1)].tobytes() for x, y in zip(off[:-1], off[1:], strict=True)], pa.binary()),
                    ],
                    ["lang", "h", "counts", "head"],
                )

    rows = _training_rows(docs, per_language).mapInArrow(count, "lang string, h long, counts binary, head binary").toPandas()
    rows = rows.sort_values(["lang", "h"]).groupby("lang").head(per_language)
    if not len(rows):
        z = np.zeros((0, DIMS), dtype=np.float32)
        return Model([], np.ones(DIMS, dtype=np.float32), z, np.zeros(0, dtype=int), np.zeros((0, 1)), np.zeros(1))
    counts = np.stack([np.frombuffer(x, dtype=np.uint32) for x in rows["counts"]]).astype(np.float32)
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.2).astype(np.float32)
    model = Model(sorted(rows["lang"].unique()), idf, np.zeros((0, DIMS), dtype=np.float32), np.zeros(0, dtype=int), np.zeros((0, 1)), np.zeros(1))
    x, rng, lang = model.vectors(counts), np.random.default_rng(seed), rows["lang"].to_numpy()
    parts = []
    for name in model.languages:
        parts.append(_kmeans(x[lang == name], k, rng))
    model.centroids = np.vstack(parts).astype(np.float32)
    model.owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    model.radius, model.sizes = _radii(model, counts, [bytes(h) for h in rows["head"]], lang, k, rng)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, score) for every row; lang is ``und`` where rejected. The model's size doesn't grow with the data."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], dtype=object)
        for b in batches:
            for lo, hi, data, off in tx.chunks(b, "text", size=1 << 19):
                langs, scores = [], []
                for s in range(0, hi - lo, 256):
                    e = min(s + 256, hi - lo)
                    counts = gram_counts(data[off[s] : off[e]], off[s : e + 1] - off[s])
                    own, score = m.predict(counts)
                    langs.append(names[own])
                    scores.append(np.where(counts.sum(axis=1) > 0, score, np.nan))
                score = np.concatenate(scores).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(np.concatenate(langs), pa.string()), pa.array(score, mask=np.isnan(score))], ["doc_id", "lang", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang string, score double")
