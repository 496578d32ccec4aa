"""Quality classifier by positive-unlabelled learning.

Trusted positives P are labelled good documents of the fitting folds; U is
every document of the corpus.  With class prior pi and the logistic loss l,
the unbiased risk of a scorer z is

    R = pi E_P[l(z)] + max(0, E_U[l(-z)] - pi E_P[l(-z)])

the second term being the risk of the negatives, N; held at zero or above, it
cannot be driven negative by overfitting the positives.  For the logistic loss
l(z) - l(-z) = -z, so where N >= 0 the risk R is convex.  Newton steps minimise
it; if the minimum lies where N < 0, they go along N = 0 instead, with a
multiplier theta for that condition: theta R + (1 - theta) pi E_P[l(z)] has no
slope there.  Fitting ends when the slope is below ``tolerance``, and reports
slope, theta, N and passes.

A document is described by ``FEATURES``, each cut into at most eight bins, and
packed into one 64-bit pattern, so the scorer is a sum of bin weights.  The
risk depends on a document through its pattern only: the table of patterns
with their counts in P and U is all that fitting reads, in every pass, with
every row of the corpus in it.  Each pass returns one gradient and Hessian
(about a hundred numbers squared) to the driver, whatever the input's size.

The class prior is the share of good among the labelled documents of the
fitting folds, or a parameter.

Defined results: a null or empty text is scored like any other pattern;
labels of unknown documents are ignored; a document labelled twice counts
once, by its lowest label; without any positive the score is the prior (0.5
if that is unknown too).
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, crc_fold, map_arrow, materialise, record_batch, table, texts_of
from .measures import DIGITS, UPPER, lines_and_repeats, repeated_words, share_of, symbols, word_chars, words_of

#: Each feature with the upper edges of its bins but the last.
FEATURES: dict[str, tuple[float, ...]] = {
    "words": (5, 10, 20, 50, 100, 300, 1000),
    "word_length": (2, 3, 3.7, 4.5, 5.5, 7, 10),
    "symbol_share": (0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.3),
    "upper_share": (0, 0.01, 0.03, 0.06, 0.12, 0.3, 0.6),
    "digit_share": (0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.5),
    "other_ascii_share": (0, 0.02, 0.04, 0.07, 0.12, 0.2, 0.4),
    "dup_line_share": (0, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
    "repeat_share": (0, 0.02, 0.05, 0.1, 0.2, 0.5, 0.8),
    "distinct_share": (0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95),
    "words_per_line": (1, 3, 6, 12, 25, 60, 150),
    "short_words": (0.05, 0.15, 0.3, 0.45, 0.6, 0.75, 0.9),
}
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "#*$%&|<>")
SIZE = 8 * len(FEATURES) + 1


@dataclass(frozen=True)
class PuSpec:
    prior: float | None = None
    ridge: float = 1e-3
    passes: int = 200  # never reached on convergent data; a warning says so
    tolerance: float = 1e-6


def pattern(text: str) -> int:
    """The bins of all features of a whole text, three bits each."""
    raw, words = text.encode("utf-8", "replace"), words_of(text)
    n, chars = len(words), max(word_chars(text), 1)
    lines, dup = lines_and_repeats(text)
    values = (n, chars / max(n, 1), symbols(text) / chars, share_of(raw, UPPER) / chars, share_of(raw, DIGITS) / chars,
              share_of(raw, _PUNCTUATION) / chars, dup / max(lines, 1), repeated_words(words) / max(n, 1),
              len(set(words)) / max(n, 1), n / max(lines, 1), sum(map(_SHORT, words)) / max(n, 1))
    return sum(sum(v > e for e in edges) << 3 * i for i, (v, edges) in enumerate(zip(values, FEATURES.values())))


def _SHORT(word: bytes) -> bool:
    return len(word) < 4


_PATTERNS = pa.schema([("doc_id", pa.int64()), ("pattern", pa.int64())])


def _pattern_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield record_batch(_PATTERNS, [column(batch, "doc_id"), [pattern(t) for t in texts_of(batch)]])


def patterns(docs: DataFrame) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return map_arrow(slim, _pattern_batches, "doc_id long, pattern long")


def _slots(codes: np.ndarray) -> np.ndarray:
    """Weight positions of each pattern: one bin a feature, and the bias."""
    i = np.arange(len(FEATURES))
    bins = codes[:, None] >> 3 * i & 7
    return np.hstack([bins + 8 * i, np.full((len(codes), 1), SIZE - 1)])


_SUMS = pa.schema([("sums", pa.list_(pa.float64()))])


_UPPER = np.triu_indices(SIZE)


def _pass(weights: np.ndarray):
    """One pass over the patterns at ``weights``: sums over U of the loss, the
    negatives' loss of P; gradient and Hessian (upper part) of U as negatives,
    then of P as positives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + 2 * SIZE + 2 * len(_UPPER[0]))
        for batch in batches:
            at = _slots(column(batch, "pattern").to_numpy())
            n_u, n_p = column(batch, "n_u").to_numpy(), column(batch, "n_p").to_numpy()
            z = weights[at].sum(1)
            loss, s = np.logaddexp(0, z), np.exp(-np.logaddexp(0, -z))
            hot = np.zeros((len(z), SIZE))
            hot[np.arange(len(z))[:, None], at] = 1
            parts = [np.array([n_u @ loss, n_p @ loss]), (n_u * s) @ hot, (n_p * (s - 1)) @ hot]
            parts += [((hot * (n * s * (1 - s))[:, None]).T @ hot)[_UPPER] for n in (n_u, n_p)]
            total += np.concatenate(parts)
        yield record_batch(_SUMS, [[total.tolist()]])
    return run


def _positive_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIZE)
    for batch in batches:
        n_p = column(batch, "n_p").to_numpy()
        at = _slots(column(batch, "pattern").to_numpy())
        total += np.bincount(at.ravel(), np.repeat(n_p.astype(float), at.shape[1]), SIZE)
    yield record_batch(_SUMS, [[total.tolist()]])


def _summed(counted: DataFrame, fn) -> np.ndarray:
    parts = map_arrow(counted, fn, "sums array<double>").select(F.posexplode("sums").alias("i", "v"))
    rows = parts.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r.v for r in rows])


@dataclass(frozen=True)
class Point:
    """The risk and its parts at ``w``: R, pi E_P[l(z)], N and their slopes."""
    w: np.ndarray
    risk: float
    negatives: float
    slope: np.ndarray       # of R
    slope_p: np.ndarray     # of pi E_P[l(z)]
    curve: np.ndarray
    curve_p: np.ndarray

    def residual(self, theta: float, ridge: float) -> np.ndarray:
        """Zero at the minimum: the slope and, on the edge, N."""
        slope = theta * self.slope + (1 - theta) * self.slope_p + ridge * self.w
        return np.append(slope, self.negatives if theta != 1 else min(0.0, self.negatives))


def minimum(at, spec: PuSpec) -> tuple[np.ndarray, dict]:
    """Where ``at`` (weights to ``Point``) is least with N >= 0, and a report.
    Cut short, it gives the best point met that keeps N >= 0."""
    p, theta, passes = at(np.zeros(SIZE)), 1.0, 1
    held = p  # the best point so far that keeps N >= 0
    while True:
        r = p.residual(theta, spec.ridge)
        if np.abs(r).max() < spec.tolerance or passes >= spec.passes:
            break
        edge = theta != 1 or p.negatives < 0
        curve = theta * p.curve + (1 - theta) * p.curve_p + spec.ridge * np.eye(SIZE)
        if edge:
            across = (p.slope - p.slope_p)[:, None]
            move = -np.linalg.solve(np.block([[curve, across], [across.T, np.zeros((1, 1))]]), np.append(r[:-1], p.negatives))
        else:
            move = np.append(-np.linalg.solve(curve, r[:-1]), 0.0)
        step = 1.0
        while True:
            new, passes, turned = at(p.w + step * move[:-1]), passes + 1, min(1.0, theta + step * move[-1])
            if edge:
                better = np.linalg.norm(new.residual(turned, spec.ridge)) < (1 - 0.1 * step) * np.linalg.norm(np.append(r[:-1], p.negatives))
            else:
                fall = spec.ridge / 2 * (new.w @ new.w - p.w @ p.w) + new.risk - p.risk
                better = fall <= 1e-4 * step * (r[:-1] @ move[:-1])
            if new.negatives >= 0 and new.risk + spec.ridge / 2 * new.w @ new.w < held.risk + spec.ridge / 2 * held.w @ held.w:
                held = new
            if better or step < 1e-4 or passes >= spec.passes:
                break
            step /= 2
        p, theta = new, turned
    report = {"passes": passes, "theta": theta, "negatives": p.negatives, "slope": float(np.abs(r).max()),
              "converged": bool(np.abs(r).max() < spec.tolerance)}
    if not report["converged"]:
        p = held
        warnings.warn(f"the non-negative risk is not minimised: {report}", RuntimeWarning, stacklevel=2)
    return p.w, report


def fit(codes: DataFrame, positives: DataFrame, prior: float, spec: PuSpec = PuSpec(), report: dict | None = None) -> np.ndarray | None:
    """Bin weights minimising the non-negative risk; None without positives.

    ``codes``: (doc_id, pattern) of every document; ``positives``: (p_id).
    ``report`` receives passes, theta, N, the slope left and ``converged``."""
    marked = codes.join(positives, codes.doc_id == positives.p_id, "left")
    counted = materialise(marked.groupBy("pattern").agg(
        F.count("*").alias("n_u"), F.count("p_id").alias("n_p")), "pu-patterns")
    n_u, n_p = counted.agg(F.coalesce(F.sum("n_u"), F.lit(0)), F.coalesce(F.sum("n_p"), F.lit(0))).first()
    if not n_p:
        return None
    mean_p = _summed(counted, _positive_sums) / n_p

    def whole(upper: np.ndarray) -> np.ndarray:
        m = np.zeros((SIZE, SIZE))
        m[_UPPER] = upper
        return m + np.triu(m, 1).T

    def at(w: np.ndarray) -> Point:
        sums, k = _summed(counted, _pass(w)), 2 + 2 * SIZE
        own = sums[1] / n_p - mean_p @ w  # E_P[l(z)]
        negatives = sums[0] / n_u - prior * sums[1] / n_p
        return Point(w, prior * own + negatives, negatives, sums[2:2 + SIZE] / n_u - prior * mean_p,
                     prior * sums[2 + SIZE:k] / n_p, whole(sums[k:k + len(_UPPER[0])]) / n_u,
                     prior * whole(sums[k + len(_UPPER[0]):]) / n_p)

    weights, found = minimum(at, spec)
    if report is not None:
        report.update(found)
    return weights


def scored(codes: DataFrame, weights: np.ndarray | None, prior: float) -> DataFrame:
    """(doc_id, score): the weight of each bin is looked up in an array."""
    if weights is None:
        return codes.select("doc_id", F.lit(float(prior)).alias("score"))
    z: Column = F.lit(float(weights[-1]))
    for i in range(len(FEATURES)):
        bins = F.array(*[F.lit(float(x)) for x in weights[8 * i:8 * i + 8]])
        z = z + bins[F.shiftright("pattern", 3 * i).bitwiseAND(F.lit(7)).cast("int")]
    return codes.select("doc_id", (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias("score"))


def learnt(docs: DataFrame, labels: DataFrame, fitting: Column, spec: PuSpec = PuSpec()) -> tuple[DataFrame, np.ndarray | None, float]:
    """The documents' patterns, and the weights and prior learnt; ``fitting``
    says of a label's ``doc_id`` whether it may be learnt from."""
    codes = materialise(patterns(docs), "pu-codes")
    known = (labels.where(fitting).groupBy(F.col("doc_id").cast("long").alias("p_id"))
             .agg(F.min("quality").alias("q")))
    prior = spec.prior
    if prior is None:
        share = known.agg(F.avg(F.col("q").cast("double"))).first()[0]
        prior = 0.5 if share is None else float(share)
    return codes, fit(codes, known.where("q = 1").select("p_id"), prior, spec), prior


def quality_scores(docs: DataFrame, labels: DataFrame, fitting: Column, spec: PuSpec = PuSpec()) -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    return scored(*learnt(docs, labels, fitting, spec))


def _acceptor(weights: np.ndarray, cutoff: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([pattern(t) for t in texts_of(batch)], np.int64)
            score = 1 / (1 + np.exp(-weights[_slots(codes)].sum(1)))
            yield batch.filter(pa.array(score >= cutoff))
    return run


def accepted(docs: DataFrame, labels: DataFrame, fitting: Column, cutoff: float = 0.5, spec: PuSpec = PuSpec()) -> DataFrame:
    """The rows of ``docs`` that score ``cutoff`` or more.  They are scored
    where they are read, so no text is moved."""
    _, weights, prior = learnt(docs, labels, fitting, spec)
    if weights is None:
        return docs if prior >= cutoff else docs.limit(0)
    return map_arrow(docs, _acceptor(weights, cutoff), docs.schema)


FOLDS, HELD = 3, 1


def op7_quality_pu(spark, sf_dir):
    """Every document scored; labels of fold 1 of 3 are held out."""
    fold = crc_fold("doc_id", FOLDS)
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold != HELD)
    return scores.select("doc_id", (fold == HELD).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
