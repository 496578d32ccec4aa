"""Quality rules with risk-controlled thresholds.

Each rule is a share of a document (symbols, repeated lines, words in repeated
windows, capitals) and rejects documents above a cutoff.  The cutoffs are
chosen per stratum (language) from labelled documents so that, with confidence
1 - ``delta`` over all strata together, the rules reject at most a share
``alpha`` of a stratum's good documents:

* the cutoffs of all rules lie on one path: at step t each rule rejects what
  reaches a share that at most ``t * reach / STEPS`` of the stratum's documents
  reach, labelled or not, so rules and languages of other scales go together
  and no label has a say in the path;
* a step is certified if the exact one-sided binomial (Clopper-Pearson) upper
  bound on the false rejection rate of all rules together is within alpha,
  which is the case if P[Bin(n, alpha) <= k] <= delta';
* steps are tested from the loosest to the strictest until the first failure,
  a fixed sequence that needs no further correction; delta' = ``delta`` /
  strata (Bonferroni);
* the strictest certified step is used; a stratum without one rejects nothing.

A document's place on the path is the step that first rejects it.  Histograms
by (stratum, rule, bin) and of good documents by (stratum, place) are the only
things that meet in a task: at most ``BINS`` + 1 or ``STEPS`` + 1 rows a
group, summed before the exchange.

Defined results: a null text has no words and fails the base; a null language
is a stratum of its own; a document labelled twice counts once, by its lowest
label; a stratum without enough good labels keeps what the base keeps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, map_arrow, materialise, record_batch, table, texts_of
from ..session import ship_package
from .measures import UPPER, lines_and_repeats, repeated_words, share_of, symbols, word_chars, words_of

RULES = ("symbol_share", "dup_line_share", "repeat_share", "upper_share")
BINS = 200
STEPS = 100
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


@dataclass(frozen=True)
class RiskSpec:
    alpha: float = 0.02
    delta: float = 0.05
    reach: float = 0.25  # the strictest step: a share of all documents, per rule


_COUNTS = pa.schema([("doc_id", pa.int64()), ("stratum", pa.string())]
                    + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                    + [(r, pa.float64()) for r in RULES])
_COUNTS_DDL = ("doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
               "n_repeat_words long, " + ", ".join(f"{r} double" for r in RULES))


def _count(text: str) -> tuple:
    raw, words = text.encode("utf-8", "replace"), words_of(text)
    n, chars, symbol = len(words), word_chars(text), symbols(text)
    lines, dup = lines_and_repeats(text)
    repeat = repeated_words(words)
    return (n, chars, symbol, dup, repeat, symbol / max(chars, 1), dup / max(lines, 1), repeat / max(n, 1),
            share_of(raw, UPPER) / max(chars, 1))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(zip(*map(_count, texts_of(batch)))) or [()] * (len(_COUNTS) - 2)
        yield record_batch(_COUNTS, [column(batch, "doc_id"), column(batch, "stratum"), *map(list, rows)])


def counts(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """The counts and rule shares of every whole text."""
    slim = docs.select(F.col("doc_id").cast("long"), F.col(stratum).cast("string").alias("stratum"),
                       F.col("text").cast("string").alias("text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return map_arrow(slim, _count_batches, _COUNTS_DDL).withColumn("base_failed", failed)


def _bin(rule: str):
    return F.ceil(F.col(rule) * BINS).cast("int")


def binomial_cdf_at_most(k: int, n: int, p: float, limit: float) -> bool:
    """Whether P[Bin(n, p) <= k] <= limit, summed exactly in logarithms."""
    if k >= n * p:  # the median is within one of the mean
        return n == 0 and limit >= 1
    i = np.arange(k)
    log_pmf = n * np.log1p(-p) + np.concatenate([[0.0], np.cumsum(np.log((n - i) / (i + 1)) + np.log(p / (1 - p)))])
    top = log_pmf.max()
    return top + np.log(np.exp(log_pmf - top).sum()) <= np.log(limit)


def certified_cutoff(good: np.ndarray, alpha: float, delta: float) -> int | None:
    """``good[b]``: good documents in bin b.  The strictest cutoff bin whose
    rejections (the bins above it) are certified, tested from the loosest."""
    total, above, best = int(good.sum()), 0, None
    for cut in range(len(good) - 1, -1, -1):
        if not binomial_cdf_at_most(above, total, alpha, delta):
            break
        best = cut
        above += int(good[cut])
    return best


def _place(levels: str = "levels"):
    """How strict a path must be to reject a document: 0 never, ``STEPS`` at
    the first step."""
    return F.greatest(F.lit(0), *[F.coalesce(F.try_element_at(F.col(levels), F.concat(F.lit(f"{r}:"), _bin(r).cast("string"))), F.lit(0))
                                  for r in RULES])


def path(stats: DataFrame, spec: RiskSpec = RiskSpec()) -> DataFrame:
    """(c_stratum, levels): for each "rule:bin" the place that it gives."""
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), _bin(r).alias("bin")) for r in RULES])
    hist = (stats.where(~F.col("base_failed")).select("stratum", F.explode(pairs).alias("p"))
            .groupBy("stratum", "p.rule", "p.bin").agg(F.count("*").alias("n")))
    rule = Window.partitionBy("stratum", "rule")
    reached = F.sum("n").over(rule.orderBy(F.desc("bin"))) / F.sum("n").over(rule)
    place = F.lit(STEPS + 1) - F.ceil(reached * STEPS / spec.reach).cast("int")
    placed = hist.withColumn("place", place).where("place > 0")
    entry = F.struct(F.concat_ws(":", "rule", F.col("bin").cast("string")), "place")
    return placed.groupBy(F.col("stratum").alias("c_stratum")).agg(F.map_from_entries(F.collect_list(entry)).alias("levels"))


def cutoffs(stats: DataFrame, labels: DataFrame, spec: RiskSpec = RiskSpec()) -> DataFrame:
    """(c_stratum, n_good, cutoff, levels): documents whose place is above the
    certified cutoff are rejected; null if none is certified."""
    good = (labels.groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.min("quality").alias("q"))
            .where("q = 1").select("l_id"))
    levels = materialise(path(stats, spec), "rule-path")
    held = stats.where(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("l_id"), "left_semi")
    held = held.join(levels, F.col("stratum").eqNullSafe(F.col("c_stratum")), "left")
    hist = materialise(held.select("stratum", _place().alias("place")).groupBy("stratum", "place").agg(F.count("*").alias("n")),
                       "rule-histogram")
    delta = spec.delta / max(1, hist.select("stratum").distinct().count())

    ship_package(stats.sparkSession)

    def certify(pdf: pd.DataFrame) -> pd.DataFrame:
        hist = np.bincount(pdf["place"], weights=pdf["n"], minlength=STEPS + 1).astype(np.int64)
        return pd.DataFrame({"stratum": pdf["stratum"].iloc[:1], "n_good": [hist.sum()],
                             "cutoff": pd.array([certified_cutoff(hist, spec.alpha, delta)], dtype="Int32")})

    certified = hist.groupBy("stratum").applyInPandas(certify, "stratum string, n_good long, cutoff int")
    return (levels.join(certified, F.col("c_stratum").eqNullSafe(F.col("stratum")), "left")
            .select("c_stratum", F.coalesce("n_good", F.lit(0)).alias("n_good"), "cutoff", "levels"))


def verdicts(stats: DataFrame, cuts: DataFrame) -> DataFrame:
    """``stats`` with ``kept``: neither the base nor a certified step rejects."""
    cuts = materialise(cuts.select("c_stratum", "cutoff", "levels"), "rule-cutoffs")
    over = F.coalesce(_place() > F.col("cutoff"), F.lit(False))
    return (stats.join(cuts, F.col("stratum").eqNullSafe(F.col("c_stratum")), "left")
            .withColumn("kept", ~F.col("base_failed") & ~over).drop("c_stratum", "cutoff", "levels"))


def op9_risk_rules(spark, sf_dir):
    """Every document judged by cutoffs that reject at most 2 % of a language's
    good documents with 95 % confidence."""
    stats = materialise(counts(table(spark, sf_dir, "documents")), "rule-counts")
    return verdicts(stats, cutoffs(stats, table(spark, sf_dir, "labels"))).drop("stratum")
