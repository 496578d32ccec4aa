"""Toxicity of text restored by noisy-channel decoding.

Writers hide words by signs that look like letters (leetspeak), by spacing
them out and by repeating letters.  Decoding undoes that:

1. A trigram model of characters is counted over the whole corpus.
2. Every token, of whatever length, that holds a sign like a letter, a
   separator between letters or a repeated character becomes a lattice: each
   sign stands for itself or for the letters it resembles, at an edge for
   these or for nothing, each repeated character may be dropped, each
   separator between letters may be dropped.  Viterbi finds the path of least
   cost, channel plus language model, over states of two characters.  Runs of
   single-character tokens are one lattice; the last may carry punctuation
   behind it, the first before it.  All other tokens have one path only, which
   is the token itself.
3. The restored words are scored by a logistic regression over counts of
   words and word beginnings, those ``features`` that best tell toxic from
   clean documents by their likelihood ratio.

Fitting uses at most ``fit_rows`` labelled documents of the fitting folds (a
third of them toxic if there are as many; rows are weighted back to the
classes' true sizes).  Which are taken depends on a hash of the id.  The
language model and the scores cover every document and whole texts.

Defined results: a null or empty text has no words and gets the score of
that; a token without a letter is a number or a row of signs unless its
likeliest reading is of letters only, and none of its signs is dropped; a word
does not fall below three letters by dropping repeats, as shorter ones have no
features; labels of unknown documents are ignored, and a document labelled twice counts
once, by its highest label; with one class only, the score is its share (0.5
without labels); other columns are never read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, crc_fold, map_arrow, materialise, record_batch, table, texts_of

#: Characters of the model: 1 to 26 letters, boundary, other letter, sign.
BOUNDARY, OTHER, SIGN, SYMBOLS = 0, 27, 28, 32
#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
SEPARATORS = " .-_*"
#: A sign between lone letters is dropped freely, and ends a word at a cost.
LEET_COST, DROP_REPEAT_COST, KEEP_SEPARATOR_COST = 1.5, 0.3, 5.0
#: A sign at an edge that is no letter; a tail of three and more is junk.
EDGE_COST, JUNK_TAIL_COST = {"!": 8.0, "$": 12.0}, 0.3
#: Longer tokens are decoded each time, not remembered.
LONGEST = 64
_EDGE = ".,;:?\"'()[]{}<>%&*#~!"
_PLAIN_EDGE = _EDGE.replace("!", "")
_LETTER = re.compile(r"[^\W\d_]")
_LEET_EDGE = "@$!|+"
_SAME = re.compile(r"(.)\1*+", re.S)
_DISGUISED = re.compile(r"[0-9@$!|+]|(.)\1|[^\W\d_][._*-]+[^\W\d_]", re.S)
#: Tokens of a spaced word: lone characters, the first after and the last
#: before punctuation, or each before punctuation.
_SPACED = re.compile("[1(]1+[1)]|\\){3,}|b{3,}")
#: Lone letters, or signs like letters, with other signs between them.
_LONE = re.compile(r"(?:[^\W_]|[@$!|+])(?:[^\w\s@$!|+]+(?:[^\W_]|[@$!|+])){2,}")
_BETWEEN = re.compile(r"[^\w\s@$!|+]+")


@dataclass(frozen=True)
class ToxicSpec:
    fit_rows: int = 12_000
    features: int = 512
    ridge: float = 0.3


def _symbol(c: str) -> int:
    base = unicodedata.normalize("NFD", c.lower())[:1]
    if "a" <= base <= "z":
        return ord(base) - 96
    return BOUNDARY if c.isspace() else OTHER if c.isalpha() else SIGN


def _symbol_table(size: int = 0x250) -> np.ndarray:
    return np.array([_symbol(chr(c)) for c in range(size)] + [OTHER], np.int64)


_COUNTED = pa.schema([("gram", pa.int32()), ("n", pa.int64())])


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbols = _symbol_table()
    total = np.zeros(SYMBOLS ** 3, np.int64)
    for batch in batches:
        text = "\n\n".join(["", *texts_of(batch), ""])
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        s = symbols[np.minimum(codes, len(symbols) - 1)]
        total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(total))
    seen = np.flatnonzero(total)
    yield record_batch(_COUNTED, [pa.array(seen.astype(np.int32)), total[seen]])


def character_model(docs: DataFrame) -> np.ndarray:
    """Costs (negative logarithms of probability) of a character after two
    others, from the trigrams of all whole texts."""
    slim = docs.select(F.col("text").cast("string").alias("text"))
    rows = map_arrow(slim, _gram_batches, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS ** 3)
    for r in rows:  # at most one row for each possible trigram
        counts[r.gram] = r.n
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None]) / (three.sum(2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


def viterbi(seen: str, costs: list, edges: dict[int, float] | None = None, repeats: bool = True) -> str:
    """The likeliest text behind ``seen`` (lower case).  ``edges``: costs of
    dropping the signs at these places, which else are letters; without
    ``repeats``, repeated characters stay."""
    paths = {(BOUNDARY, BOUNDARY): (0.0, None)}
    before = ""
    for i, c in enumerate(seen):
        at_edge = edges and i in edges
        steps = [("", None, edges[i])] if at_edge else [(c, _symbol(c), 0.0)]
        if c in LEET:
            steps += [(x, ord(x) - 96, LEET_COST) for x in LEET[c]]
        if c in SEPARATORS:
            steps = [(" ", BOUNDARY, KEEP_SEPARATOR_COST), ("", None, 0.0)]
        elif c == before and repeats and not at_edge:
            steps.append(("", None, DROP_REPEAT_COST))
        new: dict = {}
        for state, (cost, path) in paths.items():
            row = costs[state[0]][state[1]]
            for out, symbol, channel in steps:
                if symbol is None:
                    to, total, way = state, cost + channel, path
                else:
                    to, total, way = (state[1], symbol), cost + channel + row[symbol], (path, out)
                if to not in new or total < new[to][0]:
                    new[to] = (total, way)
        paths, before = new, c
    path = min((cost + costs[a][b][BOUNDARY], i, path) for i, ((a, b), (cost, path)) in enumerate(paths.items()))[2]
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


def edge_costs(word: str) -> dict[int, float]:
    """Place and cost of dropping, of the signs like letters at both edges."""
    head = len(word) - len(word.lstrip(_LEET_EDGE))
    costs = {i: EDGE_COST.get(word[i], 4.0) for i in range(head)}
    for run in _SAME.finditer(word, len(word.rstrip(_LEET_EDGE))):
        cost = 0.0 if run[1] == "!" else JUNK_TAIL_COST if len(run[0]) > 2 else EDGE_COST.get(run[1], 4.0)
        costs.update(dict.fromkeys(range(run.start(), run.end()), cost))
    return costs


def _place(token: str) -> str:
    """1 for a lone character, ( and ) for one after or before punctuation, b
    for one between."""
    if len(token) == 1:
        return "1"
    opens, closes = token[0] in _EDGE, token[-1] in _EDGE
    if closes and len(token.rstrip(_EDGE)) == 1:
        return ")"
    if opens and len(token.lstrip(_EDGE)) == 1:
        return "("
    return "b" if opens and closes and len(token.strip(_EDGE)) == 1 else "0"


class _Places(dict):
    """``_place`` of tokens, remembered."""

    def __missing__(self, token: str) -> str:
        place = _place(token)
        if len(token) <= LONGEST:
            self[token] = place
        return place


class Restorer:
    """Restored words of a text; remembers at most ``limit`` tokens."""

    def __init__(self, costs: np.ndarray, limit: int = 300_000):
        self.costs, self.limit, self.known, self.places = costs.tolist(), limit, {}, _Places()

    def token(self, token: str) -> list[str]:
        word = token.lower().strip(_PLAIN_EDGE)
        if not word.isalpha() and _LONE.fullmatch(word) and _LETTER.search(word):
            word = _BETWEEN.sub(".", word)
        if not _DISGUISED.search(word):
            return [word.strip(_EDGE)]
        if not _LETTER.search(word):
            read = viterbi(word, self.costs, repeats=False)
            return [read] if read.isalpha() else [word.strip(_EDGE)]
        edges = edge_costs(word)
        words = viterbi(word, self.costs, edges).split()
        if len("".join(words)) < 3 <= len(word):
            words = viterbi(word, self.costs, edges, repeats=False).split()
        return [w.strip(_EDGE) for w in words]

    def words(self, text: str) -> list[str]:
        tokens, out = text.split(), []
        if len(self.known) > self.limit:
            self.known, self.places = {}, _Places()
        single = "".join(map(self.places.__getitem__, tokens))
        at = 0
        for run in _SPACED.finditer(single):
            out += self._plain(tokens[at:run.start()])
            # Whatever stands before and after does not matter: it is cut off
            # by tokens of two characters and more.
            word = " ".join([t if len(t) == 1 else t.strip(_PLAIN_EDGE) for t in tokens[run.start():run.end()]]).lower()
            out += [w.strip(_EDGE) or w for w in viterbi(word, self.costs, edge_costs(word) if _LETTER.search(word) else None).split()]
            at = run.end()
        return out + self._plain(tokens[at:])

    def _plain(self, tokens: list[str]) -> list[str]:
        known = self.known
        for t in set(tokens).difference(known):
            if len(t) <= LONGEST:
                known[t] = self.token(t)
        return [w for t in tokens for w in (known[t] if len(t) <= LONGEST else self.token(t))]


def beginnings(word: str) -> list[str]:
    """The features of one word: itself, and its first three to seven letters."""
    return ["=" + word, *[word[:k] for k in range(3, min(8, len(word) + 1))]] if len(word) > 2 else []


_FREQUENCY = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])


def _frequency_batches(costs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, found = Restorer(costs), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(texts_of(batch), column(batch, "toxic").to_pylist()):
                found[toxic].update({f for w in set(restorer.words(text)) for f in beginnings(w)})
        names = list(found[0].keys() | found[1].keys())
        yield record_batch(_FREQUENCY, [names, [found[1][f] for f in names], [found[0][f] for f in names]])
    return run


def best_features(sample: DataFrame, costs: np.ndarray, sizes: tuple[int, int], top: int) -> list[str]:
    """The ``top`` features more frequent in toxic documents, by likelihood ratio."""
    clean, toxic = (float(s) for s in sizes)
    a, b, n = F.col("toxic"), F.col("clean"), clean + toxic

    def term(seen: Column, size: float) -> Column:
        p = (a + b) / n
        def half(observed: Column, expected: Column) -> Column:
            return F.when(observed > 0, observed * F.log(F.try_divide(observed, expected))).otherwise(0.0)
        return half(seen, p * size) + half(F.lit(size) - seen, (1 - p) * size)
    ratio = term(a, toxic) + term(b, clean)
    rows = (map_arrow(sample.select("text", "toxic"), _frequency_batches(costs), "feature string, toxic long, clean long")
            .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .where((a >= 3) & (a * F.lit(clean) > b * F.lit(toxic)))
            .orderBy(ratio.desc(), "feature").limit(top).collect())
    return [r.feature for r in rows]


class Scorer:
    """Feature counts of texts; remembers the features of words."""

    def __init__(self, costs: np.ndarray, features: list[str], limit: int = 300_000):
        self.restorer, self.limit, self.known = Restorer(costs), limit, {}
        self.place = {f: i for i, f in enumerate(features)}

    def counts(self, text: str) -> tuple[Counter, int]:
        words = self.restorer.words(text)
        if len(self.known) > self.limit:
            self.known = {}
        known, place = self.known, self.place
        for w in set(words).difference(known):
            known[w] = [i for f in beginnings(w) if (i := place.get(f)) is not None]
        return Counter([i for w in words for i in known[w]]), len(words)


_ROWS = pa.schema([("toxic", pa.int32()), ("n_words", pa.int32()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])


def _row_batches(costs: np.ndarray, features: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(costs, features)
        for batch in batches:
            found = [scorer.counts(t) for t in texts_of(batch)]
            yield record_batch(_ROWS, [column(batch, "toxic"), [n for _, n in found],
                                       [list(c.keys()) for c, _ in found], [list(c.values()) for c, _ in found]])
    return run


def regression(sample: DataFrame, costs: np.ndarray, features: list[str], sizes: tuple[int, int], ridge: float) -> np.ndarray:
    """Weights of the features, the document's length and the bias, by Newton
    steps on the bounded sample."""
    rows = map_arrow(sample.select("text", "toxic"), _row_batches(costs, features),
                     "toxic int, n_words int, at array<int>, n array<int>").collect()
    if not rows:  # no labelled document is there
        return np.array([0.0] * (len(features) + 1) + [np.log(sizes[1] / sizes[0])])
    x = np.zeros((len(rows), len(features) + 2))
    y = np.array([r.toxic for r in rows], float)
    for i, r in enumerate(rows):
        x[i, r.at] = np.log1p(r.n)
        x[i, -2:] = log1p(r.n_words) / 5, 1
    of = y.sum()
    weight = np.where(y == 1, sizes[1] / max(of, 1), sizes[0] / max(len(y) - of, 1))
    weight *= len(y) / weight.sum()
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _score_batches(costs: np.ndarray, features: list[str], weights: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(costs, features)
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for k, text in enumerate(texts_of(batch)):
                found, n = scorer.counts(text)
                z[k] = sum(weights[i] * log1p(c) for i, c in found.items()) + weights[-2] * log1p(n) / 5 + weights[-1]
            yield record_batch(_SCORES, [column(batch, "doc_id"), 1 / (1 + np.exp(-z))])
    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, fitting: Column, spec: ToxicSpec = ToxicSpec()) -> DataFrame:
    """(doc_id, score) for every row of ``docs``; ``fitting`` says of a label's
    ``doc_id`` whether it may be learnt from."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    known = materialise(labels.where(fitting).groupBy(F.col("doc_id").cast("long").alias("l_id"))
                        .agg(F.max("toxic").cast("int").alias("toxic")).where("toxic is not null"), "toxic-labels")
    by_class = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    sizes = by_class.get(0, 0), by_class.get(1, 0)
    if not all(sizes):  # nothing to tell apart
        share = sizes[1] / sum(sizes) if any(sizes) else 0.5
        return texts.select("doc_id", F.lit(share).alias("score"))
    n_toxic = min(sizes[1], spec.fit_rows // 3)
    taken = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("l_id"), "l_id").limit(n)
             for c, n in ((1, n_toxic), (0, spec.fit_rows - n_toxic))]
    picked = taken[0].unionByName(taken[1])  # at most fit_rows rows
    sample = materialise(texts.join(F.broadcast(picked), F.col("doc_id") == F.col("l_id"))
                         .select("text", "toxic"), "toxic-sample")
    costs = character_model(docs)
    features = best_features(sample, costs, sizes, spec.features)
    weights = regression(sample, costs, features, sizes, spec.ridge)
    return map_arrow(texts, _score_batches(costs, features, weights.tolist()), "doc_id long, score double")


FOLDS, HELD = 4, 2


def op1_toxicity_viterbi(spark, sf_dir):
    """Every document scored; labels of fold 2 of 4 are held out."""
    fold = crc_fold("doc_id", FOLDS)
    scores = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold != HELD)
    return scores.select("doc_id", (fold == HELD).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))
