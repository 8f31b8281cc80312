"""Toxicity by a classifier chain of linear models.

The categories have an order. The model of each is a logistic regression on the presence of words
and on the probabilities that the models before it give. In training those probabilities are out of
fold: every row's come from models that have not seen it, so a later model learns how far it may
trust an earlier one. For use, each model is then fitted on all rows.

Fitting takes at most ``max_rows`` labelled rows, those with the smallest hash of their id, whatever
the size of the corpus; it runs in one task on the distinct words of those rows. Scoring covers whole
texts of all rows, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bound on labelled rows, on the words that a model may use, and on folds.
MAX_ROWS, MAX_WORDS, FOLDS = 8_000, 3_000, 5
_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


class Rows:
    """A sparse 0/1 matrix by rows, with further dense columns."""

    def __init__(self, words: list[list[int]], width: int):
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.at = np.array([i for w in words for i in w], np.int64)
        self.row = np.repeat(np.arange(len(words)), self.sizes)
        self.n, self.width = len(words), width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=r[self.row], minlength=self.width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: Rows, dense: np.ndarray, y: np.ndarray, use: np.ndarray, steps: int = 60, l2: float = 1.0) -> np.ndarray:
    """Weights of words, dense columns and constant, by limited-memory quasi-Newton steps on rows ``use``."""
    k = x.width + dense.shape[1] + 1
    rate = y[use].mean() if use.any() else 0.0
    w = np.zeros(k)
    w[-1] = np.log((rate + 1e-6) / (1 - rate + 1e-6))
    if rate in (0.0, 1.0):
        return w
    penalty = np.full(k, l2)
    penalty[-1] = 0

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.clip(x.times(w[: x.width]) + dense @ w[x.width : -1] + w[-1], -500, 500)
        r = np.where(use, _sigmoid(z) - y, 0.0)
        value = np.logaddexp(0, z)[use].sum() - (z * y)[use].sum() + 0.5 * (penalty * w * w).sum()
        return value, np.concatenate((x.back(r), dense.T @ r, [r.sum()])) + penalty * w

    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        way, kept = grad.copy(), []
        for s, d, rho in reversed(past):
            kept.append(rho * (s @ way))
            way -= kept[-1] * d
        way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(grad).sum())
        for (s, d, rho), alpha in zip(past, reversed(kept)):
            way += (alpha - rho * (d @ way)) * s
        size, slope = 1.0, grad @ way
        while True:
            new_value, new_grad = loss(w - size * way)
            if new_value <= value - 1e-4 * size * slope or size < 1e-8:
                break
            size /= 2
        s, d = -size * way, new_grad - grad
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        w, value, grad = w + s, new_value, new_grad
        if s @ d > 1e-12:
            past = [*past[-9:], (s, d, 1 / (s @ d))]
        if done:
            break
    return w


@dataclass
class Chain:
    """A fitted chain. ``weights[j]``: words, probabilities of categories before, constant."""

    categories: list[str]
    vocabulary: dict[str, int]
    weights: list[np.ndarray]
    thresholds: list[float]

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """One row for each text, one column for each category."""
        vocabulary, width = self.vocabulary, len(self.vocabulary)
        known = vocabulary.keys()
        x = Rows([[vocabulary[w] for w in tokens(t) & known] for t in texts], width)
        out = np.zeros((len(texts), 0))
        for w in self.weights:
            p = _sigmoid(x.times(w[:width]) + out @ w[width:-1] + w[-1])
            out = np.column_stack((out, p))
        return out


def fit_chain(words: list[set[str]], labels: np.ndarray, folds: np.ndarray, categories: list[str], max_words: int) -> Chain:
    """``labels`` has a column for each category. A category without positive rows, or with nothing
    else, gets a constant; a threshold is the one of the best F1 out of fold, 0.5 at least."""
    total, hits = Counter(), Counter()
    for own, positive in zip(words, labels.any(1)):
        total.update(own)
        if positive:
            hits.update(own)
    n, n_hits = len(words), int(labels.any(1).sum())
    share = n_hits / max(n, 1)
    chance = {
        w: abs(hits[w] - c * share) / np.sqrt(c * share * (1 - share) + 1e-9) for w, c in total.items() if c >= 4
    }
    chosen = sorted((w for w in chance if chance[w] >= 3), key=lambda w: (-chance[w], w))[:max_words]
    vocabulary = {w: i for i, w in enumerate(sorted(chosen))}
    known = vocabulary.keys()
    x = Rows([[vocabulary[w] for w in own & known] for own in words], len(vocabulary))
    weights, thresholds = [], []
    earlier = np.zeros((n, 0))
    for j in range(len(categories)):
        y = labels[:, j].astype(float)
        held_out = np.zeros(n)
        for fold in np.unique(folds):
            out = folds == fold
            w = fit_logistic(x, earlier, y, ~out)
            z = x.times(w[: x.width]) + earlier @ w[x.width : -1] + w[-1]
            held_out[out] = _sigmoid(z)[out]
        weights.append(fit_logistic(x, earlier, y, np.ones(n, bool)))
        order = np.argsort(-held_out, kind="stable")
        right = np.cumsum(y[order])
        f1 = 2 * right / (np.arange(1, n + 1) + y.sum()) if n else np.zeros(0)
        best = float(held_out[order[int(f1.argmax())]]) if y.any() else 1.0
        thresholds.append(max(0.5, best))
        earlier = np.column_stack((earlier, held_out))
    return Chain(categories, vocabulary, weights, thresholds)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS, folds: int = FOLDS) -> Chain:
    """Fit a chain on ``docs`` (``doc_id``, ``text``) that have a row in ``labels``.

    ``categories``: name to a condition on the columns of ``labels`` and ``text``, in chain order;
    null counts as false. A repeated ``doc_id`` is positive if any of its rows is.
    """
    row = F.col("doc_id").cast("long")
    ids = labels.filter(row.isNotNull()).select(row.alias("doc_id")).distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows ids of 8 bytes.
    wanted = labels.withColumn("doc_id", row).join(F.broadcast(ids), "doc_id", "left_semi")
    plain = docs.select(row.alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = plain.join(F.broadcast(ids), "doc_id", "left_semi")
    names = list(categories)
    marks = [F.coalesce(c, F.lit(False)).cast("int").alias(f"c{i}") for i, c in enumerate(categories.values())]

    extra = [c for c in wanted.columns if c.lower() != "text"]
    joined = rows.join(wanted.select(extra), "doc_id").select("doc_id", "text", *marks)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        own = part.sort_values(["doc_id", "words"])
        chain = fit_chain(
            [set(w.split(" ")) - {""} for w in own["words"]],
            own[[f"c{i}" for i in range(len(names))]].to_numpy(bool),
            own["fold"].to_numpy(),
            names,
            max_words,
        )
        words = [" ".join(chain.vocabulary)] * len(names)
        return pd.DataFrame({"j": range(len(names)), "words": words, "weights": list(chain.weights), "threshold": chain.thresholds})

    @F.pandas_udf("string")
    def distinct_words(text: pd.Series) -> pd.Series:
        return text.map(lambda t: " ".join(sorted(tokens(t or ""))))

    prepared = (
        joined.groupBy("doc_id", "text").agg(*(F.max(f"c{i}").alias(f"c{i}") for i in range(len(names))))
        .select(
            "doc_id",
            distinct_words("text").alias("words"),
            F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds)).cast("int").alias("fold"),
            *(f"c{i}" for i in range(len(names))),
        )
    )
    schema = "j int, words string, weights array<double>, threshold double"
    model = sorted(prepared.groupBy(F.lit(1).alias("all")).applyInPandas(fit, schema).collect())
    if not model:
        never = np.array([-30.0])
        weights = [np.concatenate((np.zeros(i), never)) for i in range(len(names))]
        return Chain(names, {}, weights, [1.0] * len(names))
    vocabulary = {w: i for i, w in enumerate(filter(None, model[0]["words"].split(" ")))}
    return Chain(names, vocabulary, [np.array(m["weights"]) for m in model], [m["threshold"] for m in model])


def score(chain: Chain, text: Column) -> Column:
    """An array with the probability of each category; a null text counts as empty."""

    @F.pandas_udf("array<double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            out = [
                row
                for at in range(0, len(part), 1024)
                for row in chain.probabilities([t or "" for t in part.iloc[at : at + 1024]])
            ]
            yield pd.Series(out)

    return scored(text.cast("string"))
