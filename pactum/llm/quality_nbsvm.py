"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams of three streams of a text: bytes (orders 1 to 3), byte
shapes (letters to a/A, digits to 0; orders 1 to 4), hashed to 2^16 places, and, for each word,
whether it equals the one before it (the n-grams of orders 1, 2, 4 and 8 that are all equal). Each indicator is scaled by the log-count ratio
of the classes, and a linear hinge-loss model is fitted on the scaled indicators by dual
coordinate descent; a logistic curve on the margins of the training rows gives the score.

Training works on a bounded sample (``PER_CLASS`` rows of a class). Scoring covers the whole of
every text. Defined results: null and empty texts have no indicator but the bias, and so the
score of the bias; without rows of both classes every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm import sampling

PER_CLASS = 2500
BITS = 16
_SIZE = (1 << BITS) + 8  # the last places: runs of a word, and the bias
_MULT = np.uint32(0x9E3779B1)


def _shapes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[97:123], table[65:91], table[48:58], table[128:] = 97, 65, 48, 97
    return table


_SHAPE = _shapes()


def _ngrams(raw: np.ndarray, orders: int, salt: int) -> Iterator[np.ndarray]:
    key = np.full(len(raw), salt, dtype=np.uint32)
    for n in range(orders):
        if len(raw) <= n:
            return
        key = (key[: len(raw) - n] << np.uint32(8 if n else 0)) ^ raw[n:].astype(np.uint32) if n else raw.astype(np.uint32)
        yield ((key + np.uint32((salt * 8 + n) * 0x01000193)) * _MULT) >> np.uint32(32 - BITS)


def indicators(text: str | None, seen: np.ndarray | None = None) -> np.ndarray:
    """Places of the n-grams of a text, each once. seen: a scratch array of _SIZE zeros, given back zeroed."""
    seen = np.zeros(_SIZE, bool) if seen is None else seen
    if text:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        for keys in _ngrams(raw, 3, 1):
            seen[keys] = True
        for keys in _ngrams(_SHAPE[raw], 4, 2):
            seen[keys] = True
        words = text.split()
        most = max((sum(1 for _ in g) for same, g in groupby(map(str.__eq__, words, words[1:])) if same), default=0)
        for i, run in enumerate((1, 2, 4, 8)):
            seen[(1 << BITS) + i] = most >= run
    seen[_SIZE - 1] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


@dataclass
class Model:
    weights: np.ndarray
    slope: float
    offset: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        seen = np.zeros(_SIZE, bool)
        margin = np.array([self.weights[indicators(t, seen)].sum() for t in texts], dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float = 0.1, epochs: int = 12, seed: int = 5) -> np.ndarray:
    """w of min |w|^2/2 + cost * sum of hinge losses, over rows of scaled indicators; y is -1 or 1."""
    w, alpha = np.zeros(len(scale)), np.zeros(len(rows))
    values = [scale[r] for r in rows]
    norm = np.array([v @ v for v in values]) + 1e-12
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gap = y[i] * (w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - gap / norm[i], 0.0), cost)
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4 * cost:
            break
    return w


def fit(texts: list[str], good: np.ndarray, smooth: float = 1.0, blend: float = 0.25) -> Model:
    """good: 0/1. The final weights are the hinge model's, blended with their mean magnitude."""
    good = np.asarray(good, dtype=np.int64)
    if not len(good) or good.all() or not good.any():
        return Model(np.zeros(_SIZE), 0.0, 0.0)
    seen = np.zeros(_SIZE, bool)
    rows = [indicators(t, seen) for t in texts]
    counts = np.zeros((2, _SIZE))
    for r, y in zip(rows, good.tolist(), strict=True):
        counts[y, r] += 1
    p, q = counts[1] + smooth, counts[0] + smooth
    ratio = np.log((p / (good.sum() + 2 * smooth)) / (q / ((1 - good).sum() + 2 * smooth)))
    ratio[-1] = 1.0
    w = dual_coordinate_descent(rows, ratio, np.where(good == 1, 1.0, -1.0))
    w = (1 - blend) * np.abs(w).mean() + blend * w
    weights = w * ratio
    margin = np.array([weights[r].sum() for r in rows])
    spread = margin.std() or 1.0
    x, coef = np.stack([margin / spread, np.ones(len(rows))], axis=1), np.zeros(2)
    for _ in range(50):
        e = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        h = (x * (e * (1 - e) + 1e-6)[:, None]).T @ x + 0.1 * np.eye(2)
        coef += np.linalg.solve(h, x.T @ (good - e) - 0.1 * coef)
    return Model(weights, float(coef[0] / spread), float(coef[1]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Fit on a bounded sample of labelled documents. labels: (doc_id, label 0/1), training rows only."""
    got = sampling.collect(sampling.per_class(labels, "doc_id", label, per_class, classes=2), docs, per_class)
    return fit(got["text"].tolist(), (got["label"] == "1").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for documents (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()))

    return docs.select("doc_id", scored(F.col("text").cast("string")).alias("score"))
