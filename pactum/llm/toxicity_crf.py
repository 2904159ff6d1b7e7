"""Toxicity: a linear-chain conditional random field tags toxic tokens.

Training works on a bounded sample of labelled documents (``POSITIVE`` and ``NEGATIVE`` rows).
Labelled tokens come from the document labels: a token of a toxic document is labelled toxic
if its word, or a prefix of it, stands in many distinct contexts (neighbouring words) of
toxic documents and in hardly any of clean ones; contexts, not occurrences, so that copies
of one document don't make its words toxic. Tokens of clean documents are not toxic. The field
has hashed features of a word (itself, prefixes, suffix) and of its neighbours, a bias
and label transitions, and is fitted by gradient ascent on the exact log-likelihood.

Scoring runs forward-backward over the whole chain of every text. Segments of ``SEGMENT``
tokens are columns of a matrix; messages at their ends go on into the next segment and the one
before, until no message moves by ``SETTLED``, so marginals are those of the uncut chain. A document's score is a logistic function of its largest marginal
log-odds and of the log of its expected number of toxic tokens, fitted on the same sample;
tokens with a marginal of at least ``SPAN`` give the offending offsets (code points).

Defined results: null, empty and blank texts have no tokens, score as low as a document can
and no spans; without a labelled row of both classes every score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm import sampling
from pactum.llm.common import in_parts

POSITIVE, NEGATIVE = 1500, 4500
SEGMENT, SPAN = 64, 0.5
SETTLED = 1e-7
BITS = 18
REMEMBER = 300_000
_FLOOR = -30.0
_STRIP = "\"'`.,;:!?()[]{}<>*_-#$%&|/\\~+=“”‘’«»¿¡…"


def normal(word: str) -> str:
    return word.lower().strip(_STRIP)


def _features(word: str) -> list[int]:
    """Hashed features of a word itself, then as the word before and as the word after."""
    raw = word.encode("utf-8", "surrogatepass")
    parts = [raw, word[:3].encode("utf-8", "surrogatepass"), word[:4].encode("utf-8", "surrogatepass"), word[:5].encode("utf-8", "surrogatepass"), word[-3:].encode("utf-8", "surrogatepass"), raw, raw]
    return [zlib.crc32(p, 0x9E37 * (i + 1)) >> (32 - BITS) for i, p in enumerate(parts)]


OWN, BEFORE, AFTER = slice(0, 5), 5, 6


@dataclass
class Field:
    """Parameters; all log-odds of toxic against not."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray  # 2 x 2
    document: np.ndarray  # constant, largest log-odds, log of the expected count


def _seg(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emissions of documents as a matrix of segments, its mask, and the flat place of its cells."""
    ends = np.cumsum(counts)
    pieces = -(-counts // SEGMENT)
    first = np.repeat(ends - counts, pieces)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = first + nth * SEGMENT
    length = np.minimum(SEGMENT, np.repeat(ends, pieces) - start)
    mask = np.arange(SEGMENT) < length[:, None]
    place = np.minimum(start[:, None] + np.arange(SEGMENT), max(0, len(flat) - 1))
    return flat[place].T.copy(), mask.T.copy(), place.T


def _step(x: np.ndarray, zero_zero: float, zero_one: float, one_zero: float, one_one: float) -> np.ndarray:
    """log((e^zero_one + e^(one_one + x)) / (e^zero_zero + e^(one_zero + x)))."""
    e = np.exp(np.minimum(x, 30))
    return np.log((np.exp(zero_one) + np.exp(one_one) * e) / (np.exp(zero_zero) + np.exp(one_zero) * e))


def forward_backward(e: np.ndarray, mask: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of forward and backward sums, by position (rows) and segment (columns)."""
    (m00, m01), (m10, m11) = moves
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = e[0]
    for t in range(1, len(e)):
        a[t] = e[t] + _step(a[t - 1], m00, m01, m10, m11)
    for t in range(len(e) - 2, -1, -1):
        b[t] = np.where(mask[t + 1], _step(e[t + 1] + b[t + 1], m00, m10, m01, m11), 0)
    return a, b


def chained(e: np.ndarray, mask: np.ndarray, moves: np.ndarray, goes_on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``forward_backward`` over chains that span columns; goes_on: columns that go on with the chain of the one before.

    What a message changes fades from position to position, so each round works on a few rows
    only; a round that reaches the end of a segment is followed by one for the segments after.
    """
    (m00, m01), (m10, m11) = moves
    a, b = forward_backward(e, mask, moves)
    later = np.flatnonzero(goes_on)
    while len(later):
        x, moved = a[-1, later - 1], np.ones(len(later), bool)
        for t in range(len(e)):
            x = e[t, later] + _step(x, m00, m01, m10, m11)
            moved = (np.abs(x - a[t, later]) > SETTLED) & mask[t, later]
            a[t, later] = x
            if not moved.any():
                break
        later = np.intersect1d(later[moved] + 1, np.flatnonzero(goes_on))
    earlier = np.flatnonzero(goes_on) - 1
    while len(earlier):
        x, moved = _step(e[0, earlier + 1] + b[0, earlier + 1], m00, m10, m01, m11), np.ones(len(earlier), bool)
        for t in range(len(e) - 1, -1, -1):
            moved = np.abs(x - b[t, earlier]) > SETTLED
            b[t, earlier] = x
            if not moved.any():
                break
            if t:
                x = _step(e[t, earlier] + x, m00, m10, m01, m11)
        earlier = np.intersect1d(earlier[moved] - 1, np.flatnonzero(goes_on) - 1)
    return a, b


class Tagger:
    """Scores texts; remembers the features of words it has met."""

    def __init__(self, field: Field):
        self.field = field
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.empty((0, 3), np.float32)

    def emissions(self, words: list[list[str]], counts: np.ndarray) -> np.ndarray:
        if len(self.known) > REMEMBER:
            self._forget()
        new = list(set().union(*words).difference(self.known))
        if new:
            ids = np.array([_features(normal(w)) for w in new])
            w = self.field.weights
            self.rows = np.concatenate([self.rows, np.stack([w[ids[:, OWN]].sum(axis=1), w[ids[:, BEFORE]], w[ids[:, AFTER]]], axis=1).astype(np.float32)])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        get = self.known.__getitem__
        index = np.fromiter((get(w) for ws in words for w in ws), np.int64, int(counts.sum()))
        own, before, after = self.rows[index].T
        e = own + np.float32(self.field.bias)
        inner = np.ones(len(index), bool)
        inner[(np.cumsum(counts) - counts)[counts > 0]] = False
        e[1:] += before[:-1] * inner[1:]
        e[:-1] += after[1:] * inner[1:]
        return e

    def marginals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of every token, flat, and the number of tokens of each text."""
        words = [t.split() if t else [] for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        if not counts.sum():
            return np.empty(0, np.float32), counts
        e, mask, place = _seg(self.emissions(words, counts), counts)
        pieces = -(-counts // SEGMENT)
        goes_on = np.ones(mask.shape[1], bool)
        goes_on[(np.cumsum(pieces) - pieces)[counts > 0]] = False
        a, b = chained(e, mask, self.field.moves, goes_on)
        odds = np.empty(int(counts.sum()), np.float32)
        odds[place[mask]] = (a + b)[mask]
        return odds, counts

    def documents(self, odds: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Rows (1, largest log-odds, log of the expected count)."""
        out = np.full((len(counts), 3), _FLOOR)
        out[:, 0] = 1
        some = counts > 0
        if some.any():
            starts = (np.cumsum(counts) - counts)[some]
            out[some, 1] = np.maximum.reduceat(odds, starts)
            out[some, 2] = np.log(np.add.reduceat(1 / (1 + np.exp(-np.clip(odds.astype(np.float64), -30, 30))), starts))
        return np.maximum(out, _FLOOR)

    def score(self, texts: list[str | None], spans: bool = True) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        odds, counts = self.marginals(texts)
        x = self.documents(odds, counts) @ self.field.document
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        if spans:
            ends = np.cumsum(counts)
            for i in np.unique(np.searchsorted(ends, np.flatnonzero(odds >= np.log(SPAN / (1 - SPAN))), side="right")).tolist():
                hit = set(np.flatnonzero(odds[ends[i] - counts[i] : ends[i]] >= np.log(SPAN / (1 - SPAN))).tolist())
                found[i] = [m.span() for k, m in enumerate(re.finditer(r"\S+", texts[i] or "")) if k in hit]
        return 1 / (1 + np.exp(-np.clip(x, -30, 30))), found


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(31))


def _keys(word: str) -> tuple[str, ...]:
    """A word, and its prefixes of 4 and 5 letters as keys of their own."""
    return (word, word[:4] + "~", word[:5] + "~") if len(word) > 3 else (word,)


def token_labels(texts: list[str], toxic: np.ndarray, least: int = 8, log_odds: float = 2.5) -> list[np.ndarray | None]:
    """0/1 for each token; None for toxic texts in which nothing stands out."""
    place: dict[str, int] = {}
    split = [np.fromiter((place.setdefault(normal(w), len(place)) for w in t.split()), np.int64) for t in texts]
    names: dict[str, int] = {}
    keys = np.full((len(place), 3), -1, dtype=np.int64)
    for word, i in place.items():
        for j, k in enumerate(_keys(word)):
            keys[i, j] = names.setdefault(k, len(names))
    contexts = np.zeros((2, len(names)), dtype=np.int64)
    for y in (0, 1):
        mine = [w for w, t in zip(split, toxic.tolist(), strict=True) if t == y and len(w)]
        word = np.concatenate(mine) if mine else np.empty(0, np.int64)
        before = np.concatenate([np.append(-1, w[:-1]) for w in mine]) if mine else word
        after = np.concatenate([np.append(w[1:], -1) for w in mine]) if mine else word
        around = _mix(_mix((before + 1).astype(np.uint64)) + (after + 1).astype(np.uint64))
        for j in range(3):
            key = keys[word, j]
            seen = np.unique(_mix(around + (key + 2).astype(np.uint64)), return_index=True)[1]
            key = key[seen]
            contexts[y] += np.bincount(key[key >= 0], minlength=len(names))
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    odds = np.log((contexts[1] + 0.5) / n1) - np.log((contexts[0] + 0.5) / n0)
    bad = (contexts[1] >= least) & (odds >= log_odds)
    bad[[i for k, i in names.items() if not k.rstrip("~")]] = False
    is_bad = (np.append(bad, False)[keys]).any(axis=1)
    out: list[np.ndarray | None] = []
    for words, y in zip(split, toxic.tolist(), strict=True):
        labels = (is_bad[words] & bool(y)).astype(np.float32)
        out.append(None if y and not labels.any() else labels)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def fit(texts: list[str], toxic: np.ndarray, epochs: int = 6, batch: int = 512, rate: float = 0.3, segments: int = 8_000, seed: int = 3) -> Field:
    """Fit on texts with document labels 0/1.

    The field is fitted on ``segments`` segments with toxic tokens and as many without at most, drawn
    at random, each a chain of its own.
    """
    field = Field(np.zeros(1 << BITS, np.float32), -3.0, np.zeros((2, 2)), np.array([-30.0, 0.0, 0.0]))
    toxic = np.asarray(toxic, dtype=np.int64)
    if not toxic.any() or toxic.all():
        return field
    labels = token_labels(texts, toxic)
    used = [i for i, y in enumerate(labels) if y is not None and len(y)]
    place: dict[str, int] = {}
    tokens = [np.fromiter((place.setdefault(w, len(place)) for w in texts[i].split()), np.int64) for i in used]
    counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
    table = np.array([_features(normal(w)) for w in place])
    index = np.concatenate(tokens)
    y = np.concatenate([labels[i] for i in used])
    _, mask, at = _seg(y, counts)
    rng = np.random.default_rng(seed)
    hot = np.flatnonzero((y[at] * mask).any(axis=0))
    cold = np.setdiff1d(np.arange(mask.shape[1]), hot)
    keep = np.concatenate([rng.permutation(hot)[:segments], rng.permutation(cold)[:segments]])
    inner = np.ones(len(index), bool)
    inner[np.cumsum(counts) - counts] = False
    square, moved, biased = np.full(1 << BITS, 1e-6, np.float32), np.full((2, 2), 1e-6), 1e-6
    for _ in range(epochs):
        rng.shuffle(keep)
        for i in range(0, len(keep), batch):
            cols = keep[i : i + batch]
            cell, m = at[:, cols], mask[:, cols]
            own = table[index[cell]][..., OWN]
            left, right = table[index[np.maximum(cell - 1, 0)], BEFORE], table[index[np.minimum(cell + 1, len(index) - 1)], AFTER]
            has_left, has_right = inner[cell], np.append(inner, False)[cell + 1]
            w = field.weights
            e = w[own].sum(axis=-1) + w[left] * has_left + w[right] * has_right + np.float32(field.bias)
            a, b = forward_backward(e, m, field.moves)
            truth = y[cell]
            gap = ((truth - 1 / (1 + np.exp(-np.clip(a + b, -30, 30)))) * m).astype(np.float32)
            ids = np.concatenate([own[..., j].ravel() for j in range(own.shape[-1])] + [left.ravel(), right.ravel()])
            by = np.concatenate([gap.ravel()] * own.shape[-1] + [(gap * has_left).ravel(), (gap * has_right).ravel()])
            g = np.bincount(ids, by, 1 << BITS).astype(np.float32) - 1e-3 * w
            # expected against counted moves
            (m00, m01), (m10, m11) = field.moves
            to = np.clip(e[1:] + b[1:], -30, 30)
            fro = np.clip(a[:-1], -30, 30)
            both = np.exp(np.stack([m00 + 0 * to, m01 + to, m10 + fro, m11 + fro + to]))
            both /= both.sum(axis=0)
            code = (2 * truth[:-1] + truth[1:])[None] == np.arange(4)[:, None, None]
            gm = ((code - both) * m[1:]).sum(axis=(1, 2)).reshape(2, 2)
            gb = float(gap.sum())
            square += g * g
            moved += gm * gm
            biased += gb * gb
            field.weights = w + rate * g / np.sqrt(square)
            field.moves = field.moves + rate * gm / np.sqrt(moved)
            field.bias += rate * gb / np.sqrt(biased)
    tagger = Tagger(field)
    x = np.concatenate([tagger.documents(*tagger.marginals(texts[i : i + 500])) for i in range(0, len(texts), 500)])
    field.document = _logistic(x, toxic)
    return field


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", positive: int = POSITIVE, negative: int = NEGATIVE) -> Field:
    """Fit on a bounded sample of labelled documents. labels: (doc_id, label 0/1), training rows only."""
    most = {"1": positive, "0": negative}
    got = sampling.collect(sampling.per_class(labels, "doc_id", label, most, classes=2), docs, most).sort_values("label", ascending=False, kind="stable")
    return fit(got["text"].tolist(), (got["label"] == "1").to_numpy().astype(np.int64))


def score(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, score, spans) for documents (doc_id, text); spans is array<struct<start,end>>."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("score double, spans array<struct<start:int,end:int>>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(shared.value)
        for texts in batches:
            parts = [tagger.score(part.tolist()) for part in in_parts(texts, 3_000_000)]
            yield pd.DataFrame({"score": [x for found, _ in parts for x in found], "spans": [[{"start": a, "end": b} for a, b in s] for _, spans in parts for s in spans]})

    return docs.select("doc_id", scored(F.col("text").cast("string")).alias("found")).select("doc_id", "found.score", "found.spans")
