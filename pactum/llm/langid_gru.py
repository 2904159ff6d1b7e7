"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy.

Every byte of a text is labelled: two gated recurrent layers, one in each direction, read its
UTF-8 bytes, and a softmax over both states gives the probability of each language at that byte.
Windows of ``SEGMENT`` bytes are worked on side by side; each is read with ``WARM`` further bytes
on either side, so that states have settled (whole characters included) where labels count. A document's probabilities are the mean over its
bytes that can be part of letters. The whole of every text is read; segments of many texts are
the columns of one matrix, so each step is a few matrix operations.

The gate for the candidate is applied after its recurrent product, so that a step has a single
product of the state. Training is backpropagation through time with Adam: ``train`` on random
segments of a bounded sample (``PER_LANGUAGE`` documents of each language, fewer where languages
are so many that ``sampling.ROWS`` would be exceeded), ``train_whole`` on every byte of all rows.

Defined results: a text that is null or has no letter is ``und`` with score 0; with no
training row every text is ``und``; with one language, every text with a letter has it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.llm import sampling
from pactum.llm.common import in_parts, release, written

PER_LANGUAGE, LANGUAGES = 400, 1000
#: Bytes that a window labels, and bytes read on either side of them before labels count.
SEGMENT, WARM, HIDDEN = 384, 48, 8
#: Bytes of a shard of ``train_whole``, and those read at least for its start.
SHARD, START = 5_000_000, 4_600_000
#: Bins that a search for a quantile counts at a time.
BINS = 4096
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_SPREAD = np.zeros(256, np.float32)
_SPREAD[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
#: Columns of a matrix that is worked on at a time.
COLUMNS = 768


@dataclass
class Network:
    """Of each direction: inputs (256, 3H), recurrent (3H, H), bias of the candidate's product (H)."""

    languages: list[str]
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    inner: list[np.ndarray]
    output: np.ndarray  # (C, 2H)
    offset: np.ndarray  # (C,)

    @classmethod
    def new(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *s, k=1.0: (rng.standard_normal(s) * k).astype(np.float32)
        return cls(languages, [draw(256, 3 * hidden, k=0.3) for _ in "fb"], [draw(3 * hidden, hidden, k=hidden**-0.5) for _ in "fb"], [np.zeros(hidden, np.float32) for _ in "fb"], draw(len(languages), 2 * hidden, k=0.1), np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrent, *self.inner, self.output, self.offset]

    def states(self, x: np.ndarray, mask: np.ndarray | None, way: int, keep: np.ndarray | None = None) -> np.ndarray:
        """States after each position of bytes x (steps, columns), from one side; where mask is 0 the state is 0.

        keep: (5, steps, H, columns), gets what backpropagation needs.
        """
        hidden = len(self.inner[way])
        steps, n = x.shape
        table, u = self.inputs[way], self.recurrent[way]
        c = self.inner[way][:, None]
        out = np.empty((steps, hidden, n), np.float32)
        h = np.zeros((hidden, n), np.float32)
        gates = np.empty((3 * hidden, n), np.float32)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            np.copyto(gates, table[x[t]].T)
            p = u @ h
            zr = gates[: 2 * hidden]
            zr += p[: 2 * hidden]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            q = p[2 * hidden :]
            q += c
            z, r = zr[:hidden], zr[hidden:]
            s = gates[2 * hidden :]
            s += r * q
            np.tanh(s, out=s)
            if keep is not None:
                keep[0, t], keep[1, t], keep[2, t], keep[3, t], keep[4, t] = h, z, r, q, s
            h = s + z * (h - s)
            if mask is not None:
                h *= mask[t]
            out[t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """(steps, C, columns)."""
        hidden = len(self.inner[0])
        left, right = self.states(x, mask, 0), self.states(x, mask, 1)
        return np.matmul(self.output[:, :hidden], left) + np.matmul(self.output[:, hidden:], right) + self.offset[:, None]

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Mean probability of each language; a row of zeros for a text without letters."""
        out = np.zeros((len(texts), len(self.languages)))
        use = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not use or not self.languages:
            return out
        raw = [np.frombuffer(texts[i].encode("utf-8", "surrogatepass"), np.uint8) for i in use]
        pieces = np.array([-(-len(r) // SEGMENT) for r in raw])
        owner = np.repeat(np.arange(len(use)), pieces)
        # every text stands with WARM zeros on both sides, and zeros up to whole windows
        room = pieces * SEGMENT + 2 * WARM
        first = np.cumsum(room) - room
        flat = np.zeros(int(room.sum()), np.uint8)
        for r, at in zip(raw, first.tolist(), strict=True):
            flat[at + WARM : at + WARM + len(r)] = r
        start = np.repeat(first, pieces) + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
        window = np.arange(SEGMENT + 2 * WARM)[:, None]
        mass, total = np.zeros((len(use), len(self.languages))), np.zeros(len(use))
        for i in range(0, len(owner), COLUMNS):
            x = flat[start[i : i + COLUMNS] + window]
            # zeros stand only around a text or for a byte 0; the state is 0 there
            mask = None if x.min() > 0 else (x > 0).astype(np.float32)
            p = self.logits(x, mask)[WARM:-WARM]
            x = x[WARM:-WARM]
            p -= p.max(axis=1, keepdims=True)
            np.exp(p, out=p)
            weight = _SPREAD[x] / p.sum(axis=1)
            summed = np.einsum("tcn,tn->nc", p, weight)
            np.add.at(mass, owner[i : i + COLUMNS], summed)
            np.add.at(total, owner[i : i + COLUMNS], _SPREAD[x].sum(axis=0))
        out[use] = mass / np.maximum(total, 1)[:, None]
        return out


def _gradients(net: Network, x: np.ndarray, y: np.ndarray, worth: np.ndarray | None = None) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients over segments x (steps, columns) whose every letter byte has label y (columns).

    worth: weight of each column.
    """
    hidden = len(net.inner[0])
    steps, n = x.shape
    kept = np.empty((2, 5, steps, hidden, n), np.float32)
    states = [net.states(x, None, way, kept[way]) for way in (0, 1)]
    both = np.concatenate(states, axis=1)
    p = np.matmul(net.output, both) + net.offset[:, None]
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    weight = _SPREAD[x] if worth is None else _SPREAD[x] * worth.astype(np.float32)
    weight = weight / max(1.0, float(weight.sum()))
    loss = float(-(np.log(p[:, y, np.arange(n)] + 1e-9) * weight).sum())
    p[:, y, np.arange(n)] -= 1
    d = p * weight[:, None]
    g_out, g_off = np.matmul(d, both.transpose(0, 2, 1)).sum(axis=0), d.sum(axis=(0, 2))
    d_state = np.matmul(net.output.T, d)
    g_in, g_rec, g_inner = [], [], []
    flat = x.ravel()
    for way in (0, 1):
        h, z, r, q, s = kept[way]
        to_s, to_z, to_r = (1 - z) * (1 - s * s), (h - s) * z * (1 - z), q * r * (1 - r)
        pre, ds = np.empty((steps, 3 * hidden, n), np.float32), np.empty((steps, hidden, n), np.float32)
        back = np.ascontiguousarray(net.recurrent[way].T)
        carry = np.zeros((hidden, n), np.float32)
        for t in range(steps - 1, -1, -1) if way == 0 else range(steps):
            dh = carry
            dh += d_state[t, way * hidden : (way + 1) * hidden]
            np.multiply(dh, to_s[t], out=ds[t])
            np.multiply(dh, to_z[t], out=pre[t, :hidden])
            np.multiply(ds[t], to_r[t], out=pre[t, hidden : 2 * hidden])
            np.multiply(ds[t], r[t], out=pre[t, 2 * hidden :])
            carry = back @ pre[t]
            dh *= z[t]
            carry += dh
        g_rec.append(np.matmul(pre, h.transpose(0, 2, 1)).sum(axis=0))
        g_inner.append(pre[:, 2 * hidden :].sum(axis=(0, 2)))
        rows = (v.ravel() for k in (pre[:, : 2 * hidden], ds) for v in k.transpose(1, 0, 2))
        g_in.append(np.stack([np.bincount(flat, v, 256) for v in rows], axis=1).astype(np.float32))
    return loss, [*g_in, *g_rec, *g_inner, g_out.astype(np.float32), g_off.astype(np.float32)]


class Descent:
    """Adam over a network's parameters, by gradients of norm 1 at most."""

    def __init__(self, net: Network):
        self.net, self.steps = net, 0
        self.first = [np.zeros_like(p) for p in net.parameters()]
        self.second = [np.zeros_like(p) for p in net.parameters()]

    def step(self, rate: float, x: np.ndarray, y: np.ndarray, worth: np.ndarray | None = None) -> None:
        self.steps += 1
        k = self.steps
        _, grads = _gradients(self.net, x, y, worth)
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        for p, g, m, v in zip(self.net.parameters(), grads, self.first, self.second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)


def fit(texts: list[str], labels: list[str], rounds: int = 500, columns: int = 192, steps: int = 48, rate: float = 0.01, seed: int = 13) -> Network:
    """Train on random segments; every language is drawn alike often."""
    languages = sorted(set(labels))
    net = Network.new(languages)
    if len(languages) < 2:
        return net
    rng = np.random.default_rng(seed)
    raw = [[np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t, y in zip(texts, labels, strict=True) if y == lang and t and _LETTER.search(t)] for lang in languages]
    stock = [np.concatenate(r) if r else np.zeros(1, np.uint8) for r in raw]
    stock = [np.tile(s, -(-(steps + 1) // len(s))) for s in stock]
    descent = Descent(net)
    for k in range(1, rounds + 1):
        y = rng.integers(0, len(languages), columns)
        x = np.stack([stock[c][(a := int(rng.integers(0, len(stock[c]) - steps))) : a + steps] for c in y], axis=1)
        descent.step(rate * (1 - 0.9 * k / rounds), x, y)
    return net


def train(docs: DataFrame, rows: DataFrame, per_language: int = PER_LANGUAGE) -> Network:
    """Fit on a bounded sample. rows: (doc_id, lang) of training documents."""
    got = sampling.collect(sampling.per_class(rows, "doc_id", "lang", per_language, LANGUAGES), docs, per_language)
    return fit(got["text"].tolist(), got["label"].tolist())


def segments(texts: list[str], labels: list[str], languages: list[str], steps: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of the texts that have letters: segments (n, steps) of one language each, and their languages.

    Drawn in an order that spreads each language evenly. The last segment of a language begins
    before the end of the one before it; a language shorter than a segment is repeated.
    """
    raw: list[list[bytes]] = [[] for _ in languages]
    place = {lang: c for c, lang in enumerate(languages)}
    for t, y in zip(texts, labels, strict=True):
        if t and _LETTER.search(t):
            raw[place[y]].append(t.encode("utf-8", "surrogatepass"))
    x, y, order = [np.zeros((0, steps), np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for c, texts_of in enumerate(raw):
        if texts_of:
            flat = np.frombuffer(b"".join(texts_of), np.uint8)
            flat = np.tile(flat, -(-steps // len(flat))) if len(flat) < steps else flat
            whole = len(flat) // steps * steps
            x += [flat[:whole].reshape(-1, steps), flat[None, -steps:][: int(whole < len(flat))]]
            n = whole // steps + int(whole < len(flat))
            y.append(np.full(n, c))
            order.append((rng.permutation(n) + rng.random(n)) / n)
    at = np.concatenate(order).argsort(kind="stable")
    return np.concatenate(x)[at], np.concatenate(y)[at]


def learn(net: Network, texts: list[str], labels: list[str], weights: np.ndarray, columns: int, rate: float, least: int = 0, steps: int = 48, seed: int = 13) -> None:
    """Train net on every byte of the texts, as often as it takes to read ``least`` bytes, and once at the least."""
    rng = np.random.default_rng(seed)
    x, y = segments(texts, labels, net.languages, steps, rng)
    if not len(x):
        return
    passes = max(1, -(-least // x.size))
    starts = range(0, len(x), columns)
    descent = Descent(net)
    for done in range(passes):
        if done:
            x, y = segments(texts, labels, net.languages, steps, rng)
        for k, i in enumerate(starts):
            part = y[i : i + columns]
            slower = 1 - 0.9 * (done * len(starts) + k) / (passes * len(starts))
            descent.step(rate * slower, np.ascontiguousarray(x[i : i + columns].T), part, weights[part])


def _packed(net: Network) -> bytes:
    return np.concatenate([p.ravel() for p in net.parameters()]).astype("<f8").tobytes()


def _unpacked(languages: list[str], packed: bytes, total: float = 1.0) -> Network:
    net, at = Network.new(languages), 0
    values = np.frombuffer(packed, "<f8") / total
    for p in net.parameters():
        p[...] = values[at : at + p.size].reshape(p.shape)
        at += p.size
    return net


def _shards(rows: DataFrame, shards: int, run: Callable[[list[str], list[str]], dict]) -> DataFrame:
    """(shard, bytes, net, letters) of what run makes of the texts and labels of each shard, which come in a fixed order."""

    def one(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        group = group.sort_by([("doc_id", "ascending"), ("text", "ascending"), ("label", "ascending")])
        made = run(group.column("text").to_pylist(), group.column("label").to_pylist())
        release()
        return pa.Table.from_pydict({"shard": [shard], **{k: [v] for k, v in made.items()}}, schema=pa.schema([("shard", pa.int64()), ("bytes", pa.float64()), ("net", pa.binary()), ("letters", pa.list_(pa.int32()))]))

    shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("long")
    return rows.withColumn("shard", shard).groupBy("shard").applyInArrow(one, "shard long, bytes double, net binary, letters array<int>")


def _summed(shards: DataFrame) -> DataFrame:
    """(bytes, net, letters) of 64 shards each: networks are summed by their bytes, letters united."""

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by("shard")
        weighs = group.column("bytes").to_pylist()
        net = sum(w * np.frombuffer(n.as_py(), "<f8") for w, n in zip(weighs, group.column("net"), strict=True))
        letters = np.unique(pa.concat_arrays([a.flatten() for a in group.column("letters").chunks]).to_numpy())
        return pa.Table.from_pydict({"bytes": [sum(weighs)], "net": [net.tobytes()], "letters": [letters]}, schema=pa.schema([("bytes", pa.float64()), ("net", pa.binary()), ("letters", pa.list_(pa.int32()))]))

    bucket = F.floor(F.col("shard") / 64).alias("bucket")
    return shards.select(bucket, "*").groupBy("bucket").applyInArrow(one, "bytes double, net binary, letters array<int>")


def train_whole(rows: DataFrame, shard_bytes: int = SHARD) -> tuple[Network, np.ndarray]:
    """The network fitted on every byte of all rows (doc_id, text, label), and the letters that their texts hold.

    Rows are dealt to shards by a hash. The first shard gives the start; from there every shard is
    learned by itself, side by side, and the networks are averaged by their bytes. Languages weigh
    alike: the loss of each is divided by its share of all bytes (by no less than 1/50 of an equal
    share). The result depends neither on how the table is stored nor on the number of executors.
    """
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("label").cast("string").alias("label")).where("doc_id is not null and text is not null and label is not null")
    sizes = {r["label"]: r["bytes"] for r in rows.groupBy("label").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()}
    languages, total = sorted(sizes), sum(sizes.values())
    if len(languages) < 2 or not total:
        return Network.new(languages), np.empty(0, np.int32)
    weights = np.array([total / len(languages) / max(sizes[lang], total / len(languages) / 50) for lang in languages])
    shards = -(-total // shard_bytes)

    def start(texts: list[str], labels: list[str]) -> dict:
        net = Network.new(languages)
        learn(net, texts, labels, weights, 192, 0.01, START)
        return {"bytes": 0.0, "net": _packed(net), "letters": []}

    first = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)) == 0
    begun = _shards(rows.where(first), shards, start).select("net").collect()
    common = bytes(begun[0]["net"]) if begun else _packed(Network.new(languages))

    def refine(texts: list[str], labels: list[str]) -> dict:
        net, held = _unpacked(languages, common), np.zeros(len(_is_letter()), bool)
        learn(net, texts, labels, weights, 768, 0.003)
        for t in texts:
            held[_points(t)] = True
        return {"bytes": float(sum(len(t.encode("utf-8", "surrogatepass")) for t in texts) or 1), "net": _packed(net), "letters": np.flatnonzero(held & _is_letter())}

    made = _summed(_shards(rows, shards, refine)).collect()
    made.sort(key=lambda r: (r["bytes"], r["net"]))
    net = _unpacked(languages, sum(np.frombuffer(r["net"], "<f8") for r in made).tobytes(), sum(r["bytes"] for r in made))
    return net, np.unique(np.concatenate([np.array(r["letters"], np.int32) for r in made]))


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    """Of every code point."""
    out = np.zeros(0x110000, bool)
    for m in regex.finditer(r"\p{L}+", np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")):
        out[m.start() : m.end()] = True
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gibberish(text: str, letters: np.ndarray, draw: int) -> str:
    """The text with random letters in place of its own: by the draw any of ``letters``, or a to z."""
    points = _points(text).copy()
    at = _is_letter()[points]
    stock = letters if draw % 2 and len(letters) else np.arange(97, 123)
    points[at] = stock[np.random.default_rng(draw % 2**64).integers(0, len(stock), int(at.sum()))]
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def scored(docs: DataFrame, net: Network, letters: np.ndarray, learned: Column) -> DataFrame:
    """(document, score, noise): the columns of docs, the text's best score, and that of gibberish made of it where ``learned`` holds."""
    shared = docs.sparkSession.sparkContext.broadcast((net, letters))

    @F.pandas_udf("score double, noise double")
    def best(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        net, letters = shared.value
        top = lambda texts: net.score(texts).max(axis=1, initial=0)
        for texts, use, draw in columns:
            parts = [pd.DataFrame({"score": [], "noise": []}, dtype=float)]
            for part in in_parts(texts, 1_000_000):
                score, noise = top(part.tolist()), np.full(len(part), np.nan)
                at = np.flatnonzero((score > 0) & use[part.index].to_numpy(bool))
                noise[at] = top([gibberish(t, letters, d) for t, d in zip(part.iloc[at], draw[part.index].iloc[at].tolist(), strict=True)])
                parts.append(pd.DataFrame({"score": score, "noise": noise}))
            yield pd.concat(parts, ignore_index=True)
        release()

    text = F.col("text").cast("string")
    found = best(text, F.coalesce(learned, F.lit(False)), F.xxhash64(F.col("doc_id").cast("string"), text))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), found.alias("found"))
    return rows.select("document", "found.score", F.nanvl("found.noise", F.lit(None).cast("double")).alias("noise"))


def nth(values: DataFrame, rank: int) -> float:
    """The value at a rank (from 0) of values (value): bins are counted, the one that holds the rank is cut into finer ones, and so on."""
    low, high = values.agg(F.min("value"), F.max("value")).first()
    while low < high:
        place = F.least(F.floor((F.col("value") - low) / (high - low) * BINS), F.lit(BINS - 1))
        for r in values.where(F.col("value").between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).orderBy("bin").collect():
            if rank < r["n"]:
                break
            rank -= r["n"]
        low, high = r["low"], r["high"]
    return low


def least_score(found: DataFrame, junk: float = 0.98, lost: float = 0.005) -> float:
    """The score below which a text is no language, from all rows (score, noise) of learned texts.

    It is the one below which the share ``junk`` of gibberish falls, but at most the one below
    which the share ``lost`` of the texts falls. 0 (nothing goes by score) without texts.
    """
    found = found.where("noise is not null")
    n = found.count()
    if not n:
        return 0.0
    clean, noise = (found.select(F.col(c).alias("value")) for c in ("score", "noise"))
    return min(nth(noise, math.ceil(junk * (n - 1))), nth(clean, math.floor(lost * (n - 1))))


def known(docs: DataFrame, learned: Column, label: str = "lang") -> DataFrame:
    """The documents whose language is known, all columns as before: texts with letters that score no less than ``least_score``.

    learned: which documents (doc_id, text, label) may be learned from; all of them are. With fewer
    than two languages, whose only probability is 1, nothing goes by score.
    """
    usable = learned & F.col("doc_id").isNotNull() & F.col(label).isNotNull()
    net, letters = train_whole(docs.where(usable).select("doc_id", "text", F.col(label).alias("label")))
    found = written(scored(docs, net, letters, usable if len(net.languages) > 1 else F.lit(False)), "language-scores")
    least = least_score(found)
    return found.where((F.col("score") > 0) & (F.col("score") >= least)).select("document.*")


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, lang_pred, score) for documents (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        net, names, scores = shared.value, [], [np.empty(0)]
        for part in in_parts(texts, 4_000_000):
            p = net.score(part.tolist())
            best = p.argmax(axis=1) if net.languages else np.zeros(len(p), int)
            scores.append(p[np.arange(len(p)), best] if net.languages else np.zeros(len(p)))
            names += [net.languages[b] if s > 0 else UNKNOWN for b, s in zip(best, scores[-1], strict=True)]
        return pd.DataFrame({"lang_pred": names, "score": np.clip(np.concatenate(scores), 0, 1)})

    return docs.select("doc_id", predicted(F.col("text").cast("string")).alias("found")).select("doc_id", "found.lang_pred", "found.score")
