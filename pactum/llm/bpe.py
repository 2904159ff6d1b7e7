"""Byte-level BPE by ranks, encoding and decoding, on padded numpy matrices.

Pre-tokens (matches of a pattern) are encoded once for each distinct one of a batch. They are
dealt by byte length into buckets; a bucket is a matrix with a pre-token in each row, padded
with -1. Each round, every row merges its leftmost pair of minimum rank: the ranks of
neighbouring pairs stand in a second matrix, the merged cell and its neighbours' ranks are
renewed by lookups in an open-addressing hash table of pairs, and rows close up by one cell.
Rows without a mergeable pair leave the matrix (compaction). Pre-tokens longer than the
largest bucket, which would make the matrix quadratic, follow the same rule on a heap.

A pair's rank is that of its concatenated bytes, whichever merges lead there, as in the
tiktoken library. Defined results: null and empty texts have no ids and decode to no bytes.
"""

from __future__ import annotations

import base64
import heapq
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.common import release

#: Of this pattern no match holds white space after another character, but for the one space
#: before a word, so texts are cut there first, by a quicker pattern, and chunks are remembered.
SPACE_JOINED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BY_SPACE = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: Widths of the matrices.
BUCKETS = (4, 8, 16, 32, 64, 128, 256)
#: Distinct pre-tokens that a worker remembers; it starts anew beyond that.
REMEMBER = 100_000
#: Cells of a matrix that is worked on at a time.
CELLS = 60_000
_NONE = np.int32(2**31 - 1)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] of each, concatenated."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return values[:0]
    return values[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)]


class PairTable:
    """Open addressing with linear probing: (left id, right id) to the rank of their bytes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(2, len(keys)) * 2.5))))
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.ranks = np.full(1 << self.bits, _NONE, dtype=np.int32)
        self.mask = np.int64((1 << self.bits) - 1)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == np.iinfo(np.uint64).max
            first = np.zeros(len(todo), dtype=bool)
            at = np.flatnonzero(free)
            first[at[np.unique(slot[at], return_index=True)[1]]] = True
            self.keys[slot[first]], self.ranks[slot[first]] = keys[todo[first]], rank[todo[first]]
            todo, slot = todo[~first], (slot[~first] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; _NONE where there is none or an id is negative."""
        keys = (left.astype(np.int64).view(np.uint64) << np.uint64(32)) | right.astype(np.int64).view(np.uint64)
        out = np.full(keys.shape, _NONE, dtype=np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = keys[todo]
        slot = self._slot(keys)
        while len(todo):
            there = self.keys[slot]
            hit = there == keys
            out[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there != np.iinfo(np.uint64).max)
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & self.mask
        return out


class BytePairs:
    """Encoder and decoder of one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.by_space = pattern == SPACE_JOINED
        self.of = ranks
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*np.array(pairs, dtype=np.int64).reshape(-1, 3).T)
        self.lengths = np.array([len(t) for t in self.bytes_of], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.blob = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.forget()

    @classmethod
    @lru_cache(maxsize=2)
    def load(cls, path: str, pattern: str) -> BytePairs:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _remember(self, chunks: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks)), strict=True))
        self.flat = np.concatenate([self.flat, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])

    def _merge_matrix(self, tokens: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all tokens, concatenated, and how many each has."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ids = np.full((len(tokens), width), -1, dtype=np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.byte_id[np.frombuffer(b"".join(tokens), dtype=np.uint8)]
        rank = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(tokens), width - 1)
        done, done_lengths = np.full((len(tokens), width), -1, dtype=np.int32), lengths.copy()
        row = np.arange(len(tokens))
        while len(row):
            each = np.arange(len(row))
            at = rank.argmin(axis=1)
            best = rank[each, at]
            live = best != _NONE
            if not live.all():
                done[row[~live], : ids.shape[1]], done_lengths[row[~live]] = ids[~live], lengths[~live]
                row, lengths, at, best = row[live], lengths[live], at[live], best[live]
                if not len(row):
                    break
                most = int(lengths.max())
                ids, rank, each = ids[live, :most], rank[live, : most - 1], np.arange(len(row))
            # close up: cells right of the merged pair move left by one
            width = ids.shape[1]
            ids[each, at] = best
            left = np.arange(1, width) > at[:, None]
            ids[:, 1:-1] = np.where(left[:, :-1], ids[:, 2:], ids[:, 1:-1])
            ids[:, -1] = -1
            rank[:, :-1] = np.where(left[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = _NONE
            lengths = lengths - 1
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 1)
            p, q = np.concatenate([before, after]), np.concatenate([at[before] - 1, at[after]])
            rank[p, q] = self.pairs.get(ids[p, q], ids[p, q + 1])
        return done[np.arange(done.shape[1]) < done_lengths[:, None]], done_lengths

    def _merge_heap(self, token: bytes) -> np.ndarray:
        ids = self.byte_id[np.frombuffer(token, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        first = self.pairs.get(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    joined = self.of.get(self.bytes_of[ids[x]] + self.bytes_of[ids[y]])
                    if joined is not None:
                        heapq.heappush(heap, (joined, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens, concatenated in their order, and how many each has."""
        buckets: list[list[int]] = [[] for _ in range(len(BUCKETS) + 1)]
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        whole = np.fromiter((self.of.get(r, -1) for r in raw), np.int64, len(raw))
        for i in np.flatnonzero(whole < 0).tolist():
            buckets[bisect_left(BUCKETS, len(raw[i]))].append(i)
        order, ids, lengths = [np.flatnonzero(whole >= 0)], [whole[whole >= 0].astype(np.int32)], [np.ones(int((whole >= 0).sum()), np.int64)]
        for width, items in zip((*BUCKETS, 0), buckets, strict=True):
            step = max(1, CELLS // width) if width else 1
            for i in range(0, len(items), step):
                part = [raw[x] for x in items[i : i + step]]
                merged = self._merge_matrix(part, width) if width else (long := self._merge_heap(part[0]), np.array([len(long)]))
                order.append(np.array(items[i : i + step]))
                ids.append(merged[0])
                lengths.append(merged[1])
        place, length = np.concatenate(order), np.concatenate(lengths)
        starts = np.cumsum(length) - length
        back = np.empty(len(place), np.int64)
        back[place] = np.arange(len(place))
        length, starts = length[back], starts[back]
        return _gather(np.concatenate(ids), starts, length), length

    def _learn(self, new: list[str]) -> None:
        """Remember chunks: of one pre-token, or of several where texts are cut at white space first."""
        found = [self.pattern.findall(c) for c in new] if self.by_space else [[c] for c in new]
        pieces = list(dict.fromkeys(chain.from_iterable(found)))
        ids, lengths = self._pieces(pieces)
        starts = np.cumsum(lengths) - lengths
        place = dict(zip(pieces, range(len(pieces)), strict=True))
        index = np.fromiter(map(place.__getitem__, chain.from_iterable(found)), np.int64)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        total = np.concatenate([[0], np.cumsum(lengths[index])])
        cut = np.concatenate([[0], np.cumsum(counts)])
        self._remember(new, _gather(ids, starts[index], lengths[index]), total[cut[1:]] - total[cut[:-1]])

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        cut = _BY_SPACE.findall if self.by_space else self.pattern.findall
        chunks = [cut(t) if t else [] for t in texts]
        if len(self.known) > REMEMBER:
            self.forget()
        new = set().union(*chunks).difference(self.known)
        if new:
            self._learn(list(new))
        counts = np.fromiter(map(len, chunks), np.int64, len(chunks))
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(chunks)), np.int64, int(counts.sum()))
        lengths = self.ends[index + 1] - self.ends[index]
        ids = _gather(self.flat, self.ends[index], lengths)
        total = np.concatenate([[0], np.cumsum(lengths)])
        return np.split(ids, total[np.cumsum(counts)][:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        return _gather(self.blob, self.starts[ids], self.lengths[ids]).tobytes()


def _texts(column: pa.Array, most: int = 1_000_000) -> Iterator[list[str | None]]:
    """Texts in groups of bounded length."""
    group: list[str | None] = []
    size = 0
    for t in column:
        t = t.as_py()
        group.append(t)
        size += len(t or "")
        if size >= most:
            yield group
            group, size = [], 0
    yield group


def _decoded(bpe: BytePairs, ids: Iterable[np.ndarray]) -> pa.Array:
    return pa.array([bpe.decode(i) for i in ids], type=pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>[, decoded binary]) for documents (doc_id, text). path: a file of ranks that every executor has.

    decoded: the ids are decoded again by the same worker, as ``decode`` does it for stored ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = BytePairs.load(path, pattern)
        for x in batches:
            at = 0
            for group in _texts(x.column("text")):
                if group:
                    ids = bpe.encode(group)
                    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                    flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), type=pa.int32())
                    columns = {"doc_id": x.column("doc_id").slice(at, len(group)), "ids": pa.ListArray.from_arrays(pa.array(offsets), flat)}
                    if decoded:
                        columns["decoded"] = _decoded(bpe, ids)
                    yield pa.RecordBatch.from_pydict(columns)
                    at += len(group)
        bpe.forget()  # the worker may go on to other tasks
        release()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>{', decoded binary' * decoded}")


def decode(encoded: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """The rows of encoded with a column ``decoded`` (binary); null ids decode to no bytes."""
    kinds = ", ".join(f"{c} {encoded.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = BytePairs.load(path, pattern)
        for x in batches:
            lists = x.column("ids")
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            out = _decoded(bpe, (flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)))
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in keep), out], names=[*keep, "decoded"])

    return encoded.select(*keep).mapInArrow(run, f"{kinds}, decoded binary")
