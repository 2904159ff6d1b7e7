"""Exact n-gram Jaccard self-join by vertical partitioning, down to connected classes.

The n-grams of a document are 64-bit hashes; their numeric order is the global n-gram order.
It is cut into fragments (ranges of that order), and fragments are worked on separately:

1. *Identical sets* are one node, named by a digest of the set. Copies that stand in one task
   send their keys once, all others meet in the shuffle; thousands of copies make no pair.
2. *Candidates.* Two sets with J >= t differ in at most D = (1-t)/(1+t) * (|a|+|b|) n-grams.
   With D+1 fragments at least one fragment is the same in both, so equal (fragment, content)
   keys find every pair that can link (empty fragments are keys only where no other need be
   equal). Sizes fall in geometric classes, each with its own
   D; a set also takes part in the next class where a partner can be that much larger.
   Rows (key, node) are sorted and read as a stream: keys of one node go at once.
3. *Sketches.* One bit for each of 16 D buckets: whether the set has an odd number of n-grams
   there. Two sets can't differ in more buckets than in n-grams, so more than the pair's own D
   unequal bits prove that it can't link.
4. *Verification* counts the overlap of each fragment separately and sums the counts per
   pair. First each class verifies one pair to another class, so a group of near copies costs
   about as many verified pairs as members; pairs that are left between classes follow.
5. Keys of up to ``FEW`` nodes have all their pairs looked at; larger ones first pair each node
   with their first. *Rest:* larger keys that still hold more than one class have all pairs
   between classes compared by sketch, in blocks of bounded size; those that pass are verified
   as in 4. Nothing is capped: the result is the same as comparing all pairs.
6. *Classes* by min-label contraction of the links: joins and partial aggregates only,
   nothing on the driver.

Defined results: null, empty or blank texts have an empty set and are linked with nothing;
rows without doc_id are linked with nothing and have a null component; repeated rows are
repeated in the result; rows that share a doc_id but differ in text are sets of their own, and
each is linked by its own text; other columns of the input play no part; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from pactum.llm.common import dropped, release, written
from pactum.llm.shingles import mix64, shingles

#: Size classes grow by this factor.
CLASS_GROWTH = 1.6
#: Fragments in which overlaps are counted.
COUNT_FRAGMENTS = 4
#: Bits of a sketch for each n-gram in which sets of its class can differ.
SKETCH = 16
#: Nodes of a key that are all paired with one another.
FEW = 9
#: Nodes of a key that are compared in one block.
BLOCK = 1024
#: Elements or keys that leave Python in one batch, about.
ELEMENTS = 200_000
#: Digests of sets whose keys a task has sent, at most, before it forgets them.
REMEMBER = 200_000


def _bounds() -> np.ndarray:
    """Smallest size of each class."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, int(np.ceil(bounds[-1] * CLASS_GROWTH))))
    return np.array(bounds, dtype=np.int64)


_BOUNDS = _bounds()


def max_difference(sizes: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Most elements in which two sets of so many elements together differ if they link."""
    return ((100 - percent) * sizes) // (100 + percent)


def classes_of(n: int, percent: int) -> list[int]:
    """The class of a set of n elements, and the next one if a partner can be in it."""
    own = int(np.searchsorted(_BOUNDS, n, side="right")) - 1
    return [own, own + 1] if 100 * n >= percent * int(_BOUNDS[own + 1]) else [own]


def digest(elements: np.ndarray) -> int:
    """64 bits that name a set."""
    return int(np.uint64(xxh3_64_intdigest(elements.tobytes())).astype(np.int64))


def _segments(elements: np.ndarray, fragments: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of mixed elements in each fragment (0 if empty) and which are not empty."""
    frag = ((elements >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
    cut = np.searchsorted(frag, np.arange(fragments + 1, dtype=np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(elements))])
    return total[cut[1:]] - total[cut[:-1]], cut[1:] > cut[:-1]


def keys_in(elements: np.ndarray, size_class: int, percent: int) -> np.ndarray:
    """A key for each fragment that can be the one in which two linked sets are equal.

    None where only identical sets can link. An empty fragment counts only if the differences of
    a possible pair are enough to spoil all that aren't empty: otherwise one of those is equal.
    """
    largest = int(_BOUNDS[size_class + 1]) - 1
    most = int(max_difference(2 * largest, percent))
    if most == 0:
        return np.empty(0, dtype=np.uint64)
    sums, full = _segments(elements, most + 1)
    place = mix64(np.arange(most + 1, dtype=np.uint64) * np.uint64(4096) + np.uint64(size_class + 1))
    # the lowest six bits name the class (there are under 64)
    keys = (mix64(sums + place) & ~np.uint64(63)) | np.uint64(size_class)
    partner = min(largest, 100 * len(elements) // percent)
    return keys if max_difference(len(elements) + partner, percent) >= full.sum() else keys[full]


def sketch(elements: np.ndarray, size_class: int, percent: int) -> bytes:
    """The parities of ``SKETCH`` times as many buckets as sets of the class can differ in elements."""
    most = int(max_difference(2 * (int(_BOUNDS[size_class + 1]) - 1), percent))
    bits = 64 * -(-SKETCH * most // 64)
    if not bits:
        return b""
    bucket = (mix64(elements ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)
    return np.packbits((np.bincount(bucket.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _described(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, node, classes, sketches) of each row; no node for an empty set. 64-bit integers never pass through floats."""
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary())]
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            s = shingles(text, k)
            classes = classes_of(len(s), percent) if len(s) else []
            rows.append((len(s), digest(s) if len(s) else None, classes, [sketch(s, c, percent) for c in classes]))
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n", "node", "classes", "sketches"])
    release()


def _keyed(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, node) of the sets of a task, each set once while it is remembered."""
    seen: set[int] = set()
    keys, nodes, counts, held = [], [], [], 0

    def batch() -> pa.RecordBatch:
        node = np.repeat(np.array(nodes, np.int64), np.array(counts, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(node)], names=["key", "node"])

    for b in batches:
        for text in b.column("text"):
            s = shingles(text.as_py(), k)
            if not len(s) or (node := digest(s)) in seen:
                continue
            if len(seen) >= REMEMBER:
                seen.clear()
            seen.add(node)
            found = np.concatenate([keys_in(s, c, percent) for c in classes_of(len(s), percent)])
            if len(found):
                keys.append(found)
                nodes.append(node)
                counts.append(len(found))
                held += len(found)
                if held >= ELEMENTS:
                    yield batch()
                    keys, nodes, counts, held = [], [], [], 0
    if held:
        yield batch()
    del seen, keys
    release()


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for n in names]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node) sorted by both, without repeats, those whose key has several nodes.

    The last row waits for the next batch; nothing else is kept.
    """
    key, node, waits = np.empty(0, np.int64), np.empty(0, np.int64), False

    def rows(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "node"])

    for b in batches:
        k, n = _numbers(b, "key", "node")
        if not len(k):
            continue
        k, n = np.concatenate([key, k]), np.concatenate([node, n])
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (n[1:] != n[:-1])
        k, n = k[new], n[new]
        same = k[1:] == k[:-1]
        met = np.zeros(len(k), bool)
        met[1:] |= same
        met[:-1] |= same
        met[0] |= waits
        yield rows(k[:-1][met[:-1]], n[:-1][met[:-1]])
        key, node, waits = k[-1:], n[-1:], bool(met[-1])
    if waits:
        yield rows(key, node)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, size_class) of rows (key, node) sorted by both.

    All pairs in keys of up to FEW nodes; in a larger one, its first node with each of the others.
    The rows of a key that a batch cuts wait for the next one: up to FEW, or the first alone.
    """
    key, node = np.empty(0, np.int64), np.empty(0, np.int64)
    crowded = False  # whether the key that waits is known to be a larger one; its first node waits alone

    def pairs(k: np.ndarray, n: np.ndarray, first_is_crowded: bool) -> pd.DataFrame:
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.concatenate([start, [len(k)]]))
        hub, many = np.repeat(start, size), np.repeat(size > FEW, size)
        if first_is_crowded:
            many[: size[0]] = True
        left, right = [hub[many]], [np.flatnonzero(many)]
        for d in range(1, FEW):
            i = np.flatnonzero((k[d:] == k[:-d]) & ~many[d:])
            left.append(i)
            right.append(i + d)
        p, q = np.concatenate(left), np.concatenate(right)
        p, q = p[p != q], q[p != q]
        return pd.DataFrame({"a": np.minimum(n[p], n[q]), "b": np.maximum(n[p], n[q]), "size_class": k[p] & 63}).drop_duplicates()

    def out(x: pd.DataFrame) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x["a"].to_numpy()), pa.array(x["b"].to_numpy()), pa.array(x["size_class"].to_numpy().astype(np.int32))], names=["a", "b", "size_class"])

    for b in batches:
        k, n = _numbers(b, "key", "node")
        if not len(k):
            continue
        k, n = np.concatenate([key, k]), np.concatenate([node, n])
        last = int(np.searchsorted(k, k[-1]))
        tail_crowded = (crowded and last == 0) or len(k) - last > FEW
        if tail_crowded:
            yield out(pairs(k, n, (crowded and len(key) > 0) or last == 0))
            key, node, crowded = k[last : last + 1], n[last : last + 1], True
        else:
            if last:
                yield out(pairs(k[:last], n[:last], crowded))
            key, node, crowded = k[last:], n[last:], False
    if len(key) > 1:
        yield out(pairs(key, node, crowded))


def _sets(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Rows (node, n, frag, elements)."""
    columns = ["node", "n", "frag", "elements"]
    for batch in batches:
        rows, size = [], 0
        for text in batch["text"]:
            s = shingles(text, k)
            node = digest(s)
            cut = np.searchsorted((s >> np.uint64(32)) * np.uint64(COUNT_FRAGMENTS) >> np.uint64(32), np.arange(COUNT_FRAGMENTS + 1, dtype=np.uint64))
            rows += [(node, len(s), f, s[cut[f] : cut[f + 1]].view(np.int64)) for f in range(COUNT_FRAGMENTS)]
            size += len(s)
            if size >= ELEMENTS:
                yield pd.DataFrame(rows, columns=columns)
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)
    release()


def _may_link(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Pairs whose sizes and sketches don't rule them out."""
    for x in batches:
        na, nb = x["na"].to_numpy(), x["nb"].to_numpy()
        most = max_difference(na + nb, percent)
        unlike = np.fromiter(((int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count() for a, b in zip(x["sa"], x["sb"], strict=True)), np.int64, len(x))
        yield x.loc[(unlike <= most) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)), ["a", "b"]]


def _joined(comp: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (p, q) of rows join classes that aren't joined yet, and the classes after that."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while x in root:
            x = root[x]
        return x

    joins = np.zeros(len(p), bool)
    for i, (x, y) in enumerate(zip(comp[p].tolist(), comp[q].tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            joins[i] = True
    names, place = np.unique(comp, return_inverse=True)
    return joins, np.array([find(x) for x in names.tolist()], dtype=comp.dtype)[place]


def _pairs_of_run(x: pd.DataFrame, percent: int, forest: bool) -> Iterator[pd.DataFrame]:
    """Pairs between classes within each group of sorted rows that sketches don't rule out.

    forest: only pairs that join classes which earlier ones haven't joined, as if all were links.
    """
    for _, part in x.groupby("size_class", sort=False):
        bits = np.frombuffer(b"".join(part["sketch"]), np.uint64).reshape(len(part), -1)
        group, node, comp, n = (part[c].to_numpy() for c in ("group", "node", "comp", "n"))
        side = part["side"].to_numpy()
        largest = int(pd.Series(group).value_counts().max())
        step = max(1, 1_000_000 // max(1, bits.shape[1]))
        for d in range(1, largest):
            left = np.flatnonzero((group[:-d] == group[d:]) & (comp[:-d] != comp[d:]))
            right = left + d
            small, large = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
            keep = (100 * small >= percent * large) & ((side[left] == 0) | (side[left] != side[right]))
            left, right = left[keep], right[keep]
            for i in range(0, len(left), step):
                p, q = left[i : i + step], right[i : i + step]
                unlike = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype=np.int64)
                ok = unlike <= max_difference(n[p] + n[q], percent)
                p, q = p[ok], q[ok]
                if forest and len(p):
                    joins, comp = _joined(comp, p, q)
                    p, q = p[joins], q[joins]
                if len(p):
                    yield pd.DataFrame({"a": np.minimum(node[p], node[q]), "b": np.maximum(node[p], node[q])})


def _between_classes(batches: Iterator[pd.DataFrame], percent: int, forest: bool) -> Iterator[pd.DataFrame]:
    """Rows come sorted by group; a group that a batch cuts is finished with the next one."""
    rest = None
    for x in batches:
        x = x if rest is None else pd.concat([rest, x], ignore_index=True)
        if len(x):
            x["group"] = (x[["key", "low", "high"]].ne(x[["key", "low", "high"]].shift())).any(axis=1).cumsum()
            last = x["group"].to_numpy() == x["group"].iloc[-1]
            rest = x[last].copy()
            found = list(_pairs_of_run(x[~last], percent, forest)) if not last.all() else []
            if found:
                yield pd.concat(found).drop_duplicates()
    if rest is not None and len(rest):
        yield from _pairs_of_run(rest, percent, forest)
    del rest
    release()


def connected(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node in edges (a, b): contraction to the least neighbour in a hashed order.

    Each round replaces a node by the least of itself and its neighbours and drops what became a
    loop; the hashed order makes the number of nodes fall by a factor each round, chains included.
    Tables of a round go when the next one has been written.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges")
    roots = None
    while not edges.isEmpty():
        step = both(edges).groupBy("a").agg(F.min(order("b")).alias("m")).select("a", F.when(F.col("m") < order("a"), F.col("m.v")).otherwise(F.col("a")).alias("to"))
        step = written(step, f"{name}-step")
        if roots is None:
            roots, old = written(step.select(F.col("a").alias("node"), F.col("to").alias("root")), f"{name}-roots"), None
        else:
            roots, old = written(roots.join(step.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"{name}-roots"), roots
        moved = edges.join(step.withColumnRenamed("to", "ta"), "a").join(step.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b")
        after = written(moved.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), f"{name}-edges")
        dropped(edges, step, old)
        edges = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link: overlaps counted in each fragment apart, summed per pair."""
    side = lambda p: sets.select(F.col("node").alias(p), "frag", F.col("n").alias(f"n{p}"), F.col("elements").alias(f"e{p}"))
    partial = pairs.join(side("a"), "a").join(side("b"), ["b", "frag"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ea", "eb")).cast("long").alias("overlap"))
    total = partial.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return total.where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")


class _Links:
    """The classes that verified pairs make."""

    def __init__(self, base: DataFrame, nodes: DataFrame, k: int, percent: int, name: str):
        self.base, self.nodes, self.k, self.percent, self.name = base, nodes, k, percent, name
        self.roots: DataFrame | None = None

    def _sets(self, pairs: DataFrame) -> DataFrame:
        """The sets of the nodes in pairs, from the texts that stand for them."""
        k = self.k
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = written(self.nodes.select("node", "doc_id").join(wanted, "node"), f"{self.name}-wanted")
        texts = self.base.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
        sets = texts.mapInPandas(lambda it: _sets(it, k), "node long, n long, frag int, elements array<long>")
        sets = written(sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node", "frag"]), f"{self.name}-sets")
        dropped(wanted)
        return sets

    def between(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, ra, rb) whose nodes are in different classes."""
        if self.roots is None:
            return pairs.select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb"))
        root = lambda p: self.roots.select(F.col("node").alias(p), F.col("root").alias(f"r{p}"))
        out = pairs.select("a", "b").join(root("a"), "a", "left").join(root("b"), "b", "left")
        return out.select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")).where("ra <> rb")

    def add(self, pairs: DataFrame) -> None:
        """Verify a written table of pairs (a, b) and join the classes of those that link; the table goes.

        First every class verifies its pair to the class that is least in a hashed order: where near
        copies all pair with one another, that is one pair for each of them. All that are left follow.
        """
        if pairs.isEmpty():
            return dropped(pairs)
        sets = self._sets(pairs)
        between = written(self.between(pairs), f"{self.name}-between")
        dropped(pairs)
        ends = between.select("a", "b", F.col("ra").alias("r"), F.col("rb").alias("to")).union(between.select("a", "b", "rb", "ra"))
        chosen = ends.groupBy("r").agg(F.min(F.struct(F.xxhash64("to").alias("h"), "a", "b")).alias("m")).select("m.a", "m.b").distinct()
        chosen = written(chosen, f"{self.name}-chosen")
        self._join(_verified(chosen, sets, self.percent))
        left = written(self.between(between.join(chosen, ["a", "b"], "left_anti")), f"{self.name}-left")
        dropped(between, chosen)
        if not left.isEmpty():
            self._join(_verified(left, sets, self.percent))
        return dropped(left, sets)

    def _join(self, links: DataFrame) -> None:
        """Join classes by links (a, b): roots are contracted, nodes follow their roots."""
        joined = connected(self.between(links).select(F.col("ra").alias("a"), F.col("rb").alias("b")), self.name)
        old = self.roots
        if old is None:
            self.roots = joined
            return
        to = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
        moved = old.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        self.roots = written(moved.union(joined.join(old, "node", "left_anti").select("node", "root")), f"{self.name}-classes")
        dropped(old, joined)


def _signed(nodes: DataFrame) -> DataFrame:
    """(node, n, size_class, sketch): a row for each class that a node takes part in."""
    return nodes.select("node", "n", F.explode(F.arrays_zip("classes", "sketches")).alias("x")).select("node", "n", F.col("x.classes").alias("size_class"), F.col("x.sketches").alias("sketch"))


def _size_class(key: str) -> Column:
    return F.col(key).bitwiseAND(F.lit(63)).cast("int")


def _rest(crowded: DataFrame, links: _Links, percent: int, forest: bool, name: str) -> DataFrame:
    """Pairs (a, b) between classes in larger keys that hold more than one, in blocks."""
    now = crowded
    if links.roots is not None:
        now = now.join(links.roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    else:
        now = now.select("key", "node", F.col("node").alias("comp"))
    open_keys = now.groupBy("key").agg(F.count("*").alias("rows"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    open_keys = open_keys.select("key", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    dealt = now.join(open_keys, "key").withColumn("size_class", _size_class("key")).join(_signed(links.nodes), ["node", "size_class"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select("size_class", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "comp", "n", side.alias("side"), "sketch")
    by_class = ["size_class", "key", "low", "high"]
    found = dealt.repartition(*by_class).sortWithinPartitions(*by_class)
    return written(found.mapInPandas(lambda it: _between_classes(it, percent, forest), "a long, b long").distinct(), f"{name}-rest")


def link_classes(docs: DataFrame, k: int = 5, percent: int = 80, name: str = "jaccard") -> DataFrame:
    """(doc_id, n_shingles, component_id) for documents (doc_id, text): see the module's text.

    k: words of a shingle; percent: two sets link when 100 * |intersection| >= percent * |union|.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = written(base.mapInArrow(lambda it: _described(it, k, percent), "doc_id long, n long, node long, classes array<int>, sketches array<binary>"), f"{name}-described")
    rows = written(described.select("doc_id", "n", "node"), f"{name}-rows")
    nodes = described.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first(F.struct("classes", "sketches")).alias("x"))
    nodes = written(nodes.select("node", "doc_id", "n", "x.classes", "x.sketches"), f"{name}-nodes")
    dropped(described)

    keyed = base.where("doc_id is not null").select("text").mapInArrow(lambda it: _keyed(it, k, percent), "key long, node long")
    shared = written(keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_met, "key long, node long"), f"{name}-shared", batch=100_000)

    pairs = shared.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_pairs, "a long, b long, size_class int").distinct()
    pairs = written(pairs, f"{name}-pairs", batch=100_000)
    many = shared.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > FEW).select("key")
    crowded = written(shared.join(many, "key"), f"{name}-crowded")
    dropped(shared)

    side = lambda p: _signed(nodes).select(F.col("node").alias(p), F.col("n").alias(f"n{p}"), "size_class", F.col("sketch").alias(f"s{p}"))
    likely = pairs.join(side("a"), ["a", "size_class"]).join(side("b"), ["b", "size_class"])
    likely = written(likely.mapInPandas(lambda it: _may_link(it, percent), "a long, b long").distinct(), f"{name}-likely")
    dropped(pairs)
    links = _Links(base, nodes, k, percent, name)
    links.add(likely)
    # first pairs that would join classes if they link, then all that are left between classes
    for forest in (True, False):
        links.add(_rest(crowded, links, percent, forest, name))
    dropped(crowded)

    known = nodes.select("node", "doc_id")
    if links.roots is not None:
        member = known.join(links.roots, "node")
        least = member.groupBy("root").agg(F.min("doc_id").alias("component"))
        component = written(links.roots.join(least, "root").select("node", "component"), f"{name}-members")
        known = known.join(component, "node", "left").select("node", F.coalesce("component", "doc_id").alias("component"))
    else:
        known = known.select("node", F.col("doc_id").alias("component"))
    known = written(known, f"{name}-components")
    dropped(nodes, links.roots)
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(known, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
