"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

``TABLES`` hash tables each cut space by ``HASHES`` Gaussian (2-stable), mutually orthogonal
projections into slots of one width. Every vector stands in one bucket of each table. A query
visits, in each table, its own bucket and the ``PROBES`` - 1 perturbed ones that are likeliest
to hold neighbours: a perturbation moves some coordinates to the next slot on either side, and
its estimated success falls with the sum of squared distances from the query to the crossed
slot boundaries. Candidates of all tables are merged and ranked by the exact inner product
in double precision.

Inner products become Euclidean neighbours by one more coordinate, sqrt(M^2 - |x|^2), 0 for
queries, which are scaled to norm M. Rows are put in bands of nearly equal norm (a ratio of
``BAND``), and M is the largest norm of a row's band: one long vector changes no other band.
Divided by M, rows and queries are unit vectors, so one slot width and one set of probes
serve all bands.

The number of probes is measured on the table: the true neighbours of up to ``SAMPLE`` queries
are found by comparison with all rows, and all queries probe as many buckets (``PROBES`` at
least) as find ``RECALL`` of them. If all buckets next to a query's don't, every query is
compared with all rows.

Buckets are dealt to parts of about ``PART`` rows; a bucket above that is cut into blocks that
each meet its queries, so no task holds an unbounded bucket. A query's k-th best score so far
rules rows out as they are met; scores of what is left are summed again in one fixed order, so
that equal vectors have equal scores whichever task met them. A query that finds fewer than k
candidates is compared with all rows, block by block.

Defined results: vectors that are null, zero, of another dimension than most, or that hold a
null or non-finite component take no part, as queries or candidates; ties go to the smaller
vec_id; rows without vec_id take no part; rows of one vec_id are one vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from pactum.llm.common import dropped, written

TABLES, HASHES, PROBES, WIDTH = 6, 8, 60, 2.4
#: Share of the sampled queries' true neighbours that probing has to find, queries sampled, ratio of norms in a band.
RECALL, SAMPLE, BAND = 0.95, 200, 1.05
PART = 50_000
_OUT = "query_id long, vec_id long, score double"


class Hashes:
    """The projections of all tables, and the probes of queries."""

    def __init__(self, dims: int, tables: int, hashes: int, probes: int, width: float, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.tables, self.probes = tables, probes
        hashes = min(hashes, dims + 1)
        self.moves = np.array(list(product((-1, 0, 1), repeat=hashes)), dtype=np.int64)
        draw = [np.linalg.qr(rng.standard_normal((dims + 1, hashes)))[0] for _ in range(tables)]
        self.axes = np.stack(draw)
        self.width = width / np.sqrt(dims)
        self.shift = rng.random((tables, hashes)) * self.width

    def _places(self, x: np.ndarray, table: int) -> np.ndarray:
        return (x @ self.axes[table] + self.shift[table]) / self.width

    @staticmethod
    def _code(slots: np.ndarray) -> np.ndarray:
        out = np.zeros(slots.shape[:-1], np.uint64)
        for i in range(slots.shape[-1]):
            out = (out ^ slots[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def buckets(self, x: np.ndarray, largest: np.ndarray, table: int) -> np.ndarray:
        """Bucket of each row; largest: the largest norm of its band."""
        x = x / np.where(largest > 0, largest, 1)[:, None]
        rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
        return self._code(np.floor(self._places(np.column_stack([x, rest]), table)))

    def probe(self, q: np.ndarray, table: int, probes: int | None = None) -> np.ndarray:
        """(queries, probes): buckets in the order of their estimated success."""
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        place = self._places(np.column_stack([q, np.zeros(len(q))]), table)
        slot = np.floor(place)
        inside = place - slot
        cost = np.stack([inside, np.zeros_like(inside), 1 - inside], axis=2) ** 2
        out = np.empty((len(q), min(probes or self.probes, len(self.moves))), np.int64)
        for i in range(0, len(q), 256):
            total = sum(cost[i : i + 256, j][:, self.moves[:, j] + 1] for j in range(self.moves.shape[1]))
            best = np.argsort(total, axis=1, kind="stable")[:, : out.shape[1]]
            out[i : i + 256] = self._code(slot[i : i + 256, None] + self.moves[best])
        return out


    def probes_needed(self, q: np.ndarray, near: list[np.ndarray], largest: list[np.ndarray], recall: float) -> int | None:
        """The least number of probes that finds ``recall`` of the neighbours ``near`` of the queries q; None if all probes don't."""
        most = len(self.moves)
        first = [np.full(len(x), most) for x in near]
        for t in range(self.tables):
            for i, (x, m) in enumerate(zip(near, largest, strict=True)):
                met = self.probe(q[i : i + 1], t, most)[0] == self.buckets(x, m, t)[:, None]
                first[i] = np.minimum(first[i], np.where(met.any(axis=1), met.argmax(axis=1), most))
        found = np.sort(np.concatenate(first))
        last = int(found[int(np.ceil(recall * len(found))) - 1])
        return last + 1 if last < most else None


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_list()).astype(np.float64) if len(v) else np.empty((0, 0))


class _Best:
    """The k best rows of each query of a block, found so far; what is below a query's k-th score falls at once."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int):
        self.x, self.ids, self.q, self.own, self.k = x, ids, q, own, k
        self.row, self.col, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.least = np.full(len(q), -np.inf)
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        # products of matrices round differently from shape to shape: what is this near counts as equal until it is rescored
        self.slack = 8 * np.finfo(np.float64).eps * x.shape[1] * np.linalg.norm(q, axis=1) * (np.linalg.norm(x, axis=1).max() if len(x) else 0.0)

    def meet(self, who: np.ndarray, start: int, end: int) -> None:
        """Score the rows start to end for the queries who."""
        score = self.q[who] @ self.x[start:end].T
        r, c = np.nonzero(score >= (self.least - self.slack)[who][:, None])
        if len(r):
            self.pending.append((who[r], c + start, score[r, c]))
            self.held += len(r)
            if self.held > 8 * self.k * len(self.q):
                self.shrink()

    def shrink(self) -> None:
        row, col, score = (np.concatenate([a, *b]) for a, b in zip((self.row, self.col, self.score), zip(*self.pending, strict=True), strict=True)) if self.pending else (self.row, self.col, self.score)
        keep = self.ids[col] != self.own[row]
        row, col, score = row[keep], col[keep], score[keep]
        order = np.lexsort((-score, row))
        row, col, score = row[order], col[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        full = rank == self.k - 1
        self.least[row[full]] = score[full]
        keep = score >= (self.least - self.slack)[row]
        self.row, self.col, self.score, self.pending, self.held = row[keep], col[keep], score[keep], [], 0

    def result(self) -> pd.DataFrame:
        """The k best by scores summed in one order, so that equal vectors score alike; ties to the smaller vec_id."""
        self.shrink()
        score = np.concatenate([np.empty(0), *[(self.x[self.col[i : i + 4096]] * self.q[self.row[i : i + 4096]]).sum(axis=1) for i in range(0, len(self.row), 4096)]])
        ids = self.ids[self.col]
        order = np.lexsort((ids, -score, self.row))
        row, ids, score = self.row[order], ids[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        return pd.DataFrame({"query_id": self.own[row[keep]], "vec_id": ids[keep], "score": score[keep]})


def _nearest(base: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of each query among the base rows in the buckets that it probes (all, if it names none)."""
    none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if not len(base) or not len(queries):
        return none
    base = base.sort_values(["bucket", "vec_id"], kind="stable")
    x, q = _matrix(base["v"]), _matrix(queries["v"])
    bucket, ids, own = base["bucket"].to_numpy(), base["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
    names, starts = np.unique(bucket, return_index=True)
    ends = np.append(starts[1:], len(bucket))
    probes = queries["probes"].to_list()
    out = []
    for i in range(0, len(q), 512):
        best = _Best(x, ids, q[i : i + 512], own[i : i + 512], k)
        counts = [len(p) for p in probes[i : i + 512]]
        everywhere = np.array([j for j, n in enumerate(counts) if not n], np.int64)
        if len(everywhere):
            for a in range(0, len(x), 1024):
                best.meet(everywhere, a, min(a + 1024, len(x)))
        if any(counts):
            who = np.repeat(np.arange(len(counts)), counts)
            what = np.concatenate([p for p in probes[i : i + 512] if len(p)])
            at = np.minimum(np.searchsorted(names, what), len(names) - 1)
            hit = names[at] == what
            who, at = who[hit], at[hit]
            order = np.argsort(at, kind="stable")
            who, at = who[order], at[order]
            cut = np.flatnonzero(np.diff(at, prepend=-1, append=-2))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                for start in range(starts[at[a]], ends[at[a]], 1024):
                    best.meet(who[a:b], start, min(start + 1024, ends[at[a]]))
        out.append(best.result())
    return pd.concat(out) if out else none


def _top(found: DataFrame, k: int) -> DataFrame:
    """k best of each query; a query has at most k rows of each part and table."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _enough(rows: DataFrame, family: Hashes, k: int, recall: float, sample: int) -> int | None:
    """Probes that reach ``recall`` on sampled queries of rows (vec_id, v, asks, largest); None: no number does."""
    asked = rows.where("asks").select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not asked:
        return family.probes
    own, q = np.array([r["vec_id"] for r in asked]), np.array([r["v"] for r in asked])
    shared = rows.sparkSession.sparkContext.broadcast((own, q))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k best of a task's rows for each sampled query."""
        own, q = shared.value
        asking = pd.DataFrame({"vec_id": own, "v": list(q), "probes": [np.empty(0, np.int64)] * len(own)})
        best = None
        for b in batches:
            got = _nearest(b.assign(bucket=0), asking, k)
            best = got if best is None else pd.concat([best, got]).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        if best is not None:
            yield best

    true = _top(rows.select("vec_id", "v").mapInPandas(scan, _OUT), k).collect()  # k of each sampled query
    if not true:
        return family.probes
    met = rows.where(F.col("vec_id").isin(list({r["vec_id"] for r in true}))).select("vec_id", "v", "largest").collect()
    vector, largest = {r["vec_id"]: r["v"] for r in met}, {r["vec_id"]: r["largest"] for r in met}
    near: dict[int, list[int]] = {}
    for r in true:
        near.setdefault(r["query_id"], []).append(r["vec_id"])
    at = {x: i for i, x in enumerate(own.tolist())}
    return family.probes_needed(q[[at[x] for x in near]], [np.array([vector[i] for i in x]) for x in near.values()], [np.array([largest[i] for i in x]) for x in near.values()], recall)


def search(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, width: float = WIDTH, part: int = PART, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) for vectors (vec_id, embedding); is_query is a condition on them."""
    # single precision travels as it is: double precision of it is exact
    kind = "float" if vectors.schema["embedding"].dataType.elementType == FloatType() else "double"
    v = F.col("embedding").cast(f"array<{kind}>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda e: e != 0.0)).dropDuplicates(["vec_id"])
    rows = written(rows.withColumn("dims", F.size("v")).withColumn("square", F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))), "ann-vectors")
    common = rows.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    if common is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = rows
    rows = rows.where(F.col("dims") == common["dims"]).withColumn("band", F.round(F.log(F.greatest("square", F.lit(1e-300))) / (2 * np.log(BAND))))
    # doubles span some 14,000 bands at most
    bands = rows.groupBy("band").agg(F.sqrt(F.max("square")).alias("largest"))
    rows = written(rows.join(F.broadcast(bands), "band").select("vec_id", "v", "asks", "largest"), "ann-bands")
    dropped(found)
    n = common["n"]
    family = Hashes(common["dims"], tables, hashes, probes, width)
    enough = _enough(rows, family, k, recall, sample)
    family.probes = max(probes, enough or 0)
    shared = rows.sparkSession.sparkContext.broadcast(family)
    parts = max(1, -(-n // part))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _matrix(b["v"])
                for t in range(tables):
                    code = shared.value.buckets(x, b["largest"].to_numpy(), t)
                    yield pd.DataFrame({"tab": np.int32(t), "part": (code % parts).astype(np.int32), "bucket": code, "vec_id": b["vec_id"], "v": b["v"]})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                q = _matrix(b["v"])
                for t in range(tables):
                    code = shared.value.probe(q, t)
                    where = code % parts
                    out = [(t, int(p), i, x, codes[at == p]) for i, x, codes, at in zip(b["vec_id"], b["v"], code, where, strict=True) for p in np.unique(at)]
                    yield pd.DataFrame(out, columns=["tab", "part", "vec_id", "v", "probes"])

    base = rows.select("vec_id", "v", "largest").mapInPandas(index, f"tab int, part int, bucket long, vec_id long, v array<{kind}>")
    # where no number of probes is enough, none of the queries probes and all rows are met below
    asked = rows.where(F.col("asks") & F.lit(enough is not None)).select("vec_id", "v").mapInPandas(probe, f"tab int, part int, vec_id long, v array<{kind}>, probes array<long>")
    # buckets above a part's size are cut into blocks; there are at most tables * n / part of them
    large = written(base.groupBy("tab", "part", "bucket").count().where(F.col("count") > part).select("tab", "part", "bucket", F.ceil(F.col("count") / part).cast("int").alias("blocks")), "ann-large")
    if large.isEmpty():
        base, asked = base.withColumn("block", F.lit(0)), asked.withColumn("block", F.lit(0))
    else:
        base = base.join(large, ["tab", "part", "bucket"], "left").withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).cast("int")).drop("blocks")
        again = asked.select("tab", "part", "vec_id", "v", F.explode("probes").alias("bucket")).join(large, ["tab", "part", "bucket"]).where("blocks > 1")
        again = again.select("tab", "part", "vec_id", "v", F.array("bucket").alias("probes"), F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("block"))
        asked = asked.withColumn("block", F.lit(0)).unionByName(again)
    key = ["tab", "part", "block"]
    meet = lambda b, q: b.groupBy(*key).cogroup(q.groupBy(*key)).applyInPandas(lambda x, y: _nearest(x, y, k), _OUT)
    found = written(_top(meet(base, asked), k), "ann-found")

    # fewer than k found: compare with all rows
    full = found.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1)).select(F.col("query_id").alias("vec_id"))
    short = written(rows.where("asks").select("vec_id", "v").join(full, "vec_id", "left_anti"), "ann-short")
    if not short.isEmpty():
        blocks = F.sequence(F.lit(0), F.lit(parts - 1))
        spread = rows.select(F.lit(0).alias("tab"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("block"), F.lit(0).cast("long").alias("bucket"), "vec_id", "v")
        ask = short.select(F.lit(0).alias("tab"), F.explode(blocks).alias("part"), F.lit(0).alias("block"), "vec_id", "v", F.array().cast("array<long>").alias("probes"))
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(_top(meet(spread, ask), k))
    return found
