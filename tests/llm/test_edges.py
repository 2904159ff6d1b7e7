"""Every operator and stage on empty tables, nulls, repeats and clashing columns; registered queries against brute force."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from pactum.llm import bpe, common, jaccard_join, langid_gru, mixing, mpeg_audio, quality_nbsvm, queries, secrets, token_store, toxicity_crf

WORDS, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Names that operators and stages use for columns of their own.
CLASHES = ("left", "part", "prefix", "whole", "found_in", "live_values", "gone", "repeated", "values", "key", "id", "times", "stands", "its", "room", "place", "copies", "document", "node", "n", "score", "spans", "found", "media", "ids", "component_id", "row", "size", "draw")
BIG = (1 << 62) + 1


@pytest.fixture(scope="module")
def table(spark):
    """Rows with nulls in any column, repeats, a very long text, ids beyond 2^53 and columns of clashing names."""
    texts = ["The quick fox went over to the house with this thing, and then it came back again to the same place.", "Der schnelle Fuchs ging zu dem Haus und kam dann wieder an die gleiche Stelle zurück, wo er war."]
    rows = [(i, texts[i % 2] + f" number {i}", "en" if i % 2 == 0 else "de", "ab"[i % 2]) for i in range(40)]
    rows += [(100, texts[0], "en", "a"), (100, texts[0], "en", "a"), (101, texts[0], None, None), (None, texts[1], "de", "b"), (None, None, None, None), (102, None, "en", "a"), (103, "", "en", "b"), (104, " \n", "en", None), (BIG, "secret = abcdefghijklmnop " + "long words " * 20_000, "en", "a")]
    made = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return made.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


@pytest.fixture(scope="module")
def made(table):
    return models(table)


def models(docs):
    labels = docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    return toxicity_crf.train(docs, labels, "toxic"), quality_nbsvm.train(docs, labels, "quality"), langid_gru.fit(["abc"] * 3 + ["xyz"] * 3, ["l"] * 3 + ["r"] * 3, rounds=5)


OPERATORS = {
    "op1": lambda d, m: toxicity_crf.score(d, m[0]),
    "op2": lambda d, m: quality_nbsvm.score(d, m[1]),
    "op4": lambda d, m: langid_gru.predict(d, m[2]),
    "op5": lambda d, m: token_store.read_documents(token_store.write_shards(d, WORDS)),
    "op6": lambda d, m: secrets.judge(d),
    "op6 redact": lambda d, m: secrets.redact(d),
    "op7": lambda d, m: bpe.decode(bpe.encode(d, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN),
    "op8": lambda d, m: mpeg_audio.inspect(mpeg_audio.store(d), "doc_id"),
    "op9": lambda d, m: jaccard_join.link_classes(d),
    "op10": lambda d, m: mixing.mix(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_on_odd_rows(spark, table, made, name):
    """A row for each row, whatever its columns hold; none for none."""
    got = OPERATORS[name](table, made).collect()
    assert len(got) == table.count()
    want = sorted(str(r.doc_id) for r in table.select("doc_id").collect())
    assert sorted(str(r.doc_id) for r in got) == want  # ids beyond 2^53 stay whole beside nulls
    assert OPERATORS[name](table.limit(0), made).count() == 0


def test_models_without_rows(spark, table):
    made = models(table.limit(0))
    for name in ("op1", "op2", "op4"):
        assert OPERATORS[name](table, made).count() == table.count()
    assert langid_gru.train(table.limit(0), table.limit(0).select("doc_id", "lang")).languages == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, table, name, stage):
    kept = stage(spark, table, "")
    if name != "tokens":
        assert kept.columns == table.columns
    rows = kept.collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in table.select("doc_id").collect()}
    if name in ("secrets", "tokens"):
        assert len(rows) == table.count()
    if name == "near_duplicates":
        assert sum(r.doc_id == 100 for r in rows) <= 1 and sum(r.doc_id is None for r in rows) == 2 and {102, 103, 104, BIG} <= {r.doc_id for r in rows}
    if name == "secrets":
        assert next(r.text for r in rows if r.doc_id == BIG).startswith("<SECRET> long")
        assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert stage(spark, table.limit(0), "").count() == 0


# --- mixing ----------------------------------------------------------------------------------


def test_repeated_rows_are_taken_as_far_as_they_fit(spark):
    """A thousand equal rows end within one row of the target, in the operator and in the stage."""
    rows = [(7, "w " * 10, "b")] * 1000 + [(i, "w " * 10, "a") for i in range(1000, 1040)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(docs).collect()
    for source in "ab":
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 10
        assert max(r.copies for r in mine) <= 3
    again = mixing.mixed(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in again}[7] * 10 == sum(r.taken for r in got if r.doc_id == 7)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, got))


def brute_mix(rows, weights=(5, 2, 1), most=3.0):
    """(doc_id, taken) by sorting: rows (doc_id, source, size, draw)."""
    sizes = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}

    def filled(goal, weight, limit):
        units, closed = 0.0, set()
        while True:
            rest = sum(w for k, w in weight.items() if k not in closed)
            if not rest:
                return math.inf
            units = (goal - sum(limit[k] for k in closed)) / rest
            over = {k for k in weight if k not in closed and units * weight[k] >= limit[k]}
            if not over:
                return units
            closed |= over

    units = filled(sum(sizes.values()), weight, {s: most * n for s, n in sizes.items()})
    taken, targets = {}, {}
    for s in order:
        target = targets[s] = min(most * sizes[s], units * weight[s])
        mine = [(i, n, d) for i, x, n, d in rows if x == s]
        by = {}
        for _, n, _ in mine:
            by[n.bit_length()] = by.get(n.bit_length(), 0) + n
        per = filled(target, {c: w * max(c, 1) for c, w in by.items()}, {c: most * w for c, w in by.items()})
        expected = {c: min(most, per * max(c, 1)) for c in by}
        whole = {c: min(int(expected[c] + 1e-9), 3) for c in by}
        left = target - sum(whole[c] * by[c] for c in by)
        ranked = []
        for i, n, d in mine:
            taken[i] = whole[n.bit_length()] * n
            p = expected[n.bit_length()] - whole[n.bit_length()]
            u = ((d % (1 << 64) >> 12) % (1 << 52) + 0.5) / (1 << 52)
            if p > 0:
                ranked.append(((u / (1 - u)) / (max(p, 1e-12) / max(1 - p, 1e-12)), i, n))
        for _, i, n in sorted(ranked):
            if n > left:
                taken[i] += n if n <= 2 * left else 0
                break
            taken[i] += n
            left -= n
    return taken, targets


def test_op10_equals_sorting(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", mixing.words(), mixing._draw(7)).collect()]
    taken, targets = brute_mix(rows)
    for r in queries.QUERIES["op10_mixing"](spark, sf_dir).collect():
        source = next(s for i, s, _, _ in rows if i == r.doc_id)
        assert (r.size, r.target) == (next(n for i, _, n, _ in rows if i == r.doc_id), pytest.approx(targets[source]))
        assert r.taken == taken[r.doc_id]


def test_inclusion_follows_its_odds(spark):
    """Over many draws, documents of a class are included as often as they are expected."""
    rows = [(i, "w " * (2 if i % 2 else 200), "a" if i < 200 else "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = docs.select("source", mixing.words().alias("size"), F.lit(0).cast("long").alias("draw"))
    expected = {(r.its, r.its_class): r.whole + r.part for r in mixing.plan(common.written(sized, "t"))[0].collect()}
    seen = {}
    for seed in range(6):
        for r in mixing.mix(docs, seed=seed).collect():
            seen.setdefault((r.source, r["size"].bit_length()), []).append(r.copies)
    assert len({round(v, 3) for v in expected.values()}) > 2
    for k, copies in seen.items():
        assert np.mean(copies) == pytest.approx(expected[k], abs=0.1)


def test_mixing_needs_no_python(spark, sf_dir):
    plan = queries.QUERIES["op10_mixing"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- registered queries against brute force --------------------------------------------------


def test_op3_equals_all_rows(spark, sf_dir):
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    ids, m = np.array(list(x)), np.stack(list(x.values()))
    got = {}
    for r in queries.QUERIES["op3_ann_multiprobe"](spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {i for i in x if i % 20 == 0}
    hits = []
    for q, rows in got.items():
        score = dict(zip(ids.tolist(), (m @ x[q]).tolist(), strict=True))
        rows.sort(key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, 21)) and all(r.score == pytest.approx(score[r.vec_id], abs=1e-12) for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hits.append(len({r.vec_id for r in rows} & set(sorted((i for i in x if i != q), key=lambda i: (-score[i], i))[:20])) / 20)
    assert np.mean(hits) >= 0.9


def test_op5_equals_the_library(spark, sf_dir):
    library = Tokenizer.from_file(WORDS)
    at = 0
    rows = {r.doc_id: r for r in queries.QUERIES["op5_token_store"](spark, sf_dir).collect()}
    for doc_id, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (rows[doc_id].start, rows[doc_id].n_tokens, rows[doc_id].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op7_equals_the_library(spark, sf_dir):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r.doc_id: r for r in queries.QUERIES["op7_byte_bpe"](spark, sf_dir).collect()}
    for doc_id, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(text or "")
        assert (rows[doc_id].n_tokens, rows[doc_id].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert rows[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_op8_equals_the_payload(spark, sf_dir):
    rows = {r.doc_id: r for r in queries.QUERIES["op8_mpeg_audio"](spark, sf_dir).collect()}
    for doc_id, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = rows[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = mpeg_audio.encode(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        places = [int(x) for x in r.frame_offsets.split(",")]
        assert len(places) == r.frames and all(media[p] == 0xFF for p in places) and r.duration_us == r.frames * 24_000


def test_op6_counts_and_spans(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    judged = {r.doc_id: r.spans or [] for r in secrets.judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    holders = {}
    for i, text in docs.items():
        for _, _, _, value, _ in secrets.find(text):
            holders.setdefault(value, set()).add(i)
    for r in queries.QUERIES["op6_secrets"](spark, sf_dir).collect():
        spans = judged[r.doc_id]
        base = [s for s in spans if s.base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.kind == k for s in base) for k in ("assign", "access", "hex"))
        assert r.spans == ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)
        assert all(s.repositories == len(holders[s.value_hash]) for s in spans)
