"""Operators on small tables with nulls, ties and clashing columns, against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactum.llm import ann_multiprobe, common, jaccard_join, mixing, queries, secrets, shingles, token_store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.5, 1) for i, t, s in rows], SCHEMA)


BASE = " ".join(f"w{i}" for i in range(60))
ODD = [
    (1, BASE, "a"), (2, BASE, "a"), (3, BASE + " tail", "b"), (4, BASE.replace("w30", "x"), "b"), (5, None, None), (6, "", "a"), (7, " \n", "a"),
    (8, "one two", "b"), (9, "ONE\ttwo", "c"), (9, "ONE\ttwo", "c"), (None, BASE, "c"), (10, "long " * 30_000, None), (11, "token = abcdefghijklmnop", "b"), (12, "token = abcdefghijklmnop", "c"),
]


def brute_classes(rows, k, percent):
    sets = [set(shingles.shingles(t, k).tolist()) if i is not None else set() for i, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)) or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], None if r[0] is None else least[find(i)]) for i, r in enumerate(rows) if r[0] is not None)


@pytest.mark.parametrize("percent,k", [(85, 4), (80, 5)])
def test_classes(spark, percent, k):
    got = jaccard_join.link_classes(documents(spark, ODD), k, percent).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == brute_classes(ODD, k, percent)
    assert len(got) == len(ODD)


def test_classes_of_a_crowd(spark):
    """Many near copies that link only in part: blocks, fine signatures and later links."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(120):
        words = [f"v{j}" for j in range(80)]
        for j in rng.choice(80, int(rng.integers(0, 5)), replace=False):
            words[j] = f"u{int(rng.integers(0, 3))}"
        rows.append((i, " ".join(words), "a"))
    got = jaccard_join.link_classes(documents(spark, rows), 4, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == brute_classes(rows, 4, 85)


def test_empty_tables(spark):
    none = documents(spark, [])
    assert jaccard_join.link_classes(none, 4, 85).count() == 0
    assert mixing.mix(none).count() == 0
    assert secrets.judge(none).count() == 0
    assert ann_multiprobe.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_mix(spark):
    rows = [(i, "w " * (1 + i % 50), "abc"[i % 3] if i % 7 else None) for i in range(3000)] + [(5000, None, "d"), (5001, "x y", "d")]
    got = mixing.mix(documents(spark, rows)).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in mixing.mix(documents(spark, rows)).collect()}
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        by.setdefault(r.source, []).append(r)
    assert sum(v[0].target for v in by.values()) == pytest.approx(sum(r["size"] for r in got))
    for v in by.values():
        assert v[0].target <= 3 * v[0].source_size + 1e-6
        assert sum(r.taken for r in v) == pytest.approx(v[0].target, abs=51)
    repeated = mixing.mixed(documents(spark, rows)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in repeated} == {r.doc_id: r.copies for r in got if r.copies}


def test_secrets(spark):
    got = {r.doc_id: r for r in secrets.judge(documents(spark, ODD)).collect()}
    assert len(got[11].spans) == 1 and got[11].spans[0].owners == 2 and got[11].spans[0].verdict == "shared-example"
    lone = [*ODD, (13, "secret: zyxwvutsrqponmlk", "a")]
    plain = {r.doc_id: r.text for r in secrets.redact(documents(spark, lone)).collect()}
    assert plain[13] == "<SECRET>" and plain[11] == "token = abcdefghijklmnop"
    assert secrets.redact(documents(spark, lone)).count() == len(lone)


def test_secrets_of_many_and_of_two(spark):
    """A sample in many documents of one source is shared; a live value in two sources is not."""
    sample, live = "password = examplepassword1", "secret: q8w7e6r5t4y3u2i1"
    rows = [(i, f"{sample} in {i}", "a") for i in range(30)] + [(i, f"plain text {i}", "abc"[i % 3]) for i in range(100, 170)]
    rows += [(200, live, "a"), (201, live, "b")]
    got = {r.doc_id: [s.verdict for s in r.spans or []] for r in secrets.judge(documents(spark, rows)).collect()}
    assert {got[i][0] for i in range(30)} == {"shared-example"}
    assert got[200] == got[201] == ["owner-specific"]
    plain = {r.doc_id: r.text for r in secrets.redact(documents(spark, rows)).collect()}
    assert all(plain[i].startswith(sample) for i in range(30))
    assert plain[200] == plain[201] == "<SECRET>"


def test_token_store(spark):
    path = queries.public_tokenizers.path("word_bpe_49k.json")
    whole = token_store.write_shards(documents(spark, [(None, "a b", "x"), (5, "c", "x"), (5, "d e", "x")]), path)
    assert [r.doc_id for r in token_store.read_documents(whole).orderBy("start").collect()] == [None, 5, 5]
    assert token_store.read_documents(token_store.write_shards(documents(spark, []), path)).count() == 0
    shards = token_store.write_shards(documents(spark, ODD), path, shard_ids=200)
    got = sorted(token_store.read_documents(shards).collect(), key=lambda r: r.start)
    assert len(got) == len(ODD) and got[0].doc_id is None
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids[-1]) == (at, len(r.ids), 1)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)] + [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [1.0, 2.0]), (504, [None] * 8)]
    rows.append((400, rows[0][1]))  # a tie with 0
    got = ann_multiprobe.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, part=90).collect()
    vectors = np.vstack([x, x[:1]]).astype(np.float64)
    hits = 0
    for q in range(0, 401, 20):
        score = vectors @ vectors[q]
        want = sorted((i for i in range(401) if i != q), key=lambda i: (-score[i], i))[:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        assert all(r.score == pytest.approx(score[r.vec_id]) for r in mine)
        hits += len({r.vec_id for r in mine} & set(want))
    assert hits / (21 * 20) >= 0.9
    few = ann_multiprobe.search(spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]


def test_copies_come_in_order(spark):
    """Equal vectors score alike in whichever task they are met, so their ids are in order."""
    x = np.random.default_rng(3).standard_normal((120, 32)).astype(np.float32)
    rows = [(i, x[i % 120].tolist()) for i in range(1200)]
    got = ann_multiprobe.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, part=150).collect()
    assert len(got) == 60 * 20
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    for q, found in by.items():
        assert found == sorted(found)
        assert [i for _, i in found[:9]] == [i for i in range(q % 120, 1200, 120) if i != q]


def recall_of(spark, monkeypatch, x, every, **how):
    """Recall at 20 against brute force, of queries none of which falls back to all rows."""
    tables = {}
    monkeypatch.setattr(ann_multiprobe, "written", lambda df, name: tables.setdefault(name, common.written(df, name)))
    monkeypatch.setattr(ann_multiprobe, "dropped", lambda *tables: None)
    table = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann_multiprobe.search(table, F.col("vec_id") % every == 0, **how).collect()
    assert tables["ann-short"].isEmpty()
    mine = {}
    for r in got:
        mine.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in range(0, len(x), every):
        score = x @ x[q]
        score[q] = -np.inf
        hits.append(len(mine[q] & set(np.argsort(-score, kind="stable")[:20].tolist())) / 20)
    return np.mean(hits)


@pytest.mark.parametrize("norms", ["spread", "gauss", "outlier"])
def test_neighbours_of_unequal_norms(spark, monkeypatch, norms):
    """Most queries are outside the sample that probes are measured on, and hashing leaves rows out."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((4000, 64))
    if norms != "gauss":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "spread":
        x *= rng.lognormal(0, 0.1, (4000, 1))
    if norms == "outlier":
        x[7] *= 1.5
    assert recall_of(spark, monkeypatch, x, 20, sample=60) >= 0.9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_neighbours_of_the_tables(spark, monkeypatch, sf):
    x = np.array([r.embedding for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").orderBy("vec_id").collect()])
    recall = recall_of(spark, monkeypatch, x, 20, sample=50)
    print(f"recall of {sf}: {recall:.4f}")
    assert recall >= 0.93


def test_op6_digest(spark, sf_dir):
    rows = {r.doc_id: r for r in queries.QUERIES["op6_secrets"](spark, sf_dir).collect()}
    for doc_id, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        found = [("assign", m) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
        found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        found += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        found.sort(key=lambda x: (x[1].start(), ("assign", "access", "hex").index(x[0])))
        listed = ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found)
        assert rows[doc_id].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op1_toxicity_crf", "op2_quality_nbsvm", "op4_langid_gru"])
def test_held_out_accuracy(spark, name):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf)
    if name == "op4_langid_gru":
        truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
        rows = got.where("held_out").join(truth, "doc_id").collect()
        assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.95
        return
    label = "toxic" if "toxic" in name else "quality"
    rows = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label), "doc_id").collect()
    y, s = np.array([r[label] for r in rows]), np.array([r.score for r in rows])
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert auc >= 0.9
