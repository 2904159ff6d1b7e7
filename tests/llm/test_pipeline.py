"""The pipeline on planted documents, stage by stage against plain Python."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from pactum.llm import bpe, langid_gru

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the quick fox and the lazy dog went over to that house with this little thing"
DE = "der schnelle fuchs und das faule haus sind nicht für die ungewöhnliche größe"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = []
    for i in range(60):
        words = (EN if i % 2 else DE).split()
        text = " ".join(words[(i * 7 + j * (1 + i % 3)) % len(words)] + ("" if j % 9 else str(i)) for j in range(80))
        rows.append((i, text, "en" if i % 2 else "de", f"s{i % 3}"))
    rows += [(100, rows[3][1], "en", "s1"), (101, rows[3][1] + " end", "en", "s2"), (102, "12345 !!", "en", "s0"), (103, None, "en", "s0"), (104, rows[5][1][::-1] + " password=hunter2hunter2x", "en", "s1")]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        seen[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {k: {r.doc_id for r in v} for k, v in seen.items()}
    assert ids["language"] == set(range(60)) | {100, 101, 104}
    assert not ids["near_duplicates"] & {100, 101} and {3, 104} <= ids["near_duplicates"]
    assert ids["secrets"] == ids["near_duplicates"]
    plain = {r.doc_id: r for r in seen["secrets"]}
    assert plain[104].text.endswith(" <SECRET>") and plain[104].n_chars == len(plain[104].text)
    words = sum(len(r.text.split()) for r in seen["secrets"])
    assert sum(len(r.text.split()) for r in seen["mixing"]) == pytest.approx(words, rel=0.2)
    encoder = bpe.BytePairs.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in seen["tokens"]:
        assert list(r.ids) == encoder.encode([plain[r.doc_id].text])[0].tolist()
        assert (r.n_tokens, r.n_bytes) == (len(r.ids), len(plain[r.doc_id].text.encode()))


def test_gibberish_goes(spark):
    """Random letters go, and few documents of learned languages do."""
    rng = np.random.default_rng(4)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = lambda: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(80))
    rows = [(10_000_000 + i, t := words(), None, "junk", len(t)) for i in range(100)]
    junk = spark.createDataFrame(rows, SCHEMA).select(*[F.col(c).cast(table.schema[c].dataType).alias(c) for c in table.columns])
    kept = {r.doc_id for r in corpus_pipeline.language(spark, table.unionByName(junk), "").select("doc_id").collect()}
    ids = {r.doc_id for r in table.select("doc_id").collect()}
    print(f"gibberish kept {len(kept - ids)} of 100, documents kept {len(kept & ids)} of {len(ids)}")
    assert len(kept - ids) <= 5
    assert len(kept & ids) >= 0.98 * len(ids)


def test_language_learns_from_all_rows(spark, monkeypatch):
    """No sample: the stage collects none, a letter of any one row counts, and every row moves the network, however rows are stored."""
    monkeypatch.setattr(langid_gru.sampling, "collect", lambda *a: pytest.fail("a sample was drawn"))
    monkeypatch.setattr(langid_gru, "START", 500_000)
    rows = [(i, f"{(EN, DE)[i % 2]} {i} " + ("ж" if i == 1100 else ""), ("en", "de")[i % 2]) for i in range(1200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, label string")
    net, letters = langid_gru.train_whole(table, shard_bytes=30_000)
    assert ord("ж") in letters
    parameters = lambda t: np.concatenate([p.ravel() for p in langid_gru.train_whole(t, shard_bytes=30_000)[0].parameters()])
    whole = np.concatenate([p.ravel() for p in net.parameters()])
    assert np.array_equal(parameters(table.repartition(7)), whole)
    assert not np.array_equal(parameters(table.withColumn("text", F.when(F.col("doc_id") == 1100, F.reverse("text")).otherwise(F.col("text")))), whole)
    docs = table.select("doc_id", "text", F.col("label").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    assert corpus_pipeline.language(spark, docs, "").count() >= 0.99 * 1200


def test_segments_hold_every_byte():
    x, y = langid_gru.segments(["a" * 100, "bc", "d" * 48, "12", None], ["l", "r", "l", "r", "l"], ["l", "r"], 48, np.random.default_rng(0))
    assert x.shape == (5, 48) and sorted(y.tolist()) == [0, 0, 0, 0, 1]
    assert set(x[y == 0].ravel().tolist()) == set(b"ad") and set(x[y == 1].ravel().tolist()) == set(b"bc")


def test_rank_of_scores(spark):
    values = np.round(np.random.default_rng(1).random(500) ** 9, 4).tolist() + [0.25] * 300 + [1.0]
    table = spark.createDataFrame([(v,) for v in values], "value double").cache()
    for rank in (0, 4, 450, 600, 800):
        assert langid_gru.nth(table, rank) == sorted(values)[rank]
