"""The queries opN_<name>: each applies its operator, with production parameters, to a whole table.

A query takes (spark, sf_dir). SQL for DuckDB stands beside those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm import ann_multiprobe, bpe, jaccard_join, langid_gru, mixing, mpeg_audio, quality_nbsvm, secrets, token_store, toxicity_crf
from pactum.llm.common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels outside the held-out fold of the classifiers."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 3) != 1)


def _classified(scored: DataFrame, threshold: float) -> DataFrame:
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(True))
    return scored.withColumn("held_out", held_out).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@query
def op1_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every text from marginals of a linear-chain field."""
    docs = _documents(spark, sf_dir)
    field = toxicity_crf.train(docs, _training(spark, sf_dir), "toxic")
    out = _classified(toxicity_crf.score(docs, field), 0.7)
    return out.select("doc_id", "held_out", "score", "predicted", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))


@query
def op2_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every text from naive Bayes support vectors."""
    docs = _documents(spark, sf_dir)
    model = quality_nbsvm.train(docs, _training(spark, sf_dir), "quality")
    return _classified(quality_nbsvm.score(docs, model), 0.5).select("doc_id", "held_out", "score", "predicted")


@query
def op3_ann_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest of every 20th vector by inner product."""
    return ann_multiprobe.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


@query
def op4_langid_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text from a bidirectional recurrent network over bytes."""
    docs = _documents(spark, sf_dir)
    net = langid_gru.train(docs, docs.where(fold("doc_id", 5) != 0).select("doc_id", "lang"))
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(True))
    return langid_gru.predict(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as token ids in Elias-Fano shards, read back."""
    shards = token_store.write_shards(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_documents(shards, digest_only=True)


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text with corpus-wide ownership."""
    judged = secrets.judge(_documents(spark, sf_dir))
    spans = F.coalesce("spans", F.array())
    base = F.filter(spans, lambda s: s["base"])
    listed = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    live = F.size(F.filter(spans, lambda s: s["verdict"] == "owner-specific")).cast("long")
    judged = judged.withColumn("spans", F.coalesce("spans", F.array().cast(judged.schema["spans"].dataType)))
    return judged.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(spans).alias("spans"), live.alias("n_owner_specific"))


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by ranks and decoded again."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = bpe.encode(_documents(spark, sf_dir), path, public_tokenizers.PATTERN, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an MPEG audio stream, parsed again, with its duration and the places of its frames."""
    found = mpeg_audio.inspect(mpeg_audio.store(_documents(spark, sf_dir)), "doc_id", "n_bytes")
    return found.withColumn("frame_offsets", F.array_join(F.col("frame_offsets").cast("array<string>"), ","))


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by 4-word shingles at a Jaccard similarity of 0.85."""
    return jaccard_join.link_classes(_documents(spark, sf_dir), k=4, percent=85)


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources mixed to weights 5, 2, 1 with at most three copies."""
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL["op9_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), places AS (
  SELECT doc_id, ws, unnest(CASE WHEN len(ws) = 0 OR ws IS NULL THEN [] WHEN len(ws) < 4 THEN [1] ELSE range(1, len(ws) - 2) END) AS i FROM w
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM places
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), both_in AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM both_in JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach AS r JOIN edges AS e ON r.b = e.a
), least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.m, d.doc_id)) AS component_id
FROM documents AS d LEFT JOIN n USING (doc_id) LEFT JOIN least AS l ON l.a = d.doc_id
"""
