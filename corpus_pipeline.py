"""A corpus pipeline of five stages over documents; part of the subpackage llm.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and
returns a DataFrame; all but the last return the columns of documents. run() writes every
stage's rows as Parquet in the shared folder and reads them back for the next.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm import bpe, jaccard_join, langid_gru, mixing, secrets
from pactum.llm.common import dropped, fold, give_back, small_batches, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go (null and empty texts are such), and those whose best language scores no better
    than random letters do. Repeated rows stay repeated, other columns go along, an empty table stays empty.
    """
    small_batches(spark)
    give_back(spark)
    return langid_gru.known(docs, fold("doc_id", 5) != 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked at a similarity of 0.8 by 5-word shingles, the smallest doc_id stays.

    Rows without doc_id, and those with null or blank texts, are in no class and all stay; of rows
    with the same doc_id and text one stays. Where rows share a doc_id but differ in text, they
    stay if any of them stands for its class. An empty table stays empty.
    """
    give_back(spark)
    classes = written(jaccard_join.link_classes(docs, k=5, percent=80, name="pipeline"), "pipeline-classes")
    by_id = classes.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("component_id") == F.col("doc_id")).alias("stands"), F.count("*").alias("times"))
    by_id = written(by_id.where("not stands or times > 1"), "pipeline-by-id")
    dropped(classes)
    named = lambda rows: by_id.where(rows).select(F.col("doc_id").alias("id")).alias("of")
    at = F.col("all.doc_id").cast("long") == F.col("of.id")
    kept = docs.alias("all").join(named("not stands"), at, "left_anti")
    if by_id.where("stands").isEmpty():
        return kept
    again = kept.alias("all").join(named("stands"), at, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.alias("all").join(named("stands"), at, "left_anti").unionByName(again)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values that are not widely copied are masked; widely copied examples stay. All rows stay, null and empty texts
    and repeated rows as they are; an empty table stays empty.
    """
    small_batches(spark)
    give_back(spark)
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: null and empty texts take no words, but may stay. An empty
    table stays empty.
    """
    give_back(spark)
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, n_bytes): byte-level ids of every document and the length they decode to.

    Null and empty texts have no ids; repeated rows are repeated; an empty table gives no rows.
    """
    small_batches(spark)
    give_back(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.octet_length("decoded").cast("long").alias("n_bytes"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", redacted),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: Training of the language stage and the draw of the mix have no SQL form; tests compare run() with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
