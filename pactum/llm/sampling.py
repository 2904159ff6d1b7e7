"""Bounded, deterministic samples of labelled rows to fit a classifier on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bytes of texts that one sample brings to the driver at most, and rows of all classes together.
BYTES, ROWS = 64_000_000, 40_000


def per_class(rows: DataFrame, doc_id: str, label: str, most: int | dict[str, int], classes: int = 1000) -> DataFrame:
    """(doc_id, label, draw): about ``most`` rows (1.3 times at most, expected) of each class, by a hash of the id.

    most: the same for every class (but no more than ROWS in all), or by class. Rows with a null
    label or id are left out; beyond ``classes`` the rarest classes are.
    """
    rows = rows.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("string").alias("label")).where("doc_id is not null and label is not null")
    counts = [(r["label"], r["count"]) for r in rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(classes).collect()]
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    rows = rows.withColumn("draw", draw)
    if not counts:
        return rows.where(F.lit(False))
    share: Column = F.lit(-1.0)
    for name, n in counts:
        wanted = most.get(name, 0) if isinstance(most, dict) else min(most, ROWS // len(counts))
        share = F.when(F.col("label") == name, F.lit(1.3 * wanted / n)).otherwise(share)
    return rows.where(F.col("draw") < share)


def collect(sample: DataFrame, docs: DataFrame, most: int | dict[str, int]) -> pd.DataFrame:
    """(text, label) of the sampled documents on the driver, at most ``most`` a class, in order of their draw.

    A first scan brings the texts' lengths; the second brings texts that come first in the draw, as
    many as hold an equal share of ``BYTES`` for each class. The sample's rows are bounded by its
    parameters, so its ids are broadcast to the scans.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    sized = rows.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.xxhash64("text").alias("digest"))
    got = sized.join(F.broadcast(sample.dropDuplicates(["doc_id"])), "doc_id").toPandas().sort_values(["draw", "doc_id", "digest"], kind="stable")
    if not len(got):
        return pd.DataFrame({"text": pd.Series(dtype=object), "label": pd.Series(dtype=object)})
    limit = got["label"].map(most if isinstance(most, dict) else dict.fromkeys(got["label"].unique(), most)).fillna(0)
    by = got.groupby("label", sort=True)
    got = got[(by.cumcount() < limit) & (by["bytes"].cumsum() <= BYTES // got["label"].nunique())]
    chosen = F.broadcast(sample.sparkSession.createDataFrame(got[["doc_id", "draw", "label"]].drop_duplicates("doc_id")))
    got = rows.join(chosen, "doc_id").withColumn("digest", F.xxhash64("text")).toPandas().sort_values(["label", "draw", "doc_id", "digest"], kind="stable")
    return got[["text", "label"]].reset_index(drop=True)
