"""What the operators share: written tables in the shared folder, checks of the columns they need."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from weakref import WeakKeyDictionary

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: While a table is written: shuffle files go as soon as the query has ended.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Where written tables stand, for as long as something holds them.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in a local session that names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="pactum-")
    return _OWN[app]


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python get so many rows at a time at most for the rest of the session, as texts can be long.

    For DataFrames that a caller writes itself; ``written`` sets it for its own writes.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= rows:
        spark.conf.set(name, str(rows))


def written(df: DataFrame, name: str, batch: int = 1000) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder and read back: lineage ends there.

    A lost executor costs the tasks that were running, not what has been written. ``batch`` rows
    at most go to Python at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, {**_WRITING, "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Remove written tables that nothing reads any more: their successors are written. Other tables stay."""
    for table in tables:
        path = _PATHS.pop(table, None) if table is not None else None
        if path is not None:
            jvm = table.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def release() -> None:
    """Give memory that a task no longer holds back to the system: a worker outlives its tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def give_back(spark: SparkSession) -> None:
    """Let executors give heap that they do not use back to the system.

    A heap that one stage has grown stays grown beside the Python workers of the next; a full
    collection shrinks it. One task for each core asks its executor for one.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()


def in_parts(texts: pd.Series, characters: int) -> Iterator[pd.Series]:
    """Texts in runs of about so many characters, in order."""
    for _, part in texts.groupby(texts.str.len().fillna(0).to_numpy().cumsum() // characters, sort=True):
        yield part


def fold(doc_id: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null ids count as held out by every caller."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % of
