"""A folder as a stream: files that arrive are decoded and extracted by the same expressions as in bulk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pactum.operators.records import extract
from pactum.sources.files import bound_batches, decode

_FILES = "path string, modificationTime timestamp, length long, content binary"


def files(spark: SparkSession, folder: str, glob: str | None = None, per_trigger: int = 1000) -> DataFrame:
    bound_batches(spark)
    reader = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)


def records(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Records of a stream of files, with their warnings and errors; a file whose bytes came before, within the
    delay, is left out. Files that are too large to read go by their paths.

    Extraction works row by row, so the only state is the digests of the delay.
    """
    decoded = decode(stream, keep=("modificationTime",)).withColumn("identity", F.coalesce("sha256", "path")).withWatermark("modificationTime", delay)
    return extract(decoded.dropDuplicatesWithinWatermark(["identity"]), keep=("modificationTime", "warnings", "error"))


def run(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write records as Parquet until what is there has been read."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
