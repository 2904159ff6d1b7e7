"""Documents from files: formats by name and content, text by format, problems as a column.

Format detection, size limits and plain text are column expressions; HTML, DOCX and PDF go
through one Arrow reader. A file that can't be read gives an empty text and a warning, and never
fails the job.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pactum.functions import patterns as P
from pactum.functions.vocab import MAX_FILE_BYTES
from pactum.sources import docx, html, pdf


#: Bytes of one Arrow batch of contents, about (one file can be more).
BATCH_BYTES = 128 * 1024 * 1024
_TEXT = StructType([StructField("text", StringType()), StructField("warning", StringType())])


def looks_like_html(head: Column) -> Column:
    low = F.lower(head)
    return F.contains(low, F.lit("<!doctype html")) | F.contains(low, F.lit("<html")) | F.contains(low, F.lit("<body")) | (F.regexp_count(low, F.lit(P.HTML_TAGS)) >= 6)


def valid_utf8(content: Column) -> Column:
    """Text of bytes; what isn't UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def format_of(path: Column, content: Column) -> Column:
    """By extension, then by magic bytes, then by markup in the first 4096 bytes."""
    ext = F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1))
    plain = F.when(ext.isin(".md", ".markdown"), "markdown").otherwise("text")
    return (
        F.when(ext.isin(".htm", ".html", ".xhtml"), "html")
        .when(ext == ".docx", "docx")
        .when(ext == ".pdf", "pdf")
        .when(F.substring(content, 1, 4) == F.lit(b"%PDF"), "pdf")
        .when((F.substring(content, 1, 2) == F.lit(b"PK")) & ~ext.isin(".md", ".markdown", ".txt"), "docx")
        .when(looks_like_html(valid_utf8(F.substring(content, 1, 4096))), "html")
        .otherwise(plain)
    )


@F.pandas_udf(_TEXT)
def _decoded(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
    out = []
    for raw, k in zip(content, kind, strict=True):
        if raw is None:
            out.append((None, None))
        elif k == "html":
            out.append((html.read(bytes(raw).decode("utf-8", "replace")), ""))
        elif k == "docx":
            out.append(docx.read(bytes(raw)))
        else:
            out.append(pdf.read(bytes(raw)))
    return pd.DataFrame(out, columns=["text", "warning"])


def decode(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, text, format, sha256, warnings, error) of files (path, length, content).

    Files above the size limit have an error and no text; they are told by their length, before any
    content is read. Only HTML, DOCX and PDF contents cross to Python: the others are null there.
    """
    fits = files.where(F.col("length") <= MAX_FILE_BYTES)
    base = fits.select(*keep, "path", "content").withColumn("format", format_of(F.col("path"), F.coalesce("content", F.lit(b""))))
    rich = F.col("format").isin("html", "docx", "pdf")
    base = base.withColumn("decoded", _decoded(F.when(rich, F.col("content")), F.col("format")))
    text = F.coalesce(F.when(rich, F.col("decoded.text")).otherwise(valid_utf8(F.col("content"))), F.lit(""))
    base = base.withColumn("text", text)
    empty = (F.trim(F.translate("text", "\n\r\t", "   ")) == "") & (F.coalesce(F.col("decoded.warning"), F.lit("")) == "")
    warnings = F.filter(F.array(F.nullif("decoded.warning", F.lit("")), F.when(empty, F.lit("no text could be extracted"))), lambda w: w.isNotNull())
    read = base.select(*keep, "path", "text", "format", F.sha2("content", 256).alias("sha256"), warnings.alias("warnings"), F.lit(None).cast("string").alias("error"))
    over = files.where(F.col("length") > MAX_FILE_BYTES).select(*keep, "path").withColumns({
        "text": F.lit(""), "format": format_of(F.col("path"), F.lit(b"")), "sha256": F.lit(None).cast("string"), "warnings": F.array().cast("array<string>"),
        "error": F.lit(f"file is larger than {MAX_FILE_BYTES} bytes"),
    })
    return read.unionByName(over)


def bound_batches(spark: SparkSession) -> None:
    """Let no more than BATCH_BYTES go to Python at a time, unless the session bounds batches lower."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def scan(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files of a folder or pattern, decoded."""
    bound_batches(spark)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return decode((reader.option("pathGlobFilter", glob) if glob else reader).load(path))
