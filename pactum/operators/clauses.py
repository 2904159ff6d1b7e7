"""The clause map: detect headings, span them, drop noise, name them by the shared vocabulary.

Two forms. ``clauses_of_text`` is one column function over a text, so that records need no shuffle
and stream. ``explode_detected`` and ``canonical_titles`` are relational: detected headings as
rows, and distinct titles joined to the vocabulary, an equi-join first and a containment join
with arg-max for what is left.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactum.functions import fields as X
from pactum.functions import patterns as P
from pactum.functions import reading
from pactum.functions import vocab as V
from pactum.functions.columns import let, literal_map, literal_rows, strip, title_case, words

_HEADING = X.rows(title=pa.string(), detected=pa.string(), start=pa.int32(), end=pa.int32())
_CLAUSE = X.rows(canonical_title=pa.string(), detected_title=pa.string(), tier=pa.string(), span=X.rows(start=pa.int32(), end=pa.int32()), confidence=pa.float64(), source=pa.string(), mapped=pa.bool_())

#: struct<tier,headings> of a text: the first detector with enough headings.
detected = X.arrow(reading.detected, X.rows(tier=pa.string(), headings=pa.list_(_HEADING)))
#: Clauses of what ``detected`` gives, and of a text at once.
clause_map = X.arrow(reading.clause_map, pa.list_(_CLAUSE))
clauses_of_text = X.arrow(lambda text: reading.clause_map(reading.detected(text)), pa.list_(_CLAUSE))


def strip_number(c: Column) -> Column:
    """A title without its leading number."""
    return strip(F.regexp_replace(c, P.NUMBER_PREFIX, ""))


def clause_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip_number(c)), "[ .:;,]+$", "")


def is_heading_like(title: Column) -> Column:
    """1 to 9 words, each capitalised, a connector or not a word; a single word has 4 letters or more."""
    first = lambda w: F.substring(w, 1, 1)
    every = lambda parts: F.forall(parts, lambda w: first(w).rlike(r"^\p{Lu}") | ~first(w).rlike(r"^\p{L}") | F.lower(w).isin(*V.HEADING_STOPWORDS))
    one = lambda w: (F.length(F.regexp_replace(w, r"[^\p{L}]", "")) >= 4) & first(w).rlike(r"^\p{Lu}")
    parts = words(strip(F.regexp_replace(strip(title), r"\.+$", "")))
    return let(parts, lambda p: F.size(p).between(1, 9) & F.when(F.size(p) == 1, one(F.element_at(p, 1))).otherwise(every(p)))


def is_noise(title: Column) -> Column:
    """Codes, front and back matter, fragments of definitions and placeholders."""
    opener = lambda t: F.substring(t, 1, 1).isin(*P.NOISE_OPENERS)
    return let(strip(title), lambda t: t.rlike(P.NOISE_DIGITS) | t.rlike(P.NOISE_PREFIX) | (t == "") | opener(t) | t.rlike(P.NOISE_PLACEHOLDER))


def canonical(title: Column) -> Column:
    """struct<title,mapped>: exact key, else the longest alias (first on ties) that contains or is contained, else the title itself."""
    rows = V.aliases()
    names = literal_map((k, t) for _, k, t in rows)
    # longest first, so that the first that fits is the arg-max
    long = sorted((r for r in rows if len(r[1]) >= V.MIN_CONTAINED), key=lambda r: (-len(r[1]), r[0]))
    table = literal_rows(((k, t) for _, k, t in long), "k", "t")
    near = lambda key: F.try_element_at(F.filter(table, lambda a: F.contains(key, a["k"]) | F.contains(a["k"], key)), F.lit(1))["t"]
    plain = title_case(F.regexp_replace(strip(title), "[ .:;,]+$", ""))
    named = lambda found: F.struct(F.coalesce(found, plain).alias("title"), found.isNotNull().alias("mapped"))
    empty = F.struct(F.lit(None).cast("string").alias("title"), F.lit(False).alias("mapped"))
    return let(clause_key(title), lambda key: F.when(key == "", empty).otherwise(let(F.coalesce(F.try_element_at(names, key), near(key)), named)))


# --- relational form -------------------------------------------------------------------------


def vocabulary(spark: SparkSession) -> DataFrame:
    """(ord, alias_key, canonical): 152 rows, so a broadcast of it has a fixed bound."""
    return spark.createDataFrame(V.aliases(), "ord int, alias_key string, canonical string")


def explode_detected(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, tier, pos, title, detected, start, end) of every heading of documents (doc_id, text), before filters."""
    found = docs.select(F.col(doc_id).alias("doc_id"), detected(F.col("text")).alias("found"))
    return found.select("doc_id", "found.tier", F.posexplode_outer("found.headings").alias("pos", "h")).where("pos is not null").select("doc_id", "tier", "pos", "h.title", "h.detected", "h.start", "h.end")


def canonical_titles(titles: DataFrame) -> DataFrame:
    """(title, canonical, mapped, how) of distinct titles: broadcast equi-join, then containment with arg-max for the rest.

    The nested loop of the containment join runs over distinct unmatched titles against the fixed vocabulary.
    """
    alias = F.broadcast(vocabulary(titles.sparkSession))
    keyed = titles.select("title").distinct().withColumn("key", clause_key(F.col("title")))
    exact = keyed.join(alias.select(F.col("alias_key").alias("key"), "canonical"), "key", "left")
    contains = (F.length("alias_key") >= V.MIN_CONTAINED) & (F.contains("key", F.col("alias_key")) | F.contains("alias_key", F.col("key")))
    near = exact.where("canonical is null and key <> ''").select("title", "key").join(alias, contains).groupBy("title").agg(F.max_by("canonical", F.struct(F.length("alias_key"), -F.col("ord"))).alias("near"))
    out = exact.join(near, "title", "left")
    found = F.coalesce("canonical", "near")
    plain = title_case(F.regexp_replace(strip(F.col("title")), "[ .:;,]+$", ""))
    how = F.when(F.col("canonical").isNotNull(), "exact").when(F.col("near").isNotNull(), "contained").otherwise("unmapped")
    return out.select("title", F.when(F.col("key") != "", F.coalesce(found, plain)).alias("canonical"), found.isNotNull().alias("mapped"), how.alias("how"))


def without_repeats(headings: DataFrame, least: int = 3) -> DataFrame:
    """Headings whose title stands fewer than ``least`` times in their document."""
    by_title = Window.partitionBy("doc_id", "key")
    return headings.withColumn("key", clause_key(F.col("title"))).withColumn("repeats", F.count("*").over(by_title)).where(F.col("repeats") < least).drop("key")
