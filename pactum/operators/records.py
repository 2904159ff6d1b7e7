"""Records: one row for each document, each field a column of its own.

A field that isn't selected costs nothing: Catalyst prunes its expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum import __version__
from pactum.functions import fields as X
from pactum.operators import clauses as C

FIELDS = ("document", "parties", "dates", "term", "governing_law", "jurisdiction", "clauses", "defined_terms", "value", "amounts", "signatories")
META = "_meta"


def low_signal(parties: Column, clauses: Column, effective: Column, law: Column, terms: Column) -> Column:
    """Nothing of what a contract usually has was found."""
    return (F.size(parties) == 0) & (F.size(clauses) == 0) & effective["value"].isNull() & law["value"].isNull() & (F.size(terms) == 0)


def _columns() -> list[Column]:
    """The fields of a record, over columns path, text, format, sha256 and flat."""
    text, flat = F.col("text"), F.col("flat")
    meta = F.struct(F.lit(__version__).alias("extractor_version"), F.array(F.lit("deterministic")).alias("tiers_used"), F.lit(False).alias("llm_used"))
    return [
        F.struct(X.title(text, F.col("path")).alias("title"), F.col("format"), F.col("sha256"), F.col("path").alias("source_path")).alias("document"),
        X.parties(flat).alias("parties"),
        F.struct(X.effective_date(flat).alias("effective"), X.expiration_date(flat).alias("expiration")).alias("dates"),
        F.struct(X.term_length(flat).alias("length"), X.auto_renew(flat).alias("auto_renew"), X.notice_days(flat).alias("notice_period_days")).alias("term"),
        X.governing_law(flat).alias("governing_law"),
        X.jurisdiction_of_text(flat).alias("jurisdiction"),
        C.clauses_of_text(text).alias("clauses"),
        X.defined_terms(flat).alias("defined_terms"),
        X.headline_value(flat).alias("value"),
        X.amounts(flat).alias("amounts"),
        X.signatories(text).alias("signatories"),
        meta.alias(META),
    ]


def extract(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of documents (path, text, format, sha256); columns in keep go along.

    Null texts give records in which nothing is found.
    """
    base = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    base = base.withColumn("flat", X.flatten(F.col("text")))
    out = base.select(*keep, *_columns())
    return out.withColumn("low_signal", low_signal(F.col("parties"), F.col("clauses"), F.col("dates.effective"), F.col("governing_law"), F.col("defined_terms")))


def extract_text(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of texts in memory: (path, text)."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return extract(docs.withColumn("format", F.lit("text")).withColumn("sha256", F.sha2(raw.cast("binary"), 256)), keep)


def project(records: DataFrame, fields: list[str] | tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Only the named fields; provenance always stays, unknown names are ignored, no name at all keeps every field.

    Columns in keep, which are no fields, go ahead.
    """
    have = [f for f in (*FIELDS, "obligations") if f in records.columns]
    return records.select(*keep, *[f for f in have if f in fields or not fields], META)


def strip_confidence(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records without confidences and sources; what has one key left becomes its value. Columns in keep go ahead."""
    have = set(records.columns)
    plain = {
        "document": F.col("document"),
        "parties": F.transform("parties", lambda p: F.struct(p["name"].alias("name"), p["role"].alias("role"))),
        "dates": F.struct(F.col("dates.effective.value").alias("effective"), F.col("dates.expiration.value").alias("expiration")) if "dates" in have else None,
        "term": F.struct(*[F.col(f"term.{f}.value").alias(f) for f in records.schema["term"].dataType.names]) if "term" in have else None,
        "governing_law": F.col("governing_law.value") if "governing_law" in have else None,
        "jurisdiction": F.col("jurisdiction.value") if "jurisdiction" in have else None,
        "clauses": F.transform("clauses", lambda c: F.struct(c["canonical_title"].alias("canonical_title"), c["detected_title"].alias("detected_title"), c["tier"].alias("tier"), c["span"].alias("span"), c["mapped"].alias("mapped"))),
        "defined_terms": F.col("defined_terms.term") if "defined_terms" in have else None,
        "value": F.col("value.value") if "value" in have else None,
        "amounts": F.col("amounts.value") if "amounts" in have else None,
        "signatories": F.transform("signatories", lambda s: F.struct(s["name"].alias("name"), s["title"].alias("title"))),
        "obligations": F.transform("obligations", lambda o: o["text"]) if "obligations" in have else None,
        META: F.col(META),
    }
    return records.select(*keep, *[plain[c].alias(c) for c in (*FIELDS, "obligations", META) if c in have])


def violations(records: DataFrame | None = None) -> Column:
    """Names of the rules that a record breaks: values outside enumerations and ranges, and malformed digests."""
    tiers, sources = ("h2", "bold-numbered", "numbered", "all-caps"), ("deterministic", "llm", "none")
    in_range = lambda c: c.between(0, 1)
    rules = {
        "format": F.col("document.format").isin("markdown", "text", "html", "docx", "pdf"),
        "sha256": F.col("document.sha256").rlike("^[0-9a-f]{64}$"),
        "party": F.forall("parties", lambda p: p["name"].isNotNull() & in_range(p["confidence"]) & p["source"].isin(*sources)),
        "tier": F.forall("clauses", lambda c: c["tier"].isin(*tiers)),
        "span": F.forall("clauses", lambda c: (c["span"]["start"] >= 0) & (c["span"]["end"] >= 0)),
        "confidence": F.forall("clauses", lambda c: in_range(c["confidence"])) & in_range(F.col("governing_law.confidence")) & in_range(F.col("value.confidence")),
        "source": F.col("governing_law.source").isin(*sources) & F.col("value.source").isin(*sources),
        "term": F.forall("defined_terms", lambda t: t["term"].isNotNull()),
    }
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda v: v.isNotNull())
