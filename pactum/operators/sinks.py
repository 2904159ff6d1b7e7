"""Records out: JSON text, tables for people, a JSON Schema."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pactum.operators import records
from pactum.operators.records import FIELDS, META
from pactum.operators.schema import record_schema

#: Keys that are left out where they are null; all others are written as null.
OPTIONAL = ("obligations", "renewal_mechanics")


def json_text(shown: DataFrame) -> Column:
    """One JSON object for each record. Required keys stay when null; optional ones go."""
    have = [c for c in (*FIELDS, "obligations", META) if c in shown.columns]
    full = F.to_json(F.struct(*have), {"ignoreNullFields": "false"})
    for key in OPTIONAL:
        full = F.regexp_replace(full, rf',"{key}":null', "")
    return full


def printable(found: DataFrame, fields: list[str], plain: bool, as_table: bool) -> DataFrame:
    """Records (path, warnings, error, low_signal and fields) as a command line prints them, one row for each.

    (path, warnings, error, low_signal, format, n_parties, n_clauses, tiers, llm_used, j, record): j is the
    JSON of the named fields (all, if none is), without confidences if plain; for a table, record is the whole.
    """
    have = [c for c in (*FIELDS, "obligations", META) if c in found.columns]
    about = {"format": F.col("document.format"), "n_parties": F.size("parties"), "n_clauses": F.size("clauses"), "tiers": F.col(f"{META}.tiers_used"), "llm_used": F.col(f"{META}.llm_used")}
    said = ("path", "warnings", "error", "low_signal", *about)
    whole = found.withColumns(about)
    if as_table:
        return whole.select(*said, F.lit(None).cast("string").alias("j"), F.struct(*have).alias("record"))
    body = records.project(whole, fields, said)
    body = records.strip_confidence(body, said) if plain else body
    return body.select(*said, json_text(body).alias("j"), F.lit(None).cast("string").alias("record"))


def write_json(shown: DataFrame, path: str) -> None:
    """A text file of JSON lines for each partition."""
    shown.select(json_text(shown).alias("value")).write.mode("errorifexists").text(path)


def table(row: Row) -> str:
    """One record for people."""
    r = row.asDict(recursive=True)
    said = lambda f: "(not found)" if not f or f.get("value") is None else f"{f['value']}  [{f['confidence']:.2f}]"
    dates, term = r.get("dates") or {}, r.get("term") or {}
    lines = [("title", (r.get("document") or {}).get("title") or "(not found)")]
    lines += [("party", f"{p['name']}" + (f" ({p['role']})" if p["role"] else "")) for p in r.get("parties") or []]
    lines += [("effective", said(dates.get("effective"))), ("expiration", said(dates.get("expiration"))), ("length", said(term.get("length")))]
    lines += [("renews", said(term.get("auto_renew"))), ("notice days", said(term.get("notice_period_days"))), ("law", said(r.get("governing_law")))]
    lines += [("jurisdiction", said(r.get("jurisdiction"))), ("value", said(r.get("value")))]
    lines += [("clause", f"{c['canonical_title']}  [{c['confidence']:.2f}] {c['tier']}" + ("" if c["mapped"] else " (unmapped)")) for c in r.get("clauses") or []]
    lines += [("signatory", f"{s['name']}" + (f", {s['title']}" if s["title"] else "")) for s in (r.get("signatories") or [])[:6]]
    terms = [t["term"] for t in r.get("defined_terms") or []]
    lines += [("terms", ", ".join(terms[:20]) + (f" and {len(terms) - 20} more" if len(terms) > 20 else ""))] if terms else []
    return "\n".join(f"{k:>14}  {v}" for k, v in lines)


def json_schema() -> str:
    """JSON Schema of records."""
    return json.dumps(record_schema(), indent=2)
