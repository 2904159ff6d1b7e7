"""Enrichment of records by a language model: opt-in, additive, and harmless when it fails.

Prompts and merges are column expressions; only the request itself runs in Python, by a client
that the caller injects. The configuration is read on the driver, from the user's own folder
and never from the current one.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.functions import vocab as V
from pactum.functions.columns import envelope, let, squeeze, strip
from pactum.operators import clauses as C

# Fields, the tier that fills them, and what they hold.
FIELD_CATALOG: tuple[tuple[str, str, str], ...] = (
    ("document.title", "deterministic", "title of the document"),
    ("parties", "deterministic", "the two parties of 'between X and Y', with roles"),
    ("dates.effective", "deterministic", "effective date, ISO where it parses"),
    ("dates.expiration", "deterministic", "expiration date"),
    ("term.length", "deterministic", "length of the term"),
    ("term.notice_period_days", "deterministic", "days of notice"),
    ("term.auto_renew", "deterministic", "whether the term renews by itself"),
    ("governing_law", "deterministic", "governing law as written"),
    ("jurisdiction", "deterministic", "code of the governing law's place"),
    ("clauses", "deterministic", "clause map in the shared vocabulary"),
    ("defined_terms", "deterministic", "quoted and parenthesised defined terms"),
    ("value", "deterministic", "first amount of money"),
    ("amounts", "deterministic", "all distinct amounts of money"),
    ("signatories", "deterministic", "names and titles of signature blocks"),
    ("term.renewal_mechanics", "llm", "how the term renews"),
    ("obligations", "llm", "main obligations"),
)
_REPLY = "renewal_mechanics string, obligations array<string>, governing_law string, clauses array<struct<title:string>>"


def field_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIELD_CATALOG, "field string, tier string, description string")


def config(home: Path | None = None) -> dict | None:
    """The user's configuration, if it is a JSON object with an api_key."""
    base = home or Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config")
    try:
        found = json.loads((base / "pactum" / "llm.json").read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) and found.get("api_key") else None


# What a provider's service is asked when the configuration names no model.
_MODELS = {"anthropic": "claude-sonnet-4-6", "": "gpt-4o-mini"}


class Provider:
    """A language model's service by HTTP: messages of one provider, or chat completions of any that offers them.

    settings: api_key, and optionally provider, model and base_url. Calling it with a prompt gives the
    reply's text, or None where the reply has none; failures raise.
    """

    def __init__(self, settings: dict, timeout: float = 30.0):
        name = str(settings.get("provider") or "anthropic").lower()
        self.own, self.timeout = name == "anthropic", timeout
        self.model = settings.get("model") or _MODELS.get(name, _MODELS[""])
        if self.own:
            self.url = "https://api.anthropic.com/v1/messages"
            self.headers = {"x-api-key": settings["api_key"], "anthropic-version": "2023-06-01"}
        else:
            self.url = str(settings.get("base_url") or "https://api.openai.com/v1").rstrip("/") + "/chat/completions"
            self.headers = {"authorization": f"Bearer {settings['api_key']}"}

    def request(self, text: str) -> urllib.request.Request:
        body = {"model": self.model, "messages": [{"role": "user", "content": text}]} | ({"max_tokens": 1024} if self.own else {})
        return urllib.request.Request(self.url, json.dumps(body).encode(), {"content-type": "application/json", **self.headers}, method="POST")

    def said(self, body: dict) -> str | None:
        """The text of a reply's body."""
        if self.own:
            return "".join(part.get("text", "") for part in body.get("content") or [] if isinstance(part, dict))
        first = next(iter(body.get("choices") or []), None)
        return None if first is None else str((first.get("message") or {}).get("content", ""))

    def __call__(self, text: str) -> str | None:
        with urllib.request.urlopen(self.request(text), timeout=self.timeout) as reply:
            return self.said(json.loads(reply.read().decode("utf-8")))


def client(settings: dict) -> Callable[[str], str | None]:
    """What ``replies`` calls for a configuration."""
    return Provider(settings)


def prompt(text: Column, has_clauses: Column) -> Column:
    """What a model is asked: clauses only if none were found."""
    asks = F.when(has_clauses, F.lit("")).otherwise(F.lit(f"; clauses: up to {V.LLM_CLAUSES} objects with a title, the top-level headings in order"))
    return F.concat(
        F.lit("Read the contract below and answer with one JSON object only. Keys: renewal_mechanics: text or null; "),
        F.lit(f"obligations: up to {V.LLM_OBLIGATIONS} short texts; governing_law: text or null"), asks, F.lit(".\n\nCONTRACT\n"), F.substring(text, 1, V.LLM_TEXT),
    )


def replies(prompts: DataFrame, client: Callable[[str], str | None], key: str) -> DataFrame:
    """(key, reply, warning): the client's answer to each prompt; a failure is a warning, not an error."""
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for name, p in zip(x[key], x["prompt"], strict=True):
                try:
                    got = client(p)
                    out.append((name, got, None if got else "no content"))
                except Exception as e:  # noqa: BLE001  any failure of a client leaves the record as it is
                    out.append((name, None, f"request failed: {e}"))
            yield pd.DataFrame(out, columns=[key, "reply", "warning"])

    return prompts.select(key, "prompt").mapInPandas(run, f"{key} {kind}, reply string, warning string")


def _llm_clauses(found: Column, text: Column) -> Column:
    """Clauses of titles that a model named: distinct by key, without noise, located by plain search."""
    titles = F.transform(F.slice(found, 1, V.LLM_CLAUSES), lambda c: squeeze(F.coalesce(c["title"], F.lit(""))))
    keyed = F.filter(F.transform(titles, lambda t: F.struct(t.alias("t"), C.clause_key(t).alias("k"))), lambda x: (x["k"] != "") & ~C.is_noise(x["t"]))
    first = let(keyed, lambda ks: F.filter(ks, lambda x, i: F.array_position(F.transform(ks, lambda y: y["k"]), x["k"]) == i + 1))

    def clause(x: Column, name: Column, at: Column) -> Column:
        end = F.when(at > 0, F.least(at - 1 + F.length(x["t"]), F.length(text))).otherwise(0)
        span = F.struct(F.greatest(at - 1, F.lit(0)).cast("int").alias("start"), end.cast("int").alias("end"))
        return F.struct(
            name["title"].alias("canonical_title"), x["t"].alias("detected_title"), F.lit("llm").alias("tier"), span.alias("span"),
            F.lit(V.LLM_CLAUSE).alias("confidence"), F.lit("llm").alias("source"), name["mapped"].alias("mapped"),
        )

    place = lambda x: F.call_function("locate", F.lower(x["t"]), F.lower(text))
    return F.transform(first, lambda x: let(C.canonical(x["t"]), lambda name: let(place(x), lambda at: clause(x, name, at))))


def merge(records: DataFrame) -> DataFrame:
    """Records (with text and reply) with what the reply adds; a reply that isn't a JSON object changes nothing.

    Found values stay: the model's governing law and clauses only fill gaps, and jurisdiction isn't
    derived from its law. Adds obligations and term.renewal_mechanics; drops text and reply.
    """
    obj = F.from_json(F.regexp_extract("reply", r"(?s)\{.*\}", 0), _REPLY, {"mode": "PERMISSIVE"})
    base = records.withColumn("obj", F.when(F.col("reply").rlike(r"(?s)\{.*\}") & F.try_parse_json(F.regexp_extract("reply", r"(?s)\{.*\}", 0)).isNotNull(), obj))
    parsed = F.col("obj").isNotNull()
    mechanics = F.nullif(strip(F.col("obj.renewal_mechanics")), F.lit(""))
    obligations = F.filter(F.transform(F.slice("obj.obligations", 1, V.LLM_OBLIGATIONS), strip), lambda o: o != "")
    listed = F.transform(obligations, lambda o: F.struct(o.alias("text"), F.lit(V.LLM_LIST).alias("confidence"), F.lit("llm").alias("source")))
    law = F.nullif(strip(F.col("obj.governing_law")), F.lit(""))
    fills_law = (F.col("governing_law.source") == "none") & law.isNotNull()
    clauses = F.when(F.size("clauses") == 0, _llm_clauses(F.coalesce(F.col("obj.clauses"), F.array().cast("array<struct<title:string>>")), F.col("text"))).otherwise(F.col("clauses"))
    base = base.withColumn("new_clauses", F.when(parsed, clauses).otherwise(F.col("clauses")))
    adds = mechanics.isNotNull() | (F.size("obj.obligations") > 0) | fills_law | (F.size("new_clauses") > F.size("clauses"))
    adds = F.coalesce(adds, F.lit(False))
    meta = F.struct(
        F.col("_meta.extractor_version").alias("extractor_version"),
        F.when(adds, F.array_union(F.col("_meta.tiers_used"), F.array(F.lit("llm")))).otherwise(F.col("_meta.tiers_used")).alias("tiers_used"),
        parsed.alias("llm_used"),
    )
    out = base.withColumn("_meta", meta).withColumn("obligations", listed)
    out = out.withColumn("term", F.struct("term.*", F.when(mechanics.isNotNull(), envelope(mechanics, V.LLM_SCALAR, "string", "llm")).alias("renewal_mechanics")))
    out = out.withColumn("governing_law", F.when(fills_law, envelope(law, V.LLM_SCALAR, "string", "llm")).otherwise(F.col("governing_law")))
    return out.withColumn("clauses", F.col("new_clauses")).drop("obj", "new_clauses", "reply", "text")
