"""Queries by name, each with SQL for DuckDB that reaches the same rows another way.

Those over contracts have oracles over the facts that the contracts were rendered from; those
over documents and pages have string functions of DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.functions import fields as X
from pactum.functions import vocab as V
from pactum.functions.columns import matches, title_case
from pactum.operators import clauses as C
from pactum.operators import enrich, records as R
from pactum.plans import corpus
from pactum.plans.contracts import contracts, facts, oracle
from pactum.sources import files, html

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts(spark, sf_dir).select("contract_id", X.flatten(F.col("text")).alias("flat"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.extract(contracts(spark, sf_dir), keep=("contract_id",))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _joined(c: Column, *parts: str) -> Column:
    """An array of structs as text: parts by ':' and elements by '|'."""
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[F.coalesce(x[p].cast("string"), F.lit("-")) for p in parts])), "|")


# --- fields ----------------------------------------------------------------------------------


@query(oracle("SELECT k AS contract_id, c_name || ':Client|' || s_name || ':Provider' AS parties, 0.9 :: DOUBLE AS confidence FROM f"))
def parties_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _flat(spark, sf_dir).select("contract_id", X.parties(F.col("flat")).alias("p"))
    return out.select("contract_id", _joined(F.col("p"), "name", "role").alias("parties"), F.array_min("p.confidence").alias("confidence"))


@query(oracle("SELECT k AS contract_id, iso AS effective, CASE WHEN form = 2 THEN 0.9 ELSE 0.85 END :: DOUBLE AS confidence FROM f"))
def effective_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _flat(spark, sf_dir).select("contract_id", X.effective_date(F.col("flat")).alias("d"))
    return out.select("contract_id", F.col("d.value").alias("effective"), F.col("d.confidence").alias("confidence"))


@query(oracle("SELECT k AS contract_id, CASE WHEN k % 2 = 0 THEN until END AS expiration, CASE WHEN k % 2 = 0 THEN 0.85 ELSE 0 END :: DOUBLE AS confidence FROM f"))
def expiration_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _flat(spark, sf_dir).select("contract_id", X.expiration_date(F.col("flat")).alias("d"))
    return out.select("contract_id", F.col("d.value").alias("expiration"), F.col("d.confidence").alias("confidence"))


@query(oracle("SELECT k AS contract_id, years || CASE WHEN years = 1 THEN ' year' ELSE ' years' END AS length FROM f"))
def term_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).select("contract_id", X.term_length(F.col("flat"))["value"].alias("length"))


@query(oracle("SELECT k AS contract_id, notice AS days FROM f"))
def notice_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).select("contract_id", X.notice_days(F.col("flat"))["value"].alias("days"))


@query(oracle("SELECT k AS contract_id, CASE renewal WHEN 0 THEN true WHEN 1 THEN false END AS renews FROM f"))
def auto_renew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).select("contract_id", X.auto_renew(F.col("flat"))["value"].alias("renews"))


@query(oracle("SELECT k AS contract_id, 'State of ' || state AS law FROM f"))
def governing_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).select("contract_id", X.governing_law(F.col("flat"))["value"].alias("law"))


@query(oracle("SELECT k AS contract_id, code, CASE WHEN code IS NULL THEN 'none' ELSE 'deterministic' END AS source FROM f"))
def jurisdiction_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    law = _flat(spark, sf_dir).select("contract_id", X.governing_law(F.col("flat"))["value"].alias("law"))
    return law.select("contract_id", X.jurisdiction(F.col("law")).alias("j")).select("contract_id", F.col("j.value").alias("code"), F.col("j.source").alias("source"))


@query(oracle("SELECT k AS contract_id, money AS value FROM f"))
def headline_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).select("contract_id", X.headline_value(F.col("flat"))["value"].alias("value"))


@query(oracle("SELECT k AS contract_id, money || '|$500' AS amounts FROM f"))
def amounts_distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).select("contract_id", F.array_join(X.amounts(F.col("flat"))["value"], "|").alias("amounts"))


@query(oracle("SELECT k AS contract_id, CAST(o.ord AS INT) AS ord, o.term FROM f, (VALUES (0, 'Client'), (1, 'Provider'), (2, 'Effective Date')) AS o(ord, term) WHERE o.ord < 2 OR form = 2"))
def defined_terms_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _flat(spark, sf_dir).select("contract_id", F.posexplode(X.defined_terms(F.col("flat"))["term"]).alias("ord", "term"))
    return terms


@query(oracle("SELECT k AS contract_id, c_name || CASE WHEN k % 2 = 0 THEN ':Director|' ELSE ':-|' END || s_name || ':Secretary' AS signatories FROM f"))
def signatory_titles_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts(spark, sf_dir).select("contract_id", _joined(X.signatories(F.col("text")), "name", "title").alias("signatories"))


#: What can follow a party's name and is no part of it.
_DESCRIBED = (", a Delaware corporation", " doing business as Bolts", " d/b/a Bolts", " a Nevada limited", " having a seat in Rome", " with offices in Rome", " located in Rome", " organized in Rome", ", as agent", "")


@query("SELECT c_custkey, c_name || ':Seller|' || c_name || ' Holdings:Buyer' AS parties FROM customer")
def party_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parties without what describes them."""
    text = F.concat(F.lit("by and between "), "c_name", _title_of("c_custkey", [F.lit(d) for d in _DESCRIBED]), F.lit(' ("Seller") and '), "c_name", F.lit(" Holdings"), _title_of("c_custkey", [F.lit(d) for d in reversed(_DESCRIBED)]), F.lit(' (the "Buyer"), dated today'))
    return _read(spark, sf_dir, "customer").select("c_custkey", _joined(X.parties(text), "name", "role").alias("parties"))


@query(
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Sept ' || day(o_orderdate) || ', ' || year(o_orderdate) WHEN 1 THEN '13/32/' || year(o_orderdate) ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value,"
    " CASE WHEN o_orderkey % 4 < 2 THEN 0.55 ELSE 0.85 END :: DOUBLE AS confidence FROM orders"
)
def unparsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that no format fits stay as they are written, with less confidence; others become ISO."""
    day, year = F.dayofmonth("o_orderdate").cast("string"), F.year("o_orderdate").cast("string")
    month = F.date_format("o_orderdate", "MMM")
    forms = [F.concat(F.lit("Sept "), day, F.lit(", "), year), F.concat(F.lit("13/32/"), year), F.concat(month, F.lit(" "), day, F.lit("th, "), year), F.concat(day, F.lit(" day of "), month, F.lit(" "), year)]
    found = _read(spark, sf_dir, "orders").select("o_orderkey", X.effective_date(F.concat(F.lit("made as of "), _title_of("o_orderkey", forms), F.lit("."))).alias("d"))
    return found.select("o_orderkey", F.col("d.value").alias("value"), F.col("d.confidence").alias("confidence"))


@query("SELECT n_nationkey, CAST(least(30, 3 * n_nationkey) AS INT) AS amounts, CAST(least(50, 4 * n_nationkey) AS INT) AS terms, CAST(least(12, n_nationkey) AS INT) AS signatories FROM nation")
def list_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists stop at their limits: 30 amounts, 50 terms, 12 signatories."""
    many = lambda times, one: F.array_join(F.transform(F.sequence(F.lit(1), F.col("n_nationkey") * times), lambda i: F.concat(*[F.lit(p) if p else i.cast("string") for p in one])), "\n")
    text = F.concat(many(3, ("$", "", " due")), F.lit("\n"), many(4, ('"Term No ', "", '"')), F.lit("\n"), many(1, ("By: Signer No ", "")))
    rows = _read(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") > 0, text).otherwise("").alias("text"))
    return rows.select("n_nationkey", F.size(X.amounts(F.col("text"))).alias("amounts"), F.size(X.defined_terms(F.col("text"))).alias("terms"), F.size(X.signatories(F.col("text"))).alias("signatories"))


@query(oracle("SELECT k AS contract_id, 'Services Agreement ' || k AS title FROM f"))
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts(spark, sf_dir).select("contract_id", X.title(F.col("text"), F.col("path")).alias("title"))


@query(
    "WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\r]'), lambda x: trim(ltrim(trim(x, ' \t'), '#'), ' \t')), lambda x: x <> '' AND NOT starts_with(x, '<')) AS ls FROM documents)"
    " SELECT doc_id, CASE WHEN len(ls) > 0 AND length(ls[1]) <= 90 THEN ls[1] ELSE 'Doc ' || doc_id END AS title FROM l"
)
def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("in/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return _read(spark, sf_dir, "documents").select("doc_id", X.title(F.col("text"), path).alias("title"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def document_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[ \\t\\r\\f\\v]*\\n[ \\t\\r\\f\\v]*', ' ', 'g'), '[ \\t]+', ' ', 'g')) AS flat_sha256 FROM documents")
def flatten_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.sha2(X.flatten(F.col("text")).cast("binary"), 256).alias("flat_sha256"))


@query("SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1")
def distinct_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return _read(spark, sf_dir, "documents").groupBy(digest.alias("sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))


@query(
    "SELECT page_id, (contains(h, '<!doctype html') OR contains(h, '<html') OR contains(h, '<body')"
    " OR len(regexp_extract_all(h, '</?(?:p|div|table|tr|td|span|br|h[1-6]|font|b|i)\\b')) >= 6) AS is_html FROM (SELECT page_id, lower(html[1:4096]) AS h FROM pages)"
)
def html_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", files.looks_like_html(F.substring("html", 1, 4096)).alias("is_html"))


@query()
def html_text_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", html.text_of(F.col("html")).alias("text"))
    return pages.select("page_id", F.length("text").cast("long").alias("chars"), F.regexp_count("text", F.lit("(?m)^## ")).cast("long").alias("headings"))


# --- clauses ---------------------------------------------------------------------------------


@query(oracle("SELECT tier, count(*) AS contracts FROM f GROUP BY 1"))
def clause_tier_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts(spark, sf_dir).select(C.detected(F.col("text"))["tier"].alias("tier")).groupBy("tier").agg(F.count("*").alias("contracts"))


@query(
    oracle(
        "SELECT k AS contract_id, CAST(pos AS INT) AS pos, CAST(s AS INT) AS start, CAST(CASE WHEN pos < 3 AND v = 4 THEN e - 2 ELSE e END AS INT) AS \"end\" FROM ("
        " SELECT k, v, 0 AS pos, length(p0) AS s, length(p0 || h1 || b1) AS e FROM f UNION ALL"
        " SELECT k, v, 1, length(p0 || h1 || b1), length(p0 || h1 || b1 || h2 || b2) FROM f UNION ALL"
        " SELECT k, v, 2, length(p0 || h1 || b1 || h2 || b2), length(p0 || h1 || b1 || h2 || b2 || h3 || b3) FROM f UNION ALL"
        " SELECT k, v, 3, length(p0 || h1 || b1 || h2 || b2 || h3 || b3), length(p0 || h1 || b1 || h2 || b2 || h3 || b3 || h4 || b4 || s) FROM f)"
    )
)
def clause_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.explode_detected(contracts(spark, sf_dir).withColumnRenamed("contract_id", "doc_id")).select(F.col("doc_id").alias("contract_id"), "pos", "start", "end")


_FOUR = "(SELECT k, tier, 'Confidentiality' AS title, 'Confidentiality' AS canonical, true AS mapped FROM f UNION ALL SELECT k, tier, 'Term and Termination', 'Termination', true FROM f UNION ALL SELECT k, tier, 'Governing Law', 'Governing Law', true FROM f UNION ALL SELECT k, tier, fourth, fourth_name, k % 3 <> 1 FROM f)"


@query(oracle(f"SELECT canonical, mapped, count(*) AS clauses FROM {_FOUR} GROUP BY 1, 2"))
def clause_canonical_equi(spark: SparkSession, sf_dir: str) -> DataFrame:
    headings = C.explode_detected(contracts(spark, sf_dir).withColumnRenamed("contract_id", "doc_id"))
    named = C.canonical_titles(headings.select("title"))
    return headings.join(named, "title").groupBy("canonical", "mapped").agg(F.count("*").alias("clauses"))


_ALIAS_VALUES = ", ".join(f"({i}, '{k}', '{t}')" for i, k, t in V.aliases())


def _part_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with vocabulary inside: every alias with the type of a part before it."""
    parts = _read(spark, sf_dir, "part").select(F.lower("p_type").alias("p_type")).distinct()
    return parts.select("p_type", F.explode(F.array(*[F.lit(k) for _, k, _ in V.aliases()])).alias("alias_key")).select(F.concat_ws(" ", "p_type", "alias_key").alias("title"))


@query(
    f"WITH a(ord, k, t) AS (VALUES {_ALIAS_VALUES}), titles AS (SELECT DISTINCT lower(p_type) || ' ' || a.k AS title FROM part, a),"
    " keyed AS (SELECT title, regexp_replace(lower(title), '[ .:;,]+$', '') AS key FROM titles),"
    " hit AS (SELECT title, arg_max(a.t, length(a.k) * 1000 - a.ord) AS canonical FROM keyed JOIN a ON length(a.k) >= 5 AND (contains(key, a.k) OR contains(a.k, key)) GROUP BY 1)"
    " SELECT title, canonical FROM hit"
)
def clause_canonical_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.canonical_titles(_part_titles(spark, sf_dir)).where("mapped").select("title", "canonical")


@query("SELECT DISTINCT p_brand || ' oddities' AS title, p_brand || ' Oddities' AS canonical FROM (SELECT upper(p_brand[1:1]) || lower(p_brand[2:]) AS p_brand FROM part)")
def clause_left_outer_titlecase(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.concat(F.upper(F.substring("p_brand", 1, 1)), F.lower(F.expr("substring(p_brand, 2)")))
    made = _read(spark, sf_dir, "part").select(F.concat(brand, F.lit(" oddities")).alias("title")).distinct()
    return C.canonical_titles(made).select("title", "canonical")


@query(oracle(f"SELECT canonical, count(*) AS kept FROM {_FOUR} WHERE NOT (canonical = 'Governing Law' AND k % 2 = 1) GROUP BY 1"))
def clause_repeat_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running header that stands three times in a document goes: planted in odd contracts."""
    headings = C.explode_detected(contracts(spark, sf_dir).withColumnRenamed("contract_id", "doc_id"))
    times = F.when((F.lower("title") == "governing law") & (F.col("doc_id") % 2 == 1), 3).otherwise(1)
    kept = C.without_repeats(headings.withColumn("times", F.explode(F.sequence(F.lit(1), times))))
    named = C.canonical_titles(kept.select("title"))
    return kept.join(named, "title").groupBy("canonical").agg(F.count("*").alias("kept"))


#: Titles that are noise with any name behind them, and the vocabulary's, which aren't.
_NOISY = ("Exhibit", "Schedule", "Annex", "Appendix", "Attachment", "Table of Contents", "Signature Page", "Signatures", "Recitals", "Background", "Preamble", "Page", "4021", '"Product"', "[#]")


def _title_of(key: str, titles: list[Column]) -> Column:
    """One of the titles, in turn by a key."""
    return F.element_at(F.array(*titles), (F.col(key) % len(titles) + 1).cast("int"))


@query(f"SELECT p_partkey, (p_partkey % {len(_NOISY) + len(V.CLAUSES)}) < {len(_NOISY)} AS noise FROM part")
def clause_noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = _title_of("p_partkey", [F.concat(F.lit(t), F.lit(" "), "p_brand") for t in _NOISY] + [F.lit(t) for t in V.CLAUSES])
    return _read(spark, sf_dir, "part").select("p_partkey", C.is_noise(title).alias("noise"))


_LADDER = ", ".join(f"('{t}', true, {a}), ('{t}', false, {b})" for t, (a, b) in V.TIER_CONFIDENCE.items())


@query(oracle(f"SELECT w.tier, w.mapped, CAST(c.conf AS DOUBLE) AS confidence, count(*) AS clauses FROM {_FOUR} AS w JOIN (VALUES {_LADDER}) AS c(tier, mapped, conf) ON w.tier = c.tier AND w.mapped = c.mapped GROUP BY 1, 2, 3"))
def clause_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contracts(spark, sf_dir).select(C.detected(F.col("text")).alias("d"))
    c = found.select(F.explode_outer(C.clause_map(F.col("d"))).alias("c")).select("c.*").where("tier is not null")
    return c.groupBy("tier", "mapped", "confidence").agg(F.count("*").alias("clauses"))


@query(f"SELECT p_partkey, (p_partkey // {len(V.CLAUSES)}) % 2 = 0 AS ok FROM part")
def numbered_heading_qualifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary's titles as they are written are headings; the same in lower case aren't."""
    title = _title_of("p_partkey", [F.lit(t) for t in V.CLAUSES])
    title = F.when(F.floor(F.col("p_partkey") / len(V.CLAUSES)) % 2 == 0, title).otherwise(F.lower(title))
    return _read(spark, sf_dir, "part").select("p_partkey", C.is_heading_like(title).alias("ok"))


# --- records and corpus ----------------------------------------------------------------------


@query(
    oracle(
        "SELECT k AS contract_id, 'Services Agreement ' || k AS title, c_name || '|' || s_name AS names, iso AS effective, years || CASE WHEN years = 1 THEN ' year' ELSE ' years' END AS length,"
        " 'State of ' || state AS law, code, 'Confidentiality|Termination|Governing Law|' || fourth_name AS clauses, money AS value, false AS low_signal FROM f"
    )
)
def contract_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    return r.select(
        "contract_id", "document.title", F.array_join("parties.name", "|").alias("names"), F.col("dates.effective.value").alias("effective"), F.col("term.length.value").alias("length"),
        F.col("governing_law.value").alias("law"), F.col("jurisdiction.value").alias("code"), F.array_join("clauses.canonical_title", "|").alias("clauses"), F.col("value.value").alias("value"), "low_signal",
    )


@query(oracle("SELECT c_name || '|' || s_name AS parties, iso AS effective, 0 AS llm FROM f"))
def field_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = R.project(_records(spark, sf_dir), ["parties", "dates", "no_such_field"])
    return kept.select(F.array_join("parties.name", "|").alias("parties"), F.col("dates.effective.value").alias("effective"), F.col("_meta.llm_used").cast("int").alias("llm"))


@query(oracle("SELECT c_name || ':Client|' || s_name || ':Provider' AS parties, 'State of ' || state AS governing_law, code AS jurisdiction, money || '|$500' AS amounts FROM f"))
def strip_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = R.strip_confidence(_records(spark, sf_dir))
    return plain.select(_joined(F.col("parties"), "name", "role").alias("parties"), "governing_law", "jurisdiction", F.array_join("amounts", "|").alias("amounts"))


@query(oracle("SELECT segment, CAST(sum(CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS low, count(*) AS contracts FROM f GROUP BY 1"))
def low_signal_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thirteenth contract is a scan without text."""
    scanned = contracts(spark, sf_dir).withColumn("text", F.when(F.col("contract_id") % 13 == 0, F.concat(F.lit("scan "), F.col("contract_id").cast("string"))).otherwise(F.col("text")))
    low = R.extract(scanned, keep=("contract_id",)).select("contract_id", F.col("low_signal").cast("long").alias("low"))
    customer = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("contract_id"), F.col("c_mktsegment").alias("segment"))
    return low.join(customer, "contract_id").groupBy("segment").agg(F.sum("low").alias("low"), F.count("*").alias("contracts"))


@query(oracle("SELECT k AS contract_id FROM f WHERE k % 3 <> 1 OR v = 0"))
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.confidence_gate(_records(spark, sf_dir).select("contract_id", "clauses"), 0.7).select("contract_id")


@query(oracle("SELECT k AS contract_id, t.title AS canonical_title FROM f, (VALUES ('Confidentiality'), ('Payment'), ('Insurance')) AS t(title) WHERE t.title = 'Insurance' OR (t.title = 'Payment' AND k % 3 <> 0)"))
def coverage_gap_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.coverage_gap(_records(spark, sf_dir).select("contract_id", "clauses"), ["Confidentiality", "Payment", "Insurance"], "contract_id")[0]


@query(oracle("SELECT k AS contract_id, t.title AS canonical_title FROM f, (VALUES ('Termination'), ('Governing Law'), ('Support')) AS t(title) WHERE t.title <> 'Support' OR k % 3 = 2"))
def coverage_gap_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.coverage_gap(_records(spark, sf_dir).select("contract_id", "clauses"), ["Confidentiality", "Payment", "Insurance"], "contract_id")[1]


@query(oracle("SELECT CAST(count(*) * 4 AS BIGINT) AS clauses, CAST(sum(CASE WHEN k % 3 = 1 THEN 3 ELSE 4 END) AS BIGINT) AS mapped, round(100.0 * sum(CASE WHEN k % 3 = 1 THEN 3 ELSE 4 END) / (count(*) * 4), 3) AS pct FROM f"))
def mapped_coverage_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.mapped_share(_records(spark, sf_dir).select("clauses"))


@query(oracle("SELECT k AS contract_id, c_name || '|' || s_name AS names, 'State of ' || state AS law, CAST(4 AS BIGINT) AS n_clauses FROM f"))
def intake_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    return corpus.merged_intake(r.select("contract_id", "parties", "governing_law"), r.select("contract_id", "clauses"), "contract_id")


@query(
    oracle(
        "SELECT tp, fp, fn, round(tp / (tp + fp), 3) AS precision, round(tp / (tp + fn), 3) AS recall, round(2 * tp / (2 * tp + fp + fn), 3) AS f1 FROM"
        " (SELECT CAST(sum(CASE WHEN k % 10 = 0 THEN 1 ELSE 2 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM f)"
    )
)
def eval_party_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found parties against gold in which every tenth customer has another name."""
    found = _flat(spark, sf_dir).select("contract_id", F.explode(X.parties(F.col("flat"))["name"]).alias("value"))
    gold = found.select("contract_id", F.when((F.col("contract_id") % 10 == 0) & F.col("value").startswith("Customer"), F.lit("Nobody")).otherwise(F.upper("value")).alias("value"))
    return corpus.precision_recall(found, gold, "contract_id")


_N = "CAST(count(*) AS BIGINT)"


def _accuracy_row(field: str, tp: str, fp: str, fn: str) -> str:
    return f"SELECT '{field}' AS field, {tp} AS tp, {fp} AS fp, {fn} AS fn, round({tp} / ({tp} + {fp}), 3) AS precision, round({tp} / ({tp} + {fn}), 3) AS recall, round(2 * {tp} / (2 * {tp} + {fp} + {fn}), 3) AS f1, CAST(NULL AS DOUBLE) AS accuracy, {_N} AS n FROM f"


def _scalar_row(field: str, right: str) -> str:
    return f"SELECT '{field}', NULL, NULL, NULL, NULL, NULL, NULL, round(avg(CASE WHEN {right} THEN 1.0 ELSE 0.0 END), 3), {_N} FROM f"


_TENTH = "CAST(sum(CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT)"


@query(oracle(" UNION ALL ".join([
    _accuracy_row("parties", f"(2 * {_N} - {_TENTH})", _TENTH, _TENTH), _accuracy_row("clauses", f"(2 * {_N})", "CAST(0 AS BIGINT)", _N),
    _scalar_row("effective_date", "k % 7 <> 0"), _scalar_row("governing_law", "k % 9 <> 0"), _scalar_row("jurisdiction", "true"),
])))
def eval_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accuracy report by field, with faults planted in the gold."""
    k = F.col("k")
    gold = facts(spark, sf_dir).select(
        k.alias("contract_id"), F.array("c_name", F.when(k % 10 == 0, "Nobody").otherwise(F.col("s_name"))).alias("parties"), F.when(k % 7 == 0, "1999-01-01").otherwise(F.col("iso")).alias("effective_date"),
        F.when(k % 9 == 0, "Mars").otherwise(F.col("state")).alias("governing_law"), F.col("code").alias("jurisdiction"), F.array(F.lit("Confidentiality"), F.lit("Termination"), F.lit("Insurance")).alias("clauses_present"),
    )
    return corpus.accuracy(_records(spark, sf_dir), gold, "contract_id")


@query(oracle("SELECT k AS contract_id, CASE WHEN k % 7 = 0 THEN 'sha256' ELSE '' END AS broken FROM f"))
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contracts(spark, sf_dir).withColumn("sha256", F.when(F.col("contract_id") % 7 == 0, F.lit("not a digest")).otherwise(F.col("sha256")))
    return R.extract(rows, keep=("contract_id",)).select("contract_id", F.array_join(R.violations(None), ",").alias("broken"))


_CATALOG_VALUES = ", ".join(f"('{name}', '{tier}')" for name, tier, _ in enrich.FIELD_CATALOG)


@query(f"SELECT * FROM (VALUES {_CATALOG_VALUES}) AS c(field, tier)")
def field_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.field_catalog(spark).select("field", "tier")


@query(oracle("SELECT k AS contract_id, 'State of ' || state AS law, CASE WHEN k % 2 = 0 THEN 'by notice' END AS mechanics, CASE WHEN k % 3 = 0 THEN CAST(2 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS obligations, true AS llm_used FROM f"))
def llm_merge_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(
        F.lit("Sure: {"), F.when(F.col("contract_id") % 2 == 0, '"renewal_mechanics": "by notice", ').otherwise(""),
        F.when(F.col("contract_id") % 3 == 0, '"obligations": ["pay", "report"], ').otherwise(""), F.lit('"governing_law": "Mars"} done'),
    )
    merged = enrich.merge(_records(spark, sf_dir).withColumn("reply", reply).withColumn("text", F.lit("")))
    return merged.select("contract_id", F.col("governing_law.value").alias("law"), F.col("term.renewal_mechanics.value").alias("mechanics"), F.coalesce(F.size("obligations"), F.lit(0)).cast("long").alias("obligations"), F.col("_meta.llm_used").alias("llm_used"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[.]')) AS BIGINT) AS hits, CAST(coalesce(instr(text, '.'), 0) - 1 AS BIGINT) AS first FROM documents")
def match_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _read(spark, sf_dir, "documents").select("doc_id", matches(F.col("text"), r"\.").alias("m"))
    return found.select("doc_id", F.size("m").cast("long").alias("hits"), F.coalesce(F.try_element_at("m", F.lit(1))["start"], F.lit(-1)).cast("long").alias("first"))


@query("SELECT DISTINCT p_brand, upper(p_brand[1:1]) || lower(p_brand[2:]) AS titled FROM part")
def title_casing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_brand", title_case(F.lower("p_brand")).alias("titled")).distinct()
