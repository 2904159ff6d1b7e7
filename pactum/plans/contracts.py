"""Contracts rendered from the star schema, one for each customer.

The facts of a contract are plain arithmetic on keys, in SQL that Spark and DuckDB both run, so
that what extraction should find is known without looking at the text. Surface forms vary with
the key: four spellings of dates, five kinds of headings, negated renewals, number words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH = "CASE month({d}) " + " ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate("January February March April May June July August September October November December".split())) + " END"
STATES = ("Delaware", "New York", "California", "Texas", "Ohio", "Illinois", "Washington", "West Virginia", "Atlantis", "Nevada", "Florida", "Georgia", "Maine", "Oregon", "Utah", "Vermont", "Iowa", "Kansas", "Hawaii", "Alaska", "Arizona", "Indiana", "Michigan", "Montana", "Wyoming")
CODES = ("US-DE", "US-NY", "US-CA", "US-TX", "US-OH", "US-IL", "US-WA", "US-WV", None, "US-NV", "US-FL", "US-GA", "US-ME", "US-OR", "US-UT", "US-VT", "US-IA", "US-KS", "US-HI", "US-AK", "US-AZ", "US-IN", "US-MI", "US-MT", "US-WY")


def _case(of: str, values: tuple[str | None, ...]) -> str:
    quoted = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted)) + " END"


#: Facts: integers and strings only; k is the key.
_BASE = f"""
SELECT c_custkey AS k, c_name, s_name, c_mktsegment AS segment,
  DATE '2018-01-01' + CAST((c_custkey * 7) % 2000 AS INT) AS d,
  DATE '2026-01-01' + CAST((c_custkey * 11) % 900 AS INT) AS x,
  CAST(c_custkey % 5 AS INT) AS v, CAST(c_custkey % 4 AS INT) AS form,
  CAST(1 + c_custkey % 7 AS INT) AS years, CAST(c_custkey % 3 AS INT) AS renewal,
  CAST(1000 + (c_custkey * 137) % 900000 AS BIGINT) AS fee,
  {_case("c_nationkey", STATES)} AS state, {_case("c_nationkey", CODES)} AS code
FROM {{customer}} JOIN {{supplier}} ON s_suppkey = c_custkey % 10
"""
_FACTS = f"""
SELECT *, CAST(year(d) AS VARCHAR(4)) || '-' || lpad(CAST(month(d) AS VARCHAR(2)), 2, '0') || '-' || lpad(CAST(day(d) AS VARCHAR(2)), 2, '0') AS iso,
  CAST(year(x) AS VARCHAR(4)) || '-' || lpad(CAST(month(x) AS VARCHAR(2)), 2, '0') || '-' || lpad(CAST(day(x) AS VARCHAR(2)), 2, '0') AS until,
  '$' || CAST(CAST(floor(fee / 1000) AS BIGINT) AS VARCHAR(10)) || ',' || lpad(CAST(fee % 1000 AS VARCHAR(3)), 3, '0') AS money,
  {_case("years", ("", "one", "two", "three", "four", "five", "six", "seven"))} AS years_word,
  CASE WHEN k % 2 = 0 THEN 30 ELSE 90 END AS notice, CASE WHEN k % 2 = 0 THEN 'thirty (30)' ELSE '90' END AS notice_text,
  {_case("k % 3", ("Fees and Payment", "Widget Calibration", "Support Services"))} AS fourth,
  {_case("k % 3", ("Payment", "Widget Calibration", "Support"))} AS fourth_name,
  {_case("v", ("h2", "bold-numbered", "numbered", "numbered", "all-caps"))} AS tier
FROM ({_BASE}) AS base
"""
_HEAD = {
    0: lambda n, t: f"'## ' || {t} || chr(10)",
    1: lambda n, t: f"'**{n}. ' || {t} || '**' || chr(10)",
    2: lambda n, t: f"'{n}. ' || {t} || chr(10)",
    3: lambda n, t: f"'ARTICLE {('I', 'II', 'III', 'IV')[n - 1]}' || chr(10) || {t} || chr(10)",
    4: lambda n, t: f"upper({t}) || chr(10) || chr(10)",
}


def _heading(n: int, title: str) -> str:
    return "CASE v " + " ".join(f"WHEN {v} THEN {f(n, title)}" for v, f in _HEAD.items()) + " END"


_DATED = f"""CASE form
  WHEN 0 THEN 'effective as of ' || iso
  WHEN 1 THEN 'dated as of ' || {MONTH.format(d="d")} || ' ' || CAST(day(d) AS VARCHAR(2)) || ', ' || CAST(year(d) AS VARCHAR(4))
  WHEN 2 THEN 'dated ' || CAST(day(d) AS VARCHAR(2)) || ' ' || {MONTH.format(d="d")} || ' ' || CAST(year(d) AS VARCHAR(4)) || ' (the "Effective Date")'
  ELSE 'effective ' || CAST(month(d) AS VARCHAR(2)) || '/' || CAST(day(d) AS VARCHAR(2)) || '/' || CAST(year(d) AS VARCHAR(4)) END"""
#: The parts of a text, in order; h1 to h4 are headings, b1 to b4 bodies.
PARTS = {
    "p0": f"CASE WHEN v = 0 THEN '# ' ELSE '' END || 'Services Agreement ' || CAST(k AS VARCHAR(20)) || chr(10) || chr(10) || 'This Agreement is entered into by and between ' || c_name || ' (the \"Client\") and ' || s_name || ' (the \"Provider\"), ' || {_DATED} || '.' || chr(10) || chr(10)",
    "h1": _heading(1, "'Confidentiality'"),
    "b1": "'Each party keeps what it learns secret.' || chr(10) || chr(10)",
    "h2": _heading(2, "'Term and Termination'"),
    "b2": "'The initial term of this Agreement is ' || years_word || ' (' || CAST(years AS VARCHAR(2)) || ') ' || CASE WHEN years = 1 THEN 'year' ELSE 'years' END || '. Either party may end it on ' || notice_text || ' days'' prior written notice.' || CASE renewal WHEN 0 THEN ' It shall automatically renew for' || chr(10) || 'successive periods.' WHEN 1 THEN ' It shall not automatically renew.' ELSE '' END || CASE WHEN k % 2 = 0 THEN ' It shall remain in effect until ' || until || '.' ELSE '' END || chr(10) || chr(10)",
    "h3": _heading(3, "'Governing Law'"),
    "b3": "'This Agreement is governed by the laws of the State of ' || state || '.' || chr(10) || chr(10)",
    "h4": _heading(4, "fourth"),
    "b4": "'The fee is ' || money || ' and a deposit of $500 is due; the deposit of $500 is returned.' || chr(10) || chr(10)",
    "s": "'By: ' || c_name || chr(10) || CASE WHEN k % 2 = 0 THEN 'Title: Director' || chr(10) ELSE '' END || 'By: ' || s_name || chr(10) || 'Title: Secretary' || chr(10)",
}
_ALL = ", ".join(f"{e} AS {n}" for n, e in PARTS.items())
FACTS_SQL = f"SELECT *, {_ALL} FROM ({_FACTS}) AS facts"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and parts of every contract."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(FACTS_SQL, customer=read("customer"), supplier=read("supplier"))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contract_id, path, text, format, sha256) of every contract."""
    rows = facts(spark, sf_dir)
    text = F.concat(*PARTS)
    out = rows.select(F.col("k").alias("contract_id"), F.concat(F.lit("contract_"), F.col("k").cast("string"), F.lit(".md")).alias("path"), text.alias("text"), F.lit("markdown").alias("format"))
    return out.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))


def oracle(select: str) -> str:
    """SQL for DuckDB over the facts, named f."""
    return f"WITH f AS ({FACTS_SQL.format(customer='customer', supplier='supplier')}) {select}"
