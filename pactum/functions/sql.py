"""Field extractors by name in SQL: SELECT extract_value(flatten_text(text)) FROM docs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pactum.functions import fields as X
from pactum.functions import reading
from pactum.operators import clauses as C

#: Functions of the flat text; of the text itself; of a text and its path.
FLAT = {
    "extract_effective_date": X.effective_date, "extract_expiration_date": X.expiration_date, "extract_term_length": X.term_length, "extract_notice_days": X.notice_days,
    "extract_auto_renew": X.auto_renew, "extract_governing_law": X.governing_law, "extract_jurisdiction": X.jurisdiction_of_text, "extract_value": X.headline_value,
    "extract_amounts": X.amounts, "extract_defined_terms": X.defined_terms, "extract_parties": X.parties,
}
WHOLE = {"extract_signatories": X.signatories, "extract_clauses": C.clauses_of_text, "detect_headings": C.detected}
NAMED = {"extract_title": X.title}


def _low_signal(text: str) -> bool:
    """Whether nothing of what a contract usually has is found in a text."""
    flat = re.sub(r"[ \t]+", " ", re.sub(r"[ \t\r\f\x0b]*\n[ \t\r\f\x0b]*", " ", text))
    return not (reading.parties(flat) or reading.effective_date(flat)["value"] or reading.governing_law(flat)["value"] or reading.defined_terms(flat) or reading.clause_map(reading.detected(text)))


@F.udtf(returnType="start int, `end` int, match string")
class MatchSpans:
    """Rows (start, end, match) of a pattern (of Python's engine) in a text, in order; code points, end exclusive."""

    def eval(self, text: str, pattern: str) -> Iterator[tuple[int, int, str]]:
        for m in re.finditer(pattern, text or ""):
            yield m.start(), m.end(), m[0]


def register(spark: SparkSession) -> list[str]:
    """Make every extractor a function of the session's SQL, with match_spans(text, pattern) as a table; their names."""
    functions: dict[str, Callable] = {**FLAT, **WHOLE, **NAMED, "is_low_signal": X.arrow(_low_signal, pa.bool_())}
    for name, f in functions.items():
        spark.udf.register(name, f)
    spark.udf.register("flatten_text", X.arrow(lambda t: re.sub(r"[ \t]+", " ", re.sub(r"[ \t\r\f\x0b]*\n[ \t\r\f\x0b]*", " ", t)), pa.string()))
    spark.udtf.register("match_spans", MatchSpans)
    return [*functions, "flatten_text", "match_spans"]


def with_fields(spark: SparkSession, view: str, text: str = "text", as_view: str | None = None) -> str:
    """A view with a column for each extractor beside those of another view; unused ones are pruned."""
    base = spark.table(view).withColumn("__flat", X.flatten(F.col(text)))
    out = base.select("*", *[f(F.col("__flat")).alias(n) for n, f in FLAT.items()], *[f(F.col(text)).alias(n) for n, f in WHOLE.items()]).drop("__flat")
    name = as_view or f"{view}_fields"
    out.createOrReplaceTempView(name)
    return name
