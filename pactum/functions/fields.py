"""Fields of a contract as columns: text in, envelope or array out.

``flat`` is the text with line breaks and runs of blanks turned to one space; scalar fields read
it. Titles, signatories and clauses read the text itself. Each is an Arrow function over the
rules in ``reading``: a field takes a few of the patterns' matches, with logic between them, so
one compiled pass over a batch costs a fraction of the same rules as nested column expressions.
Spark runs all fields of a row in one pass to Python, and prunes those that nothing selects.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from pactum.functions import reading

_TEXT, _REAL = pa.string(), pa.float64()
_FOUND = {"confidence": _REAL, "source": _TEXT}


def rows(**fields: pa.DataType) -> pa.DataType:
    return pa.struct(list(fields.items()))


def arrow(rule: Callable, kind: pa.DataType, empty: object = "") -> Callable[..., Column]:
    """A column function that applies a rule to each row; null arguments count as ``empty``."""

    @F.arrow_udf(from_arrow_type(kind))
    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([rule(*[empty if v is None else v for v in row]) for row in zip(*[c.to_pylist() for c in columns], strict=True)], type=kind)

    return run


def envelope_of(kind: pa.DataType) -> pa.DataType:
    return rows(value=kind, **_FOUND)


def flatten(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f\x0B]*\n[ \t\r\f\x0B]*", " "), r"[ \t]+", " ")


# --- scalars: of the flat text, but for jurisdiction, which is of a governing law ---------------

effective_date = arrow(reading.effective_date, envelope_of(_TEXT))
expiration_date = arrow(reading.expiration_date, envelope_of(_TEXT))
term_length = arrow(reading.term_length, envelope_of(_TEXT))
notice_days = arrow(reading.notice_days, envelope_of(pa.int32()))
auto_renew = arrow(reading.auto_renew, envelope_of(pa.bool_()))
governing_law = arrow(reading.governing_law, envelope_of(_TEXT))
jurisdiction = arrow(reading.jurisdiction, envelope_of(_TEXT))
jurisdiction_of_text = arrow(lambda flat: reading.jurisdiction(reading.governing_law(flat)["value"] or ""), envelope_of(_TEXT))
headline_value = arrow(reading.headline_value, envelope_of(_TEXT))

# --- lists: of the flat text, but for signatories and titles, which are of the text itself ------

amounts = arrow(reading.amounts, pa.list_(envelope_of(_TEXT)))
defined_terms = arrow(reading.defined_terms, pa.list_(rows(term=_TEXT, **_FOUND)))
parties = arrow(reading.parties, pa.list_(rows(name=_TEXT, role=_TEXT, **_FOUND)))
signatories = arrow(reading.signatories, pa.list_(rows(name=_TEXT, title=_TEXT, **_FOUND)))
title = arrow(reading.title, _TEXT)
