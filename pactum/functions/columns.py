"""Small column helpers on which field and clause expressions are built."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _quoted(v: object) -> str:
    return str(v) if isinstance(v, int) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(pairs: Iterable[tuple[object, object]]) -> Column:
    """A map of constants, built as one expression."""
    return F.expr("map(" + ", ".join(_quoted(x) for pair in pairs for x in pair) + ")")


def literal_rows(rows: Iterable[tuple[object, ...]], *names: str) -> Column:
    """An array of structs of constants, built as one expression."""
    one = lambda r: "named_struct(" + ", ".join(f"'{n}', {_quoted(v)}" for n, v in zip(names, r, strict=True)) + ")"
    return F.expr("array(" + ", ".join(one(r) for r in rows) + ")")


def squeeze(c: Column) -> Column:
    """Runs of white space, Unicode included, to one space; ends stripped."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Split at white space; an empty text has no words."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def matches(c: Column, pattern: str) -> Column:
    """array<struct<start,text>>: where each match of a pattern (of Python's engine) starts (code points from 0) and
    the rest of the text from there to the next match. One pass, linear in the text.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("text", pa.string())]))
    known = re.compile(pattern)

    @F.arrow_udf("array<struct<start:int,text:string>>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            at = [m.start() for m in known.finditer(t)] if t else []
            out.append(None if t is None else [{"start": a, "text": t[a:b]} for a, b in zip(at, [*at[1:], len(t)], strict=False)])
        return pa.array(out, type=kind)

    return run(c)


def envelope(value: Column, confidence: Column | float, kind: str, source: str = "deterministic") -> Column:
    """struct<value,confidence,source>; a null value is 'not found'."""
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    return let(value.cast(kind), lambda v: F.struct(v.alias("value"), F.when(v.isNotNull(), confidence).otherwise(F.lit(0.0)).alias("confidence"), F.when(v.isNotNull(), F.lit(source)).otherwise(F.lit("none")).alias("source")))


def title_case(c: Column) -> Column:
    """Each word capitalised; in a text that isn't all upper case, upper-case words of up to 4 characters stay."""
    upper = lambda w: (w == F.upper(w)) & w.rlike(r"(?U)\p{L}")
    word = lambda whole: lambda w: F.when(~whole & upper(w) & (F.length(w) <= 4), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w)))))
    return let(c, lambda t: let(upper(t), lambda whole: F.array_join(F.transform(words(t), word(whole)), " ")))
