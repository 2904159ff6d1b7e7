"""Secret scan with corpus-wide ownership frequency.

``scan`` finds candidate spans in whole texts: three base kinds by fixed patterns, and one
further kind, long mixed-alphabet tokens outside base spans. ``ownership`` aggregates the
hashes of candidate values by distinct repositories and owners over the whole corpus.
``judge`` puts both together: a value is a widely copied example if ``MANY`` repositories hold
it, or ``SPREAD`` repositories of more than ``max_owners`` owners; any other is owner-specific
(live-looking). In a corpus of less than ten times ``SPREAD`` documents, a tenth of them (two
at least) takes the place of ``SPREAD``. Base spans always stay, with their verdict; tokens of
the further kind become spans only if they are owner-specific.

Who holds a value: in the queries here a repository is a document and an owner its source, as the
table names no other holders; ``holders`` names the columns of real ones.

Offsets are code points, ends exclusive. Defined results: null and empty texts have no spans;
a null repository or owner counts as one unnamed holder; repeated rows are repeated;
columns other than those named play no part.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.llm.common import dropped, written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: Kinds in the order in which spans with equal starts are listed.
KINDS = ("assign", "access", "hex", "token")
#: Repositories that hold a widely copied value: within one owner, and over several.
MANY, SPREAD = 10, 5
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_SPANS = "array<struct<kind:string,start:int,end:int,value_hash:long,base:boolean>>"


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def find(text: str, min_entropy: float = 3.5) -> list[tuple[str, int, int, int, bool]]:
    """(kind, start, end, hash of the value, whether base) of a text, by start and then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", *m.span(), _hash(m[2]), True) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span(), _hash(m[0]), True) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", *m.span(), _hash(m[0]), True) for m in HEX.finditer(text)]
    base = [(a, b) for _, a, b, _, _ in out]
    for m in TOKEN.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and v.lower() != v and v.upper() != v and entropy(v) >= min_entropy and not any(a < m.end() and m.start() < b for a, b in base):
            out.append(("token", *m.span(), _hash(v), False))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def scan(docs: DataFrame, min_entropy: float = 3.5, holders: tuple[str, str] = ("doc_id", "source")) -> DataFrame:
    """(doc_id, repository, owner, candidates) for documents; candidates is an array of spans."""

    @F.pandas_udf(_SPANS)
    def candidates(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "start", "end", "value_hash", "base"), s, strict=True)) for s in find(t, min_entropy)] if t else [] for t in texts], dtype=object)

    return docs.select("doc_id", F.col(holders[0]).cast("string").alias("repository"), F.col(holders[1]).cast("string").alias("owner"), candidates(F.col("text").cast("string")).alias("candidates"))


def ownership(scanned: DataFrame) -> DataFrame:
    """(value_hash, repositories, owners, spans): distinct holders of each candidate value, and its spans.

    Distinct (value, owner, repository) rows are counted in two steps, so that a value which a
    third of all rows hold is summed from partial counts.
    """
    one = scanned.select("repository", "owner", F.explode("candidates.value_hash").alias("value_hash")).groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("spans"))
    by_owner = one.groupBy("value_hash", "owner").agg(F.count("*").alias("repositories"), F.sum("spans").alias("spans"))
    return by_owner.groupBy("value_hash").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"), F.sum("spans").alias("spans"))


def with_values(spans: DataFrame, values: DataFrame, total: int) -> DataFrame:
    """Spans joined to values on value_hash; values come with the number of their spans, all together total.

    Values that hold a thousandth of all spans or more are a thousand at most, so they are
    broadcast; no other value makes a task of more than that share.
    """
    hot = F.broadcast(values.where(F.col("spans") * 1000 >= total).drop("spans"))
    rest = values.where(F.col("spans") * 1000 < total).drop("spans")
    return spans.join(hot, "value_hash").unionByName(spans.join(hot.select("value_hash"), "value_hash", "left_anti").join(rest, "value_hash"))


def is_shared(documents: int, max_owners: int = 1) -> Column:
    """Whether a row of ``ownership`` is a widely copied value, in a corpus of so many documents."""
    spread = min(SPREAD, max(2, documents // 10))
    return (F.col("repositories") >= MANY) | ((F.col("owners") > max_owners) & (F.col("repositories") >= spread))


def judge(docs: DataFrame, max_owners: int = 1, min_entropy: float = 3.5, holders: tuple[str, str] = ("doc_id", "source")) -> DataFrame:
    """(row_id, doc_id, spans) for documents; spans is sorted, each with repositories, owners and verdict.

    row_id tells repeated rows apart.
    """
    scanned = written(scan(docs, min_entropy, holders).withColumn("row_id", F.monotonically_increasing_id()), "secrets-scan")
    stats = written(ownership(scanned), "secrets-stats")
    documents, total = scanned.agg(F.count("*"), F.coalesce(F.sum(F.size("candidates")), F.lit(0))).first()
    verdict = F.when(is_shared(documents, max_owners), "shared-example").otherwise("owner-specific")
    spans = scanned.select("row_id", F.explode("candidates").alias("c")).select("row_id", "c.*")
    spans = with_values(spans, stats.withColumn("verdict", verdict), total).where("base or verdict = 'owner-specific'")
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct("start", order.alias("ord"), "kind", "end", "base", "repositories", "owners", "verdict", "value_hash")
    per_row = spans.groupBy("row_id").agg(F.sort_array(F.collect_list(span)).alias("spans"))  # as many as one text has
    return scanned.select("row_id", "doc_id").join(per_row, "row_id", "left")


def redact(docs: DataFrame, max_owners: int = 1, mark: str = "<SECRET>", min_entropy: float = 3.5, holders: tuple[str, str] = ("doc_id", "source")) -> DataFrame:
    """The documents with owner-specific values replaced by ``mark`` and n_chars renewed; all rows stay.

    Ownership is counted in a first pass; the second finds the spans of each text again and
    looks their verdicts up among the live values, joined to the rows that hold any. Null and
    empty texts stay as they are; a row without doc_id goes by the digest of its text; other
    columns, whatever their names, go along; an empty table stays empty.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)))
    named = docs.select(key.alias("doc_id"), "text", *[F.col(h).alias(f"held{i}") for i, h in enumerate(holders)])
    scanned = written(scan(named, min_entropy, ("held0", "held1")), "redact-scan")
    documents = scanned.count()
    live = written(ownership(scanned).where(~is_shared(documents, max_owners)).select("value_hash", "spans"), "redact-values")
    total = live.agg(F.coalesce(F.sum("spans"), F.lit(0))).first()[0]
    found = with_values(scanned.select("doc_id", F.explode("candidates.value_hash").alias("value_hash")), live, total)
    per_doc = written(found.groupBy("doc_id").agg(F.collect_set("value_hash").alias("values")), "redact-live")  # as many as one text has
    dropped(scanned, live)

    @F.pandas_udf("string")
    def masked(text: pd.Series, live_values: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or values is None or not len(values) else mask(t, set(values), mark, min_entropy) for t, values in zip(text, live_values, strict=True)], dtype=object)

    rows = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    joined = rows.join(per_doc, F.col("key") == F.col("doc_id"), "left").select("document", masked(F.col("document.text"), F.col("values")).alias("plain"))
    new = {"text": F.col("plain"), "n_chars": F.length("plain").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return joined.select(*[new.get(c, F.col(f"document.`{c}`")).alias(c) for c in docs.columns])


def mask(text: str, live: set[int], mark: str, min_entropy: float = 3.5) -> str:
    out, at = [], 0
    for _, start, end, value, _ in find(text, min_entropy):
        if value in live and end > at:
            out += [text[at : max(at, start)], mark]
            at = end
    return "".join([*out, text[at:]])
