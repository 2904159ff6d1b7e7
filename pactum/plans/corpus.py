"""Questions over many records: coverage, confidence gates, merges and accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def mapped_clauses(records: DataFrame, key: str) -> DataFrame:
    """(key, canonical_title) of clauses that the vocabulary knows."""
    return records.select(key, F.explode_outer("clauses").alias("c")).where("c.mapped").select(key, F.col("c.canonical_title").alias("canonical_title")).distinct()


def coverage_gap(records: DataFrame, standard: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(missing, added): clauses of the standard that a document lacks, and those it has beyond it."""
    spark = records.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in standard], "canonical_title string"))
    have = mapped_clauses(records, key)
    expected = records.select(key).distinct().select(key, F.explode(F.array(*[F.lit(t) for t in standard])).alias("canonical_title"))
    return expected.join(have, [key, "canonical_title"], "left_anti"), have.join(wanted, "canonical_title", "left_anti").select(key, "canonical_title")


def confidence_gate(records: DataFrame, least: float) -> DataFrame:
    """Records with clauses, all of them above a confidence."""
    return records.where((F.size("clauses") > 0) & F.forall("clauses", lambda c: c["confidence"] > least))


def mapped_share(records: DataFrame) -> DataFrame:
    """(clauses, mapped, pct) of the corpus."""
    one = records.select(F.explode_outer("clauses.mapped").alias("m")).where("m is not null")
    return one.agg(F.count("*").alias("clauses"), F.sum(F.col("m").cast("long")).alias("mapped"), F.round(100 * F.avg(F.col("m").cast("double")), 3).alias("pct"))


def merged_intake(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row for documents that stand in two sets of records: names from the one, number of clauses from the other."""
    a = left.select(key, F.array_join(F.array_sort("parties.name"), "|").alias("names"), F.col("governing_law.value").alias("law"))
    return a.join(right.select(key, F.size("clauses").cast("long").alias("n_clauses")), key)


def _shares(tp: str, fp: str, fn: str) -> list[Column]:
    p, r = F.col(tp) / F.nullif(F.col(tp) + F.col(fp), F.lit(0)), F.col(tp) / F.nullif(F.col(tp) + F.col(fn), F.lit(0))
    return [F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(2 * p * r / (p + r), 3).alias("f1")]


def precision_recall(found: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of values per key: equal, or one contains the other, in lower case."""
    near = (F.contains(F.lower("f.value"), F.lower("g.value"))) | (F.contains(F.lower("g.value"), F.lower("f.value")))
    same = F.col(f"f.{key}") == F.col(f"g.{key}")
    hit = gold.alias("g").join(found.alias("f"), same & near, "left_semi").agg(F.count("*").alias("tp"))
    miss = gold.alias("g").join(found.alias("f"), same & near, "left_anti").agg(F.count("*").alias("fn"))
    extra = found.alias("f").join(gold.alias("g"), same & near, "left_anti").agg(F.count("*").alias("fp"))
    counts = hit.withColumn("one", F.lit(1)).join(miss.withColumn("one", F.lit(1)), "one").join(extra.withColumn("one", F.lit(1)), "one")
    return counts.select("tp", "fp", "fn", *_shares("tp", "fp", "fn"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(name, parties, effective_date, governing_law, jurisdiction, clauses_present) of a JSON object of documents by name.

    Names that start with an underscore are remarks.
    """
    kind = "map<string,struct<parties:array<string>,effective_date:string,governing_law:string,jurisdiction:string,clauses_present:array<string>>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("name", "g"))
    return whole.where(~F.col("name").startswith("_")).select("name", "g.*")


def accuracy(records: DataFrame, gold: DataFrame, key: str = "name") -> DataFrame:
    """(field, tp, fp, fn, precision, recall, f1, accuracy, n) of records against gold, a row for each field.

    Parties count as found if one name contains the other; clauses if the vocabulary's names are equal, and
    further clauses are no fault, as gold names some of them. Dates and codes have to be equal, laws to contain
    one another, all without case. A document that has no record counts as one in which nothing was found.
    """
    r = records.select(
        key, F.col("dates.effective.value").alias("date"), F.lower("governing_law.value").alias("law"), F.col("jurisdiction.value").alias("code"),
        F.transform("parties", lambda p: F.lower(p["name"])).alias("names"), F.transform(F.filter("clauses", lambda c: c["mapped"]), lambda c: c["canonical_title"]).alias("titles"),
    )
    none = F.array().cast("array<string>")
    both = gold.join(r, key, "left").select(key, "date", "law", "code", "effective_date", "jurisdiction", F.lower("governing_law").alias("true_law"), *[F.coalesce(c, none).alias(c) for c in ("names", "titles")], F.coalesce(F.transform("parties", F.lower), none).alias("true_names"), F.coalesce("clauses_present", none).alias("true_titles"))
    within = lambda a, b: F.contains(a, b) | F.contains(b, a)
    hits = F.size(F.filter("true_names", lambda g: F.exists("names", lambda f: within(f, g))))
    extra = F.size(F.filter("names", lambda f: ~F.exists("true_names", lambda g: within(f, g))))
    titles = F.size(F.array_intersect("true_titles", "titles"))
    none_of = F.lit(None).cast("int")
    row = lambda field, tp=none_of, fp=none_of, fn=none_of, right=none_of: F.struct(F.lit(field).alias("field"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), right.alias("right"))
    rows = both.select(F.explode(F.array(
        row("parties", hits, extra, F.size("true_names") - hits),
        row("clauses", titles, F.lit(0), F.size(F.array_distinct("true_titles")) - titles),
        row("effective_date", right=F.col("date").eqNullSafe(F.col("effective_date")).cast("int")),
        row("governing_law", right=F.coalesce(within(F.col("law"), F.col("true_law")), F.lit(False)).cast("int")),
        row("jurisdiction", right=F.col("code").eqNullSafe(F.col("jurisdiction")).cast("int")),
    )).alias("x")).select("x.*")
    total = rows.groupBy("field").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("right").alias("accuracy"), F.count("*").alias("n"))
    return total.select("field", "tp", "fp", "fn", *_shares("tp", "fp", "fn"), F.round("accuracy", 3).alias("accuracy"), "n")
