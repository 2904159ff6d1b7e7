"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every source gets a share of all words in proportion to its weight, but at most ``max_copies``
times its own words; what a source can't take is reshared by weight among the others until no
source is above its limit.

Within a source a document is expected ``c * w`` times, at most ``max_copies`` times: w is its
length class (the bits of its size) to the power ``favour``, and c brings the expected words to
the source's target. The whole part of that number is certain; the odd part p is the inclusion
of one further copy, unequal between documents of different length. Pareto order sampling draws
it: a document's random odds u/(1-u), divided by its inclusion odds p/(1-p), rank it, and the
lowest ranks are taken until the words of the sample reach the part of the target that whole
copies leave, so that the size of a sample is fixed to within half a document. u is a hash of
the document, so reruns agree and no order of rows matters.

The cut in a source's ranking needs no sort of a source in one task: word sums are aggregated
over bins of the rank (partial sums first), the bin that holds the cut is cut into finer bins,
and so on. Rows of equal rank at the cut (repeated rows) are told apart by a number of the row,
and cut the same way: as many of them are taken as fit.

Defined results: null and empty texts have size 0 and take 0; a null source is a source of its
own, last in code point order; repeated rows (same id, text and source) rank alike, and at the
cut as many of them are taken as come nearest to the target (which of them is open); an empty
table gives no rows; other columns of the input, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.llm.common import dropped, written

#: Weights by rank of the source in code point order, repeating.
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the rank that one level of the search for the cut looks at, bits of a rank and of a row's number.
BITS, RANK_BITS, ROW_BITS = 10, 52, 63


def words(text: str = "text") -> Column:
    """Number of words of a text."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def length_class(size: str = "size") -> Column:
    """Bits of the size: 0 for nothing, 1 for one word, 9 for 256 to 511."""
    return F.when(F.col(size) > 0, F.length(F.bin(size))).otherwise(0).cast("int")


def _filled(table: DataFrame, by: list[str], goal: str, weight: str, limit: str, name: str) -> DataFrame:
    """The table with ``units``: what each group gets for a unit of weight, so that least(limit, units * weight) sums to its goal.

    A round closes the rows that would be above their limit; the table is small (a row for each
    source, or for each length class of one), and rounds are as many as rows of a group at most.
    """
    level = table.select(*by).distinct().withColumn("units", F.lit(0.0))
    same = lambda other: [F.col(f"x.{b}").eqNullSafe(F.col(f"{other}.{b}")) for b in by]
    while True:
        closed = F.col("units") * F.col(f"x.{weight}") >= F.col(f"x.{limit}")
        sums = table.alias("x").join(level.alias("l"), same("l")).groupBy(*[F.col(f"x.{b}").alias(b) for b in by], "units").agg(
            F.max(F.col(f"x.{goal}")).alias("goal"), F.sum(F.when(closed, F.col(f"x.{limit}")).otherwise(0.0)).alias("full"), F.sum(F.when(closed, 0.0).otherwise(F.col(f"x.{weight}"))).alias("weighs")
        )
        units = F.greatest(F.col("units"), F.when(F.col("weighs") > 0, (F.col("goal") - F.col("full")) / F.col("weighs")).otherwise(F.col("units")))
        after = written(sums.select(*by, units.alias("units"), (units > F.col("units") * (1 + 1e-12)).alias("moved")), name)
        moved = not after.where("moved").isEmpty()
        dropped(level)
        level = after
        if not moved:
            return table.alias("x").join(level.alias("l"), same("l")).select("x.*", "units")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: float = 3.0) -> DataFrame:
    """(source, source_size, weight, target) for rows (source, source_size), one for each source.

    The table of sources is small against the documents; its rank is one window over it.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    sized = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(max_copies)).alias("limit"))
    everything = F.coalesce(F.sum("source_size").over(Window.partitionBy()), F.lit(0)).cast("double")
    sized = written(sized.select("*", everything.alias("all_words"), F.lit(0).alias("one")), "mix-sources")
    filled = _filled(sized, ["one"], "all_words", "weight", "limit", "mix-share")
    return filled.select("source", "source_size", "weight", F.least(F.col("limit"), F.col("units") * F.col("weight")).alias("target"))


def _draw(seed: int) -> Column:
    """A hash of the document, the same in every run."""
    return F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))


def _place(draw: Column, part: Column) -> Column:
    """Random odds over inclusion odds, mapped to [0, 2^RANK_BITS) without change of order."""
    u = (F.pmod(F.shiftrightunsigned(draw, 12), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    pareto = (u / (1 - u)) / (F.greatest(part, F.lit(1e-12)) / F.greatest(1 - part, F.lit(1e-12)))
    return F.least(F.floor(pareto / (1 + pareto) * float(1 << RANK_BITS)), F.lit((1 << RANK_BITS) - 1))


def _cut(ranked: DataFrame, goal: DataFrame, bits: int) -> DataFrame:
    """(its, prefix, room): where the words of a source's rows (source, size, place), by place, run over what is left.

    goal: (its, left). The room is what is left at the place of the cut. Sources that are used up have no cut.
    """
    cut = goal.select("its", "left", F.lit(0).cast("long").alias("prefix"))
    shift = bits
    while shift > 0:
        step = min(BITS, shift)
        inside = ranked.alias("r").join(cut.alias("c"), F.col("r.source").eqNullSafe(F.col("c.its"))).where(F.shiftright("r.place", shift) == F.col("c.prefix"))
        bins = inside.groupBy("c.its", F.shiftright("r.place", shift - step).alias("bin")).agg(F.sum("r.size").alias("words"), F.first("c.left").alias("left"))
        run = Window.partitionBy("its").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most 2^BITS bins
        bins = bins.withColumn("upto", F.sum("words").over(run)).where(F.col("upto") > F.col("left"))
        found = bins.groupBy("its").agg(F.min(F.struct("bin", "upto", "words", "left")).alias("x"))
        finer = written(found.select("its", (F.col("x.left") - F.col("x.upto") + F.col("x.words")).alias("left"), F.col("x.bin").alias("prefix")), "mix-cut")
        dropped(cut)
        cut = finer
        shift -= step
    return cut.select("its", "prefix", F.col("left").alias("room"))


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: float = 3.0, favour: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """What is expected of each length class of a source, and the cut of each source, for rows (source, size, draw).

    The first table holds (its, its_class, source_size, target, whole, part): certain copies of a
    document and the inclusion of one more. The second holds (its, prefix, room) as in ``_cut``;
    where a source has no cut, all are drawn. Both are small: sources times 64 rows at most.
    """
    by_class = written(rows.groupBy("source", length_class().alias("its_class")).agg(F.sum("size").alias("words")), "mix-classes")
    goal = targets(by_class.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_copies)
    favoured = F.pow(F.greatest(F.col("its_class"), F.lit(1)).cast("double"), F.lit(float(favour)))
    shares = by_class.alias("c").join(goal.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select(F.col("c.source").alias("its"), "its_class", "words", "source_size", "target")
    # in words: a class has its words times its weight for each unit, and its limit
    shares = shares.select("*", (F.col("words") * favoured).alias("weighs"), (F.col("words") * float(max_copies)).alias("limit"))
    shares = written(shares, "mix-shares")
    filled = _filled(shares, ["its"], "target", "weighs", "limit", "mix-units").withColumn("expected", F.least(F.lit(float(max_copies)), F.col("units") * favoured))
    whole = F.least(F.floor(F.col("expected") + 1e-9), F.lit(int(max_copies)))
    expected = written(filled.select("its", "its_class", "words", "source_size", "target", whole.cast("long").alias("whole"), F.greatest(F.col("expected") - whole, F.lit(0.0)).alias("part")), "mix-expected")
    dropped(by_class, shares)

    left = expected.groupBy("its").agg((F.first("target") - F.sum(F.col("whole") * F.col("words"))).alias("left"))
    ranked = rows.alias("r").join(expected.alias("e"), _mine("r", "e")).where("part > 0")
    ranked = written(ranked.select("r.source", "r.size", _place(F.col("r.draw"), F.col("e.part")).alias("place")), "mix-ranked")
    cut = _cut(ranked, written(left, "mix-left"), RANK_BITS)
    dropped(ranked)
    return expected.drop("words"), cut


def _mine(rows: str, expected: str) -> Column:
    return F.col(f"{rows}.source").eqNullSafe(F.col(f"{expected}.its")) & (length_class(f"{rows}.size") == F.col(f"{expected}.its_class"))


def _drawn(rows: DataFrame, expected: DataFrame, cut: DataFrame, *keep: str) -> DataFrame:
    """Rows (source, size, draw, ...) with their plan, ``place`` and ``side``: -1 drawn, 0 at the cut, 1 not drawn."""
    at_cut = F.col("c.prefix").isNull()
    side = F.when(F.col("e.part") <= 0, 1).when(at_cut | (F.col("place") < F.col("c.prefix")), -1).when(F.col("place") == F.col("c.prefix"), 0).otherwise(1)
    out = rows.alias("r").join(expected.alias("e"), _mine("r", "e")).join(cut.alias("c"), F.col("r.source").eqNullSafe(F.col("c.its")), "left")
    out = out.withColumn("place", _place(F.col("r.draw"), F.col("e.part")))
    return out.select("r.source", "r.size", *keep, F.col("e.source_size").alias("source_size"), F.col("e.target").alias("target"), F.col("e.whole").alias("whole"), side.alias("side"), F.col("c.room").alias("room"))


def _settled(at_cut: DataFrame) -> DataFrame:
    """Rows at the cut with their copies: those whose numbers come first are drawn while their words fit, and the next if that comes nearer.

    at_cut: a written table (source, size, room, row, whole, ...).
    """
    goal = at_cut.groupBy("source").agg(F.first("room").alias("left")).withColumnRenamed("source", "its")
    cut = _cut(at_cut.select("source", "size", F.col("row").alias("place")), written(goal, "mix-tied"), ROW_BITS)
    last, space = F.col("t.prefix"), F.col("t.room")
    drawn = last.isNull() | (F.col("x.row") < last) | ((F.col("x.row") == last) & (F.col("x.size") <= 2 * space))
    return at_cut.alias("x").join(cut.alias("t"), F.col("x.source").eqNullSafe(F.col("t.its")), "left").select("x.*", (F.col("x.whole") + drawn.cast("long")).alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: float = 3.0, seed: int = 7, favour: float = 1.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for documents (doc_id, text, source)."""
    rows = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), words().alias("size"), _draw(seed).alias("draw")), "mix-rows")
    drawn = _drawn(rows, *plan(rows, weights, max_copies, favour), "r.doc_id")
    at_cut = written(drawn.where("side = 0").withColumn("row", F.monotonically_increasing_id()), "mix-at-cut")
    columns = ["doc_id", "source", "size", "source_size", "target"]
    plain = drawn.where("side <> 0").select(*columns, (F.col("whole") + (F.col("side") < 0).cast("long")).alias("copies"))
    return plain.union(_settled(at_cut).select(*columns, "copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: float = 3.0, seed: int = 7, favour: float = 1.0) -> DataFrame:
    """The documents themselves, each as many times as the mix takes it; columns as before.

    Texts are read once for sizes and once for the copies; rows at the cut, one for each source
    unless rows repeat, are written before they are settled.
    """
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.col("source").cast("string").alias("source"), words().alias("size"), _draw(seed).alias("draw"))
    rows = written(sized.select("source", "size", "draw"), "mix-rows")
    drawn = _drawn(sized, *plan(rows, weights, max_copies, favour), "document")
    at_cut = written(drawn.where("side = 0").withColumn("row", F.monotonically_increasing_id()), "mix-at-cut")
    plain = drawn.where("side <> 0").select("document", (F.col("whole") + (F.col("side") < 0).cast("long")).alias("copies"))
    taken = plain.union(_settled(at_cut).select("document", "copies")).where("copies > 0")
    return taken.select("document", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("document.*")
