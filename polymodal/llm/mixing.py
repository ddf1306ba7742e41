"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations alone.

A row's key is an exponential variable divided by its quality weight: sorting a source by key is weighted sampling without
replacement, and the prefix of that order whose sizes reach the source's budget is the sample. A whole epoch is taken as often as it fits in the
target; only the rest is sampled. Instead of sorting whole sources, sizes are summed per source and slice of the key's range;
prefix sums over the slices find the one slice in which the budget ends, and only its rows are sorted. What comes out is one threshold
a source, so a source with any share of all rows is spread evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import materialise

#: Slices of the sampling key: this many each time it doubles, so a slice holds about a thousandth of a source's rows at most, whatever their weights.
SLICES = 256
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#$%&*|<>{}=!]"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def default_quality(text: Column, size: Column) -> Column:
    """In (0, 1]: falls with the symbols a word."""
    return F.lit(1.0) / (F.lit(1.0) + F.coalesce(F.regexp_count(text, F.lit(SYMBOL)), F.lit(0)) / F.greatest(size, F.lit(1)))


def sampling_key(doc_id: Column, quality: Column, seed: int) -> Column:
    """-ln(u) / quality, u in (0, 1) from the id's MD5, so reruns agree. Rows of weights not above zero (null, NaN, below 1e-20) come after all others, in random order too."""
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return F.when((quality >= 1e-20) & ~F.isnan(quality.cast("double")), -F.log(u) / quality).otherwise(F.lit(1e30) * (F.lit(1.0) - F.log(u)))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size), one row a source -> also target: budget times all sizes shared by weight, none above most times its own size.

    Sources in code point order, null last, weigh ``weights``, repeating. Sources that reach their limit in the order of limit / weight leave
    the rest of the budget to the others by weight; these are prefix sums over one row a source. Past the first source below its limit the level only falls,
    so the largest level of those below is the level of them all.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = Window.orderBy(F.col("__limit") / F.col("__w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    t = sizes.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights))) + 1)).withColumn("__limit", most * F.col("source_size").cast("double"))
    before = F.coalesce(F.sum("__limit").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("__w").over(turn.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    t = t.withColumn("__level", (F.lit(budget) * F.sum("source_size").over(every) - before) / rest)
    t = t.withColumn("__final", F.max(F.when(F.col("__limit") / F.col("__w") > F.col("__level"), F.col("__level"))).over(every))
    return t.select("source", "source_size", F.least("__limit", F.coalesce(F.col("__final") * F.col("__w"), F.col("__limit"))).alias("target"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, quality: Column | None, seed: int) -> list[Column]:
    text, size = F.col(text_col).cast("string"), word_count(F.col(text_col).cast("string"))
    q = quality if quality is not None else default_quality(text, size)
    return [F.col(source_col).cast("string").alias("__source"), size.alias("__size"), sampling_key(F.col(id_col), q, seed).alias("__key"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("__id")]


def thresholds(keyed: DataFrame, weights: tuple[float, ...], budget: float, most: float) -> DataFrame:
    """One row a source: source, source_size, target, epochs, and where its sample ends (at_key, at_id, at_size, at_taken)."""
    cut = F.floor(F.log2(F.greatest("__key", F.lit(1e-300))) * SLICES).cast("int")
    keyed = keyed.withColumn("__slice", cut)
    slices = materialise(keyed.groupBy("__source", "__slice").agg(F.sum("__size").alias("words")), "slices")
    goal = targets(slices.groupBy(F.col("__source").alias("source")).agg(F.sum("words").alias("source_size")), weights, budget, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    goal = materialise(goal, "goals")
    order = Window.partitionBy("__source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    start = slices.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    ends = start.join(goal, start["__source"].eqNullSafe(goal["source"])).where("rest > before and rest <= before + words").select(F.col("__source").alias("es"), F.col("__slice").alias("ec"), "before", "rest")
    near = keyed.join(ends, keyed["__source"].eqNullSafe(ends["es"]) & (keyed["__slice"] == ends["ec"]))
    alike = near.groupBy("__source", "__key", "__id", "__size").agg(F.count(F.lit(1)).alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    upto = F.sum(F.col("n") * F.col("__size")).over(Window.partitionBy("__source").orderBy("__key", "__id", "__size"))
    alike = alike.withColumn("upto", F.col("before") + upto).where("rest <= upto and rest > upto - n * __size")
    found = alike.select(F.col("__source").alias("fs"), F.col("__key").alias("at_key"), F.col("__id").alias("at_id"), F.col("__size").alias("at_size"), F.floor((F.col("rest") - (F.col("upto") - F.col("n") * F.col("__size"))) / F.col("n")).cast("long").alias("at_taken"))
    return goal.join(found, goal["source"].eqNullSafe(found["fs"]), "left").drop("fs")


def _taken(cut: str = "at_taken") -> Column:
    """Words taken of a row that has its source's thresholds beside it: whole epochs, and all of a row before the end of the sample."""
    row, end = F.struct("__key", "__id", "__size"), F.struct("at_key", "at_id", "at_size")
    part = F.when(F.col("at_key").isNull(), F.lit(0)).when(row < end, F.col("__size")).when(row == end, F.col(cut)).otherwise(F.lit(0))
    return F.col("epochs") * F.col("__size") + part


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), budget: float = 1.5, most: float = 2.0, quality: Column | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, size (words), source, source_size, target (its source's), taken (words the mix takes, repeats counted).

    The row at which a source's sample ends gives its leading words only, so each source's taken words are its target rounded down. Null texts have no words,
    a null source is a source, null ids are one id; equal ids tie by size, and rows alike in all of these share what is left evenly. A source
    without words has target 0. Very long texts are counted whole; other columns are ignored. An empty table gives no rows. Quality weights not above zero come last.
    """
    own = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), *_keyed(docs, id_col, text_col, source_col, quality, seed)), "keyed")
    goal = materialise(thresholds(own.drop("doc_id"), weights, budget, most), "thresholds")
    return own.join(goal, own["__source"].eqNullSafe(goal["source"])).select("doc_id", F.col("__size").alias("size"), F.col("__source").alias("source"), "source_size", "target", _taken().cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), budget: float = 1.5, most: float = 2.0, quality: Column | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix holds them: each row as often as it is taken, columns unchanged. The row at which a source's sample ends is taken whole if at least half of it is, else not once more.

    Rows without words are in every epoch, and so stay once at least where their source has a whole epoch.
    """
    keyed = _keyed(docs, id_col, text_col, source_col, quality, seed)
    goal = materialise(thresholds(materialise(docs.select(*keyed), "keyed"), weights, budget, most), "thresholds")
    goal = goal.withColumn("whole", F.when(2 * F.col("at_taken") >= F.col("at_size"), F.col("at_size")).otherwise(F.lit(0)))
    row, end = F.struct("__key", "__id", "__size"), F.struct("at_key", "at_id", "at_size")
    once = F.when(F.col("at_key").isNull(), F.lit(0)).when((row < end) | ((row == end) & (F.col("whole") > 0)), F.lit(1)).otherwise(F.lit(0))
    wide = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), *keyed)  # the input's own columns travel as one, whatever their names
    out = wide.join(goal, wide["__source"].eqNullSafe(goal["source"])).select("__row", F.explode(F.array_repeat(F.lit(1), (F.col("epochs") + once).cast("int"))))
    return out.select("__row.*")
