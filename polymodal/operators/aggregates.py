"""Aggregates whose results differ from Spark's by default, or that Spark lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def array_agg(x: Column, *order: Column) -> Column:
    """Keeps nulls; NULL for no rows. With order, sorted by these keys (ascending)."""
    rows = F.collect_list(F.struct(*(k.alias(f"k{n}") for n, k in enumerate(order)), x.alias("v")))
    rows = F.array_sort(rows) if order else rows
    return F.when(F.count(F.lit(1)) > 0, F.transform(rows, lambda r: r["v"]))


def collect(x: Column) -> Column:
    """The graph language's collect: drops nulls, and is empty for no rows."""
    return F.collect_list(x)


def percentile_cont(x: Column, *fractions: float) -> Column:
    return F.percentile(x, list(fractions)) if len(fractions) > 1 else F.percentile(x, fractions[0])


def percentile_disc(x: str, fraction: float) -> Column:
    return F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY {x})")


def hypothetical_rank(x: Column, value: Column) -> Column:
    """rank(value) WITHIN GROUP (ORDER BY x): the rank that value would have among the rows."""
    return (F.count_if(x < value) + 1).cast("long")


def hypothetical_dense_rank(x: Column, value: Column) -> Column:
    return (F.count_distinct(F.when(x < value, x)) + 1).cast("long")


def hypothetical_percent_rank(x: Column, value: Column) -> Column:
    return F.when(F.count(F.lit(1)) == 0, F.lit(0.0)).otherwise(F.count_if(x < value) / F.count(F.lit(1)))


def hypothetical_cume_dist(x: Column, value: Column) -> Column:
    return (F.count_if(x <= value) + 1) / (F.count(F.lit(1)) + 1)


def vector_aggregate(df: DataFrame, keys: list[str], vector: str, how: str = "avg") -> DataFrame:
    """Component-wise sum or avg of array<float> columns: components are aggregated map-side, position by position."""
    parts = df.select(*keys, F.posexplode(vector).alias("__p", "__x")).groupBy(*keys, "__p").agg(getattr(F, how)(F.col("__x").cast("double")).alias("__v"))
    out = F.transform(F.array_sort(F.collect_list(F.struct("__p", "__v"))), lambda s: s["__v"].cast("float"))
    return parts.groupBy(*keys).agg(out.alias(vector))


def skewed_sum(df: DataFrame, keys: list[str], value: str, salts: int = 64) -> DataFrame:
    """A sum in two steps over salted keys, for aggregates that don't combine map-side."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    return salted.groupBy(*keys, "__salt").agg(F.sum(value).alias("__s")).groupBy(*keys).agg(F.sum("__s").alias(value))
