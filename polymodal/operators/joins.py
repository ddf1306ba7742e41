"""Joins beyond plain equi-joins: NOT IN, as-of, interval and salted joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_in(left: DataFrame, right: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Null-aware anti join, as NOT IN (subquery): a null on the right admits nothing, a null on the left only against an empty right side."""
    spark = left.sparkSession
    left.createOrReplaceTempView("__l")
    right.select(F.col(other or key).alias("__k")).createOrReplaceTempView("__r")
    return spark.sql(f"SELECT * FROM __l WHERE `{key}` NOT IN (SELECT __k FROM __r)")


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str | None = None, values: list[str] | None = None) -> DataFrame:
    """Left rows with the values of the last right row at or before them, by key.

    Both sides are united and sorted once per key; last() carries right rows forward, so no pair of rows is ever formed.
    """
    right_on, values = right_on or on, values or [c for c in right.columns if c not in by and c != (right_on or on)]
    a = left.withColumn("__t", F.col(on)).withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType))
    b = right.select(*by, F.col(right_on).alias("__t"), F.lit(0).alias("__side"), F.struct(*values).alias("__v"))
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__last", F.last("__v", ignorenulls=True).over(w))
    return both.where("__side = 1").select(*left.columns, *(F.col("__last")[v].alias(v) for v in values))


def interval_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Rows with low <= point < high. Both sides are cut into bins of ``width`` so this is an equi-join with a residual; an interval is repeated once a bin that it touches."""
    by = by or []
    bin_ = lambda c: F.floor(c.cast("double") / F.lit(width)).cast("long")
    l = left.withColumn("__bin", bin_(F.col(point)))  # noqa: E741
    r = right.withColumn("__bin", F.explode(F.sequence(bin_(F.col(low)), bin_(F.col(high)))))
    return l.join(r, [*by, "__bin"]).where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__bin")


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salts: int = 32, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys are spread: rows of big get a random salt, rows of small one copy a salt. For how = inner or left."""
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    b = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    s = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return b.join(s, [*keys, "__salt"], how).drop("__salt")


def theta(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    return left.join(right, condition, how)
