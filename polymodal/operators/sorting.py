"""Order, top-k and DISTINCT ON under the dialect's rule that nulls are the largest values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asc(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def desc(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def order_by(df: DataFrame, *keys: str | tuple[str, bool]) -> DataFrame:
    """keys: names, or (name, descending)."""
    return df.orderBy(*(asc(k) if isinstance(k, str) else desc(k[0]) if k[1] else asc(k[0]) for k in keys))


def top_k(df: DataFrame, k: int, *keys: Column) -> DataFrame:
    """TakeOrderedAndProject: each task keeps k rows, the driver merges them."""
    return df.orderBy(*keys).limit(k)


def top_k_per_group(df: DataFrame, group: list[str], k: int, *keys: Column) -> DataFrame:
    """k first rows of each group; rows beyond k leave before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*keys))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def distinct_on(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return top_k_per_group(df, keys, 1, *(order or [F.col(k) for k in keys]))


def rank_columns(df: DataFrame, partition: list[str], *order: Column) -> DataFrame:
    """row_number, rank, dense_rank as bigint, and percent_rank and cume_dist."""
    w = Window.partitionBy(*partition).orderBy(*order)
    whole = {n: getattr(F, n)().over(w).cast("long") for n in ("row_number", "rank", "dense_rank")}
    return df.withColumns({**whole, "percent_rank": F.percent_rank().over(w), "cume_dist": F.cume_dist().over(w)})
