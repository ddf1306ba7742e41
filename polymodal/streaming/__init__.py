"""Windowed aggregation of event streams; the same functions serve batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read_events(spark, path: str, schema: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], *aggs: Column, late: str | None = None) -> DataFrame:
    """Aggregates over windows of one size; with ``late``, a stream drops rows later than that and its state stays bounded."""
    df = df.withWatermark(ts, late) if late and df.isStreaming else df
    out = df.groupBy(F.window(ts, size).alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(c for c in out.columns if c != "w"))


def sliding(df: DataFrame, ts: str, size: str, slide: str, keys: list[str], *aggs: Column, late: str | None = None) -> DataFrame:
    df = df.withWatermark(ts, late) if late and df.isStreaming else df
    out = df.groupBy(F.window(ts, size, slide).alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(c for c in out.columns if c != "w"))


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], *aggs: Column, late: str | None = None) -> DataFrame:
    df = df.withWatermark(ts, late) if late and df.isStreaming else df
    out = df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *(c for c in out.columns if c != "w"))
