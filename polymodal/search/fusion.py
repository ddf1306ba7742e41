"""Fusing ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the constant of reciprocal rank fusion.
RRF = 60


def _ranked(hits: DataFrame) -> DataFrame:
    if "rank" in hits.columns:
        return hits
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def _best(fused: DataFrame, k: int) -> DataFrame:
    out = fused.orderBy(F.desc("score"), "id").limit(k)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))


def _fuse(parts: list[DataFrame], k: int) -> DataFrame:
    every = None
    for n, p in enumerate(parts):
        one = p.withColumn("__list", F.lit(n))
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    aggs = [F.sum("part").alias("score")]
    if "payload" in every.columns:  # the first list's payload wins
        aggs.append(F.min_by("payload", F.when(F.col("payload").isNotNull(), F.col("__list"))).alias("payload"))
    return _best(every.groupBy("id").agg(*aggs), k)


def fuse_rrf(dense: DataFrame, sparse: DataFrame, k: int, constant: int = RRF) -> DataFrame:
    """(id, score, rank): the sum over lists of 1 / (60 + rank)."""
    cols = lambda d: [c for c in ("id", "payload") if c in d.columns]
    parts = [_ranked(d).select(*cols(d), (1.0 / (constant + F.col("rank"))).alias("part")) for d in (dense, sparse)]
    return _fuse(parts, k)


def dbsf_normalise(hits: DataFrame) -> DataFrame:
    """part: scores by (s - (mean - 3 sd)) / 6 sd, cut to 0..1, population moments; 0.5 in a constant list, 0 where a score isn't finite."""
    m = hits.agg(F.avg("score").alias("mu"), F.stddev_pop("score").alias("sd"), F.bool_and(F.coalesce(F.abs("score") < float("inf"), F.lit(False))).alias("ok"))
    unit = (F.col("score") - (F.col("mu") - 3 * F.col("sd"))) / (6 * F.col("sd"))
    part = F.when(~F.col("ok"), 0.0).when(F.col("sd") == 0, 0.5).otherwise(F.greatest(F.least(unit, F.lit(1.0)), F.lit(0.0)))
    return hits.crossJoin(m).withColumn("part", part).drop("mu", "sd", "ok")  # by one row


def fuse_dbsf(dense: DataFrame, sparse: DataFrame, k: int) -> DataFrame:
    cols = lambda d: [c for c in ("id", "payload") if c in d.columns]
    return _fuse([dbsf_normalise(d).select(*cols(d), "part") for d in (dense, sparse)], k)


def group_hits(hits: DataFrame, field: str, limit: int, size: int = 1) -> DataFrame:
    """The ``limit`` best groups by a payload field, with their ``size`` best hits: (group, id, score, place, group_rank)."""
    g = hits.withColumn("group", F.col(f"payload.{field}") if "payload" in hits.columns else F.col(field)).where("group IS NOT NULL")
    g = g.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), "id")).cast("long")).where(F.col("place") <= size)
    tops = g.where("place = 1").orderBy(F.desc("score"), "id").limit(limit)
    tops = tops.select("group", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long").alias("group_rank"))
    return g.join(tops, "group").select("group", "id", "score", "place", "group_rank")
