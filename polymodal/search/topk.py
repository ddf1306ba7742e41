"""Top-k hits: an exact distance in higher-order functions, a filter beneath it, TakeOrderedAndProject above it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import MACROS
from .filters import compile_filter

#: Metric -> (function, whether larger is nearer).
METRICS = {"l2": ("l2_distance", False), "euclidean": ("l2_distance", False), "cosine": ("cosine_distance", False), "ip": ("inner_product", True), "inner_product": ("inner_product", True), "dot": ("inner_product", True), "l1": ("l1_distance", False), "manhattan": ("l1_distance", False)}


def vector_literal(v: Sequence[float]) -> str:
    return f"array({', '.join(f'CAST({float(x)!r} AS FLOAT)' for x in v)})"


def distance(column: str, query: Sequence[float] | str, metric: str = "l2") -> Column:
    """query: numbers, or the name of another vector column."""
    name = METRICS[metric][0]
    return F.expr(MACROS[name](f"`{column}`", query if isinstance(query, str) else vector_literal(query)))


def _payload(df: DataFrame, options: dict, column: str, id_col: str) -> Column | None:
    want = options.get("with_payload", False)
    if not want:
        return None
    cols = [c for c in df.columns if c not in (column, id_col)]
    if isinstance(want, dict):
        cols = [c for c in cols if (c in want["include"] if "include" in want else c not in want.get("exclude", []))]
    elif isinstance(want, list):
        cols = [c for c in cols if c in want]
    return F.struct(*(F.col(c) for c in cols)) if cols else None


def top_k_hits(df: DataFrame, column: str, query: Sequence[float] | str, k: int | None, metric: str = "l2", id_col: str = "id", distance_threshold: float | None = None, score_threshold: float | None = None, options: dict | None = None) -> DataFrame:
    """(id, score, rank[, payload][, vector]): the k nearest rows that pass the filter. Ties go to the smaller id; rows without a vector never hit.
    With k None (and no limit or offset) every row that passes the filter and thresholds, without a rank.

    options: filter, offset, limit (over k), with_payload (true, names, include or exclude), with_vector.
    """
    o = options or {}
    up = METRICS[metric][1]
    rows = df.where(compile_filter(o.get("filter"), id_col)).where(F.col(column).isNotNull())
    score = distance(column, query, metric)
    cols = [F.col(id_col).alias("id"), score.alias("score")]
    if (p := _payload(df, o, column, id_col)) is not None:
        cols.append(p.alias("payload"))
    if o.get("with_vector"):
        cols.append(F.col(column).alias("vector"))
    hits = rows.select(*cols).where("score IS NOT NULL")
    if distance_threshold is not None:
        hits = hits.where(F.col("score") >= distance_threshold if up else F.col("score") <= distance_threshold)
    if score_threshold is not None:
        hits = hits.where(F.col("score") >= score_threshold if up else F.col("score") <= score_threshold)
    order = [F.desc("score") if up else F.asc("score"), F.asc("id")]
    if k is None and not {"offset", "limit"} & o.keys():
        return hits
    skip, n = int(o.get("offset", 0)), o.get("limit", k)
    if n is None:
        raise ValueError("offset needs k or a limit")
    n = int(n)
    hits = hits.orderBy(*order).limit(n + skip)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long") - skip).where("rank > 0")  # over at most k rows


def top_k_ids(df: DataFrame, column: str, query: Sequence[float], k: int, metric: str = "l2", id_col: str = "id", **more) -> DataFrame:
    return top_k_hits(df, column, query, k, metric, id_col, **more).orderBy("rank").select("id")


def prefetch_hits(df: DataFrame, coarse: str, fine: str, query: Sequence[float], k: int, prefetch: int | None = None, metric: str = "l2", id_col: str = "id", coarse_query: Sequence[float] | None = None) -> DataFrame:
    """A coarse pass over one column keeps ``prefetch`` rows, an exact one over another ranks them."""
    first = top_k_hits(df.withColumn("__fine", F.col(fine)), coarse, coarse_query or query, prefetch or 4 * k, metric, id_col, options={"with_payload": ["__fine"]})
    return top_k_hits(first.select("id", F.col("payload.__fine").alias(fine)), fine, query, k, metric)


def recommend_hits(df: DataFrame, column: str, positive: Sequence, negative: Sequence, k: int, metric: str = "cosine", id_col: str = "id", options: dict | None = None) -> DataFrame:
    """Nearest rows to mean(positive), moved by mean(positive) - mean(negative) if there are negatives. Examples are ids (which never hit) or vectors."""
    ids = [x for x in [*positive, *negative] if not isinstance(x, (list, tuple))]
    found = {r[0]: list(r[1]) for r in df.where(F.col(id_col).isin(*ids)).select(id_col, column).collect()} if ids else {}  # the examples alone

    def mean(xs):
        vs = [found[x] if not isinstance(x, (list, tuple)) else list(x) for x in xs]
        return [sum(c) / len(vs) for c in zip(*vs)]

    query = mean(positive)
    if negative:
        query = [p + p - n for p, n in zip(query, mean(negative))]
    rest = df.where(~F.col(id_col).isin(*ids)) if ids else df
    return top_k_hits(rest, column, query, k, metric, id_col, options=options)


def full_text_hits(df: DataFrame, column: str, query: str, k: int, mode: str = "plain", config: str = "english", threshold: float | None = None, id_col: str = "id", options: dict | None = None) -> DataFrame:
    """(id, score, rank[, payload]): the k documents that rank best among those that match. mode: plain, phrase, web or query."""
    from pyspark.sql import SparkSession

    spark: SparkSession = df.sparkSession
    from ..functions import fulltext

    o = options or {}
    for name, udf in fulltext.udfs().items():
        spark.udf.register(name, udf)
    q = {"plain": lambda: fulltext.plain_query(query, " & ", config), "phrase": lambda: fulltext.plain_query(query, " <-> ", config), "web": lambda: fulltext.web_query(query, config), "query": lambda: fulltext.to_query(query, config)}[mode]()
    text = q.replace("\\", "\\\\").replace("'", "\\'")
    rows = df.where(compile_filter(o.get("filter"), id_col))
    cols = [F.col(id_col).alias("id"), F.expr(f"pm_text_rank(`{column}`, '{text}', '{config}')").alias("score")]
    if (p := _payload(df, o, column, id_col)) is not None:
        cols.append(p.alias("payload"))
    hits = rows.select(*cols).where("score IS NOT NULL")  # null where a text doesn't match
    hits = hits if threshold is None else hits.where(F.col("score") >= threshold)
    hits = hits.orderBy(F.desc("score"), "id").limit(int(o.get("limit", k)))
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))  # over at most k rows


def hybrid_hits(df: DataFrame, vector_col: str, text_col: str, vector: Sequence[float], text: str, k: int, fusion: str = "rrf", metric: str = "cosine", id_col: str = "id", candidates: int | None = None, options: dict | None = None) -> DataFrame:
    """Dense and full-text hits, fused."""
    from .fusion import fuse_dbsf, fuse_rrf

    n = candidates or 4 * k
    dense = top_k_hits(df, vector_col, vector, n, metric, id_col, options=options)
    sparse = full_text_hits(df, text_col, text, n, id_col=id_col, options=options)
    if fusion == "dbsf":  # distances fall with likeness
        dense = dense if METRICS[metric][1] else dense.withColumn("score", -F.col("score"))
        return fuse_dbsf(dense, sparse, k)
    return fuse_rrf(dense, sparse, k)
