"""Vector, full-text and hybrid search over embeddings and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import search as S
from ..operators import aggregates
from ..search import fusion
from ._case import case, engine

CASES: dict = {}


def _emb(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet")


def _docs(s, d):
    return s.read.parquet(f"{d}/documents.parquet")


QUERY = [round(((i * 37) % 64 - 32) / 64, 4) for i in range(64)]
_Q = "[" + ", ".join(map(str, QUERY)) + "]::DOUBLE[]"
_V = "embedding::DOUBLE[]"
_DISTANCE = {"l2": f"list_distance({_V}, {_Q})", "cosine": f"(1 - list_cosine_similarity({_V}, {_Q}))", "ip": f"list_inner_product({_V}, {_Q})", "l1": f"list_sum(list_transform(list_zip({_V}, {_Q}), lambda x: abs(x[1] - x[2])))"}
for _m, _sql in _DISTANCE.items():
    _o = "DESC" if _m == "ip" else "ASC"
    CASES[f"vector_top_k_{_m}"] = (lambda s, d, m=_m: S.top_k_hits(_emb(s, d), "embedding", QUERY, 10, m, "vec_id").withColumn("score", F.round("score", 4)), f"SELECT vec_id AS id, round({_sql}, 4) AS score, row_number() OVER (ORDER BY {_sql} {_o}, vec_id) AS rank FROM embeddings QUALIFY rank <= 10")
CASES["vector_top_k_ids"] = (lambda s, d: S.top_k_ids(_emb(s, d), "embedding", QUERY, 5, "l2", "vec_id"), f"SELECT vec_id AS id FROM embeddings ORDER BY {_DISTANCE['l2']}, vec_id LIMIT 5")
_FILTER = {"must": [{"key": "label", "range": {"gte": 2, "lt": 8}}], "must_not": [{"key": "label", "match": {"value": 5}}], "should": [{"key": "label", "match": {"any": [2, 3, 4]}}, {"has_id": [1, 2, 3]}]}
CASES["vector_filtered"] = (lambda s, d: S.top_k_hits(_emb(s, d), "embedding", QUERY, 10, "cosine", "vec_id", options={"filter": _FILTER, "offset": 2, "with_payload": True}).select("id", F.round("score", 6).alias("score"), "payload.label", "rank"),
    f"WITH h AS (SELECT vec_id AS id, round({_DISTANCE['cosine']}, 6) AS score, label, row_number() OVER (ORDER BY {_DISTANCE['cosine']}, vec_id) - 2 AS rank FROM embeddings WHERE label >= 2 AND label < 8 AND label <> 5 AND (label IN (2, 3, 4) OR vec_id IN (1, 2, 3))) SELECT * FROM h WHERE rank BETWEEN 1 AND 10")
CASES["vector_threshold"] = (lambda s, d: S.top_k_hits(_emb(s, d), "embedding", QUERY, None, "l2", "vec_id", distance_threshold=2.6).select("id"), f"SELECT vec_id AS id FROM embeddings WHERE {_DISTANCE['l2']} <= 2.6")
CASES["vector_prefetch"] = (lambda s, d: S.prefetch_hits(_emb(s, d), "embedding", "embedding", QUERY, 5, 50, "l2", "vec_id").select("id", "rank"), f"SELECT vec_id AS id, row_number() OVER (ORDER BY {_DISTANCE['l2']}, vec_id) AS rank FROM embeddings QUALIFY rank <= 5")
CASES["vector_recommend"] = (lambda s, d: S.recommend_hits(_emb(s, d), "embedding", [1, 2], [3], 8, "l2", "vec_id").select("id", "rank"),
    """WITH q AS (SELECT list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[], c.embedding::DOUBLE[]), lambda x: (x[1] + x[2]) - x[3]) AS q FROM embeddings a, embeddings b, embeddings c WHERE a.vec_id = 1 AND b.vec_id = 2 AND c.vec_id = 3),
    h AS (SELECT vec_id AS id, row_number() OVER (ORDER BY list_distance(embedding::DOUBLE[], q), vec_id) AS rank FROM embeddings, q WHERE vec_id NOT IN (1, 2, 3)) SELECT * FROM h WHERE rank <= 8""")
CASES["vector_aggregate"] = (lambda s, d: aggregates.vector_aggregate(_emb(s, d), ["label"], "embedding").select("label", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("x0"), F.round(F.get("embedding", F.lit(63)).cast("double"), 5).alias("x63")), "SELECT label, round(avg(embedding[1]::DOUBLE)::FLOAT::DOUBLE, 5) AS x0, round(avg(embedding[64]::DOUBLE)::FLOAT::DOUBLE, 5) AS x63 FROM embeddings GROUP BY label")
case(CASES, "vector_operators", "SELECT vec_id, round(embedding <-> '[" + ",".join(map(str, QUERY)) + "]'::vector, 5) AS l2, round(l2_norm(embedding), 5) AS n, vector_dims(embedding) AS d, binary_quantize(subvector(embedding, 1, 8)) AS b FROM embeddings",
     f"SELECT vec_id, round({_DISTANCE['l2']}, 5) AS l2, round(sqrt(list_inner_product({_V}, {_V})), 5) AS n, len(embedding) AS d, array_to_string(list_transform(embedding[1:8], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS b FROM embeddings")
case(CASES, "vector_functions", "SELECT round(cosine_distance(ARRAY[1.0, 0.0], ARRAY[1.0, 1.0]), 6) AS a, hamming_distance('1010', '1001') AS b, round(jaccard_distance('1010', '1001'), 6) AS c, negative_inner_product(ARRAY[1.0, 2.0], ARRAY[3.0, 4.0]) AS d, array_to_string(vector_add(ARRAY[1.0, 2.0], ARRAY[3.0, 4.0]), ',') AS e, array_to_string(sparsevec_in('{1:1.5,3:2}/4'), ',') AS f", "SELECT 0.292893 AS a, 2.0 AS b, 0.666667 AS c, -11.0 AS d, '4.0,6.0' AS e, '1.5,0.0,2.0,0.0' AS f")


def _lists(s, d):
    e = _emb(s, d)
    return S.top_k_hits(e, "embedding", QUERY, 30, "ip", "vec_id"), S.top_k_hits(e, "embedding", QUERY[::-1], 30, "ip", "vec_id")


_R = "[" + ", ".join(map(str, QUERY[::-1])) + "]::DOUBLE[]"
_LISTS = f"a AS (SELECT vec_id AS id, list_inner_product({_V}, {_Q}) AS score, row_number() OVER (ORDER BY list_inner_product({_V}, {_Q}) DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 30), b AS (SELECT vec_id AS id, list_inner_product({_V}, {_R}) AS score, row_number() OVER (ORDER BY list_inner_product({_V}, {_R}) DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 30)"
CASES["hybrid_rrf"] = (lambda s, d: S.fuse_rrf(*_lists(s, d), 20).withColumn("score", F.round("score", 8)), f"WITH {_LISTS}, u AS (SELECT id, sum(1.0 / (60 + rank))::DOUBLE AS score FROM (FROM a UNION ALL FROM b) GROUP BY 1) SELECT id, round(score, 8) AS score, row_number() OVER (ORDER BY round(score, 12) DESC, id) AS rank FROM u QUALIFY rank <= 20")
_N = "least(greatest((score - (avg(score) OVER () - 3 * stddev_pop(score) OVER ())) / (6 * stddev_pop(score) OVER ()), 0), 1)"
CASES["hybrid_dbsf"] = (lambda s, d: S.fuse_dbsf(*_lists(s, d), 20).select("id", F.round("score", 4).alias("score")), f"WITH {_LISTS}, u AS (SELECT id, {_N} AS p FROM a UNION ALL SELECT id, {_N} FROM b), f AS (SELECT id, sum(p) AS score FROM u GROUP BY 1) SELECT id, round(score, 4) AS score FROM f ORDER BY f.score DESC, id LIMIT 20")
CASES["hybrid_group"] = (lambda s, d: fusion.group_hits(S.top_k_hits(_emb(s, d), "embedding", QUERY, 60, "ip", "vec_id", options={"with_payload": True}), "label", 3, 2).select("group", "id", "place", "group_rank"),
    f"WITH h AS (SELECT label AS g, vec_id AS id, list_inner_product({_V}, {_Q}) AS s FROM embeddings ORDER BY s DESC, id LIMIT 60), p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, id) AS place FROM h), t AS (SELECT g, row_number() OVER (ORDER BY s DESC, id) AS group_rank FROM p WHERE place = 1) SELECT p.g AS \"group\", id, place, group_rank FROM p JOIN t ON p.g = t.g WHERE place <= 2 AND group_rank <= 3")
CASES["full_text_top_k"] = (lambda s, d: S.full_text_hits(_docs(s, d), "text", "license version", 20, id_col="doc_id"), None)
CASES["hybrid_search"] = (lambda s, d: S.hybrid_hits(_docs(s, d).join(_emb(s, d), F.col("doc_id") == F.col("vec_id")), "embedding", "text", QUERY, "license version", 10, id_col="doc_id"), None)


def ivf(s, d):
    from ..search.ivf import IvfIndex

    return IvfIndex.build(_emb(s, d), "embedding", "vec_id", nlist=16).search(QUERY, 10, nprobe=16).select("id", "rank")


CASES["vector_ivf_flat"] = (ivf, f"SELECT vec_id AS id, row_number() OVER (ORDER BY {_DISTANCE['l2']}, vec_id) AS rank FROM embeddings QUALIFY rank <= 10")


def vector_join_rank(s, d):
    """Hybrid of graph, filter and vectors: parts of a nation's customers, by likeness of their embeddings."""
    e = engine(s, d, "", "customer", "orders", "lineitem", "embeddings")
    e.sql("SELECT DISTINCT l_partkey AS id FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_nationkey = 7").createOrReplaceTempView("reached")
    rows = e.table("embeddings").join(s.table("reached"), F.col("vec_id") == F.col("id"), "left_semi")
    return S.top_k_hits(rows, "embedding", QUERY, 10, "l2", "vec_id").select("id", "rank")


CASES["vector_join_graph_filter_rank"] = (vector_join_rank, f"SELECT vec_id AS id, row_number() OVER (ORDER BY {_DISTANCE['l2']}, vec_id) AS rank FROM embeddings WHERE vec_id IN (SELECT l_partkey FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_nationkey = 7) QUALIFY rank <= 10")

_TEXT = "[" + ",".join(map(str, QUERY)) + "]"
_BACK = "[" + ",".join(map(str, QUERY[::-1])) + "]"
case(CASES, "sql_vector_top_k", f"SELECT h.id, h.rank FROM vector_top_k_hits('embeddings', 'embedding', '{_TEXT}', 7, 'ip', NULL, NULL, NULL, NULL, '{{\"filter\": {{\"key\": \"label\", \"range\": {{\"lte\": 6}}}}}}') AS h",
     f"SELECT vec_id AS id, row_number() OVER (ORDER BY {_DISTANCE['ip']} DESC, vec_id) AS rank FROM embeddings WHERE label <= 6 QUALIFY rank <= 7")
case(CASES, "sql_hybrid_rrf", f"SELECT id, rank FROM hybrid_fuse_rrf_hits(vector_top_k_hits('embeddings', 'embedding', '{_TEXT}', 30, 'ip'), vector_top_k_hits('embeddings', 'embedding', '{_BACK}', 30, 'ip'), 20) AS f",
     f"WITH {_LISTS}, u AS (SELECT id, sum(1.0 / (60 + rank))::DOUBLE AS score FROM (FROM a UNION ALL FROM b) GROUP BY 1) SELECT id, row_number() OVER (ORDER BY round(score, 12) DESC, id) AS rank FROM u QUALIFY rank <= 20")
