"""Operators, sources, streams and search in corner cases."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from polymodal import Engine, search, sources, streaming
from polymodal.operators import aggregates, dml, joins, recursive, sequences
from polymodal.search.ivf import IvfIndex
from polymodal.search.quantize import BinaryQuantizer, ProductQuantizer, ScalarQuantizer


def test_full_outer_join_keeps_no_pairs_of_a_key(spark):
    """Generated code of this join holds all matches of a key in memory before the first leaves it: a plan of the engine has none."""
    e = Engine(spark)
    e.register("fl", spark.createDataFrame([(1, 1, 5.0), (2, 1, 1.0), (3, None, 9.0), (4, 7, 9.0)], "a int, k int, x double"))
    e.register("fr", spark.createDataFrame([(10, 1, 4.0), (11, 1, 6.0), (12, None, 0.0), (13, 1, 0.5)], "b int, j int, y double"))
    df = e.sql("SELECT a, b FROM fl FULL OUTER JOIN fr ON k = j AND x > y")
    assert set(map(tuple, df.collect())) == {(1, 10), (1, 13), (2, 13), (3, None), (4, None), (None, 11), (None, 12)} and df.count() == 7
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" in plan and not re.search(r"\*\(\d+\) SortMergeJoin[^\n]*FullOuter", plan)


def test_asof_and_interval_joins(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), ("c", 1)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 10, "z")], "k string, t int, v string")
    assert sorted(map(tuple, joins.asof(left, right, ["k"], "t").collect())) == [("a", 1, None), ("a", 5, "y"), ("b", 9, None), ("c", 1, None)]
    p = spark.createDataFrame([(0.5,), (10.0,), (-3.0,)], "x double")
    i = spark.createDataFrame([(-5.0, 0.6), (10.0, 11.0)], "lo double, hi double")
    assert sorted(r["x"] for r in joins.interval_join(p, i, "x", "lo", "hi", 4.0).collect()) == [-3.0, 0.5, 10.0]


def test_array_agg_and_hypothetical_ranks(spark):
    df = spark.createDataFrame([(1, None), (1, 3.0), (2, 5.0)], "k int, x double")
    got = {r["k"]: r["a"] for r in df.groupBy("k").agg(aggregates.array_agg(F.col("x"), F.col("x")).alias("a")).collect()}
    assert got == {1: [None, 3.0], 2: [5.0]}
    assert df.limit(0).agg(aggregates.array_agg(F.col("x")).alias("a")).first()["a"] is None


def test_upsert_and_merge_actions(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c"), (3, "d"), (None, "m")], "id int, v string")
    got = sorted(((r["id"], r["v"]) for r in dml.upsert(t, new, ["id"], {"v": "excluded.v"}).collect()), key=str)
    assert got == sorted([(1, "a"), (2, "B"), (3, "c"), (None, "n"), (None, "m")], key=str)
    m = dml.merge(t, new.limit(2), "t.id = s.id", [("s.v = 'B'", {"v": "concat(t.v, s.v)"})], [("true", {"id": "s.id", "v": "s.v"})], [("t.id = 1", "delete")])
    assert sorted(map(str, (r["v"] for r in m.collect()))) == ["bB", "c", "n"]


def test_fixpoint_of_nulls(spark):
    base = spark.createDataFrame([(None,), (0,)], "n int")
    out = recursive.fixpoint(base, lambda d: d.select(((F.col("n") + 1) % 3).alias("n")))
    assert sorted((r["n"] for r in out.collect()), key=str) == [0, 1, 2, None]


def test_sequence(spark):
    s = sequences.Sequence(5, 2)
    assert [s.nextval(), s.nextval(), s.currval()] == [5, 7, 7]
    got = [r["n"] for r in s.number(spark.range(100), "n", "id").orderBy("id").collect()]
    assert got == list(range(9, 209, 2)) and s.nextval() == 209
    assert s.number(spark.range(0), "n", "id").count() == 0


def test_copy_text_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"", None), (2, "", 2.5), (3, None, -1.0)], "id int, s string, x double")
    for fmt in ("text", "csv"):
        path = str(tmp_path / fmt)
        sources.copy_to(df, path, fmt, header=fmt == "csv")
        got = sources.copy_from(spark, path, "id int, s string, x double", fmt, header=fmt == "csv").orderBy("id").collect()
        assert [(r["id"], r["x"]) for r in got] == [(1, None), (2, 2.5), (3, -1.0)] and got[0]["s"] == 'a,"b"' and got[2]["s"] is None


def test_stream_equals_batch(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.write.parquet(str(tmp_path / "in"))
    make = lambda df: streaming.tumbling(df, "ts", "1 day", ["event_type"], F.count(F.lit(1)).alias("n"), late="1 day")
    q = make(streaming.read_events(spark, str(tmp_path / "in"), ev.schema.simpleString().removeprefix("struct<")[:-1].replace(":", " "))).writeStream.format("memory").queryName("win").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("win").collect())) == sorted(map(tuple, make(ev).collect()))


def test_filters(spark):
    df = spark.createDataFrame([(1, "red apple", [1, 2], ("x",)), (2, None, [], ("y",)), (3, "green", None, ("x",))], "id int, c string, tags array<int>, n struct<a:string>")
    ids = lambda f: [r["id"] for r in df.where(search.compile_filter(f)).orderBy("id").collect()]
    assert ids({"must": [{"key": "n.a", "match": {"value": "x"}}]}) == [1, 3]
    assert ids({"must_not": [{"key": "c", "match": {"text": "apple"}}]}) == [2, 3]
    assert ids({"must": [{"key": "tags", "values_count": {"gte": 1}}]}) == [1]
    assert ids({"must": [{"is_null": {"key": "c"}}]}) == [2] and ids({"must": [{"is_empty": {"key": "tags"}}]}) == [2, 3]
    assert ids({"min_should": {"conditions": [{"has_id": [1, 3]}, {"key": "id", "range": {"gt": 2}}], "min_count": 2}}) == [3]
    assert ids({"must": [{"key": "tags[0]", "match": {"value": 1}}]}) == [1] and ids({}) == [1, 2, 3]
    with pytest.raises(ValueError):
        ids({"key": "id", "nothing": 1})


def test_hits_and_fusion(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "b"), (3, None, "a"), (4, [0.0, 1.0], "a"), (5, [1.0, 0.0], "b")], "id int, v array<float>, g string")
    hits = search.top_k_hits(df, "v", [1.0, 0.0], 3, "l2", options={"with_payload": {"include": ["g"]}, "with_vector": True}).orderBy("rank").collect()
    assert [(r["id"], r["rank"], r["payload"]["g"]) for r in hits] == [(1, 1, "a"), (5, 2, "b"), (2, 3, "b")]
    a = spark.createDataFrame([(1, 1.0, 1), (2, 1.0, 2)], "id int, score double, rank int")
    b = spark.createDataFrame([(2, 9.0, 1), (3, 1.0, 2)], "id int, score double, rank int")
    rrf = search.fuse_rrf(a, b, 3).collect()
    assert rrf[0]["id"] == 2 and rrf[0]["score"] == pytest.approx(1 / 62 + 1 / 61)
    dbsf = {r["id"]: r["score"] for r in search.fuse_dbsf(a, b, 3).collect()}
    assert dbsf[1] == 0.5 and dbsf[2] == pytest.approx(0.5 + 4 / 6) and dbsf[3] == pytest.approx(2 / 6)
    assert search.fuse_rrf(a.limit(0), b.limit(0), 3).count() == 0


def test_ivf_and_quantizers(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(400)], "id int, v array<float>")
    index = IvfIndex.build(df, "v", nlist=8).save(str(tmp_path / "ivf"))
    want = [r["id"] for r in search.top_k_ids(df, "v", x[7].tolist(), 10).collect()]
    assert [r["id"] for r in index.search(x[7].tolist(), 10, nprobe=8).orderBy("rank").collect()] == want
    near = {r["id"] for r in index.search(x[7].tolist(), 10, nprobe=2).collect()}
    assert 7 in near
    true = np.sqrt(((x - x[7]) ** 2).sum(1))
    s = ScalarQuantizer.train(x)
    assert np.abs(s.distances(x[7], s.encode(x)) - true).max() < 0.2
    p = ProductQuantizer.train(x, parts=8, words=64)
    assert np.corrcoef(p.distances(x[7], p.encode(x)), true)[0, 1] > 0.9
    assert np.allclose(p.distances(x[7], p.encode(x)), np.sqrt(((p.decode(p.encode(x)) - x[7]) ** 2).sum(1)))
    assert BinaryQuantizer.distances(x[7], BinaryQuantizer.encode(x))[7] == 0
