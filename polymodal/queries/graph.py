"""Graph queries and algorithms over nations, customers, orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..graph import algorithms as A
from ..graph import procedures
from ._case import engine

CASES: dict = {}


def shop(spark, sf_dir):
    """customer -placed-> orders -contains-> part; customer and supplier -in-> nation -of-> region."""
    e = engine(spark, sf_dir, "", "region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    g = e.graph
    g.node_label("Customer", e.table("customer"), "c_custkey").node_label("Order", e.table("orders"), "o_orderkey").node_label("Part", e.table("part"), "p_partkey").node_label("Nation", e.table("nation"), "n_nationkey").node_label("Region", e.table("region"), "r_regionkey").node_label("Supplier", e.table("supplier"), "s_suppkey")
    g.edge_label("PLACED", e.table("orders").select("o_custkey", "o_orderkey", "o_totalprice"), "Customer", "Order", "o_custkey", "o_orderkey")
    g.edge_label("CONTAINS", e.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity"), "Order", "Part", "l_orderkey", "l_partkey")
    g.edge_label("IN", e.table("customer").select("c_custkey", "c_nationkey"), "Customer", "Nation", "c_custkey", "c_nationkey")
    g.edge_label("OF", e.table("nation").select("n_nationkey", "n_regionkey"), "Nation", "Region", "n_nationkey", "n_regionkey")
    g.edge_label("SUPPLIES_FROM", e.table("supplier").select("s_suppkey", "s_nationkey"), "Supplier", "Nation", "s_suppkey", "s_nationkey")
    return e


def ring(spark, sf_dir):
    """Nations with edges k -> 2k + 1 and k -> 3k + 2 (mod 25)."""
    e = engine(spark, sf_dir, "", "nation")
    t = e.table("nation").select("n_nationkey", F.explode(F.array((F.col("n_nationkey") * 2 + 1) % 25, (F.col("n_nationkey") * 3 + 2) % 25)).alias("to")).where("n_nationkey <> to").distinct()
    e.graph.node_label("Nation", e.table("nation"), "n_nationkey").edge_label("NEXT", t, "Nation", "Nation", "n_nationkey", "to")
    return e


_RING = "e AS (SELECT DISTINCT src, dst FROM (SELECT n_nationkey AS src, unnest([(n_nationkey * 2 + 1) % 25, (n_nationkey * 3 + 2) % 25]) AS dst FROM nation) WHERE src <> dst)"


def _q(name, text, oracle, on=shop):
    CASES[name] = (lambda spark, d: on(spark, d).graph.query(text), oracle)


_q("graph_node_scan", "MATCH (n:Nation {n_regionkey: 1}) RETURN n.n_nationkey AS id, n.n_name AS name", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 1")
_q("graph_one_hop", "MATCH (c:Customer)-[p:PLACED]->(o:Order) WHERE o.o_totalprice > 200000 RETURN c.c_name AS name, o.o_orderkey AS k, p.o_totalprice AS price", "SELECT c_name AS name, o_orderkey AS k, o_totalprice AS price FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000")
_q("graph_in_hop", "MATCH (r:Region)<-[:OF]-(n:Nation) RETURN r.r_name AS region, count(n) AS nations", "SELECT r_name AS region, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_q("graph_two_hops", "MATCH (c:Customer)-[:IN]->(n:Nation)-[:OF]->(r:Region) RETURN r.r_name AS region, count(*) AS n, avg(c.c_acctbal) > 0 AS positive ORDER BY region", "SELECT r_name AS region, count(*) AS n, avg(c_acctbal) > 0 AS positive FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_q("graph_both_directions", "MATCH (a:Nation {n_nationkey: 3})-[:NEXT]-(b) RETURN b.n_nationkey AS id", f"WITH {_RING} SELECT dst AS id FROM e WHERE src = 3 UNION ALL SELECT src FROM e WHERE dst = 3", ring)
_q("graph_type_alternatives", "MATCH (n:Nation)<-[r:IN|SUPPLIES_FROM]-(x) RETURN n.n_nationkey AS id, type(r) AS t, count(*) AS n", "SELECT c_nationkey AS id, 'IN' AS t, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, 'SUPPLIES_FROM', count(*) FROM supplier GROUP BY 1")
_q("graph_optional", "MATCH (n:Nation) OPTIONAL MATCH (s:Supplier)-[:SUPPLIES_FROM]->(n) WHERE s.s_acctbal > 0 RETURN n.n_nationkey AS id, s.s_suppkey AS s", "SELECT n_nationkey AS id, s_suppkey AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0")
_q("graph_with_filter", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS orders, sum(o.o_totalprice) AS total WHERE orders > 12 RETURN c.c_custkey AS k, orders, round(total, 2) AS total ORDER BY total DESC LIMIT 20", "SELECT o_custkey AS k, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 HAVING count(*) > 12 ORDER BY total DESC LIMIT 20")
_q("graph_unwind", "UNWIND [1, 2, 3] AS x UNWIND ['a', 'b'] AS y RETURN x, y, x * 2 AS d", "SELECT x, y, x * 2 AS d FROM (VALUES (1), (2), (3)) a(x), (VALUES ('a'), ('b')) b(y)")
_q("graph_pattern_predicate", "MATCH (n:Nation) WHERE NOT (n)<-[:SUPPLIES_FROM]-(:Supplier) RETURN n.n_nationkey AS id", "SELECT n_nationkey AS id FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
_q("graph_exists_subquery", "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 250000 } RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
_q("graph_var_length", "MATCH (a:Nation {n_nationkey: 1})-[r:NEXT*1..3]->(b:Nation) RETURN b.n_nationkey AS id, size(r) AS hops", f"WITH RECURSIVE {_RING}, p(id, hops, used) AS (SELECT dst, 1, [src * 100 + dst] FROM e WHERE src = 1 UNION ALL SELECT dst, hops + 1, list_append(used, src * 100 + dst) FROM p JOIN e ON e.src = p.id WHERE hops < 3 AND NOT list_contains(used, src * 100 + dst)) SELECT id, hops FROM p", ring)
_q("graph_shortest_path", "MATCH (a:Nation {n_nationkey: 1}), (b:Nation) MATCH p = shortestPath((a)-[:NEXT*]->(b)) RETURN b.n_nationkey AS id, length(p) AS hops", f"WITH RECURSIVE {_RING}, p(id, hops) AS (SELECT dst, 1 FROM e WHERE src = 1 UNION SELECT dst, hops + 1 FROM p JOIN e ON e.src = p.id WHERE hops < 25) SELECT id, min(hops) AS hops FROM p WHERE id <> 1 GROUP BY id", ring)
_q("graph_named_path", "MATCH p = (a:Nation {n_nationkey: 4})-[:NEXT]->(b)-[:NEXT]->(c) RETURN nodes(p)[0] AS f, nodes(p)[2] AS l, length(p) AS n", f"WITH {_RING} SELECT 4 AS f, y.dst AS l, 2 AS n FROM e x JOIN e y ON x.dst = y.src WHERE x.src = 4 AND NOT (x.src = y.src AND x.dst = y.dst)", ring)
_q("graph_union", "MATCH (n:Nation) WHERE n.n_nationkey < 3 RETURN n.n_name AS name UNION MATCH (r:Region) RETURN r.r_name AS name", "SELECT n_name AS name FROM nation WHERE n_nationkey < 3 UNION SELECT r_name FROM region")
_q("graph_collect", "MATCH (n:Nation)-[:OF]->(r:Region) WITH r, n ORDER BY n.n_nationkey RETURN r.r_regionkey AS k, size(collect(n.n_name)) AS n, any(x IN collect(n.n_nationkey) WHERE x > 20) AS big", "SELECT n_regionkey AS k, count(*) AS n, max(n_nationkey) > 20 AS big FROM nation GROUP BY 1")
_q("graph_strings_lists", "MATCH (n:Nation) WHERE n.n_name STARTS WITH 'A' OR n.n_name CONTAINS 'AN' OR n.n_nationkey IN [1, 2] RETURN n.n_nationkey AS id, [x IN range(1, 3) WHERE x <> 2 | x * 10][1] AS t, n.n_name ENDS WITH 'A' AS e", "SELECT n_nationkey AS id, 30 AS t, n_name LIKE '%A' AS e FROM nation WHERE n_name LIKE 'A%' OR n_name LIKE '%AN%' OR n_nationkey IN (1, 2)")
_q("graph_call_subquery", "MATCH (r:Region) CALL { WITH r MATCH (r)<-[:OF]-(n:Nation) RETURN count(n) AS n } RETURN r.r_name AS name, n", "SELECT r_name AS name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
_q("graph_call_algorithm", "CALL graph.degreeCentrality() YIELD nodeId, score RETURN nodeId AS id, round(score, 8) AS score", f"WITH {_RING} SELECT n_nationkey AS id, round((SELECT count(*) FROM e WHERE src = n_nationkey) / 24.0, 8) AS score FROM nation", ring)
_q("graph_k_hop_counts", "MATCH (c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part) RETURN p.p_brand AS brand, count(*) AS n, count(DISTINCT c) AS customers", "SELECT p_brand AS brand, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1")


def graph_neighbors(spark, d):
    return ring(spark, d).graph.neighbors("NEXT", 3)


CASES["graph_neighbors"] = (graph_neighbors, f"WITH {_RING} SELECT DISTINCT dst AS id FROM e WHERE src = 3")


def graph_create(spark, d):
    e = ring(spark, d)
    e.graph.query("MATCH (a:Nation {n_nationkey: 3}) CREATE (a)-[:NEXT]->(b:Nation {n_nationkey: 77, n_name: 'X'})")
    e.graph.query("MATCH (n:Nation {n_nationkey: 5}) SET n.n_name = 'FIVE'")
    e.graph.query("MATCH (n:Nation {n_nationkey: 6}) DETACH DELETE n")
    return e.graph.query("MATCH (n:Nation) OPTIONAL MATCH (n)-[:NEXT]->(m:Nation) RETURN n.n_nationkey AS id, n.n_name AS name, count(m) AS deg")


CASES["graph_mutations"] = (graph_create, f"WITH {_RING}, n AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey = 5 THEN 'FIVE' ELSE n_name END AS name FROM nation WHERE n_nationkey <> 6 UNION ALL SELECT 77, 'X'), f AS (SELECT * FROM e WHERE src <> 6 AND dst <> 6 UNION ALL SELECT 3, 77) SELECT id, name, count(dst) AS deg FROM n LEFT JOIN f ON id = src GROUP BY 1, 2")


def _p(name, proc, *args, oracle=None, round_=None, weight=None):
    def run(spark, d):
        df = procedures.call(ring(spark, d).graph, proc, *args, weight=weight)
        for c, k in df.dtypes:
            if k == "double":
                df = df.withColumn(c, F.round(c, round_ or 6))
            elif k.startswith("array"):
                df = df.withColumn(c, F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
        return df

    CASES[name] = (run, oracle)


_U = f"{_RING}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
_p("algo_in_degree", "graph.inDegreeCentrality", oracle=f"WITH {_RING} SELECT n_nationkey AS nodeId, round((SELECT count(*) FROM e WHERE dst = n_nationkey) / 24.0, 6) AS score FROM nation")
_p("algo_out_degree", "graph.outDegreeCentrality", oracle=f"WITH {_RING} SELECT n_nationkey AS nodeId, round((SELECT count(*) FROM e WHERE src = n_nationkey) / 24.0, 6) AS score FROM nation")
_p("algo_degree_distribution", "graph.degreeDistribution", oracle=f"WITH {_RING}, d AS (SELECT n_nationkey, (SELECT count(*) FROM e WHERE src = n_nationkey) AS degree FROM nation) SELECT degree, count(*) AS count FROM d GROUP BY 1")
_p("algo_weighted_degree", "graph.weightedDegreeCentrality", oracle=f"WITH {_RING} SELECT n_nationkey AS nodeId, (SELECT count(*) FROM e WHERE src = n_nationkey)::DOUBLE AS score FROM nation")
_p("algo_components", "graph.connectedComponents", oracle=f"WITH RECURSIVE {_U}, r(a, b) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT r.a, u.dst FROM r JOIN u ON r.b = u.src) SELECT a AS nodeId, min(b) AS componentId FROM r GROUP BY 1")
_p("algo_component_count", "graph.componentCount", oracle=f"WITH RECURSIVE {_U}, r(a, b) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT r.a, u.dst FROM r JOIN u ON r.b = u.src) SELECT count(DISTINCT m) AS components FROM (SELECT min(b) AS m FROM r GROUP BY a)")
_p("algo_strong_components", "graph.stronglyConnectedComponents", oracle=f"WITH RECURSIVE {_RING}, r(a, b) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src) SELECT x.a AS nodeId, min(x.b) AS componentId FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1")
_TRI = f"{_U}, t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM u x JOIN u y ON x.dst = y.src JOIN u z ON z.src = y.dst AND z.dst = x.src WHERE x.src < x.dst AND x.dst < y.dst)"
_p("algo_triangles", "graph.triangleCount", oracle=f"WITH {_TRI} SELECT n_nationkey AS nodeId, (SELECT count(*) FROM t WHERE n_nationkey IN (a, b, c)) AS triangles FROM nation")
_p("algo_total_triangles", "graph.totalTriangleCount", oracle=f"WITH {_TRI} SELECT count(*) AS triangles FROM t")
_p("algo_local_clustering", "graph.localClusteringCoefficient", oracle=f"WITH {_TRI}, d AS (SELECT src, count(*) AS d FROM u GROUP BY 1) SELECT n_nationkey AS nodeId, round(CASE WHEN d > 1 THEN 2.0 * (SELECT count(*) FROM t WHERE n_nationkey IN (a, b, c)) / (d * (d - 1)) ELSE 0 END, 6) AS coefficient FROM nation LEFT JOIN d ON src = n_nationkey")
_p("algo_global_clustering", "graph.globalClusteringCoefficient", oracle=f"WITH {_TRI}, d AS (SELECT src, count(*) AS d FROM u GROUP BY 1) SELECT round(3.0 * (SELECT count(*) FROM t) / (SELECT sum(d * (d - 1) / 2) FROM d), 6) AS coefficient")
_p("algo_common_neighbors", "graph.commonNeighbors", 1, 3, oracle=f"WITH {_RING} SELECT dst AS nodeId FROM e WHERE src = 1 INTERSECT SELECT dst FROM e WHERE src = 3")
_p("algo_jaccard", "graph.jaccardSimilarity", 1, 3, oracle=f"WITH {_RING}, a AS (SELECT dst FROM e WHERE src = 1), b AS (SELECT dst FROM e WHERE src = 3) SELECT round((SELECT count(*) FROM (FROM a INTERSECT FROM b))::DOUBLE / (SELECT count(*) FROM (FROM a UNION FROM b)), 6) AS score")
_p("algo_overlap", "graph.overlapCoefficient", 1, 3, oracle=f"WITH {_RING}, a AS (SELECT dst FROM e WHERE src = 1), b AS (SELECT dst FROM e WHERE src = 3) SELECT round((SELECT count(*) FROM (FROM a INTERSECT FROM b))::DOUBLE / least((SELECT count(*) FROM a), (SELECT count(*) FROM b)), 6) AS score")
_p("algo_adamic_adar", "graph.adamicAdar", 1, 3, oracle=f"WITH {_RING}, c AS (SELECT dst FROM e WHERE src = 1 INTERSECT SELECT dst FROM e WHERE src = 3) SELECT round(coalesce(sum(1 / ln(d)), 0.0), 6) AS score FROM (SELECT (SELECT count(*) FROM e WHERE e.src = c.dst) AS d FROM c) WHERE d > 1")
_DIST = f"{_RING}, p(s, id, hops) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION SELECT s, dst, hops + 1 FROM p JOIN e ON e.src = p.id WHERE hops < 24), d AS (SELECT s, id, min(hops) AS h FROM p GROUP BY 1, 2)"
_p("algo_all_pairs", "graph.allPairs", oracle=f"WITH RECURSIVE {_DIST} SELECT s AS sourceNodeId, id AS targetNodeId, h::DOUBLE AS distance FROM d WHERE s <> id")
_p("algo_closeness", "graph.closenessCentrality", oracle=f"WITH RECURSIVE {_DIST} SELECT n_nationkey AS nodeId, round(coalesce((SELECT count(*)::DOUBLE / sum(h) FROM d WHERE s = n_nationkey AND id <> s), 0), 6) AS score FROM nation")
_p("algo_closeness_wf", "graph.closenessCentralityWf", oracle=f"WITH RECURSIVE {_DIST} SELECT n_nationkey AS nodeId, round(coalesce((SELECT count(*)::DOUBLE / sum(h) * count(*) / 24.0 FROM d WHERE s = n_nationkey AND id <> s), 0), 6) AS score FROM nation")
_p("algo_harmonic", "graph.harmonicCentrality", oracle=f"WITH RECURSIVE {_DIST} SELECT n_nationkey AS nodeId, round(coalesce((SELECT sum(1.0 / h) FROM d WHERE s = n_nationkey AND id <> s), 0), 6) AS score FROM nation")
_p("algo_delta_stepping", "graph.deltaStepping", 1, oracle=f"WITH RECURSIVE {_DIST} SELECT id AS nodeId, h::DOUBLE AS distance FROM d WHERE s = 1")
CASES["algo_shortest_path"] = (lambda spark, d: procedures.call(ring(spark, d).graph, "graph.shortestPath", 1, 20).select("sourceNodeId", "targetNodeId", "distance", (F.size("path") - 1).alias("hops")), f"WITH RECURSIVE {_DIST} SELECT s AS sourceNodeId, id AS targetNodeId, h::DOUBLE AS distance, h AS hops FROM d WHERE s = 1 AND id = 20")
_p("algo_bellman_ford", "graph.bellmanFord", 1, oracle=f"WITH RECURSIVE {_DIST} SELECT id AS nodeId, h::DOUBLE AS distance FROM d WHERE s = 1")
_p("algo_modularity", "graph.modularity", [[i, i % 3] for i in range(25)], oracle=f"WITH {_U}, c AS (SELECT src % 3 AS k, count(*) AS deg, count(*) FILTER (WHERE src % 3 = dst % 3) AS inside FROM u GROUP BY 1), m AS (SELECT count(*)::DOUBLE AS m2 FROM u) SELECT round(sum(inside / m2 - (deg / m2) ** 2), 6) AS modularity FROM c, m")
_p("algo_conductance", "graph.conductance", [[i, i % 3] for i in range(25)], oracle=f"WITH {_RING}, c AS (SELECT src % 3 AS k, count(*)::DOUBLE AS vol, count(*) FILTER (WHERE src % 3 <> dst % 3)::DOUBLE AS cut FROM e GROUP BY 1), m AS (SELECT count(*)::DOUBLE AS a FROM e) SELECT n_nationkey AS nodeId, round(cut / least(vol, a - vol), 6) AS score FROM nation, c, m WHERE k = n_nationkey % 3")
for _name, _proc, _args in (
    ("algo_approximate_ppr", "graph.approximatePPR", (1,)),
    ("algo_hits", "graph.hits", ()), ("algo_eigenvector", "graph.eigenvectorCentrality", ()), ("algo_sampled_betweenness", "graph.sampledBetweenness", (0, 10)),
    ("algo_single_source", "graph.singleSourceShortestPath", (1,)), ("algo_dijkstra", "graph.dijkstra", (1, 20)), ("algo_yen", "graph.yen", (1, 20, 3)), ("algo_kcore", "graph.kcore", ()), ("algo_degeneracy", "graph.degeneracy", ()),
    ("algo_articulation_points", "graph.articulationPoints", ()), ("algo_bridges", "graph.bridges", ()), ("algo_label_propagation", "graph.labelPropagation", ()), ("algo_louvain", "graph.louvain", ()), ("algo_leiden", "graph.leiden", ()), ("algo_k1_coloring", "graph.k1Coloring", ()), ("algo_max_k_cut", "graph.maxKCut", ()), ("algo_sllpa", "graph.sllpa", ()),
    ("algo_spanning_tree", "graph.minimumSpanningTree", ()), ("algo_k_spanning_tree", "graph.kSpanningTree", (3,)), ("algo_steiner_tree", "graph.steinerTree", ([7, 20], 1)), ("algo_link_prediction", "graph.linkPrediction", (10,)),
    ("algo_random_walk", "graph.randomWalk", (7, 10, 2)), ("algo_node2vec", "graph.node2vec", (0.5, 7, 2.0, 10, 2)), ("algo_fast_rp", "graph.fastRP", (16,)), ("algo_hashgnn", "graph.hashgnn", (16,)),
):
    _p(_name, _proc, *_args)


def _power(share: str, home: str, rounds: int = 20) -> str:
    """Rounds of PageRank by recursion: share is what an edge carries of its source's rank, home where rank starts and lost rank goes."""
    return f"""WITH RECURSIVE {_RING}, o AS (SELECT src, count(*) AS d FROM e GROUP BY 1), m AS (SELECT count(*) / 25.0::DOUBLE AS mean FROM e),
    w AS (SELECT e.src, e.dst, {share} AS share FROM e JOIN o ON o.src = e.src, m), v AS (SELECT n_nationkey AS id, {home} AS home FROM nation),
    r(it, id, pr) AS (SELECT 0, id, home FROM v UNION ALL
      SELECT i.it + 1, v.id, 0.15::DOUBLE * v.home + 0.85::DOUBLE * (coalesce(f.s, 0) + (1 - k.kept) * v.home)
      FROM v CROSS JOIN (SELECT max(it) AS it FROM r) i CROSS JOIN (SELECT coalesce(sum(r.pr * w.share), 0) AS kept FROM r JOIN w ON w.src = r.id) k
      LEFT JOIN (SELECT w.dst, sum(r.pr * w.share) AS s FROM r JOIN w ON w.src = r.id GROUP BY 1) f ON f.dst = v.id WHERE i.it < {rounds})
    SELECT id AS nodeId, round(pr, 4) AS score FROM r WHERE it = {rounds}"""


_KATZ = f"""WITH RECURSIVE {_RING}, r(it, id, x) AS (SELECT 0, n_nationkey, 0.0::DOUBLE FROM nation UNION ALL
    SELECT i.it + 1, n_nationkey, 0.1::DOUBLE * coalesce(f.s, 0) + 1 FROM nation CROSS JOIN (SELECT max(it) AS it FROM r) i LEFT JOIN (SELECT dst, sum(x) AS s FROM r JOIN e ON src = id GROUP BY 1) f ON f.dst = n_nationkey WHERE i.it < 40)
    SELECT id AS nodeId, round(x, 4) AS score FROM r WHERE it = 40"""


def _similar(a: str, b: str, where: str = "true") -> str:
    return f"""WITH {_RING}, d AS (SELECT src, count(*) AS d FROM e GROUP BY 1), p AS (SELECT x.src AS a, y.src AS b, count(*) AS c FROM e x JOIN e y ON x.dst = y.dst AND x.src <> y.src GROUP BY 1, 2),
    s AS (SELECT a, b, c::DOUBLE / (da.d + db.d - c) AS score FROM p JOIN d da ON da.src = a JOIN d db ON db.src = b WHERE {where})
    SELECT a AS "{a}", b AS "{b}", round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5"""


_BETWEEN = f"""WITH RECURSIVE {_RING}, p(s, id, hops, n) AS (SELECT n_nationkey, n_nationkey, 0, 1::DOUBLE FROM nation UNION ALL SELECT s, dst, hops + 1, sum(n) FROM p JOIN e ON e.src = p.id WHERE hops < 24 GROUP BY 1, 2, 3),
    d AS (SELECT s, id, min(hops) AS h, arg_min(n, hops) AS n FROM p GROUP BY 1, 2)
    SELECT n_nationkey AS nodeId, round(coalesce((SELECT sum(a.n * b.n / c.n) FROM d a JOIN d b ON b.s = a.id JOIN d c ON c.s = a.s AND c.id = b.id AND c.h = a.h + b.h WHERE a.id = n_nationkey AND a.s <> a.id AND b.id <> a.id AND a.s <> b.id), 0) / (24 * 23), 6) AS score FROM nation"""
_p("algo_betweenness", "graph.betweennessCentrality", oracle=_BETWEEN)
_UNI = "1 / 25.0::DOUBLE"
_p("algo_pagerank", "graph.pageRank", oracle=_power("1.0::DOUBLE / d", _UNI), round_=4)
_p("algo_weighted_pagerank", "graph.weightedPageRank", oracle=_power("1.0::DOUBLE / d", _UNI), round_=4)
_p("algo_article_rank", "graph.articleRank", oracle=_power("1.0::DOUBLE / (d + mean)", _UNI), round_=4)
_p("algo_personalized_pagerank", "graph.personalizedPageRank", 0.85, 20, 1, 0.0, oracle=_power("1.0::DOUBLE / d", "(n_nationkey = 1)::INT::DOUBLE"), round_=4)
_p("algo_katz", "graph.katzCentrality", oracle=_KATZ, round_=4)
_p("algo_node_similarity", "graph.nodeSimilarity", 5, oracle=_similar("node1Id", "node2Id"))
_p("algo_knn", "graph.knn", 5, oracle=_similar("nodeId", "neighborId"))
_p("algo_filtered_knn", "graph.filteredKnn", [[i, i % 2] for i in range(25)], 5, oracle=_similar("nodeId", "neighborId", "a % 2 = b % 2"))


def _dag(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("src"))
    return n.select("src", F.explode(F.array(F.col("src") + 2, F.col("src") * 2 + 1)).alias("dst"), F.lit(1.0).alias("weight")).where("dst < 25 AND src <> dst").distinct()


_DAG = "e AS (SELECT DISTINCT src, dst FROM (SELECT n_nationkey AS src, unnest([n_nationkey + 2, n_nationkey * 2 + 1]) AS dst FROM nation) WHERE dst < 25)"
CASES["algo_longest_path"] = (lambda s, d: A.longest_path(_dag(s, d)), f"WITH RECURSIVE {_DAG}, p(id, n) AS (SELECT id, 0 FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) UNION SELECT dst, n + 1 FROM p JOIN e ON src = id) SELECT id AS nodeId, max(n)::DOUBLE AS score FROM p GROUP BY 1")
CASES["algo_topological_sort"] = (lambda s, d: A.topological_sort(_dag(s, d)), f"WITH {_DAG} SELECT src AS nodeId FROM e UNION SELECT dst FROM e")
