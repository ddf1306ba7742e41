"""Patterns and algorithms on small graphs with known answers."""

import random
from collections import defaultdict

import pytest

from polymodal import Engine
from polymodal.graph import algorithms as A
from polymodal.graph import local as L
from polymodal.graph import procedures


@pytest.fixture(scope="module")
def town(spark):
    e = Engine(spark)
    persons = spark.createDataFrame([(1, "Alice", 30), (2, "Bob", 25), (3, "Carol", 35)], "id int, name string, age int")
    cities = spark.createDataFrame([(10, "Paris", "France"), (20, "London", "UK")], "id int, name string, country string")
    g = e.graph.node_label("person", persons).node_label("city", cities)
    g.edge_label("lives_in", spark.createDataFrame([(1, 10), (2, 20), (3, 10)], "source_id int, target_id int"), "person", "city")
    g.edge_label("friends", spark.createDataFrame([(1, 2, 2020), (2, 3, 2021)], "source_id int, target_id int, since int"), "person", "person")
    return g


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_patterns(town):
    q = lambda t: rows(town.query(t))
    assert q("MATCH (p:person)-[:lives_in]->(c:city {name: 'Paris'}) RETURN p.name") == [("Alice",), ("Carol",)]
    assert q("MATCH (:person {name: 'Bob'})-[:friends]->(f) RETURN f.name") == [("Carol",)]
    assert q("MATCH (p)-[:lives_in]->(c:city) RETURN c.name AS city, count(p) AS n") == [("London", 1), ("Paris", 2)]
    assert q("MATCH (a:person)-[f:friends]->(b) WHERE f.since > 2020 RETURN a.name, b.name") == [("Bob", "Carol")]
    assert q("MATCH (a:person {id: 1})-[:friends*1..2]->(b) RETURN b.id") == [(2,), (3,)]
    assert q("MATCH (a:person {id: 1})-[:friends*0..1]->(b) RETURN b.id") == [(1,), (2,)]
    assert q("MATCH (p:person) OPTIONAL MATCH (p)-[:friends]->(f) RETURN p.id, f.id") == [(1, 2), (2, 3), (3, None)]
    assert q("MATCH (a:person)--(b:person) RETURN count(*) AS n") == [(4,)]
    assert q("MATCH (p:person) WHERE (p)-[:friends]->() RETURN p.id") == [(1,), (2,)]
    assert q("MATCH (p:person) RETURN max(p.age) AS a, min(p.age) AS b, size(collect(p.name)) AS n") == [(35, 25, 3)]
    assert q("MATCH (n) WHERE n:city RETURN labels(n)[0] AS l, id(n) AS i") == [("city", 10), ("city", 20)]
    assert q("UNWIND [] AS x RETURN x") == []
    assert q("MATCH (p:person) WITH p ORDER BY p.age DESC LIMIT 2 RETURN p.name") == [("Alice",), ("Carol",)]
    assert q("MATCH (p:person) RETURN p.name AS n ORDER BY p.age SKIP 1 LIMIT 1") == [("Alice",)]
    assert q("MATCH (a:person {id: 1}), (b:person {id: 3}) MATCH p = shortestPath((a)-[:friends*]->(b)) RETURN length(p) AS n") == [(2,)]


def test_optional_match_keeps_rows(town):
    got = {(r[0], r[1]) for r in town.query("MATCH (p:person) OPTIONAL MATCH (p)-[:friends]->(f) RETURN p.id AS a, f.id AS b").collect()}
    assert got == {(1, 2), (2, 3), (3, None)}


def test_an_edge_is_used_once(spark):
    e = Engine(spark)
    n = spark.createDataFrame([(i,) for i in range(3)], "id int")
    e.graph.node_label("n", n).edge_label("e", spark.createDataFrame([(0, 1), (1, 0), (1, 2)], "source_id int, target_id int"), "n", "n")
    assert e.graph.query("MATCH (a {id: 0})-[r:e*]->(b) RETURN b.id AS x, size(r) AS n").count() == 3  # 1, 1-0, 1-2
    assert rows(e.graph.query("MATCH (a {id: 0})-[:e]->(b)-[:e]->(c) RETURN c.id AS x")) == [(0,), (2,)]


EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (6, 7), (8, 8), (9, 1)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(a, b, 1.0 + (a * b) % 4) for a, b in EDGES], "src long, dst long, weight double")


def adjacency():
    out = defaultdict(set)
    for a, b in EDGES:
        out[a].add(b)
    return out


NODES = sorted({x for e in EDGES for x in e})


def scores(df):
    return {r["nodeId"]: r["score"] for r in df.collect()}


def test_pagerank_by_hand(edges):
    out, n = adjacency(), len(NODES)
    r = dict.fromkeys(NODES, 1 / n)
    for _ in range(20):
        lost = sum(r[x] for x in NODES if not out[x])
        new = {x: 0.15 / n + 0.85 * (lost / n + sum(r[u] / len(out[u]) for u in NODES if x in out[u])) for x in NODES}
        change, r = sum(abs(new[x] - r[x]) for x in NODES), new
        if change < 1e-6:
            break
    got = scores(A.pagerank(edges))
    assert got == pytest.approx(r, abs=1e-9) and sum(got.values()) == pytest.approx(1)
    assert sum(scores(A.pagerank(edges, article=True)).values()) == pytest.approx(1)
    personal = scores(A.pagerank(edges, source=4))
    assert max(personal, key=personal.get) in (4, 6) and personal[9] == 0


def test_hits_and_eigenvector(edges):
    h = A.hits(edges, iterations=50).collect()
    assert sum(r["authority"] ** 2 for r in h) == pytest.approx(1) and sum(r["hub"] ** 2 for r in h) == pytest.approx(1)
    assert sum(r**2 for r in scores(A.eigenvector(edges)).values()) == pytest.approx(1)


def test_betweenness_matches_counting_paths(edges):
    out, n = adjacency(), len(NODES)
    total = dict.fromkeys(NODES, 0.0)
    for s in NODES:
        dist, paths, layer = {s: 0}, {s: [[s]]}, [s]
        while layer:
            nxt = []
            for u in layer:
                for w in sorted(out[u]):
                    if w not in dist:
                        dist[w], paths[w] = dist[u] + 1, []
                        nxt.append(w)
                    if dist[w] == dist[u] + 1:
                        paths[w] += [p + [w] for p in paths[u]]
            layer = nxt
        for t, ps in paths.items():
            for p in ps:
                for x in p[1:-1]:
                    total[x] += 1 / len(ps)
    want = {x: v / ((n - 1) * (n - 2)) for x, v in total.items()}
    v = A.vertices_of(edges)
    assert scores(procedures._betweenness(edges, v, v)) == pytest.approx(want)


def test_components_and_cores(edges):
    assert {r[0]: r[1] for r in A.connected_components(edges).collect()} == {**dict.fromkeys([1, 2, 3, 4, 5, 6, 7, 9], 1), 8: 8}
    assert {r[0]: r[1] for r in A.strongly_connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 9: 9}
    assert {r[0]: r[1] for r in A.core_numbers(edges).collect()} == {1: 2, 2: 2, 3: 2, 4: 2, 5: 2, 6: 2, 7: 1, 8: 0, 9: 1}
    assert A.total_triangles(edges).first()[0] == 2


def test_paths(edges):
    d = {r["id"]: r["distance"] for r in A.single_source(edges, 1).collect()}
    assert d == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6}
    p = A.paths_from(A.single_source(edges, 1, True), 1, 7, "totalCost").first()
    assert p["path"] == [1, 2, 3, 4, 5, 6, 7] and p["totalCost"] == sum(1.0 + (a * b) % 4 for a, b in zip(p["path"], p["path"][1:]))
    with pytest.raises(ValueError):
        A.topological_sort(edges).collect()


def test_negative_cycles_raise(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, -3.0), (3, 1, 1.0)], "src long, dst long, weight double")
    with pytest.raises(ValueError):
        A.bellman_ford(e, 1)


def adj(pairs):
    return L.Adjacency([a for a, _ in pairs], [b for _, b in pairs], [1.0] * len(pairs))


def test_cut_nodes_and_bridges_by_removal():
    rng = random.Random(4)
    for _ in range(25):
        pairs = [(rng.randrange(9), rng.randrange(9)) for _ in range(10)]
        g = adj(pairs)

        def parts(skip=None, without=None):
            left, n = {x for x in g.nodes if x != skip}, 0
            while left:
                todo, n = [left.pop()], n + 1
                while todo:
                    u = todo.pop()
                    for w in g.both[u]:
                        if w in left and {u, w} != without:
                            left.discard(w)
                            todo.append(w)
            return n

        whole = parts()
        assert L.articulation_points(g) == [(x,) for x in g.nodes if parts(skip=x) > whole - (not g.both[x])]
        simple = {(min(a, b), max(a, b)) for a, b in pairs if a != b}
        assert L.bridges(g) == sorted(e for e in simple if parts(without=set(e)) > whole)


def test_communities_find_cliques():
    clique = lambda xs: [(a, b) for a in xs for b in xs if a < b]
    g = adj(clique(range(5)) + clique(range(10, 15)) + [(4, 10)])
    for f in (L.louvain, L.leiden):
        com = dict(f(g))
        assert len({com[x] for x in range(5)}) == 1 and len({com[x] for x in range(10, 15)}) == 1 and com[0] != com[14]
    assert dict(L.label_propagation(g)) == dict.fromkeys(g.nodes, 1)  # in order and smallest first, one label walks over the bridge
    colour = dict(L.k1_coloring(g))
    assert all(colour[a] != colour[b] for a in g.nodes for b in g.both[a])
    assert len(L.spanning_tree(g)) == 9 and len(set(dict(L.k_spanning_tree(g, 2)).values())) == 2


def test_yen_gives_loopless_paths_in_order():
    g = L.Adjacency([1, 1, 2, 3, 2], [2, 3, 4, 4, 3], [1.0, 2.0, 1.0, 1.0, 0.5])
    got = L.yen(g, 1, 4, 5)
    assert [p for *_, p in got] == [[1, 2, 4], [1, 2, 3, 4], [1, 3, 4]] and [c for _, _, c, _ in got] == [2.0, 2.5, 3.0]
    assert L.steiner_tree(g, 1, [4]) == [(1, 2, 1.0), (2, 4, 1.0)]


def test_walks_follow_edges():
    g = adj(EDGES)
    out = adjacency()
    for _, path in L.walks(g, 1, 12, 5, p=0.5, q=2.0):
        assert path[0] == 1 and all(b in out[a] for a, b in zip(path, path[1:]))
    assert L.walks(g, 1, 6, 2) == L.walks(g, 1, 6, 2)


def test_every_procedure_has_a_name(town):
    assert len({id(f) for f in procedures.PROCEDURES.values()}) >= 61
    assert procedures.arguments("gds.pageRank") == ["damping", "max_iterations", "tolerance"]
    with pytest.raises(ValueError):
        town.query("CALL graph.nothing() YIELD x RETURN x")
    assert town.query("CALL graph.pageRank(0.85, 5) YIELD nodeId, score RETURN nodeId, score").count() == 5


def test_patterns_inside_expressions(town):
    q = lambda t: rows(town.query(t))
    assert q("MATCH (c:city) RETURN c.name AS c, [(p:person)-[:lives_in]->(c) WHERE p.age > 31 | p.name] AS who") == [("London", []), ("Paris", ["Carol"])]
    assert q("MATCH (p:person) RETURN p.id AS i, COUNT { (p)-[:friends]->() } AS n, EXISTS { (p)<-[:friends]-() } AS e") == [(1, 1, False), (2, 1, True), (3, 0, True)]
    assert q("MATCH (p:person) WHERE COUNT { (p)--(:person) } > 1 OR p.id = 3 RETURN p.id AS i") == [(2,), (3,)]
    assert town.query("MATCH (p:person {id: 1}) RETURN p {.name, older: p.age + 1} AS m").first()["m"].asDict() == {"name": "Alice", "older": 31}
    assert q("MATCH (p:person) WHERE p.name =~ 'A.*' RETURN p.name AS n, size([x IN [1, 2, 3] WHERE x > 1]) AS k, none(x IN [1] WHERE x = 2) AS o") == [("Alice", 2, True)]


@pytest.fixture(scope="module")
def small(spark):
    e = Engine(spark)
    e.register("chain", spark.createDataFrame([(i, i + 1) for i in range(70)], "a long, b long"))
    e.register("spots", spark.createDataFrame([(i, f"s{i}") for i in range(71)], "id long, name string"))
    e.register("others", spark.createDataFrame([(1, "x")], "id long, name string"))
    g = e.graph
    g.node_label("Spot", "spots", "id").node_label("Place", "spots", "id").node_label("Other", "others", "id").edge_label("N", "chain", "Spot", "Spot", "a", "b")
    return g


def test_long_ways_are_found(small):
    assert small.query("MATCH (a:Spot {id: 0}), (b:Spot {id: 66}) MATCH p = shortestPath((a)-[:N*]->(b)) RETURN length(p) AS n").collect()[0]["n"] == 66
    assert small.query("MATCH (a:Spot {id: 50})-[r:N*]->(b:Spot) RETURN max(size(r)) AS n").collect()[0]["n"] == 20


def test_all_labels_must_hold(small):
    count = lambda p: small.query(f"MATCH {p} RETURN count(*) AS n").collect()[0]["n"]
    assert count("(x:Spot)") == 71 == count("(x:Spot:Place)") and count("(x:Spot:Other)") == 0
    assert count("(x:Spot)-[:N]->(y:Spot:Other)") == 0 and count("(x:Spot)-[:N]->(y:Place:Spot)") == 0 and count("(x:Spot)-[:N]->(y:Spot:Place)") == 70


def test_a_chain_begins_where_it_is_bound(small):
    q = "MATCH (a:Spot)-[:N]->(b:Spot), (c:Spot)-[:N*1..2]->(d:Spot)-[:N]->(b) RETURN a.id AS a, b.id AS b, c.id AS c"
    df = small.query("MATCH (a:Spot)-[:N]->(b:Spot), (c:Spot)-[:N]->(b) RETURN a.id AS a")
    assert "CartesianProduct" not in df._jdf.queryExecution().optimizedPlan().toString() and "Join Cross" not in df._jdf.queryExecution().optimizedPlan().toString() and df.count() == 0
    assert sorted(map(tuple, small.query(q.replace("a.id AS a, ", "")).collect())) == []
    two = small.query("MATCH (b:Spot {id: 5}) MATCH (c:Spot)-[r:N*2..2]->(b) RETURN c.id AS c, [x IN r | x.__src] AS via").collect()
    assert [(r["c"], list(r["via"])) for r in two] == [(3, [3, 4])]


def test_text_keys(spark):
    e = Engine(spark)
    e.register("p", spark.createDataFrame([("ann", 1), ("bob", 2)], "id string, n long"))
    e.register("k", spark.createDataFrame([("ann", "bob")], "a string, b string"))
    e.graph.node_label("P", "p", "id").edge_label("K", "k", "P", "P", "a", "b")
    assert [tuple(r) for r in e.graph.query("MATCH (x:P)-[:K]->(y:P) RETURN x.id AS x, y.n AS n").collect()] == [("ann", 2)]


def test_sampled_betweenness_is_the_samples_sum(small):
    got = {r["nodeId"]: r["score"] for r in small.query("CALL graph.sampledBetweenness(0, 71) YIELD nodeId, score RETURN nodeId, score").collect()}
    assert got[1] == pytest.approx(69) and got[35] == pytest.approx(35 * 35) and got[0] == 0
