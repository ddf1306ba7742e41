"""CALL graph.<name>(...): the algorithms by name, over the union of all edge labels.

Positional arguments are those of ``arguments(name)``, in that order; names are case-insensitive and ``gds.`` is an alias of ``graph.``.
"""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import algorithms as A
from . import local as L


def _communities(edges: DataFrame, given) -> DataFrame:
    """[[node, community], ...] or [community of the k-th node in order]."""
    spark = edges.sparkSession
    if given and not isinstance(given[0], (list, tuple)):
        ids = [r["id"] for r in A.vertices_of(edges).orderBy("id").limit(len(given)).collect()]
        given = list(zip(ids, given))
    return spark.createDataFrame([(int(a), int(b)) for a, b in given], "id long, community long")


_LABELS = "nodeId long, communityId long"
_PAIRS = "sourceNodeId long, targetNodeId long, weight double"
_PATHS = "sourceNodeId long, targetNodeId long, totalCost double, path array<long>"
_EMBED = "nodeId long, embedding array<double>"


def _betweenness(e, v, sources, scale=None):
    if scale is None:
        n = v.count()
        scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    part = L.by_source(e, sources, L.dependencies, "nodeId long, d double").groupBy("nodeId").agg(F.sum("d").alias("d"))
    return v.join(part, v["id"] == part["nodeId"], "left").select(F.col("id").alias("nodeId"), (F.coalesce("d", F.lit(0.0)) * scale).alias("score"))


def _sampled(e, v, random_seed, top_k):
    s = v.orderBy(F.xxhash64("id", F.lit(random_seed))).limit(top_k)
    n = v.count()
    return _betweenness(e, v, s, n / max(min(top_k, n), 1))  # the sample's sums, for all nodes


def _dijkstra(e, source, target, weighted=True):
    return A.paths_from(A.single_source(e, source, weighted), source, target, "totalCost" if weighted else "distance")


def _walks(e, v, walk_length, per_node, seed, p=1.0, q=1.0):
    return L.by_source(e, v, lambda g, s: L.walks(g, s, walk_length, per_node, seed, p, q), "nodeId long, path array<long>")


PROCEDURES = {
    "adamicadar": lambda e, v, source, target: A.pair_similarity(e, source, target, "adamic_adar"),
    "allpairs": lambda e, v: A.all_pairs(e, v), "allpairsshortestpaths": lambda e, v: A.all_pairs(e, v),
    "approximateppr": lambda e, v, source, tolerance=1e-4: A.approximate_ppr(e, source, tolerance),
    "articlerank": lambda e, v, damping=0.85, max_iterations=20, tolerance=1e-6: A.pagerank(e, v, damping, max_iterations, tolerance, article=True),
    "articulationpoints": lambda e, v: L.in_one_task(e, v, L.articulation_points, "nodeId long"),
    "bellmanford": lambda e, v, source: A.bellman_ford(e, source, v),
    "betweennesscentrality": lambda e, v: _betweenness(e, v, v),
    "bridges": lambda e, v: L.in_one_task(e, v, L.bridges, "sourceNodeId long, targetNodeId long"),
    "closenesscentrality": lambda e, v: A.closeness(e, v), "closenesscentralitywf": lambda e, v: A.closeness(e, v, "wf"), "harmoniccentrality": lambda e, v: A.closeness(e, v, "harmonic"),
    "commonneighbors": lambda e, v, source, target: A.common_neighbors(e, source, target),
    "componentcount": lambda e, v: A.component_count(e, v), "conductance": lambda e, v, communities: A.conductance(e, _communities(e, communities)),
    "connectedcomponents": lambda e, v: A.connected_components(e, v), "degeneracy": lambda e, v: A.degeneracy(e),
    "degreecentrality": lambda e, v: A.degree(e, v), "degreedistribution": lambda e, v: A.degree_distribution(e, v), "indegreecentrality": lambda e, v: A.degree(e, v, "dst"), "outdegreecentrality": lambda e, v: A.degree(e, v), "weighteddegreecentrality": lambda e, v: A.degree(e, v, weight=True),
    "deltastepping": lambda e, v, source: A.single_source(e, source, True).select(F.col("id").alias("nodeId"), "distance"),
    "dijkstra": lambda e, v, source, target: _dijkstra(e, source, target),
    "eigenvectorcentrality": lambda e, v, max_iterations=100, tolerance=1e-6: A.eigenvector(e, v, max_iterations, tolerance),
    "fastrp": lambda e, v, embedding_dimension=128, random_seed=0: L.in_one_task(e, v, lambda g: L.fast_rp(g, embedding_dimension, seed=random_seed), _EMBED),
    "filteredknn": lambda e, v, communities, top_k=10: A.knn(e, top_k, _communities(e, communities)), "knn": lambda e, v, top_k=10: A.knn(e, top_k),
    "globalclusteringcoefficient": lambda e, v: A.global_clustering(e), "localclusteringcoefficient": lambda e, v: A.local_clustering(e, v),
    "hashgnn": lambda e, v, embedding_dimension=128, max_iterations=3, random_seed=0: L.in_one_task(e, v, lambda g: L.hashgnn(g, embedding_dimension, max_iterations, random_seed), _EMBED),
    "hits": lambda e, v, max_iterations=20, tolerance=1e-6: A.hits(e, v, max_iterations, tolerance),
    "jaccardsimilarity": lambda e, v, source, target: A.pair_similarity(e, source, target, "jaccard"), "overlapcoefficient": lambda e, v, source, target: A.pair_similarity(e, source, target, "overlap"),
    "k1coloring": lambda e, v: L.in_one_task(e, v, L.k1_coloring, _LABELS), "kspanningtree": lambda e, v, top_k=2: L.in_one_task(e, v, lambda g: L.k_spanning_tree(g, top_k), _LABELS),
    "katzcentrality": lambda e, v, max_iterations=100, tolerance=1e-6: A.katz(e, v, iterations=max_iterations, tolerance=tolerance), "kcore": lambda e, v: A.core_numbers(e, v),
    "labelpropagation": lambda e, v, max_iterations=10: L.in_one_task(e, v, lambda g: L.label_propagation(g, max_iterations), _LABELS),
    "leiden": lambda e, v, max_iterations=10, resolution=1.0: L.in_one_task(e, v, lambda g: L.leiden(g, max_iterations, resolution), _LABELS),
    "linkprediction": lambda e, v, top_k=10: A.link_prediction(e, top_k), "longestpath": lambda e, v: A.longest_path(e, v),
    "louvain": lambda e, v, max_iterations=10, min_modularity_gain=1e-6: L.in_one_task(e, v, lambda g: L.louvain(g, max_iterations, min_modularity_gain), _LABELS),
    "maxkcut": lambda e, v, max_iterations=10, random_seed=0, top_k=2: L.in_one_task(e, v, lambda g: L.max_k_cut(g, top_k, max_iterations, random_seed), _LABELS),
    "minimumspanningtree": lambda e, v: L.in_one_task(e, v, L.spanning_tree, _PAIRS), "modularity": lambda e, v, communities: A.modularity(e, _communities(e, communities)),
    "node2vec": lambda e, v, in_out_param=1.0, random_seed=L.SEED, return_param=1.0, walk_length=80, walks_per_node=10: _walks(e, v, walk_length, walks_per_node, random_seed, return_param, in_out_param),
    "nodesimilarity": lambda e, v, top_k=10: A.node_similarity(e, top_k), "pagerank": lambda e, v, damping=0.85, max_iterations=20, tolerance=1e-6: A.pagerank(e, v, damping, max_iterations, tolerance),
    "personalizedpagerank": lambda e, v, damping, max_iterations, source, tolerance=1e-6: A.pagerank(e, v, damping, max_iterations, tolerance, source=source), "weightedpagerank": lambda e, v, damping=0.85, max_iterations=20, tolerance=1e-6: A.pagerank(e, v, damping, max_iterations, tolerance, weighted=True),
    "randomwalk": lambda e, v, random_seed=L.SEED, walk_length=80, walks_per_node=10: _walks(e, v, walk_length, walks_per_node, random_seed), "sampledbetweenness": lambda e, v, random_seed=0, top_k=100: _sampled(e, v, random_seed, top_k),
    "shortestpath": lambda e, v, source, target: _dijkstra(e, source, target, False), "singlesourceshortestpath": lambda e, v, source: A.paths_from(A.single_source(e, source), source),
    "sllpa": lambda e, v, max_iterations=20, random_seed=0: L.in_one_task(e, v, lambda g: L.sllpa(g, max_iterations, random_seed), _LABELS), "steinertree": lambda e, v, communities, source: L.in_one_task(e, v, lambda g: L.steiner_tree(g, source, list(communities)), _PAIRS),
    "stronglyconnectedcomponents": lambda e, v: A.strongly_connected_components(e, v), "topologicalsort": lambda e, v: A.topological_sort(e, v), "totaltrianglecount": lambda e, v: A.total_triangles(e), "trianglecount": lambda e, v: A.triangle_count(e, v),
    "yen": lambda e, v, source, target, top_k=3: L.in_one_task(e, v, lambda g: L.yen(g, source, target, top_k), _PATHS), "kshortestpaths": lambda e, v, source, target, top_k=3: L.in_one_task(e, v, lambda g: L.yen(g, source, target, top_k), _PATHS),
}


def arguments(name: str) -> list[str]:
    return list(inspect.signature(PROCEDURES[_key(name)]).parameters)[2:]


def _key(name: str) -> str:
    key = name.lower().removeprefix("graph.").removeprefix("gds.").replace("_", "").replace(".", "")
    if key not in PROCEDURES:
        raise ValueError(f"no procedure {name}")
    return key


def call(graph, name: str, *args, types: list[str] | None = None, weight: str | None = None, **named) -> DataFrame:
    """Edges' weights are the column ``weight`` where an edge table has one, else 1."""
    if weight is None and "weight" in graph.edge_table(types).columns:
        weight = "weight"
    edges = graph.projection(types, weight)
    ids = A.vertices_of(edges)
    for label, (df, key) in graph.nodes.items():
        if types is None:
            ids = ids.union(df.select(F.col(key).cast("long").alias("id")))
    return PROCEDURES[_key(name)](edges, ids.distinct(), *args, **named)
