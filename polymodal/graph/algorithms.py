"""Graph algorithms as DataFrame loops: vertices (id), edges (src, dst, weight).

Each round is a join on the source and an aggregation by the target, both of which combine map-side, and ends in a checkpoint in the shared folder, so plans stay small and
a lost executor repeats a round at most. Vertices are the edges' ends unless given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.recursive import cut

def _rows() -> Column:
    return F.count(F.lit(1))


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge once, without loops."""
    e = edges.where("src <> dst").select("src", "dst")
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def _n(v: DataFrame) -> int:
    return v.count()


# ------------------------------------------------------------------ degrees


def degree(edges: DataFrame, v: DataFrame | None = None, side: str = "src", normalised: bool = True, weight: bool = False) -> DataFrame:
    """(nodeId, score): edges that leave (side src) or enter (dst) over n - 1; all zero when n < 2."""
    v = v if v is not None else vertices_of(edges)
    n = _n(v)
    d = edges.groupBy(F.col(side).alias("id")).agg((F.sum("weight") if weight else _rows()).alias("d"))
    scale = 1.0 if not normalised or weight else (1.0 / (n - 1) if n > 1 else 0.0)
    return v.join(d, "id", "left").select(F.col("id").alias("nodeId"), (F.coalesce(F.col("d").cast("double"), F.lit(0.0)) * scale).alias("score"))


def degree_distribution(edges: DataFrame, v: DataFrame | None = None) -> DataFrame:
    d = degree(edges, v, normalised=False)
    return d.groupBy(F.col("score").cast("long").alias("degree")).agg(_rows().alias("count")).orderBy("degree")


# ----------------------------------------------------------------- PageRank


def pagerank(edges: DataFrame, v: DataFrame | None = None, damping: float = 0.85, iterations: int = 20, tolerance: float = 1e-6, source: int | None = None, weighted: bool = False, article: bool = False) -> DataFrame:
    """(nodeId, score). Start 1/n; dangling mass goes to all nodes (to the source, if personalised); ends when the L1 change is below the tolerance.

    article: shares are divided by out-degree plus the mean out-degree, and what that leaves is spread evenly.
    """
    v = cut(v if v is not None else vertices_of(edges))
    n = _n(v)
    if not n:
        return v.select(F.col("id").alias("nodeId"), F.lit(0.0).alias("score"))
    out = edges.groupBy("src").agg((F.sum("weight") if weighted else F.sum(F.lit(1.0))).alias("out"))
    mean = (edges.count() / n) if article else 0.0
    shares = cut(edges.join(out, "src").select("src", "dst", ((F.col("weight") if weighted else F.lit(1.0)) / (F.col("out") + mean)).alias("share")))
    home = F.when(F.col("id") == source, 1.0).otherwise(0.0) if source is not None else F.lit(1.0 / n)
    passed = shares.groupBy(F.col("src").alias("id")).agg(F.sum("share").alias("passed"))  # what a node hands on of its rank; the rest is lost
    rank = cut(v.join(passed, "id", "left").select("id", home.alias("r"), (1.0 - F.coalesce("passed", F.lit(0.0))).alias("loss")))
    lost = rank.agg(F.sum(F.col("r") * F.col("loss"))).first()[0]
    for _ in range(iterations):
        flow = rank.join(shares, rank["id"] == shares["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("r") * F.col("share")).alias("in"))
        new = rank.join(flow, "id", "left").select("id", F.col("r").alias("was"), (F.lit(1 - damping) * home + damping * (F.coalesce("in", F.lit(0.0)) + F.lit(lost) * home)).alias("r"), "loss")
        new = cut(new)
        change, lost = new.agg(F.sum(F.abs(F.col("r") - F.col("was"))), F.sum(F.col("r") * F.col("loss"))).first()
        rank = new.select("id", "r", "loss")
        if change < tolerance:
            break
    return rank.select(F.col("id").alias("nodeId"), F.col("r").alias("score"))


def approximate_ppr(edges: DataFrame, source: int, tolerance: float = 1e-4, alpha: float = 0.15) -> DataFrame:
    """Forward push from one node: residuals above tolerance times the out-degree move on, all in a round at once. Each round settles a share alpha of what it moves, so it ends for any tolerance above zero."""
    if tolerance <= 0:
        raise ValueError("tolerance must be above zero")
    out = cut(edges.groupBy("src").agg(_rows().cast("double").alias("out")))
    spark = edges.sparkSession
    state = spark.createDataFrame([(source, 0.0, 1.0)], "id long, p double, r double")
    hop = edges.select("src", "dst")
    while True:
        s = cut(state.join(out, state["id"] == out["src"], "left").select("id", "p", "r", F.coalesce("out", F.lit(0.0)).alias("out")))
        push = s.where((F.col("r") > 0) & (F.col("r") >= tolerance * F.greatest("out", F.lit(1.0))))
        if push.isEmpty():
            break
        moved = push.where("out > 0").join(hop, push["id"] == hop["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum((1 - alpha) * F.col("r") / F.col("out")).alias("r")).select("id", F.lit(0.0).alias("p"), "r")
        pushed = (F.col("r") > 0) & (F.col("r") >= tolerance * F.greatest("out", F.lit(1.0)))
        stay = s.select("id", (F.col("p") + F.when(pushed, F.when(F.col("out") > 0, alpha * F.col("r")).otherwise(F.col("r"))).otherwise(0.0)).alias("p"), F.when(pushed, 0.0).otherwise(F.col("r")).alias("r"))
        state = stay.unionAll(moved).groupBy("id").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    return state.where("p > 0").select(F.col("id").alias("nodeId"), F.col("p").alias("score"))


def hits(edges: DataFrame, v: DataFrame | None = None, iterations: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """(nodeId, authority, hub): authorities from hubs, then hubs from the new authorities, both scaled to length one."""
    v = cut(v if v is not None else vertices_of(edges))
    e = cut(edges.select("src", "dst"))
    hub = v.select("id", F.lit(1.0).alias("x"))
    auth = hub
    for _ in range(iterations):
        before = auth
        auth = _unit(_flow(hub, e, "src", "dst", v))
        hub = _unit(_flow(auth, e, "dst", "src", v))
        change = auth.join(before.withColumnRenamed("x", "y"), "id").agg(F.sum(F.abs(F.col("x") - F.col("y")))).first()[0] or 0.0
        if change < tolerance:
            break
    return auth.withColumnRenamed("x", "authority").join(hub.withColumnRenamed("x", "hub"), "id").withColumnRenamed("id", "nodeId")


def _flow(x: DataFrame, e: DataFrame, a: str, b: str, v: DataFrame) -> DataFrame:
    got = x.join(e, x["id"] == e[a]).groupBy(F.col(b).alias("id")).agg(F.sum("x").alias("s"))
    return cut(v.join(got, "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("x")))


def _unit(x: DataFrame) -> DataFrame:
    n = x.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 0.0
    return x if not n else x.select("id", (F.col("x") / n).alias("x"))


def eigenvector(edges: DataFrame, v: DataFrame | None = None, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    v = cut(v if v is not None else vertices_of(edges))
    e = cut(edges.select("src", "dst"))
    x = _unit(v.select("id", F.lit(1.0).alias("x")))
    for _ in range(iterations):
        new = _unit(_flow(x, e, "src", "dst", v))
        change = new.join(x.withColumnRenamed("x", "y"), "id").agg(F.sum(F.abs(F.col("x") - F.col("y")))).first()[0] or 0.0
        x = new
        if change < tolerance:
            break
    return x.select(F.col("id").alias("nodeId"), F.col("x").alias("score"))


def katz(edges: DataFrame, v: DataFrame | None = None, alpha: float = 0.1, beta: float = 1.0, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    v = cut(v if v is not None else vertices_of(edges))
    e = cut(edges.select("src", "dst"))
    x = v.select("id", F.lit(0.0).alias("x"))
    for _ in range(iterations):
        new = cut(_flow(x, e, "src", "dst", v).select("id", (alpha * F.col("x") + beta).alias("x")))
        change = new.join(x.withColumnRenamed("x", "y"), "id").agg(F.sum(F.abs(F.col("x") - F.col("y")))).first()[0] or 0.0
        x = new
        if change < tolerance:
            break
    return x.select(F.col("id").alias("nodeId"), F.col("x").alias("score"))


# --------------------------------------------------------------- components


def connected_components(edges: DataFrame, v: DataFrame | None = None) -> DataFrame:
    """(nodeId, componentId): the smallest id of each undirected component, by large-star and small-star rounds."""
    v = v if v is not None else vertices_of(edges)
    now = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(_rows().alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = cut(small)
    return v.join(now, v["id"] == now["u"], "left").select(F.col("id").alias("nodeId"), F.coalesce("v", "id").alias("componentId"))


def component_count(edges: DataFrame, v: DataFrame | None = None) -> DataFrame:
    return connected_components(edges, v).agg(F.count_distinct("componentId").alias("components"))


def strongly_connected_components(edges: DataFrame, v: DataFrame | None = None) -> DataFrame:
    """(nodeId, componentId): smallest id of each. Forward colouring by smallest reaching id, then backward reach within the colour, until nothing is left."""
    left = cut((v if v is not None else vertices_of(edges)).select("id"))
    e = cut(edges.where("src <> dst").select("src", "dst").distinct())
    done = None
    while not left.isEmpty():
        colour = cut(left.select("id", F.col("id").alias("c")))
        while True:
            got = colour.join(e, colour["id"] == e["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("g"))
            new = cut(colour.join(got, "id", "left").select("id", F.least("c", "g").alias("c"), (F.coalesce("g", "c") < F.col("c")).alias("moved")))
            moved = not new.where("moved").isEmpty()
            colour = new.select("id", "c")
            if not moved:
                break
        inside = e.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c"))
        inside = cut(inside)
        found = cut(colour.where("id = c"))
        front = found
        while True:
            tip = front.select(F.col("id").alias("dst"), F.col("c").alias("fc"))
            back = tip.join(inside, "dst").where("fc = c").select(F.col("src").alias("id"), "c").distinct()
            front = cut(back.join(found, "id", "left_anti"))
            if front.isEmpty():
                break
            found = cut(found.unionAll(front))
        done = found if done is None else done.unionAll(found)
        left = cut(left.join(found, "id", "left_anti"))
        e = cut(e.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    if done is None:
        return left.select(F.col("id").alias("nodeId"), F.col("id").alias("componentId"))
    return done.select(F.col("id").alias("nodeId"), F.col("c").alias("componentId"))


# ---------------------------------------------------------------- triangles


def _oriented(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, from the end of smaller degree, so a hub's wedges stay few."""
    u = undirected(edges)
    d = u.groupBy("src").agg(_rows().alias("d"))
    both = u.join(d.withColumnRenamed("d", "ds"), "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    return cut(both.where((F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))).select("src", "dst"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c): each undirected triangle once."""
    o = _oriented(edges)
    wedge = o.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(o.select(F.col("src").alias("a"), F.col("dst").alias("c")), "a").where("b < c")
    close = o.select(F.least("src", "dst").alias("b"), F.greatest("src", "dst").alias("c"))
    return wedge.join(close, ["b", "c"]).select("a", "b", "c")


def triangle_count(edges: DataFrame, v: DataFrame | None = None) -> DataFrame:
    v = v if v is not None else vertices_of(edges)
    per = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(_rows().alias("t"))
    return v.join(per, "id", "left").select(F.col("id").alias("nodeId"), F.coalesce("t", F.lit(0)).alias("triangles"))


def total_triangles(edges: DataFrame) -> DataFrame:
    return triangles(edges).agg(_rows().alias("triangles"))


def local_clustering(edges: DataFrame, v: DataFrame | None = None) -> DataFrame:
    d = undirected(edges).groupBy(F.col("src").alias("nodeId")).agg(_rows().alias("d"))
    t = triangle_count(edges, v).join(d, "nodeId", "left")
    return t.select("nodeId", F.when(F.col("d") > 1, 2.0 * F.col("triangles") / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("coefficient"))


def global_clustering(edges: DataFrame) -> DataFrame:
    wedges = undirected(edges).groupBy("src").agg(_rows().alias("d")).agg(F.coalesce(F.sum(F.col("d") * (F.col("d") - 1) / 2), F.lit(0.0)).alias("w"))
    return total_triangles(edges).crossJoin(wedges).select(F.when(F.col("w") > 0, 3.0 * F.col("triangles") / F.col("w")).otherwise(0.0).alias("coefficient"))  # one row by one row


# --------------------------------------------------------------- similarity


def _neighbours(edges: DataFrame, node: int) -> DataFrame:
    return edges.where(F.col("src") == node).select(F.col("dst").alias("nodeId")).distinct()


def common_neighbors(edges: DataFrame, a: int, b: int) -> DataFrame:
    return _neighbours(edges, a).join(_neighbours(edges, b), "nodeId").orderBy("nodeId")


def pair_similarity(edges: DataFrame, a: int, b: int, metric: str) -> DataFrame:
    """(score) of two nodes' out-neighbour sets: jaccard, overlap or adamic_adar."""
    x = _neighbours(edges, a).withColumn("x", F.lit(1)).join(_neighbours(edges, b).withColumn("y", F.lit(1)), "nodeId", "full")
    if metric == "adamic_adar":
        d = edges.select("src", "dst").distinct().groupBy(F.col("src").alias("nodeId")).agg(_rows().alias("d"))
        return common_neighbors(edges, a, b).join(d, "nodeId").where("d > 1").agg(F.coalesce(F.sum(1 / F.log("d")), F.lit(0.0)).alias("score"))
    both, na, nb = F.count_if(F.expr("x = 1 AND y = 1")), F.count_if(F.expr("x = 1")), F.count_if(F.expr("y = 1"))
    value = both / F.nullif(na + nb - both, F.lit(0)) if metric == "jaccard" else both / F.nullif(F.least(na, nb), F.lit(0))
    return x.agg(F.coalesce(value, F.lit(0.0)).alias("score"))


def neighbour_pairs(edges: DataFrame, metric: str = "jaccard", hub: int | None = None) -> DataFrame:
    """(a, b, score), a < b, of all pairs with a common out-neighbour."""
    e = cut(edges.select("src", "dst").distinct())
    d = e.groupBy("src").agg(_rows().alias("d"))
    indeg = e.groupBy("dst").agg(_rows().alias("k"))
    weight = F.lit(1.0)
    if metric == "adamic_adar":
        m = e.join(d.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst", "left").where("dd > 1").select("src", "dst", (1 / F.log("dd")).alias("w"))
    else:
        m = e.withColumn("w", weight)
    if hub is not None:
        m = m.join(indeg.where(F.col("k") <= hub), "dst", "left_semi")
    pairs = m.select("dst", F.col("src").alias("a"), "w").join(m.select("dst", F.col("src").alias("b")), "dst").where("a < b").groupBy("a", "b").agg(F.sum("w").alias("c"))
    if metric in ("common", "adamic_adar"):
        return pairs.withColumnRenamed("c", "score")
    p = pairs.join(d.select(F.col("src").alias("a"), F.col("d").alias("da")), "a").join(d.select(F.col("src").alias("b"), F.col("d").alias("db")), "b")
    value = F.col("c") / (F.col("da") + F.col("db") - F.col("c")) if metric == "jaccard" else F.col("c") / F.least("da", "db")
    return p.select("a", "b", value.alias("score"))


def _top(pairs: DataFrame, k: int | None, a: str, b: str) -> DataFrame:
    both = pairs.select(F.col("a").alias(a), F.col("b").alias(b), "score").unionAll(pairs.select(F.col("b").alias(a), F.col("a").alias(b), "score"))
    if k is None:
        return both
    return both.withColumn("__r", F.row_number().over(Window.partitionBy(a).orderBy(F.desc("score"), b))).where(F.col("__r") <= k).drop("__r")


def node_similarity(edges: DataFrame, k: int = 10) -> DataFrame:
    return _top(neighbour_pairs(edges), k, "node1Id", "node2Id")


def knn(edges: DataFrame, k: int = 10, keep: DataFrame | None = None) -> DataFrame:
    """(nodeId, neighborId, score): the k most similar nodes by neighbour sets; keep (id, community) restricts pairs to one community."""
    p = neighbour_pairs(edges)
    if keep is not None:
        p = p.join(keep.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(keep.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b").where("ca = cb").select("a", "b", "score")
    return _top(p, k, "nodeId", "neighborId")


def link_prediction(edges: DataFrame, k: int = 10, metric: str = "adamic_adar") -> DataFrame:
    """(node1Id, node2Id, score): the k best pairs that no edge joins."""
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    p = neighbour_pairs(edges, metric).join(e, ["a", "b"], "left_anti")
    return p.orderBy(F.desc("score"), "a", "b").limit(k).select(F.col("a").alias("node1Id"), F.col("b").alias("node2Id"), "score")


# --------------------------------------------------------------------- paths


def distances(edges: DataFrame, sources: DataFrame, weighted: bool = False, most: int | None = None) -> DataFrame:
    """(source, id, distance, parent): shortest distances from each source (column id). Rounds relax only what changed; the parent is the smallest on a shortest path."""
    e = cut(edges.groupBy("src", "dst").agg((F.min("weight") if weighted else F.min(F.lit(1.0))).alias("w")))
    best = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("distance"), F.lit(None).cast("long").alias("parent")))
    front, n = best, 0
    while most is None or n < most:
        n += 1
        step = front.join(e, front["id"] == e["src"]).select("source", F.col("dst").alias("id"), (F.col("distance") + F.col("w")).alias("d"), F.col("src").alias("p"))
        step = step.groupBy("source", "id").agg(F.min(F.struct("d", "p")).alias("s"))
        j = best.join(step, ["source", "id"], "full").select("source", "id", "distance", "parent", F.col("s.d").alias("d"), F.col("s.p").alias("p"))
        better = F.col("distance").isNull() | (F.col("d") < F.col("distance"))
        j = cut(j.select("source", "id", F.when(better, F.col("d")).otherwise(F.col("distance")).alias("distance"), F.when(better, F.col("p")).otherwise(F.col("parent")).alias("parent"), F.coalesce(better & F.col("d").isNotNull(), F.lit(False)).alias("new")))
        best, front = j.select("source", "id", "distance", "parent"), j.where("new").select("source", "id", "distance", "parent")
        if front.isEmpty():
            break
        if weighted and n > 100_000:
            raise ValueError("a negative cycle")
    return best


def single_source(edges: DataFrame, source: int, weighted: bool = False) -> DataFrame:
    s = edges.sparkSession.createDataFrame([(source,)], "id long")
    return distances(edges, s, weighted)


def bellman_ford(edges: DataFrame, source: int, v: DataFrame | None = None) -> DataFrame:
    """(nodeId, distance); raises on a negative cycle, which still improves after n rounds."""
    n = _n(v if v is not None else vertices_of(edges))
    s = edges.sparkSession.createDataFrame([(source,)], "id long")
    d = distances(edges, s, True, most=n)
    e = edges.select("src", "dst", "weight")
    again = d.select(F.col("id").alias("src"), F.col("distance").alias("ds")).join(e, "src").join(d.select(F.col("id").alias("dst"), F.col("distance").alias("dd")), "dst").where("ds + weight < dd")
    if not again.isEmpty():
        raise ValueError("a negative cycle")
    return d.select(F.col("id").alias("nodeId"), "distance")


def paths_from(d: DataFrame, source: int, target: int | None = None, cost: str = "distance") -> DataFrame:
    """(sourceNodeId, targetNodeId, cost, path): paths rebuilt along parents, all targets a hop a round."""
    now = d.where(F.col("source") == source)
    todo = now if target is None else now.where(F.col("id") == target)
    walk = cut(todo.select(F.col("id").alias("t"), "distance", F.array("id").alias("path"), "parent"))
    up = cut(now.select(F.col("id").alias("pid"), F.col("parent").alias("pp")))
    while not walk.where("parent IS NOT NULL").isEmpty():
        done, open_ = walk.where("parent IS NULL"), walk.where("parent IS NOT NULL")
        open_ = open_.join(up, open_["parent"] == up["pid"]).select("t", "distance", F.concat(F.array("parent"), "path").alias("path"), F.col("pp").alias("parent"))
        walk = cut(done.unionAll(open_))
    return walk.select(F.lit(source).cast("long").alias("sourceNodeId"), F.col("t").alias("targetNodeId"), F.col("distance").alias(cost), "path")


def all_pairs(edges: DataFrame, v: DataFrame | None = None) -> DataFrame:
    """(sourceNodeId, targetNodeId, distance) of all reachable pairs: as many rows as there are such pairs, by definition."""
    v = v if v is not None else vertices_of(edges)
    return distances(edges, v).where("source <> id").select(F.col("source").alias("sourceNodeId"), F.col("id").alias("targetNodeId"), "distance")


def closeness(edges: DataFrame, v: DataFrame | None = None, kind: str = "plain") -> DataFrame:
    """(nodeId, score): (r - 1) / sum of distances over the r nodes reached; wf: times (r - 1) / (n - 1); harmonic: sum of 1 / distance."""
    v = cut(v if v is not None else vertices_of(edges))
    n = _n(v)
    d = distances(edges, v).where("source <> id").groupBy(F.col("source").alias("id")).agg(_rows().alias("r"), F.sum("distance").alias("s"), F.sum(1 / F.col("distance")).alias("h"))
    plain = F.col("r") / F.col("s")
    value: Column = {"plain": plain, "wf": plain * F.col("r") / F.lit(max(n - 1, 1)), "harmonic": F.col("h")}[kind]
    return v.join(d, "id", "left").select(F.col("id").alias("nodeId"), F.coalesce(value, F.lit(0.0)).alias("score"))


# ------------------------------------------------------------ orders and cores


def core_numbers(edges: DataFrame, v: DataFrame | None = None) -> DataFrame:
    """(nodeId, core): nodes peel off while they have fewer than k neighbours left."""
    v = cut((v if v is not None else vertices_of(edges)).select("id"))
    e = cut(undirected(edges))
    left, out, k = v, None, 0
    while not left.isEmpty():
        while True:
            d = e.groupBy(F.col("src").alias("id")).agg(_rows().alias("d"))
            low = cut(left.join(d, "id", "left").where(F.coalesce("d", F.lit(0)) <= k).select("id"))
            if low.isEmpty():
                break
            done = low.select(F.col("id").alias("nodeId"), F.lit(k).cast("long").alias("core"))
            out = done if out is None else out.unionAll(done)
            left = cut(left.join(low, "id", "left_anti"))
            e = cut(e.join(low.withColumnRenamed("id", "src"), "src", "left_anti").join(low.withColumnRenamed("id", "dst"), "dst", "left_anti"))
        k += 1
    return out if out is not None else v.select(F.col("id").alias("nodeId"), F.lit(0).cast("long").alias("core"))


def degeneracy(edges: DataFrame) -> DataFrame:
    return core_numbers(edges).agg(F.coalesce(F.max("core"), F.lit(0)).alias("degeneracy"))


def levels(edges: DataFrame, v: DataFrame | None = None) -> DataFrame:
    """(id, level): edges on the longest path that ends at a node. Nodes without edges left to them leave a round at a time; a cycle raises."""
    left = cut((v if v is not None else vertices_of(edges)).select("id"))
    e = cut(edges.select("src", "dst").distinct())
    out, n = None, 0
    while not left.isEmpty():
        first = cut(left.join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_anti"))
        if first.isEmpty():
            raise ValueError("the graph has a cycle")
        done = first.select("id", F.lit(n).alias("level"))
        out = done if out is None else out.unionAll(done)
        left = cut(left.join(first, "id", "left_anti"))
        e = cut(e.join(first.withColumnRenamed("id", "src"), "src", "left_anti"))
        n += 1
    return out if out is not None else left.select("id", F.lit(0).alias("level"))


def topological_sort(edges: DataFrame, v: DataFrame | None = None) -> DataFrame:
    return levels(edges, v).orderBy("level", "id").select(F.col("id").alias("nodeId"))


def longest_path(edges: DataFrame, v: DataFrame | None = None) -> DataFrame:
    return levels(edges, v).select(F.col("id").alias("nodeId"), F.col("level").cast("double").alias("score"))


# --------------------------------------------------------------- communities


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(modularity) of communities (id, community) over undirected edges: sum of e_in / m - (degree / 2m)^2."""
    u = undirected(edges)
    c = communities.select("id", "community")
    j = u.join(c.select(F.col("id").alias("src"), F.col("community").alias("cs")), "src").join(c.select(F.col("id").alias("dst"), F.col("community").alias("cd")), "dst")
    per = j.groupBy("cs").agg(_rows().cast("double").alias("deg"), F.count_if(F.expr("cs = cd")).cast("double").alias("inside"))
    total = j.agg(_rows().cast("double").alias("m2"))
    return per.crossJoin(total).agg(F.coalesce(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("deg") / F.col("m2"), F.lit(2.0))), F.lit(0.0)).alias("modularity"))  # by one row


def conductance(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(nodeId, score): for each node its community's cut over the smaller volume of it and the rest, volumes being out-degrees."""
    c = communities.select("id", "community")
    j = edges.join(c.select(F.col("id").alias("src"), F.col("community").alias("cs")), "src").join(c.select(F.col("id").alias("dst"), F.col("community").alias("cd")), "dst")
    per = j.groupBy("cs").agg(_rows().cast("double").alias("vol"), F.count_if(F.expr("cs <> cd")).cast("double").alias("cut"))
    total = j.agg(_rows().cast("double").alias("all"))
    small = F.least(F.col("vol"), F.col("all") - F.col("vol"))
    scores = per.crossJoin(total).select("cs", F.when(small > 0, F.col("cut") / small).otherwise(0.0).alias("score"))
    return c.join(scores, c["community"] == scores["cs"], "left").select(F.col("id").alias("nodeId"), F.coalesce("score", F.lit(0.0)).alias("score"))
