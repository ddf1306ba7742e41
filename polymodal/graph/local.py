"""Algorithms whose steps depend on each other, on one adjacency in one task.

They get graphs of at most MOST_EDGES edges, which is checked by a count before any data moves; larger graphs raise. Betweenness and walks, independent by
source, spread sources over tasks with the (bounded) adjacency broadcast.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_EDGES = 5_000_000
#: Fixed value: the default seed of walks.
SEED = 0x9E3779B97F4A7C15


class Adjacency:
    def __init__(self, src, dst, weight, ids=()):
        self.out, self.both = defaultdict(dict), defaultdict(dict)
        self.nodes = sorted({*map(int, src), *map(int, dst), *map(int, ids)})
        for a, b, w in zip(src, dst, weight):
            a, b, w = int(a), int(b), float(w)
            self.out[a][b] = self.out[a].get(b, 0.0) + w
            if a != b:
                self.both[a][b] = self.both[a].get(b, 0.0) + w
                self.both[b][a] = self.both[b].get(a, 0.0) + w


def bounded(edges: DataFrame) -> None:
    n = edges.count()
    if n > MOST_EDGES:
        raise ValueError(f"this algorithm runs in one task, for at most {MOST_EDGES} edges; the graph has {n}")


def in_one_task(edges: DataFrame, v: DataFrame | None, f, schema: str) -> DataFrame:
    """f(Adjacency) -> rows, by one task."""
    bounded(edges)
    rows = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    if v is not None:
        rows = rows.unionByName(v.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(None).cast("double").alias("weight")))
    names = [c.strip().split(" ")[0] for c in _columns(schema)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        real = pdf[pdf.weight.notna()]
        out = list(f(Adjacency(real.src, real.dst, real.weight, pdf.src)))
        return pd.DataFrame(out, columns=names)

    return rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, schema)


def _columns(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def by_source(edges: DataFrame, sources: DataFrame, f, schema: str) -> DataFrame:
    """f(Adjacency, node) -> rows for every source, spread over tasks; the adjacency is broadcast after its size is checked."""
    bounded(edges)
    sc = edges.sparkSession.sparkContext
    shared = sc.broadcast(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).toPandas())
    names = [c.strip().split(" ")[0] for c in _columns(schema)]

    def run(batches):
        g = None
        for pdf in batches:
            if g is None:
                e = shared.value
                g = Adjacency(e.src, e.dst, e.weight, pdf.id)
            rows = [r for s in pdf.id for r in f(g, int(s))]
            yield pd.DataFrame(rows, columns=names)

    return sources.repartition("id").mapInPandas(run, schema)


# ------------------------------------------------------------------ structure


def _low_links(g: Adjacency):
    """Depth-first search without recursion: cut nodes and bridges."""
    index, low, cuts, bridges, n = {}, {}, set(), [], 0
    for root in g.nodes:
        if root in index:
            continue
        index[root] = low[root] = n
        n += 1
        stack = [(root, None, iter(sorted(g.both[root])))]
        children = 0
        while stack:
            u, parent, it = stack[-1]
            w = next(it, None)
            if w is None:
                stack.pop()
                if stack:
                    p = stack[-1][0]
                    low[p] = min(low[p], low[u])
                    if low[u] > index[p]:
                        bridges.append((min(p, u), max(p, u)))
                    if p != root and low[u] >= index[p]:
                        cuts.add(p)
            elif w not in index:
                children += u == root
                index[w] = low[w] = n
                n += 1
                stack.append((w, u, iter(sorted(g.both[w]))))
            elif w != parent:
                low[u] = min(low[u], index[w])
        if children > 1:
            cuts.add(root)
    return sorted(cuts), sorted(bridges)


def articulation_points(g):
    return [(x,) for x in _low_links(g)[0]]


def bridges(g):
    return _low_links(g)[1]


# ---------------------------------------------------------------- communities


def label_propagation(g, iterations: int = 10):
    """Nodes in ascending order take the commonest label around them at once; the smallest wins ties, unless the own label is among the commonest."""
    label = {x: x for x in g.nodes}
    for _ in range(iterations):
        moved = False
        for x in g.nodes:
            n = defaultdict(int)
            for y in g.both[x]:
                n[label[y]] += 1
            if not n:
                continue
            most = max(n.values())
            best = [c for c, k in n.items() if k == most]
            if label[x] not in best:
                label[x], moved = min(best), True
        if not moved:
            break
    return sorted(label.items())


def _one_level(adj, gain_least, resolution, sweeps):
    degree = {x: sum(ns.values()) + ns.get(x, 0.0) for x, ns in adj.items()}
    m2 = sum(degree.values()) or 1.0
    com, total = {x: x for x in adj}, dict(degree)
    for _ in range(sweeps):
        moved = 0.0
        for x in sorted(adj):
            links = defaultdict(float)
            for y, w in adj[x].items():
                if y != x:
                    links[com[y]] += w
            own = com[x]
            total[own] -= degree[x]
            score = lambda c, links=links, x=x: links.get(c, 0.0) - resolution * total[c] * degree[x] / m2
            best = min(sorted(links), key=lambda c: (-score(c), c), default=own)
            if score(best) <= score(own) + 1e-12:
                best = own
            total[best] += degree[x]
            if best != own:
                moved += 2 * (score(best) - score(own)) / m2
                com[x] = best
        if moved <= gain_least:
            break
    return com


def louvain(g, iterations: int = 10, gain: float = 1e-6, resolution: float = 1.0, refine: bool = False):
    adj = {x: dict(g.both[x]) for x in g.nodes}
    where = {x: x for x in g.nodes}
    for _ in range(iterations):
        com = _one_level(adj, gain, resolution, iterations)
        if refine:
            com = _connected(adj, com)
        if len(set(com.values())) == len(adj):
            break
        name = {}
        for x in sorted(adj):
            name.setdefault(com[x], x)
        new: dict = defaultdict(lambda: defaultdict(float))
        for x, ns in adj.items():
            a = name[com[x]]
            new[a]
            for y, w in ns.items():
                b = name[com[y]]
                new[a][b] += w / 2 if x == y or a == b and x != y else w
        where = {x: name[com[c]] for x, c in where.items()}
        adj = {x: dict(ns) for x, ns in new.items()}
    least = {}
    for x in g.nodes:
        least[where[x]] = min(least.get(where[x], x), x)
    return [(x, least[where[x]]) for x in g.nodes]


def _connected(adj, com):
    """Communities split into their connected parts."""
    out = {}
    for x in sorted(adj):
        if x in out:
            continue
        out[x], todo = x, [x]
        while todo:
            u = todo.pop()
            for w in adj[u]:
                if w not in out and com[w] == com[u]:
                    out[w] = x
                    todo.append(w)
    return out


def leiden(g, iterations: int = 10, resolution: float = 1.0):
    return louvain(g, iterations, resolution=resolution, refine=True)


def k1_coloring(g):
    """Greedy by node order: the smallest colour that no neighbour has."""
    colour = {}
    for x in g.nodes:
        used = {colour[y] for y in g.both[x] if y in colour}
        c = 0
        while c in used:
            c += 1
        colour[x] = c
    return sorted(colour.items())


def max_k_cut(g, k: int = 2, iterations: int = 10, seed: int = 0):
    rng = np.random.default_rng(seed)
    part = {x: int(rng.integers(k)) for x in g.nodes}
    for _ in range(iterations):
        moved = False
        for x in g.nodes:
            inside = [0.0] * k
            for y, w in g.both[x].items():
                inside[part[y]] += w
            best = min(range(k), key=lambda c: (inside[c], c != part[x], c))
            if inside[best] < inside[part[x]]:
                part[x], moved = best, True
        if not moved:
            break
    return sorted(part.items())


def sllpa(g, iterations: int = 20, seed: int = 0):
    """Speakers pass on a label from their memory, listeners keep the commonest; the dominant label of each memory."""
    rng = np.random.default_rng(seed)
    memory = {x: [x] for x in g.nodes}
    for _ in range(iterations):
        for x in g.nodes:
            heard = defaultdict(int)
            for y in sorted(g.out[x]):
                heard[memory[y][int(rng.integers(len(memory[y])))]] += 1
            if heard:
                memory[x].append(min(heard, key=lambda c: (-heard[c], c)))
    return [(x, min(set(m), key=lambda c: (-m.count(c), c))) for x, m in sorted(memory.items())]


# ---------------------------------------------------------------------- trees


def spanning_tree(g):
    """Kruskal: (source, target, weight), lightest first."""
    parent = {x: x for x in g.nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    seen = {}
    for a in g.nodes:
        for b, w in g.out[a].items():
            k = (min(a, b), max(a, b))
            seen[k] = min(w, seen.get(k, w))
    out = []
    for (a, b), w in sorted(seen.items(), key=lambda e: (e[1], e[0])):
        if root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
            out.append((a, b, w))
    return out


def k_spanning_tree(g, k: int = 2):
    """The spanning forest less its k - 1 heaviest edges; communities are what stays connected."""
    tree = spanning_tree(g)
    kept = sorted(tree, key=lambda e: (e[2], e[0], e[1]))[: max(0, len(tree) - (k - 1))]
    parent = {x: x for x in g.nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in kept:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [(x, root(x)) for x in g.nodes]


def dijkstra(g, source: int, banned_nodes=frozenset(), banned_edges=frozenset()):
    dist, prev, heap = {source: 0.0}, {}, [(0.0, source)]
    done = set()
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        for w, c in sorted(g.out.get(u, {}).items()):
            if w in banned_nodes or (u, w) in banned_edges:
                continue
            if d + c < dist.get(w, float("inf")):
                dist[w], prev[w] = d + c, u
                heapq.heappush(heap, (d + c, w))
    return dist, prev


def _path(prev, s, t):
    out = [t]
    while out[-1] != s:
        out.append(prev[out[-1]])
    return out[::-1]


def yen(g, source: int, target: int, k: int = 3):
    """The k shortest loopless paths: (source, target, cost, path)."""
    dist, prev = dijkstra(g, source)
    if target not in dist:
        return []
    found = [(dist[target], _path(prev, source, target))]
    heap: list = []
    known = {tuple(found[0][1])}
    while len(found) < k:
        last = found[-1][1]
        for i in range(len(last) - 1):
            rootp = last[: i + 1]
            banned = {(p[i], p[i + 1]) for _, p in found if p[: i + 1] == rootp and len(p) > i + 1}
            d, pv = dijkstra(g, last[i], frozenset(rootp[:-1]), frozenset(banned))
            if target in d:
                p = rootp[:-1] + _path(pv, last[i], target)
                if tuple(p) not in known:
                    known.add(tuple(p))
                    heapq.heappush(heap, (sum(g.out[a][b] for a, b in zip(p, p[1:])), p))
        if not heap:
            break
        found.append(heapq.heappop(heap))
    return [(source, target, float(c), p) for c, p in found]


def steiner_tree(g, source: int, terminals: list[int]):
    """Terminals join one by one, nearest first, along a shortest path from what is joined already."""
    inside, out, left = {source}, [], set(terminals) - {source}
    while left:
        dist, prev, heap = {x: 0.0 for x in inside}, {}, [(0.0, x) for x in sorted(inside)]
        heapq.heapify(heap)
        hit = None
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            if u in left:
                hit = u
                break
            for w, c in sorted(g.out.get(u, {}).items()):
                if d + c < dist.get(w, float("inf")):
                    dist[w], prev[w] = d + c, u
                    heapq.heappush(heap, (d + c, w))
        if hit is None:
            break
        u = hit
        while u not in inside:
            out.append((prev[u], u, g.out[prev[u]][u]))
            inside.add(u)
            u = prev[u]
        left.discard(hit)
    return sorted(out)


# ---------------------------------------------------------- betweenness, walks


def dependencies(g, s):
    """Brandes: what source s adds to each node's betweenness."""
    order, preds, sigma, dist = [], defaultdict(list), defaultdict(float), {s: 0}
    sigma[s] = 1.0
    queue = deque([s])
    while queue:
        u = queue.popleft()
        order.append(u)
        for w in g.out.get(u, {}):
            if w not in dist:
                dist[w] = dist[u] + 1
                queue.append(w)
            if dist[w] == dist[u] + 1:
                sigma[w] += sigma[u]
                preds[w].append(u)
    delta = defaultdict(float)
    out = []
    for w in reversed(order):
        for u in preds[w]:
            delta[u] += sigma[u] / sigma[w] * (1 + delta[w])
        if w != s:
            out.append((w, delta[w]))
    return out


def walks(g, s, length=80, per_node=10, seed=SEED, p=1.0, q=1.0):
    """Walks from s; p and q bias them towards the last node and away from its neighbours."""
    out = []
    for k in range(per_node):
        rng = np.random.default_rng([seed % (1 << 63), s % (1 << 63), k])
        path = [s]
        while len(path) < length:
            ns = sorted(g.out.get(path[-1], {}))
            if not ns:
                break
            if len(path) == 1 or (p == 1.0 and q == 1.0):
                path.append(ns[int(rng.integers(len(ns)))])
                continue
            prev = path[-2]
            w = np.array([1 / p if x == prev else 1.0 if x in g.out.get(prev, {}) else 1 / q for x in ns])
            path.append(ns[int(rng.choice(len(ns), p=w / w.sum()))])
        out.append((s, path))
    return out


def fast_rp(g, dim: int = 128, weights=(0.0, 1.0, 1.0), seed: int = 0):
    """Very sparse random vectors, averaged over neighbours once a weight and summed."""
    at = {x: i for i, x in enumerate(g.nodes)}
    rng = np.random.default_rng(seed)
    x = rng.choice([-np.sqrt(3.0), 0.0, np.sqrt(3.0)], size=(len(at), dim), p=[1 / 6, 2 / 3, 1 / 6])
    out = np.zeros_like(x)
    for w in weights:
        new = np.zeros_like(x)
        for u, i in at.items():
            ns = [at[y] for y in g.out[u]]
            if ns:
                new[i] = x[ns].mean(0)
        norm = np.linalg.norm(new, axis=1, keepdims=True)
        x = np.divide(new, norm, out=np.zeros_like(new), where=norm > 0)
        out += w * x
    return [(u, [float(z) for z in out[i]]) for u, i in at.items()]


def hashgnn(g, dim: int = 128, iterations: int = 3, seed: int = 0):
    """Binary features: each round keeps, hash by hash, the feature with the least hash among a node and its neighbours."""
    at = {x: i for i, x in enumerate(g.nodes)}
    rng = np.random.default_rng(seed)
    bits = rng.random((len(at), dim)) < min(1.0, 8 / dim)
    for _ in range(iterations):
        hashes = rng.permuted(np.tile(np.arange(dim), (max(4, dim // 8), 1)), axis=1)
        new = np.zeros_like(bits)
        for u, i in at.items():
            have = bits[[i, *(at[y] for y in g.out[u])]].any(0)
            if have.any():
                new[i, np.where(have, hashes, dim).argmin(1)] = True
        bits = new
    return [(u, [float(z) for z in bits[i]]) for u, i in at.items()]
