"""SimHash near-duplicates: a binary trie of fingerprints joined with itself.

Two tries' nodes are walked together, adding up the bits in which their paths differ; a pair of nodes is left as soon as it
exceeds the error budget. The top of the trie, at most TOP_BITS levels, is walked on the driver over prefix
counts (at most 2**TOP_BITS of them) and yields pairs of subtrees; each such pair is one group that a task walks on down.
Tasks return a spanning forest of the links they find, never the links themselves, and components
are closed over these edges by alternating large-star and small-star rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import WordIds, folded_words, materialise, mixed_runs, only, remembers, sliced, text_rows, without

TOP_BITS = 12
#: A subtree with more fingerprints is split further, down to TOP_BITS levels.
SUBTREE = 1 << 17
_BLOCK = 1 << 21


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the words' shingles (A-Z lower-cased; repeats count; no words: zero)."""
    words = folded_words(text)
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], seed) for a, b in zip(start[:n].tolist(), end[len(words) - n :].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches):
        only("simhash")
        for batch in batches:
            got = [fingerprint(x, shingle, seed) for part in sliced(batch, 1) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(got, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return run


def subtree_pairs(counts: dict[int, int], budget: int, largest: int = SUBTREE, least: int = 3) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """counts: fingerprints by their top TOP_BITS bits. The subtree (leaf of the top) of each such prefix, and the pairs of leaves within the budget, with the bits in which they differ for sure."""
    total = np.zeros(1 << TOP_BITS, np.int64)
    for k, v in counts.items():
        total[k] = v
    leaf_of, leaves, todo = np.full(1 << TOP_BITS, -1, np.int64), [], [(0, 0)]
    while todo:
        depth, path = todo.pop()
        width = 1 << (TOP_BITS - depth)
        n = int(total[path * width : (path + 1) * width].sum())
        if not n:
            continue
        if depth < TOP_BITS and (n > largest or depth < least):
            todo += [(depth + 1, 2 * path + 1), (depth + 1, 2 * path)]
            continue
        leaf_of[path * width : (path + 1) * width] = len(leaves)
        leaves.append((depth, path))
    pairs = []
    for i, (d, p) in enumerate(leaves):
        for j in range(i, len(leaves)):
            e, q = leaves[j]
            k = min(d, e)
            diff = ((p >> (d - k)) ^ (q >> (e - k))).bit_count()
            if diff <= budget:
                pairs.append((i, j, diff))
    return leaf_of, pairs


class Forest:
    """Union-find over array places, merging whole batches of links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        p = self.parent
        while len(i):
            i, j = p[i], p[j]
            keep = i != j
            i, j = i[keep], j[keep]
            if not len(i):
                break
            np.minimum.at(p, np.maximum(i, j), np.minimum(i, j))
            while True:
                q = p[p]
                if np.array_equal(q, p):
                    break
                p = q
        self.parent = p


def trie_links(a: np.ndarray, b: np.ndarray, budget: int, same: bool, found, top: int = 63) -> None:
    """Walks the tries of two ascending arrays (same: one trie with itself) and calls found(i, j) with batches of places whose values differ in at most budget bits; top is their highest bit."""
    if not len(a) or not len(b):
        return
    one = lambda x: np.array([x], np.int64)
    todo = [(top, one(0), one(len(a)), one(0), one(len(b)), one(0), np.array([same]))]
    while todo:
        bit, a0, a1, b0, b1, diff, self_pair = todo.pop()
        if len(a0) > _BLOCK:  # depth first, so the frontier stays bounded
            h = len(a0) // 2
            todo += [(bit, *(x[h:] for x in (a0, a1, b0, b1, diff, self_pair))), (bit, *(x[:h] for x in (a0, a1, b0, b1, diff, self_pair)))]
            continue
        small = (a1 - a0) * (b1 - b0) <= 64
        if bit < 0:
            small[:] = True
        if small.any():
            _compare(a, b, *(x[small] for x in (a0, a1, b0, b1, self_pair)), budget, found)
        if small.all():
            continue
        a0, a1, b0, b1, diff, self_pair = (x[~small] for x in (a0, a1, b0, b1, diff, self_pair))
        step = np.uint64(1 << bit)
        high = ~np.uint64((1 << (bit + 1)) - 1)
        am = np.searchsorted(a, (a[a0] & high) | step)
        bm = np.searchsorted(b, (b[b0] & high) | step)
        rows = [(a0, am, b0, bm, diff, self_pair), (am, a1, bm, b1, diff, self_pair), (a0, am, bm, b1, diff + 1, np.zeros_like(self_pair))]
        other = ~self_pair  # of a node with itself the mirrored pair is the same
        rows.append((am[other], a1[other], b0[other], bm[other], diff[other] + 1, np.zeros(int(other.sum()), bool)))
        a0, a1, b0, b1, diff, self_pair = (np.concatenate(x) for x in zip(*rows))
        keep = (diff <= budget) & (a1 > a0) & (b1 > b0)
        if keep.any():
            todo.append((bit - 1, *(x[keep] for x in (a0, a1, b0, b1, diff, self_pair))))


def _compare(a, b, a0, a1, b0, b1, self_pair, budget, found) -> None:
    """All value pairs of small node pairs, in blocks."""
    nb = b1 - b0
    cells = (a1 - a0) * nb
    cut = np.cumsum(cells) // _BLOCK
    for k in np.unique(cut):
        m = cut == k
        n = cells[m]
        which = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        i, j = a0[m][which] + place // nb[m][which], b0[m][which] + place % nb[m][which]
        ok = (np.bitwise_count(a[i] ^ b[j]) <= budget) & (~self_pair[m][which] | (i < j))
        if ok.any():
            found(i[ok], j[ok])


def _walk(budget: int, pairs: dict[int, tuple[int, int]]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Rows (side, fp) of a pair of subtrees; out: edges from each linked fingerprint to the root of its tree."""
        side, fp = np.asarray(table.column("side")), np.asarray(table.column("fp")).view(np.uint64)
        same = bool(pairs[key[0].as_py()])
        a = np.sort(fp[side == 0])
        b = a if same else np.sort(fp[side == 1])
        forest = Forest(len(a) + (0 if same else len(b)))
        shift = 0 if same else len(a)
        trie_links(a, b, budget, same, lambda i, j: forest.link(i, j + shift))
        every = a if same else np.concatenate([a, b])
        linked = np.flatnonzero(forest.parent != np.arange(len(every)))
        return pa.table({"u": pa.array(every[linked].view(np.int64)), "v": pa.array(every[forest.parent[linked]].view(np.int64))})

    return run


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs -> (node, root): the smallest node of each component, for every node that has an edge.

    Large-star and small-star rounds, each written to the shared folder; minima aggregate map-side, and joins on a
    hot root are plain equi-joins that adaptive execution splits.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = materialise(small, "edges")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id that links reach).

    Null and word-less texts have fingerprint zero and link like others; equal fingerprints always link. Null ids are never
    a component's id unless it has no other. Repeated rows and ids each give a row. An empty table gives no rows.
    """
    rows = text_rows(docs, id_col, text_col)
    narrow = materialise(rows.mapInArrow(_fingerprints(shingle, seed), "doc_id long, fp long"), "fingerprints")
    nodes = materialise(narrow.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    top = F.shiftrightunsigned("fp", 64 - TOP_BITS).cast("int")
    counts = {r["top"]: r["n"] for r in nodes.groupBy(top.alias("top")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 2**TOP_BITS rows at most
    leaf_of, pairs = subtree_pairs(counts, budget)
    of_leaf: dict[int, list[tuple[int, int]]] = {}
    for k, (i, j, _) in enumerate(pairs):
        of_leaf.setdefault(i, []).append((k, 0))
        if i != j:
            of_leaf.setdefault(j, []).append((k, 1))
    spark = docs.sparkSession
    kind = T.StructType([T.StructField("top", T.IntegerType()), T.StructField("to", T.ArrayType(T.StructType([T.StructField("pair", T.IntegerType()), T.StructField("side", T.IntegerType())])))])
    routes = spark.createDataFrame([(p, of_leaf[int(leaf_of[p])]) for p in sorted(counts)], kind)
    dealt = nodes.select("fp", top.alias("top")).join(F.broadcast(routes), "top").select("fp", F.explode("to").alias("t")).select("t.pair", "t.side", "fp")  # at most 4096 routes
    edges = dealt.groupBy("pair").applyInArrow(_walk(budget, {k: i == j for k, (i, j, _) in enumerate(pairs)}), "u long, v long")
    linked = materialise(components(edges), "components")
    member = nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = materialise(member.join(ids, "root").select("fp", "component_id"), "classes")
    return narrow.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Stage on similar texts: bits of a wide fingerprint, tries, leading bits that must agree in a trie, bits after those, and how many of them may differ.
WIDE, TRIES, PREFIX, DEPTH, BUDGET = 256, 24, 8, 17, 3
#: Wide fingerprints further apart than this are no candidates: four standard deviations above what a similarity of 0.8 gives.
FAR = 62
_LINKS, _LEAF = 1 << 21, 512
_rng = np.random.default_rng(9)
_SALTS = _rng.integers(0, 2**64, (2, WIDE // 64), np.uint64) | np.uint64(1)
#: The bits that each trie reads, in its order.
_ORDERS = np.stack([_rng.permutation(WIDE)[: PREFIX + DEPTH] for _ in range(TRIES)])
_ids = WordIds()
remembers("simhash", _ids)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Ascending distinct 64-bit marks of the words' shingles (A-Z lower-cased; a shorter text is one shingle; no words, none)."""
    words = folded_words(text)
    return np.unique(mixed_runs(_ids.of(words), min(shingle, len(words)))) if words else np.zeros(0, np.uint64)


def wide_fingerprint(marks: np.ndarray) -> np.ndarray:
    """SimHash of WIDE bits, one a byte."""
    ones = np.zeros(WIDE, np.int64)
    for at in range(0, len(marks), 1 << 14):
        h = (marks[at : at + (1 << 14), None] ^ _SALTS[0]) * _SALTS[1]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return (2 * ones > len(marks)).astype(np.uint8)


def _wide(batches):
    """(doc_id, digest, text) -> (doc_id, digest, wide); a text without words has no wide fingerprint."""
    only("simhash")
    for batch in batches:
        for part in sliced(batch, 2):
            marks = [shingle_set(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([np.packbits(wide_fingerprint(m), bitorder="little").tobytes() if len(m) else None for m in marks], pa.binary())], names=["doc_id", "digest", "wide"])


def _into_tries(batches):
    """(node, wide) -> for each trie (group: trie and leading bits, path: the bits after them, node, wide)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        bits = np.unpackbits(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, -1), axis=1, bitorder="little")
        node = np.asarray(batch.column(0))
        for t, order in enumerate(_ORDERS):
            own = bits[:, order].astype(np.int64)
            head, path = own[:, :PREFIX] @ (1 << np.arange(PREFIX)[::-1]), own[:, PREFIX:] @ (1 << np.arange(DEPTH)[::-1])
            yield pa.RecordBatch.from_arrays([pa.array((t << PREFIX | head).astype(np.int32)), pa.array(path.astype(np.int32)), pa.array(node), batch.column(1)], names=["group", "path", "node", "wide"])


def least_forest(i: np.ndarray, j: np.ndarray, far: np.ndarray, n: int) -> np.ndarray:
    """Places of the links of a spanning forest with the least distances (ties: first links): components of all links up to any distance are those of the forest's links up to it."""
    order = np.argsort(far, kind="stable")
    i, j = i[order], j[order]
    forest, kept, left = Forest(n), [], np.arange(len(order))
    while len(left):
        a, b = forest.parent[i[left]], forest.parent[j[left]]
        apart = a != b
        left, a, b = left[apart], a[apart], b[apart]
        if not len(left):
            break
        first = np.full(n, len(order))
        np.minimum.at(first, a, left)
        np.minimum.at(first, b, left)
        take = np.unique(first[first < len(order)])
        kept.append(take)
        forest.link(i[take], j[take])
    return order[np.concatenate(kept)] if kept else np.zeros(0, np.int64)


def _near(key: tuple, table: pa.Table) -> pa.Table:
    """A group of a trie, joined with itself; out: the links of its least spanning forest."""
    n = table.num_rows
    path = np.asarray(table.column("path")).astype(np.uint64)
    order = np.argsort(path, kind="stable")
    path, node = path[order], np.asarray(table.column("node"))[order]
    wide = np.frombuffer(b"".join(table.column("wide").to_pylist()), np.uint64).reshape(n, -1)[order]
    links: list[np.ndarray] = [np.zeros((3, 0), np.int64)]
    held = 0

    def thin() -> None:
        every = np.concatenate(links, axis=1)
        links[:] = [every[:, least_forest(*every, n)]]

    def found(i, j):
        nonlocal held
        far = np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1, dtype=np.int64)
        close = far <= FAR
        links.append(np.stack([i[close], j[close], far[close]]))
        held += int(close.sum())
        if held > _LINKS:
            thin()
            held = 0

    if n <= _LEAF:  # a leaf: its paths are compared at once
        found(*np.nonzero(np.triu(np.bitwise_count(path[:, None] ^ path) <= BUDGET, 1)))
    else:
        trie_links(path, path, BUDGET, True, found, top=DEPTH - 1)
    thin()
    i, j, _ = links[0]
    return pa.table({"u": pa.array(np.minimum(node[i], node[j])), "v": pa.array(np.maximum(node[i], node[j]))})


def _sets(batches):
    only("simhash")
    for batch in batches:
        for part in sliced(batch, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(x).tobytes() for x in part.column(1).to_pylist()], pa.binary())], names=["node", "shingles"])


def _similar(least: float):
    def run(batches):
        """(u, v, their shingles) -> (u, v) of the pairs whose Jaccard similarity is at least ``least``."""
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of all rows: components of equal texts and of pairs whose five-word shingles have a Jaccard similarity of at least ``least`` (0.8 or more).

    Texts of that similarity differ in some 15% of the bits of a SimHash, more than one trie of all bits can prune by. So TRIES binary tries over bits of a wide
    SimHash, each in its own order, are joined with themselves: a pair of nodes is left as soon as a leading bit or more than BUDGET of the
    bits after those differ. Of what a group links, the least spanning forest by wide distance goes on to exact verification, never all pairs. A pair of
    similarity 0.8 is missed by all tries with a chance of about 2%, one of 0.85 of 0.1%. Word-less texts are equal; null ids come last.
    """
    rows = text_rows(docs, id_col, text_col).withColumn("digest", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    wide = materialise(rows.select("doc_id", "digest", "text").mapInArrow(_wide, "doc_id long, digest binary, wide binary"), "wide")
    nodes = materialise(wide.where("wide is not null").groupBy("digest").agg(F.first("wide").alias("wide")).withColumn("node", F.monotonically_increasing_id()), "wide_nodes")
    alike = nodes.groupBy("wide").agg(F.min("node").alias("lead"))
    same = nodes.join(alike, "wide").where("node <> lead").select(F.col("lead").alias("u"), F.col("node").alias("v"))
    dealt = alike.select(F.col("lead").alias("node"), "wide").mapInArrow(_into_tries, "group int, path int, node long, wide binary")
    pairs = materialise(dealt.groupBy("group").applyInArrow(_near, "u long, v long").union(same).distinct(), "pairs")
    some = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = nodes.join(some, "node").select("digest", "node")
    sets = materialise(rows.select("digest", "text").join(wanted, "digest").select("node", "text").mapInArrow(_sets, "node long, shingles binary").dropDuplicates(["node"]), "sets")
    one, two = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "uv")
    edges = pairs.join(one, "u").join(two, "v").select("u", "v", "u_set", "v_set").mapInArrow(_similar(least), "u long, v long")
    linked = materialise(components(edges), "components")
    member = nodes.join(linked, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    member = materialise(wide.select("doc_id", "digest").join(member, "digest", "left").select("doc_id", F.coalesce("root", F.lit(-1)).alias("root")), "members")
    ids = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return member.join(ids, "root").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with, of each group of near copies (see near_copies), only the rows under its smallest id; all columns unchanged."""
    verdict = materialise(near_copies(docs, id_col, text_col), "verdict")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = verdict.groupBy("doc_id").agg(F.bool_or(stays).alias("stays")).where("not stays").select("doc_id")
    return without(docs, gone, id_col)
