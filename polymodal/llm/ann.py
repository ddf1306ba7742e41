"""Approximate nearest neighbours by additive quantisation.

A vector's direction is coded as the sum of one codeword of each codebook, found by beam search over residuals: BOOKS books over all
dimensions, then FINE books for each run of at most WIDTH dimensions (their codewords are zero elsewhere), so the code grows with the dimension. The
codebooks come from residual k-means on a bounded sample. With each code go the vector's stored norm and the length of its residual. A query's
inner products with all codewords are its lookup table: a row of it a book, summed and times the norm, estimates the inner product, and with both
norms the distance. An estimate errs by the query's product with the residual: by a share of the residual's length that is measured on rows outside the sample,
and never by more than that length. Only ids, codes and these lengths meet the queries. All codes whose estimate, plus its margin, reaches the k-th largest estimate less its margin meet
their original vectors for exact scores in double precision, the RERANK best codes and those that tie with the last in any case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import materialise

BOOKS, FINE, WIDTH, WORDS, BEAM = 4, 8, 16, 256, 2
#: Rows that the codebooks are fitted on at most (those first by hash of id); all rows are coded.
SAMPLE = 8192
#: Other rows that the errors of estimates are measured on at most, queries and best codes of each, and the quantile taken; what single precision adds for a vector of length one.
HELD, HELD_QUERIES, HELD_BEST, QUANTILE, ROUNDING = 4096, 256, 64, 0.999, 4e-6
#: Rows of a block of codes and of a block of queries, and codes that are reranked for each query at least.
BLOCK, QUERIES, RERANK = 65536, 8192, 128


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():  # an empty word takes over a random residual
            c[n == 0] = x[rng.integers(0, len(x), int((n == 0).sum()))]
    return c


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 5, seed: int = 0, fine: int = 0) -> list[tuple[int, np.ndarray]]:
    """Codebooks by residual k-means, each its first dimension and [word, dimension]: ``books`` over all dimensions, then ``fine`` for each run of WIDTH dimensions."""
    rng, residual, out = np.random.default_rng(seed), x.astype(np.float32), []
    dim = x.shape[1]
    cuts = np.linspace(0, dim, -(-dim // WIDTH) + 1).astype(int).tolist()
    for lo, hi in [(0, dim)] * books + [run for run in zip(cuts, cuts[1:]) for _ in range(fine)]:
        part = residual[:, lo:hi]
        c = _kmeans(part, min(words, len(part)), rounds, rng)
        residual[:, lo:hi] -= c[np.argmin((c * c).sum(1) - 2 * part @ c.T, axis=1)]
        out.append((lo, c))
    return out


def encode(x: np.ndarray, codebooks: list[tuple[int, np.ndarray]], beam: int = BEAM) -> np.ndarray:
    """Codes [row, book] by beam search: of all beams' extensions by a codeword the ``beam`` with the smallest residuals go on."""
    out = np.zeros((len(x), len(codebooks)), np.uint8)
    for at in range(0, len(x), 512):
        part = x[at : at + 512].astype(np.float32)
        n = len(part)
        row = np.arange(n)[:, None]
        residual, codes = part[:, None, :], np.zeros((n, 1, 0), np.uint8)
        for lo, c in codebooks:
            hi = lo + c.shape[1]
            error = (residual * residual).sum(2)[:, :, None] - 2 * residual[:, :, lo:hi] @ c.T + (c * c).sum(1)
            flat = error.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            b, w = best // len(c), best % len(c)
            residual = residual[row, b]
            residual[:, :, lo:hi] -= c[w]
            codes = np.concatenate([codes[row, b], w[:, :, None].astype(np.uint8)], axis=2)
        out[at : at + n] = codes[np.arange(n), (residual * residual).sum(2).argmin(1)]
    return out


def decode(codes: np.ndarray, codebooks: list[tuple[int, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(codes), max(lo + c.shape[1] for lo, c in codebooks)), np.float32)
    for m, (lo, c) in enumerate(codebooks):
        out[:, lo : lo + c.shape[1]] += c[codes[:, m]]
    return out


def lookup_scores(queries: np.ndarray, codes: np.ndarray, codebooks: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """[code, query] inner products of queries with what codes decode to, by one table row a book."""
    out = np.zeros((len(codes), len(queries)), np.float32)
    for m, (lo, c) in enumerate(codebooks):
        out += (c @ queries[:, lo : lo + c.shape[1]].T)[codes[:, m]]
    return out


def residuals(unit: np.ndarray, codes: np.ndarray, codebooks: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Lengths of what the codes leave of rows of length one."""
    return np.sqrt(((unit - decode(codes, codebooks)) ** 2).sum(axis=1))


def error_share(queries: np.ndarray, unit: np.ndarray, codebooks: list[tuple[int, np.ndarray]]) -> float:
    """What share of a residual's length an estimate errs by, at QUANTILE of each query's best codes; 1 bounds every error."""
    codes = encode(unit, codebooks)
    q = _lengths(queries)[1]
    near = lookup_scores(q.astype(np.float32), codes, codebooks).T
    best = np.argsort(-near, axis=1)[:, :HELD_BEST]
    error = np.abs(near - q @ unit.T) / (residuals(unit, codes, codebooks) + ROUNDING)
    return float(min(1.0, np.quantile(np.take_along_axis(error, best, 1), QUANTILE)))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row in double precision; equal rows score equally wherever they stand."""
    return (q.astype(np.float64) * x.astype(np.float64)).sum(axis=-1)


def usable(vector, dim: int):
    """Vectors that take part: not null or zero, all components there and finite, of the index's dimension."""
    return F.coalesce((F.size(vector) == dim) & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of rows, and rows of length one; scaled first so that squares neither overflow nor vanish."""
    most = np.abs(x).max(axis=1)
    x = x / most[:, None]
    size = np.sqrt((x * x).sum(axis=1))
    return most * size, x / size[:, None]


def _encoder(codebooks: list[tuple[int, np.ndarray]]):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            norm, unit = _lengths(_matrix(b.column(1)).astype(np.float64))
            codes = encode(unit, codebooks)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(residuals(unit, codes, codebooks)), b.column(2)], names=["vec_id", "code", "norm", "residual", "block"])

    return run


def estimates(queries: np.ndarray, codes: np.ndarray, norms: np.ndarray, codebooks: list[tuple[int, np.ndarray]], metric: str) -> np.ndarray:
    """[query, code]: inner products in the query's direction, or for l2 what grows as distances fall. Tables are in single precision, over queries of length one."""
    size, unit = _lengths(queries)
    with np.errstate(over="ignore", invalid="ignore"):
        ip = lookup_scores(unit.astype(np.float32), codes, codebooks).T * norms
        if metric == "ip":
            return ip
        out = 2 * ip * size[:, None] - norms * norms
        out[np.isnan(out)] = np.inf  # beyond doubles: left to the exact scores
        return out


def margins(queries: np.ndarray, norms: np.ndarray, lengths: np.ndarray, share: float, metric: str) -> np.ndarray:
    """[query or 1, code]: how far estimates may be from what they estimate, given the lengths of residuals and the share of them that counts."""
    with np.errstate(over="ignore"):
        off = ((share * lengths + ROUNDING) * norms)[None, :]
        return off if metric == "ip" else 2 * off * _lengths(queries)[0][:, None]


def _search(codebooks: list[tuple[int, np.ndarray]], share: float, k: int, rerank: int, metric: str):
    def run(key: tuple, codes: pa.Table, queries: pa.Table) -> pa.Table:
        """Of a block of codes, for each of a block of queries, the best codes, all that tie with the last of them and all that may be among the k nearest."""
        kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("estimate", pa.float64()), ("margin", pa.float64())])
        if not codes.num_rows or not queries.num_rows:
            return kind.empty_table()
        ids, norm, residual = (codes.column(c).to_numpy() for c in ("vec_id", "norm", "residual"))
        code = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        queries = queries.sort_by("query_id")  # each block of codes sees them in one order, so equal codes score alike in all blocks
        qid, q = queries.column("query_id").to_numpy(), _matrix(queries.column("vector")).astype(np.float64)
        out: list[tuple] = []
        for at in range(0, len(qid), 64):
            own_id = qid[at : at + 64]
            near = estimates(q[at : at + 64], code, norm, codebooks, metric)
            near[ids[None, :] == own_id[:, None]] = -np.inf
            off = margins(q[at : at + 64], norm, residual, share, metric)
            off = np.broadcast_to(off, near.shape)
            n = len(ids) - min(rerank, len(ids))
            keep = near >= np.partition(near, n, axis=1)[:, n, None]
            if k < len(ids):  # the k-th largest of what the best codes' inner products are at least
                row, place = np.nonzero(keep)
                with np.errstate(invalid="ignore"):
                    low = near[row, place] - off[row, place]
                reached = low[np.lexsort((-low, row))][np.searchsorted(row, np.arange(len(own_id))) + k - 1]
                keep |= ~(near + off < reached[:, None])
            row, place = np.nonzero(keep & (ids[None, :] != own_id[:, None]))
            out.append((own_id[row], ids[place], near[row, place], off[row, place]))
        cols = [np.concatenate(c) for c in zip(*out)]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kind.types)], schema=kind)

    return run


def _exact(metric: str):
    def run(batches):
        """(query_id, vec_id, query's vector, vector) -> (query_id, vec_id, score)"""
        for b in batches:
            if b.num_rows:
                q, x = _matrix(b.column(2)), _matrix(b.column(3))
                s = exact_scores(q, x) if metric == "ip" else -np.sqrt(((q.astype(np.float64) - x.astype(np.float64)) ** 2).sum(-1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, metric: str = "ip", id_col: str = "vec_id", vector_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """Per query its k nearest rows found: query_id, rank (from 1), vec_id, score (exact inner product of the original vectors; for metric l2 the negative distance).

    is_query is a condition on the columns of vectors (on vec_id, if renamed). Candidates are all rows with another id than the query's. Null, zero and non-finite vectors, vectors
    with null components and null ids take no part, nor do those whose length differs from ``dim`` (default: the commonest length, the smaller of
    a tie). Equal scores go to the smaller id. Rows equal in id and vector are one row; of rows with one id and several vectors each is a candidate, and the query is
    the least of those marked. Fewer candidates than k give fewer rows, an empty table none. Other columns may have any names. Of equal vectors only the
    k + 1 smallest ids are coded, as no other can be among a query's k nearest. Queries meet codes in blocks of fixed size, whatever the table's.
    """
    if metric not in ("ip", "l2"):
        raise ValueError("metric is ip or l2")
    spark = vectors.sparkSession
    own = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = "float" if own == "float" else "double"
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast(f"array<{kind}>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where("vec_id is not null")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dim is None:
        lengths = given.where("vector is not null and size(vector) > 0").groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
        if lengths is None:
            return empty
        dim = lengths["d"]
    some = given.where(usable(F.col("vector"), dim))
    # equal vectors meet by hash; the window's limit is taken before the shuffle too, so a vector of any number of copies sends few
    turn = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    x = materialise(some.select("vec_id", "vector").withColumn("turn", turn).where(F.col("turn") <= k + 1).drop("turn").distinct(), "vectors")
    asked = materialise(some.where("is_query").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector")), "queries")
    n, n_queries = x.count(), asked.count()
    if not n or not n_queries:
        return empty
    sample = _lengths(_matrix(x.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id", "vector").limit(SAMPLE + HELD).select("vector").toArrow().column(0)).astype(np.float64))[1]
    codebooks = train(sample[:SAMPLE], fine=FINE)
    some_asked = _matrix(asked.orderBy(F.xxhash64("query_id", F.lit(11)), "query_id").limit(HELD_QUERIES).select("vector").toArrow().column(0)).astype(np.float64)
    share = error_share(some_asked, sample[-HELD:], codebooks)
    blocks, query_blocks = -(-n // BLOCK), -(-n_queries // QUERIES)
    block = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks)).cast("int")
    coded = materialise(x.select("vec_id", "vector", block.alias("block")).mapInArrow(_encoder(codebooks), "vec_id long, code binary, norm double, residual double, block int"), "codes")
    codes = coded.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    queries = asked.select("query_id", "vector", F.pmod(F.xxhash64("query_id", F.lit(6)), F.lit(query_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = codes.groupBy("block", "qb").cogroup(queries.groupBy("block", "qb")).applyInArrow(_search(codebooks, share, k, max(RERANK, k), metric), "query_id long, vec_id long, estimate double, margin double")
    each = Window.partitionBy("query_id")
    low, high = F.col("estimate") - F.col("margin"), F.col("estimate") + F.col("margin")
    placed = found.withColumn("place", F.rank().over(each.orderBy(F.desc("estimate")))).withColumn("turn", F.row_number().over(each.orderBy(low.desc())))
    reached = F.min(F.when(F.col("turn") <= k, low)).over(each)
    pairs = placed.withColumn("reached", reached).where((F.col("place") <= max(RERANK, k)) | ~(high < F.col("reached"))).select("query_id", "vec_id").distinct()
    scored = pairs.join(asked.withColumnRenamed("vector", "asked"), "query_id").join(x, "vec_id").select("query_id", "vec_id", "asked", "vector").mapInArrow(_exact(metric), "query_id long, vec_id long, score double")
    nearest_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
