"""Exact deduplication by counting quotient filters.

Fingerprints (64 bits) of whole texts go into a counting quotient filter per input partition. Filters are cut into blocks by the
fingerprint's top bits, so merging them is one shuffle of small blobs by block; two blocks merge without loss by
merging their sorted remainders within each quotient. Only fingerprints whose merged count is above one send their texts on to the byte
verification, which groups on the text itself.
"""

from __future__ import annotations

import hashlib
import math
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import materialise, only, sliced, text_rows

SEED = 0x5EED
#: Fingerprints in one block of the merged filter, about; the number of blocks follows the rows.
BLOCK_ROWS = 1 << 18


class CountingQuotientFilter:
    """A lossless counting filter of 64-bit fingerprints that share their top ``block_bits`` bits.

    A fingerprint's next ``quotient_bits`` bits are its quotient, the rest its remainder. Stored are, per quotient,
    the length of its run, and the runs' sorted remainders; a counter is kept only where a remainder repeats.
    """

    def __init__(self, block_bits: int, quotient_bits: int = 12):
        if not 0 <= block_bits <= 32 or not 1 <= quotient_bits <= 24:
            raise ValueError("block_bits must be in 0..32 and quotient_bits in 1..24")
        self.block_bits, self.quotient_bits = block_bits, quotient_bits
        self.remainder_bits = 64 - block_bits - quotient_bits
        self.runs = np.zeros(1 << quotient_bits, np.uint32)
        self.remainders = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.uint64)

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, block_bits: int = 0, quotient_bits: int = 12) -> CountingQuotientFilter:
        """The filter of fingerprints, which all lie in one block."""
        f = cls(block_bits, quotient_bits)
        values, place = np.unique(np.asarray(fingerprints, np.uint64), return_inverse=True)
        f.counts = np.bincount(place, counts, len(values)).astype(np.uint64)
        f._set(values)
        return f

    def _set(self, values: np.ndarray) -> None:
        r = np.uint64(self.remainder_bits)
        quotient = (values >> r) & np.uint64((1 << self.quotient_bits) - 1)
        self.runs = np.bincount(quotient.astype(np.int64), minlength=1 << self.quotient_bits).astype(np.uint32)
        self.remainders = values & np.uint64((1 << self.remainder_bits) - 1)

    def fingerprints(self, block: int) -> np.ndarray:
        """All distinct fingerprints, ascending."""
        quotient = np.repeat(np.arange(1 << self.quotient_bits, dtype=np.uint64), self.runs)
        top = np.uint64((block << (64 - self.block_bits)) & 0xFFFFFFFFFFFFFFFF if self.block_bits else 0)
        return top | (quotient << np.uint64(self.remainder_bits)) | self.remainders

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both filters' multisets together: runs of equal quotients merge by their sorted remainders."""
        both = np.concatenate([self.fingerprints(0), other.fingerprints(0)])
        order = np.argsort(both, kind="stable")
        both, n = both[order], np.concatenate([self.counts, other.counts])[order]
        out = CountingQuotientFilter(self.block_bits, self.quotient_bits)
        if len(both):
            first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
            out.counts = np.add.reduceat(n, first)
            out._set(both[first])
        return out

    def to_bytes(self) -> bytes:
        """Header, occupied quotients with their run lengths, remainders, and the counters above one with their places."""
        used = np.flatnonzero(self.runs).astype(np.uint32)
        many = np.flatnonzero(self.counts > 1).astype(np.uint32)
        return struct.pack("<BBIII", self.block_bits, self.quotient_bits, len(used), len(self.remainders), len(many)) + b"".join(
            x.tobytes() for x in (used, self.runs[used], self.remainders, many, self.counts[many])
        )

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        b, q, used, n, many = struct.unpack_from("<BBIII", raw)
        f, at = cls(b, q), 14
        parts = []
        for kind, size in (("<u4", used), ("<u4", used), ("<u8", n), ("<u4", many), ("<u8", many)):
            parts.append(np.frombuffer(raw, kind, size, at))
            at += size * np.dtype(kind).itemsize
        f.runs[parts[0]] = parts[1]
        f.remainders, f.counts = parts[2], np.ones(n, np.uint64)
        f.counts[parts[3]] = parts[4]
        return f


def _fold(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower() if text else b""  # bytes.lower() folds A-Z only


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _digests(batches):
    """(id, text) -> (id, row_no, fingerprint, sha256), in the input's order."""
    only("exact")
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        for part in sliced(batch, 1):
            texts = [_fold(x) for x in part.column(1).to_pylist()]
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(np.arange(row, row + n)),
                    _signed(np.fromiter((xxhash.xxh3_64_intdigest(x, SEED) for x in texts), np.uint64, n)),
                    pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()),
                ],
                names=["doc_id", "row_no", "fp", "sha"],
            )
            row += n


def _texts(batches):
    """(text) -> (fingerprint, folded bytes)."""
    for batch in batches:
        for part in sliced(batch, 0):
            texts = [_fold(x) for x in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([_signed(np.fromiter((xxhash.xxh3_64_intdigest(x, SEED) for x in texts), np.uint64, len(texts))), pa.array(texts, pa.binary())], names=["fp", "folded"])


def _filters(block_bits: int):
    def build(batches):
        """One blob a block that this partition touches."""
        got = [np.asarray(b.column(0)).view(np.uint64) for b in batches]
        values, counts = np.unique(np.concatenate(got), return_counts=True) if got else ([], [])
        if not len(values):
            return
        block = (values >> np.uint64(64 - block_bits)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist() + [len(values)]
        blobs = [CountingQuotientFilter.of(values[a:b], counts[a:b], block_bits).to_bytes() for a, b in zip(cut, cut[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(block[cut[:-1]]), pa.array(blobs, pa.binary())], names=["block", "filter"])

    return build


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    """All filters of a block as one, level by level; of it the fingerprints that occur more than once."""
    level = [CountingQuotientFilter.from_bytes(x) for x in table.column("filter").to_pylist()]
    while len(level) > 1:
        level = [level[i].merge(level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    many = level[0].counts > 1
    return pa.table({"fp": _signed(level[0].fingerprints(key[0].as_py())[many])})


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """Of a column fp (long): the values that occur more than once, by merged filters."""
    bits = max(5, math.ceil(math.log2(max(1, rows) / BLOCK_ROWS)))
    return fingerprints.select("fp").mapInArrow(_filters(bits), "block long, filter binary").groupBy("block").applyInArrow(_merged, "fp long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are after lower-casing A-Z; null counts as empty. The row with the
    largest id stays (null ids are smallest); of rows repeated under that id exactly one is marked kept. Empty and very long texts are
    texts like others. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    rows = text_rows(docs, id_col, text_col)
    narrow = materialise(rows.mapInArrow(_digests, "doc_id long, row_no long, fp long, sha binary"), "digests")
    repeated = materialise(repeated_fingerprints(narrow, narrow.count()), "repeated")
    verified = (
        rows.select("text").mapInArrow(_texts, "fp long, folded binary").join(repeated, "fp", "left_semi")
        .groupBy("fp", "folded").agg(F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1").select(F.unhex(F.sha2("folded", 256)).alias("sha"), "group_size")
    )
    stays = (
        narrow.join(repeated, "fp", "left_semi").groupBy("sha")
        .agg(F.max(F.struct("doc_id", (-F.col("row_no")).alias("back"))).alias("top"))
        .select("sha", F.col("top.doc_id").alias("keep_id"), (-F.col("top.back")).alias("keep_row"))
    )
    groups = materialise(verified.join(stays, "sha"), "groups")
    own = F.col("group_size").isNull()
    return narrow.join(groups, "sha", "left").select(
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (own | (F.col("row_no") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all columns unchanged.

    Rows leave by id. Ids under which some rows stay and others go (ids that repeat) are settled by their texts' digest, and one row of each is kept.
    """
    from ._base import without

    verdict = materialise(exact_dedup(docs, id_col, text_col), "verdict")
    gone, stay = verdict.where("not kept").select("doc_id").distinct(), verdict.where("kept").select("doc_id", "text_sha256")
    both = materialise(gone.join(stay.select(F.col("doc_id").alias("d")).distinct(), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi"), "both")
    out = without(docs, gone, id_col)
    if both.isEmpty():
        return out
    folded = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    odd = docs.join(both.select(F.col("doc_id").alias("__id")), docs[id_col].eqNullSafe(F.col("__id")), "left_semi").withColumn("__sha", F.sha2(folded.cast("binary"), 256))
    odd = odd.join(stay.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__s")).distinct(), docs[id_col].eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__s")), "left_semi")
    return out.unionByName(odd.dropDuplicates([id_col, "__sha"]).drop("__sha"))
