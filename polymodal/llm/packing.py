"""Best-fit packing in residual rounds.

Every partition tokenises its documents and packs their pieces best-fit, longest first. Full and nearly full bins leave at once;
underfull bins become the items of the next round, in which a tree merges FAN_IN partitions into one, until the bins left fit
PER_TASK a task. Bins travel as rows (length, members), so no round joins anything, and each round is
written to the shared folder, so a lost executor repeats one round's task only.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import coder, materialise, sliced, text_rows

CAPACITY = 2048
FAN_IN = 16
PER_TASK = 200_000
_MEMBER = "array<struct<doc_id:long,piece:int,start:long,length:int,ids_crc32:long,offset:int,ids:binary>>"
_SCHEMA = f"done boolean, length int, sequence_id long, members {_MEMBER}"


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of places. Longest first; an item goes to the open bin in which it leaves least room. A bit set of the rooms in use finds it at once."""
    order = np.argsort(-np.asarray(lengths), kind="stable").tolist()
    size, open_at, rooms, bins = np.asarray(lengths).tolist(), {}, 0, []
    for i in order:
        s = size[i]
        above = rooms >> s
        if above:
            room = s + (above & -above).bit_length() - 1
            stack = open_at[room]
            k = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        left = room - s
        if left:
            open_at.setdefault(left, []).append(k)
            rooms |= 1 << left
    return bins


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n tokens: only longer ones are cut, the first piece taking the remainder."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


class _Members:
    """Columns of pieces; bins are lists of rows of them."""

    def __init__(self, cols: list, ids: list | None):
        self.doc, self.null, self.piece, self.start, self.length, self.crc = (np.asarray(x) for x in cols)
        self.ids = ids

    def batch(self, order: np.ndarray, sizes: np.ndarray, done: np.ndarray, sequence: np.ndarray) -> pa.RecordBatch:
        """Rows (bins) of consecutive members: order holds the members' places, sizes how many each bin has."""
        edge = np.concatenate([[0], np.cumsum(sizes)])
        n = self.length[order]
        ends = np.concatenate([[0], np.cumsum(n)])
        offset = ends[:-1] - np.repeat(ends[edge[:-1]], sizes)
        ids = [self.ids[i] for i in order.tolist()] if self.ids is not None else [None] * len(order)
        member = pa.StructArray.from_arrays(
            [pa.array(self.doc[order], pa.int64(), mask=self.null[order].astype(bool)), pa.array(self.piece[order], pa.int32()), pa.array(self.start[order], pa.int64()), pa.array(n, pa.int32()), pa.array(self.crc[order], pa.int64()), pa.array(offset, pa.int32()), pa.array(ids, pa.binary())],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "offset", "ids"],
        )
        return pa.RecordBatch.from_arrays([pa.array(done), pa.array(ends[edge[1:]] - ends[edge[:-1]], pa.int32()), pa.array(sequence, pa.int64()), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), member)], names=["done", "length", "sequence_id", "members"])


def _bins(members: _Members, lengths: np.ndarray, rows: list[np.ndarray] | None, capacity: int, nearly: int, last: bool, base: int):
    """Packs items (rows: their members' places; None: the members are the items) and yields batches of bins, nearly full ones or all as done."""
    bins = best_fit(lengths, capacity)
    for at in range(0, len(bins), 4096):
        part = bins[at : at + 4096]
        if rows is None:
            order, sizes = np.concatenate([np.array(b, np.int64) for b in part]), np.array([len(b) for b in part])
        else:
            own = [np.concatenate([rows[i] for i in b]) for b in part]
            order, sizes = np.concatenate(own), np.array([len(x) for x in own])
        fill = np.array([int(lengths[b].sum()) for b in part])
        yield members.batch(order, sizes, np.ones(len(part), bool) if last else fill >= nearly, base + np.arange(at, at + len(part)))


def _first_round(path: str, end_id: int, capacity: int, nearly: int, keep_ids: bool):
    def run(batches):
        base, given = TaskContext.get().partitionId() << 32, 0
        cols: list[list] = [[] for _ in range(6)]
        kept: list | None = [] if keep_ids else None
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in sliced(batch, 1):
                coded = coder(path)([x or "" for x in part.column(1).to_pylist()])
                full: list[list] = [[] for _ in range(6)]
                full_ids: list | None = [] if keep_ids else None
                for doc, raw in zip(part.column(0).to_pylist(), coded):
                    raw += end
                    for k, (start, n) in enumerate(pieces(len(raw) // 4, capacity)):
                        own = raw[4 * start : 4 * (start + n)]
                        to, to_ids = (full, full_ids) if n == capacity else (cols, kept)
                        for c, x in zip(to, (doc or 0, doc is None, k, start, n, zlib.crc32(own))):
                            c.append(x)
                        if keep_ids:
                            to_ids.append(own)
                if n_full := len(full[0]):  # a sequence of their own
                    yield _Members(full, full_ids).batch(np.arange(n_full), np.ones(n_full, int), np.ones(n_full, bool), base + given + np.arange(n_full))
                    given += n_full
        if cols[0]:
            m = _Members(cols, kept)
            yield from _bins(m, m.length, None, capacity, nearly, False, base + given)

    return run


def _next_round(number: int, capacity: int, nearly: int, last: bool):
    def run(batches):
        base = number << 56 | TaskContext.get().partitionId() << 32
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        col = pa.chunked_array([b.column(1) for b in got]).combine_chunks()
        flat, edge = col.flatten(), np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))])
        f = {n: flat.field(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
        ids = flat.field("ids")
        numbers = lambda n: f[n].fill_null(0).to_numpy(zero_copy_only=False)
        m = _Members([numbers("doc_id"), f["doc_id"].is_null().to_numpy(zero_copy_only=False), numbers("piece"), numbers("start"), numbers("length"), numbers("ids_crc32")], None if ids.null_count else ids.to_pylist())
        lengths = np.concatenate([np.asarray(b.column(0)) for b in got])
        yield from _bins(m, lengths, [np.arange(a, b) for a, b in zip(edge, edge[1:])], capacity, nearly, last, base)

    return run


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian uint32, if keep_ids).

    A document is its whole text's ids and end_id; null texts are empty, so every row gives a piece at least. Rows that repeat, ids too, are
    documents of their own; a null id stays null. Sequences are gapless and hold at most capacity tokens. Very long texts are encoded whole and cut into
    pieces; other columns are ignored, whatever their names. An empty table gives no rows.
    """
    if not 2 <= capacity <= 1 << 20:
        raise ValueError("capacity must be in 2..2**20")
    nearly = capacity - capacity // 256
    rows = text_rows(docs, id_col, text_col)
    level = materialise(rows.mapInArrow(_first_round(path, end_id, capacity, nearly, keep_ids), _SCHEMA), "round0")
    parts = max(1, len(level.inputFiles()))
    levels, number = [level], 0
    while left := levels[-1].where("not done").count():
        number += 1
        least = math.ceil(left / PER_TASK)
        parts = max(least, math.ceil(parts / FAN_IN))
        step = levels[-1].where("not done").select("length", "members").repartition(parts).mapInArrow(_next_round(number, capacity, nearly, parts == least), _SCHEMA)
        levels.append(materialise(step, f"round{number}"))
    done = levels[0]
    for x in levels[1:]:
        done = done.union(x)
    m = F.col("m")
    cols = ["doc_id", "piece", F.col("start"), F.col("length").cast("long").alias("length"), "ids_crc32"]
    out = done.where("done").select("sequence_id", F.explode("members").alias("m")).select(*(m[c].alias(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "offset", "ids")), "sequence_id")
    return out.select(*cols, "sequence_id", F.col("offset").cast("long").alias("offset"), *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences of pack(keep_ids=True): sequence_id, ids (little-endian uint32) and how many tokens they are; a sequence's rows are few, as it holds at most capacity tokens."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(own.alias("p"), F.sum("length").alias("n_tokens")).select("sequence_id", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"), "n_tokens")
