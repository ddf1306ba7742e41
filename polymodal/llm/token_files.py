"""Token ids in Arrow files of fixed-size-list batches.

A shard is an Arrow IPC file whose rows are sequences of ``length`` ids (uint16 where the vocabulary allows, else uint32) and the mask of those that are
real; only a shard's last row is padded. Rows have one size, so any range of tokens is an address: readers map the file and get
views without copying: arrays of ids, and of masks the bits as Arrow holds them. Beside each shard lies an index (doc_id, start in the shard, n_tokens). Documents are dealt to shards by range of doc_id, so
shards in order are all documents in order. A shard and its index carry the name of the attempt that wrote them, and the manifest, which only
successful attempts enter, says which belong together: what a lost or repeated attempt leaves behind is never read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import coder, materialise, shared_folder, sliced, text_rows

LENGTH = 2048
BATCH = 64


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class TokenWriter:
    """Appends ids to a file, BATCH rows of ``length`` at a time."""

    def __init__(self, sink, length: int, wide: bool):
        kind = pa.uint32() if wide else pa.uint16()
        self.dtype, self.length, self.buffer, self.held = np.dtype("<u4" if wide else "<u2"), length, [], 0
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = ipc.new_file(sink, self.schema)
        self.total = 0

    def append(self, ids: np.ndarray) -> None:
        if self.dtype.itemsize == 2 and len(ids) and int(ids.max()) > 0xFFFF:
            raise ValueError("an id does not fit 16 bits")
        self.buffer.append(ids.astype(self.dtype))
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.length * BATCH:
            flat = np.concatenate(self.buffer)
            whole = len(flat) // (self.length * BATCH) * self.length * BATCH
            for at in range(0, whole, self.length * BATCH):
                self._rows(flat[at : at + self.length * BATCH], self.length * BATCH)
            self.buffer, self.held = [flat[whole:]], len(flat) - whole

    def _rows(self, flat: np.ndarray, real: int) -> None:
        mask = np.zeros(len(flat), bool)
        mask[:real] = True
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate([np.zeros(0, self.dtype), *self.buffer])
        if len(flat):
            rows = -(-len(flat) // self.length)
            self._rows(np.concatenate([flat, np.zeros(rows * self.length - len(flat), self.dtype)]), len(flat))
        self.out.close()


class TokenFile:
    """Random access to a shard: tokens() of any range, sequence() and mask() of any row. Within a batch these are views of the mapped file, masks as Arrow's bits."""

    def __init__(self, uri: str):
        from pyarrow import fs

        where, path = _fs(uri)
        self.source = pa.memory_map(path) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(path)
        self.file = ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self._at, self._batch = -1, None

    def _get(self, k: int) -> pa.RecordBatch:
        if k != self._at:
            self._at, self._batch = k, self.file.get_batch(k)
        return self._batch

    def sequence(self, row: int) -> np.ndarray:
        return self.tokens(row * self.length, self.length)

    def mask(self, row: int) -> pa.BooleanArray:
        """A view of the mapped bits."""
        return self._get(row // BATCH).column("mask").flatten().slice(row % BATCH * self.length, self.length)

    def tokens(self, start: int, n: int) -> np.ndarray:
        size, out = self.length * BATCH, []
        while n > 0:
            k, at = divmod(start, size)
            flat = self._get(k).column("ids").flatten().to_numpy(zero_copy_only=True)
            out.append(flat[at : at + n])
            start, n = start + len(out[-1]), n - len(out[-1])
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def _write(folder: str, path: str, end_id: int, length: int):
    def run(batches):
        task = TaskContext.get()
        shard = task.partitionId()
        name = f"{shard:06d}-{task.taskAttemptId()}"
        where, top = _fs(folder)
        where.create_dir(top, recursive=True)
        sink = index = writer = None
        end = np.array([end_id], np.uint32)
        try:
            for batch in batches:
                for part in sliced(batch, 1):
                    if writer is None:
                        wide = max(coder(path).tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id) > 0xFFFF
                        sink, place = where.open_output_stream(f"{top}/shard-{name}.arrow"), where.open_output_stream(f"{top}/index-{name}.arrow")
                        writer, index = TokenWriter(sink, length, wide), ipc.new_file(place, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
                    starts, sizes = [], []
                    for raw in coder(path)([x or "" for x in part.column(1).to_pylist()]):
                        ids = np.concatenate([np.frombuffer(raw, "<u4"), end])
                        starts.append(writer.total)
                        sizes.append(len(ids))
                        writer.append(ids)
                    index.write_batch(pa.RecordBatch.from_arrays([part.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "start", "n_tokens"]))
        finally:
            if writer is not None:
                writer.close()
                index.close()
                sink.close()
                place.close()
        if writer is not None:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([writer.total], pa.int64())], names=["shard", "name", "n_tokens"])

    return run


def write_token_files(docs: DataFrame, path: str, end_id: int = 1, length: int = LENGTH, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, list[tuple[str, int]]]:
    """Writes all documents in ascending id order (null ids first; equal ids by a hash of the text, then the text); returns the folder and its shards as (name, tokens), in order.

    Null texts are empty, so each row has its end id at least; repeated rows are written as often as they occur, very long texts whole. An empty table gives no shard. Other
    columns are ignored, whatever their names.
    folder is a URI that pyarrow opens and all executors share; by default a new one below spark.checkpoint.dir.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens"
    if "://" not in folder:
        folder = f"file://{folder.removeprefix('file:')}"
    rows = text_rows(docs, id_col, text_col)
    turn = F.xxhash64("text")  # rows under one id, or none, spread over shards too
    dealt = rows.withColumn("turn", turn).repartitionByRange("doc_id", "turn").sortWithinPartitions("doc_id", "turn", "text").drop("turn")
    done = materialise(dealt.mapInArrow(_write(folder, path, end_id, length), "shard int, name string, n_tokens long"), "manifest")
    return folder, [(r["name"], r["n_tokens"]) for r in done.orderBy("shard").collect()]  # a row a shard


def _read(folder: str, shards: list[tuple[str, int]]):
    base = np.concatenate([[0], np.cumsum([n for _, n in shards])]).tolist()

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                name = shards[k][0]
                tokens, (where, top) = TokenFile(f"{folder}/shard-{name}.arrow"), _fs(folder)
                with where.open_input_file(f"{top}/index-{name}.arrow") as f:
                    index = ipc.open_file(f)
                    for i in range(index.num_record_batches):
                        part = index.get_batch(i)
                        starts = part.column("start").to_pylist()
                        crc = [zlib.crc32(tokens.tokens(s, n).astype("<u4").tobytes()) for s, n in zip(starts, part.column("n_tokens").to_pylist())]
                        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(starts, np.int64) + base[k]), part.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_files(spark, folder: str, shards: list[tuple[str, int]]) -> DataFrame:
    """Per document, from the files alone: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32."""
    n = len(shards)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(_read(folder, shards), "doc_id long, start long, n_tokens long, ids_crc32 long")
