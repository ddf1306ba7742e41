"""Helpers shared by the operators of this subpackage: shared-folder tables, kept rows, tokenizers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every byte that separates words under the pattern ``[^\x20\x09-\x0D]+``; ``bytes.split()`` cuts at exactly these.
ASCII_SPACE = b" \t\n\x0b\x0c\r"

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only where that setting is absent (tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='polymodal-')}"
        spark.sparkContext.setCheckpointDir(top)
    path = f"{top.rstrip('/')}/polymodal-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage is cut, and its size is known to the planner."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_written() -> None:
    for path, spark in _written.items():
        try:
            jvm = spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001  the JVM has gone; the folder is temporary anyway
            return


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of its session bounded by bytes (4 MB, where the caller has set no smaller bound), not only by rows: long texts stay few in Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = re.fullmatch(r"(\d+)b?", df.sparkSession.conf.get(name) or "")
    if not given or not 0 < int(given[1]) <= 4 << 20:
        df.sparkSession.conf.set(name, 4 << 20)
    return df


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of all rows, for Arrow functions."""
    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs less the rows whose id is in dropped (one column of ids, null-safe)."""
    gone = dropped.select(F.col(dropped.columns[0]).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__gone"]), "left_anti")


_caches: dict[str, list] = {}
_owner: list[str] = []


def remembers(name: str, *caches) -> None:
    """Says that an operator's functions keep these dicts in a worker from task to task."""
    _caches.setdefault(name, []).extend(caches)


def only(name: str) -> None:
    """At the start of an operator's function in a worker: what other operators remembered there goes, so a pipeline's memory is that of its largest stage."""
    if _owner != [name]:
        _owner[:] = [name]
        for other, caches in _caches.items():
            if other != name:
                for c in caches:
                    c.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Unicode White_Space, where both public pre-tokenizers always start a new piece.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: A run of letters before an ASCII character that is no letter, or at the end: pre-tokenizers cut there, and no normalisation joins the two.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+(?=[\\x00-@\\[-`{-\\x7f]|\\Z)"
_SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))


class WordIds(dict):
    """Word -> 64-bit id, remembered a worker."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, w: bytes) -> int:
        v = xxhash.xxh64_intdigest(w)
        if len(self) < self.most and len(w) <= 64:
            self[w] = v
        return v

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def folded_words(text: str | None) -> list[bytes]:
    """Words between ASCII space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed_runs(ids: np.ndarray, k: int) -> np.ndarray:
    """64-bit marks of all runs of k ids."""
    n = max(len(ids) - k + 1, 0)
    h = np.full(n, k, np.uint64)
    for i in range(k if n else 0):
        h = (h ^ ids[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class TokenCoder:
    """Whole texts to ids (bytes of little-endian uint32) by a ``tokenizers`` file, remembering short chunks.

    Chunks are a run of white space with the word after it (byte-level pre-tokenizer with its own pattern), or
    words alone (pre-tokenizers that drop white space), words being cut after their leading letters too. Neither pattern ever matches across such
    a cut, so a text's ids are its chunks' ids in a row. Any other pre-tokenizer gets whole texts, and so do texts that hold an added token's string, for
    which the library gives its id; with ``plain`` such strings are ordinary text.
    """

    REMEMBERED = 400_000
    LONGEST = 48

    def __init__(self, path: str, plain: bool = False):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE).search if added else None
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(self.tokenizer.to_str())
        before, normal = spec["pre_tokenizer"] or {}, spec["normalizer"]
        pattern = before.get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex", "")
        if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and normal is None:
            self.cut = re.compile(f"[{_WS}]*{_LETTERS}|[{_WS}]*[^{_WS}]+|[{_WS}]+").findall
        elif before.get("type") == "Sequence" and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and before["pretokenizers"][0]["invert"]:
            self.cut = re.compile(f"{_LETTERS}|[^{_WS}]+").findall
        else:
            self.cut = None
        self.spaced = None
        if before.get("type") == "ByteLevel" and self.cut is not None:
            vocab = self.tokenizer.get_vocab(with_added_tokens=False)
            self.spaced = np.zeros(max(vocab.values()) + 1, bool)
            self.spaced[[i for x, i in vocab.items() if x[0] == "\u0120"]] = True  # how this vocabulary writes a space
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.cut is None:
            return self._whole(texts)
        odd = [i for i, x in enumerate(texts) if self.added(x)] if self.added else []
        if odd:
            rest = self([x for x in texts if not self.added(x)])
            for i, x in zip(odd, self._whole([texts[i] for i in odd])):
                rest.insert(i, x)
            return rest
        chunks, known = [self.cut(x) for x in texts], self.known
        new = list(set().union(*chunks).difference(known))
        if new:
            known.update(self._encode(new))
        out = [b"".join(map(known.__getitem__, ws)) for ws in chunks]
        if len(known) > self.REMEMBERED:  # what came last goes; the first seen are mostly the frequent ones
            for w in new[-(len(known) - self.REMEMBERED) :]:
                del known[w]
        for w in new:
            if len(w) > self.LONGEST:
                known.pop(w, None)
        return out

    def _encode(self, new: list[str]) -> dict[str, bytes]:
        out = {}
        if self.spaced is not None:  # " word" chunks in a row are a text; each begins at its own space
            plain, rest = [], []
            for w in new:
                (plain if w[0] == " " and len(w) > 1 and w[1] not in _SPACES else rest).append(w)
            for first in range(0, len(plain), 4096):
                rows = [plain[at : at + 64] for at in range(first, min(first + 4096, len(plain)), 64)]
                for row, e in zip(rows, self.tokenizer.encode_batch_fast(["".join(row) for row in rows], add_special_tokens=False)):
                    ids = np.array(e.ids, "<u4")
                    raw, cut = ids.tobytes(), (4 * np.flatnonzero(self.spaced[ids])).tolist()
                    for w, p, q in zip(row, cut, [*cut[1:], len(raw)]):
                        out[w] = raw[p:q]
            new = rest
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            e = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            raw = np.array(e.ids, "<u4").tobytes()
            ends = (4 * np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(part) + 1))).tolist()
            for w, p, q in zip(part, ends, ends[1:]):
                out[w] = raw[p:q]
        return out


_coders: dict[str, TokenCoder] = {}
remembers("tokens", _coders)


def coder(path: str) -> TokenCoder:
    """One coder a worker process and file."""
    if path not in _coders:
        only("tokens")
        _coders[path] = TokenCoder(path)
    return _coders[path]


def sliced(batch, column: int, most: int = 1 << 20):
    """Slices of an Arrow batch with at most about ``most`` bytes of the text column each, so one batch of long texts stays small in Python."""
    import pyarrow.compute as pc

    n = batch.num_rows
    if batch.nbytes <= most:
        if n:
            yield batch
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    part, first = np.cumsum(size) // most, 0
    for last in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), n]:
        if last > first:
            yield batch.slice(first, last - first)
        first = last
