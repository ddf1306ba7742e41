"""Cross-entropy difference of matched target and background n-gram models.

Both are bigram models with the same order and smoothing over one vocabulary: all distinct words of the corpus, and one for any other. Words, words as context and pairs of words are
counted under 64-bit keys of their own, so the models grow with the corpus and are never in one place: documents are dealt to blocks of about BLOCK bytes, each block sends its distinct keys with its
counts to as many buckets, ranges of keys, and gets the sums over all blocks back. Counts cover every document. The background's counts are scaled to as many tokens as the
target has. A document is scored without its own counts, in both models.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import WordIds, folded_words, only, remembers, text_rows

#: Counts that the unigram model weighs in the bigram model, and that each word of the shared vocabulary has beforehand.
BACK_OFF, BEFOREHAND = 8.0, 0.01
#: Bytes of text of a block of documents.
BLOCK = 8 << 20
_START = 0
#: Words, words as context and pairs are told apart by their keys' lowest bits.
_WORD, _CONTEXT, _PAIR = np.uint64(0), np.uint64(1), np.uint64(2)
_KINDS = ~np.uint64(3)
#: The key under which all words are counted together.
_TOTAL = np.uint64(7)
_ids = WordIds()
remembers("lm", _ids)


def tokens(text: str | None) -> np.ndarray:
    return _ids.of(folded_words(text))


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def cells(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(previous ids, keys) of a text's bigrams, the first after the start mark."""
    before = np.concatenate([np.array([_START], np.uint64), ids[:-1]])
    return before, _spread(_spread(before) * np.uint64(0x9E3779B97F4A7C15) ^ ids)


def _keys(texts: list[np.ndarray]) -> np.ndarray:
    """Keys of the words, of the words as context and of the pairs of each text in turn, and last the key of all words."""
    out = []
    for ids in texts:
        before, pair = cells(ids)
        out += [ids & _KINDS | _WORD, _spread(before) & _KINDS | _CONTEXT, pair & _KINDS | _PAIR]
    return np.concatenate([*out, np.array([_TOTAL])])


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where ascending keys are cut into buckets, equal ranges of all keys."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


def _packed(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, deflated."""
    return zlib.compress(x.astype(np.min_scalar_type(int(x.max()))).tobytes(), 1)


def _unpacked(x: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(x)
    return np.frombuffer(raw, f"u{len(raw) // n}").astype(np.int64)


def _folded(keys: np.ndarray) -> bytes:
    """Ascending keys as planes of their gaps' bytes; only the upper three have repeats to deflate."""
    planes = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return planes[:5].tobytes() + zlib.compress(planes[5:].tobytes(), 1)


def _unfolded(x: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(x[: 5 * n] + zlib.decompress(x[5 * n :]), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64)[:, 0], dtype=np.uint64)


def _count(buckets: int):
    def run(key: tuple, docs: pa.Table, targets: pa.Table) -> pa.Table:
        """A block's documents and target ids -> its distinct keys of each bucket, with their counts in all documents and in the target's."""
        only("lm")
        flags = np.isin(docs.column("doc_id").fill_null(0).to_numpy(), targets.column("t").to_numpy()) & docs.column("doc_id").is_valid().to_numpy()
        texts = [tokens(x.as_py()) for x in docs.column("text")]
        given = [(x, f) for x, f in zip(texts, flags.tolist()) if len(x)]
        schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("background", pa.binary()), ("target", pa.binary())])
        if not given:
            return schema.empty_table()
        keys, background = np.unique(_keys([x for x, _ in given]), return_counts=True)
        target, total = np.zeros(len(keys), np.int64), np.searchsorted(keys, _TOTAL)
        own, n = np.unique(_keys([x for x, f in given if f]), return_counts=True)
        target[np.searchsorted(keys, own)] = n
        for count, each in ((background, [len(x) for x, _ in given]), (target, [len(x) for x, f in given if f])):
            count[total] += sum(each) - 1
        cuts = _cuts(keys, buckets).tolist()
        some = [(k, key[0].as_py(), b - a, _folded(keys[a:b]), _packed(background[a:b]), _packed(target[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)

    return run


def _sum(blocks: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """A bucket's keys from all blocks -> for every block the sums of its keys, in its order, and how many distinct words the bucket has."""
        asked = [_unfolded(x, n) for x, n in zip(table.column("keys").to_pylist(), table.column("n").to_pylist())]
        cuts = np.cumsum([len(x) for x in asked])[:-1]
        keys, place = np.unique(np.concatenate(asked), return_inverse=True)
        words = int(((keys & ~_KINDS) == _WORD).sum())
        senders = table.column("block").to_pylist()
        rest = sorted(set(range(blocks)).difference(senders))  # they need the number of words all the same
        out = []
        for name in ("background", "target"):
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, place, np.concatenate([_unpacked(x, len(k)) for x, k in zip(table.column(name).to_pylist(), asked)]))
            out.append(pa.array([_packed(x) for x in np.split(sums[place], cuts)] + [None] * len(rest), pa.binary()))
        n = len(senders) + len(rest)
        return pa.table([pa.array([key[0].as_py()] * n, pa.int32()), pa.array(senders + rest, pa.int32()), *out, pa.array([words] * n, pa.int64())], names=["bucket", "block", "background", "target", "words"])

    return run


def _losses(ids: np.ndarray, given: np.ndarray, total: tuple[int, int], vocabulary: int) -> tuple[float | None, float | None, float | None]:
    """Mean loss of a word in nats under the background, under the target, and under the target if the text is part of it; None without a target. given: counts [corpus][kind][place]."""
    if not total[1]:
        return None, None, None
    n, own = len(ids), []
    for x in (ids, *cells(ids)):
        _, place, many = np.unique(x, return_inverse=True, return_counts=True)
        own.append(many[place])
    without = np.maximum(given - np.stack(own), 0)
    size, less = max(total[0] - n, 1), max(total[1] - n, 0)
    return tuple(float(-np.log(probability(c, size_, scale, vocabulary)).mean()) for c, size_, scale in ((without[0], size, total[1] / size), (given[1], total[1], 1.0), (without[1], less, 1.0)))


def probability(counts: np.ndarray, total: float, scale: float, vocabulary: int) -> np.ndarray:
    """Of each word after its context; counts: of the words, of the contexts, of the pairs. Over a vocabulary, all words of the corpus and one for any other, they sum to one."""
    word, context, pair = counts * scale
    p = (word + BEFOREHAND) / (total * scale + BEFOREHAND * vocabulary)
    return (pair + BACK_OFF * p) / (context + BACK_OFF)


def _score(buckets: int):
    def run(key: tuple, docs: pa.Table, sums: pa.Table) -> pa.Table:
        only("lm")
        texts = [tokens(x.as_py()) for x in docs.column("text")]
        keys, place = np.unique(_keys([x for x in texts if len(x)]), return_inverse=True)
        cuts = np.diff(_cuts(keys, buckets))
        vocabulary = 1 + sum(sums.column("words").to_pylist())
        sums = sums.filter(sums.column("background").is_valid()).sort_by("bucket")
        got = []
        if sums.num_rows:
            sizes = [int(cuts[k]) for k in sums.column("bucket").to_pylist()]
            got = np.stack([np.concatenate([_unpacked(x, n) for x, n in zip(sums.column(name).to_pylist(), sizes)]) for name in ("background", "target")])
            total = tuple(got[:, place[-1]].tolist())
        out, at = [], 0
        for ids in texts:
            n = len(ids)
            out.append((n, *(_losses(ids, got[:, place[at : at + 3 * n].reshape(3, n)], total, vocabulary) if n else (None, None, None))))
            at += 3 * n
        kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return pa.table([docs.column("doc_id"), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], names=["doc_id", "n_tokens", "background", "outside", "within"])

    return run


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ce_target, ce_background, score (their difference a word in nats; lower is closer to the target), in_target.

    targets has the ids of the target corpus in its first column; nulls and repeats in it don't matter. Null or word-less texts have 0 tokens and null
    scores, and so has every text if the target has no words. Rows with a null id are never in the target; repeated rows count and are scored as often as they occur.
    """
    ids = targets.select(F.col(targets.columns[0]).cast("long").alias("__t")).where("__t is not null").distinct()
    rows = text_rows(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK) or 1

    def block(c):
        return F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias("block")

    # texts, ids and counts grow with the corpus and meet in shuffles by block or bucket at any size
    dealt = rows.select("doc_id", "text", block(F.coalesce("doc_id", F.xxhash64("text")))).groupBy("block")
    counts = dealt.cogroup(ids.select(F.col("__t").alias("t"), block("__t")).groupBy("block")).applyInArrow(_count(n), "bucket int, block int, n int, keys binary, background binary, target binary")
    sums = counts.groupBy("bucket").applyInArrow(_sum(n), "bucket int, block int, background binary, target binary, words long")
    scored = dealt.cogroup(sums.groupBy("block")).applyInArrow(_score(n), "doc_id long, n_tokens long, background double, outside double, within double")
    out = scored.join(ids, scored["doc_id"] == ids["__t"], "left").withColumn("in_target", F.col("__t").isNotNull())
    target = F.when(F.col("in_target"), F.col("within")).otherwise(F.col("outside"))
    return out.select("doc_id", "n_tokens", target.alias("ce_target"), F.col("background").alias("ce_background"), (target - F.col("background")).alias("score"), "in_target")
