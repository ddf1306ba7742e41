"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text answers longest-match queries. A whole text (its runs of letters, lower-cased, a space around
each) is cut greedily into phrases that each occur in that language's text, longest first and at the latest after every BLOCK letters. A phrase costs as many bits as name a place in the automaton's text,
so languages learnt from little text compare with others; a letter that never occurs costs UNSEEN bits more. Bits a letter are the
cross-entropy, and the language in which they are fewest wins.
"""

from __future__ import annotations

import math
import re

import numpy as np
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import bounded_batches, only, remembers, sliced

#: Bounds of the sample a model learns from: passages a language, drawn from all passages of all its labelled texts, and characters of a passage.
PASSAGES, PASSAGE = 100, 1000
#: Bits of a letter that a language's text doesn't have, besides those of a phrase.
UNSEEN = 16.0
#: A text is rejected if the best language's bits are more than those of a plain code of its letters, by more than SLACK bits.
SLACK = 256.0
#: Letters after which a phrase ends at the latest, and blocks of letters that are followed side by side.
BLOCK, LANES = 1024, 4096
_words = re.compile(r"[^\W\d_]+").findall


class SuffixAutomaton:
    """Every substring of a text, in linear space: per state a dict of its transitions, letter to state; state 0 is the root."""

    def __init__(self, text: str):
        states, link, length, last = [{}], [-1], [0], 0
        for c in text:
            cur = len(states)
            states.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in states[p]:
                states[p][c] = cur
                p = link[p]
            if p >= 0:
                q = states[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    twin = len(states)
                    states.append(dict(states[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and states[p].get(c) == q:
                        states[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        self.states = states

    def longest(self, text: str) -> int:
        """Length of the longest prefix that occurs."""
        state = 0
        for n, c in enumerate(text):
            state = self.states[state].get(c)
            if state is None:
                return n
        return len(text)


class Transitions:
    """An automaton's transitions in a cuckoo table, so each is in one of two places and many texts follow them side by side. An entry is state, letter and next state in one integer."""

    _ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
    _LETTER, _TO = 17, 23

    def __init__(self, automaton: SuffixAutomaton, place: dict[str, int]):
        if len(automaton.states) >= 1 << self._TO or len(place) >= 1 << self._LETTER:
            raise ValueError("the sample is too large for a table")
        entries = np.fromiter(((k << self._LETTER | place[c]) << self._TO | to for k, own in enumerate(automaton.states) for c, to in own.items()), np.int64)
        bits = max(4, (len(entries) * 6 // 5).bit_length())
        while not self._fill(entries, bits):
            bits += 1

    def _fill(self, entries: np.ndarray, bits: int) -> bool:
        self.shift, self.table = np.uint64(64 - bits), np.full((2, 1 << bits), -1, np.int64)
        side = np.zeros(len(entries), np.int64)
        for _ in range(100):  # who comes to a taken place sends its holder to the holder's other place
            if not len(entries):
                return True
            slot = self._slot(entries >> self._TO, side)
            _, one = np.unique(side << bits | slot, return_index=True)
            left = np.ones(len(entries), bool)
            left[one] = False
            sent = self.table[side[one], slot[one]]
            self.table[side[one], slot[one]] = entries[one]
            entries, side = np.concatenate([entries[left], sent[sent >= 0]]), 1 - np.concatenate([side[left], side[one][sent >= 0]])
        return False

    def _slot(self, keys: np.ndarray, side) -> np.ndarray:
        odd = self._ODD[side] if isinstance(side, int) else np.array(self._ODD)[side]
        return (((keys ^ keys >> 15).view(np.uint64) * odd) >> self.shift).view(np.int64)

    def follow(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is none."""
        key = state << self._LETTER | letter
        held = self.table[0].take(self._slot(key, 0))
        out = held & ((1 << self._TO) - 1)
        other = np.flatnonzero(held >> self._TO != key)
        key = key[other]
        held = self.table[1].take(self._slot(key, 1))
        out[other] = np.where(held >> self._TO == key, held & ((1 << self._TO) - 1), -1)
        return out


def _parse(table: Transitions, letters: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """letters [place, lane], lanes by falling size -> a lane's phrases, and those that are letters the language doesn't have."""
    state, phrases, unseen = (np.zeros(len(size), np.int64) for _ in range(3))
    live = np.searchsorted(-size, -np.arange(len(letters)), side="left")  # lanes longer than each place
    for row, n in zip(letters, live.tolist()):
        now = table.follow(state[:n], row[:n])
        ends = np.flatnonzero(now < 0)
        if len(ends):
            inside = ends[state[ends] > 0]  # their phrase ends here, and the letter begins another
            phrases[inside] += 1
            now[inside] = table.follow(np.zeros(len(inside), np.int64), row[inside])
            lost = ends[now[ends] < 0]
            phrases[lost] += 1
            unseen[lost] += 1
            now[lost] = 0
        state[:n] = now
    return phrases + (state > 0), unseen


def letters_of(text: str) -> str:
    """What models see of a text: its runs of letters, lower-cased, a space around each; empty without a letter."""
    words = _words(text.lower())
    return f" {' '.join(words)} " if words else ""


class CrossParser:
    """Cross-entropies of texts in several languages."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.place = {c: k for k, c in enumerate(sorted(set().union(*samples.values())), 1)}
        self.costs = [math.log2(len(samples[x]) + 1) for x in self.langs]
        self.tables = [Transitions(SuffixAutomaton(samples[x]), self.place) for x in self.langs]  # one automaton at a time
        self.plain = math.log2(len(self.place) + 1)
        self.letter = np.zeros(ord(max(self.place, default=" ")) + 2, np.int64)
        self.letter[[ord(c) for c in self.place]] = list(self.place.values())

    def bits(self, texts: list[str]) -> np.ndarray:
        """[language, text]: bits of the phrases of each text; a phrase ends after BLOCK letters of a text at the latest, and blocks are followed side by side."""
        blocks = [(i, x[at : at + BLOCK]) for i, x in enumerate(texts) for at in range(0, len(x), BLOCK)]
        blocks.sort(key=lambda b: -len(b[1]))
        out = np.zeros((len(self.langs), len(texts)))
        for first in range(0, len(blocks), LANES):
            part = blocks[first : first + LANES]
            size = np.array([len(b) for _, b in part])
            code = np.frombuffer("".join(b for _, b in part).encode("utf-32-le", "surrogatepass"), "<u4")
            letters = np.zeros((size[0], len(part)), np.int64)
            letters[np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size), np.repeat(np.arange(len(part)), size)] = self.letter[np.minimum(code, len(self.letter) - 1)]
            for own, table, cost in zip(out, self.tables, self.costs):
                phrases, unseen = _parse(table, letters, size)
                np.add.at(own, [i for i, _ in part], phrases * cost + unseen * UNSEEN)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Of each text its language, score, and whether it is in that language at all."""
        letters = [letters_of(x) if x and self.langs else "" for x in texts]
        some = [i for i, x in enumerate(letters) if x]
        out: list[tuple[str, float, bool]] = [("und", 0.0, False)] * len(texts)
        if some:
            bits = self.bits([letters[i] for i in some])
            order = np.argsort(bits, axis=0, kind="stable")[:2]
            each = np.arange(len(some))
            best = bits[order[0], each]
            score = 1 - best / bits[order[1], each] if len(self.langs) > 1 else np.ones(len(some))
            for i, k, s, b in zip(some, order[0].tolist(), score.tolist(), best.tolist()):
                out[i] = self.langs[k], s, b <= self.plain * len(letters[i]) + SLACK
        return out


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_samples(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id", passages: int = PASSAGES) -> dict[str, str]:
    """A bounded sample of all labelled text: of each language the ``passages`` first by hash, out of all passages of PASSAGE characters that its texts fall into.

    Every language with a letter in some passage is learnt; those with few passages keep them all.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(order_col).alias("id"))
    each = F.ceil(F.length("text") / PASSAGE)
    counts = rows.groupBy("lang").agg(F.sum(each).alias("n")).collect()  # a row a language
    if not counts:
        return {}
    # of each language only hashes below a bar that some 8 * passages pass reach the window, so its tasks stay as small at any size
    bar = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1 << 32, (8 * passages << 32) // r["n"] + 1))))
    cut = rows.select("lang", "text", "id", F.explode(F.sequence(F.lit(0).cast("long"), each - 1)).alias("k")).withColumn("h", F.xxhash64("id", "k", F.lit(7)))
    cut = cut.where(F.shiftrightunsigned("h", 32) < bar[F.col("lang")]).select("lang", "h", "k", F.substring("text", F.col("k").cast("int") * PASSAGE + 1, F.lit(PASSAGE)).alias("passage"))
    cut = cut.where(F.col("passage").rlike(r"\p{L}"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h", "k", "passage"))
    texts: dict[str, list[str]] = {}
    for r in cut.withColumn("turn", turn).where(F.col("turn") <= passages).orderBy("lang", "turn").collect():  # bounded a language
        texts.setdefault(r["lang"], []).append(letters_of(r["passage"]))
    return {k: "".join(v) for k, v in texts.items()}


_parsers: dict[int, CrossParser] = {}
remembers("language", _parsers)


def _predict(samples: dict[str, str]):
    mark = hash(tuple(sorted(samples.items())))

    def run(batches):
        only("language")
        if mark not in _parsers:
            _parsers.clear()
            _parsers[mark] = CrossParser(samples)
        model = _parsers[mark]
        for batch in batches:
            got = [x for part in sliced(batch, 0, 4 << 20) for x in model.predict(part.column(0).to_pylist())]
            lang, score, fits = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1, batch.num_columns)), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(fits, pa.bool_())], names=[*batch.schema.names[1:], "lang_pred", "score", "fits"])

    return run


def identify(docs: DataFrame, samples: dict[str, str], text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Of every row a struct ``row`` of the carried columns (default: all), with lang_pred, score and fits beside it.

    Texts that are null or have no letter are ``und`` with score 0. The score is one less the best language's bits over the second best's, so a tie scores 0;
    with one language it is 1. Ties go to the first language by name. fits is false for und and for texts whose cross-parsing costs over SLACK bits more
    than a plain code of their letters would: they are in no learnt language. Very long texts are parsed whole. Repeated rows each give a row; carried columns may have any names.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)))
    given = bounded_batches(docs).select(F.col(f"`{text_col}`").cast("string").alias("text"), row.alias("row"))
    kind = T.StructType([given.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fits", T.BooleanType())])
    return given.mapInArrow(_predict(samples), kind)


def identify_with_own_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score; learnt from rows that are not held out and have a label. Without any label every text is und."""
    samples = training_samples(docs.where(~held_out(id_col)), text_col, lang_col, id_col)
    out = identify(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), samples, carry=["doc_id"])
    return out.select("row.doc_id", "lang_pred", "score").select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows that cross-parsing rejects: und, or in no learnt language (see identify); all columns unchanged. Without any label only texts without a letter go."""
    samples = training_samples(docs.where(~held_out(id_col)), text_col, lang_col, id_col)
    if not samples:
        return docs.where(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    return identify(docs, samples, text_col).where("fits").select("row.*")
