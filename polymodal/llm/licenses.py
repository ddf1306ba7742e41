"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

A template of T shingles is looked for in windows of neighbouring blocks, whose length is a power of two of at most T / 8, so many that any run of
T shingles lies within a window. Bands are of ROWS minima, and as many as it takes for a window that holds at least ``least`` of a template
to share a band with it but for a chance of MISS. All templates share the hash functions: minima are taken over blocks of one shingle, merged to blocks
twice as long again and again, and slid over windows. A window that shares a band is verified exactly: a run of T shingles in it must hold
at least ``least`` of the template's distinct shingles.
"""

from __future__ import annotations

import math
from collections import defaultdict
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import WordIds, mixed_runs, only, remembers, sliced, text_rows

SHINGLE, LEAST, MISS, ROWS = 5, 0.8, 1e-4, 2
#: Words of texts that go through the bands together, so that arrays stay in a core's cache.
GROUP = 1 << 15
PAD = 8
#: Blocks of windows of templates with 8 to 16 blocks of their own: each has the next of these.
WINDOWS = (10, 12, 14, 17)

#: One-line notices by which works name their licence; whole licences and their longer notices are files in license_texts.
NOTICES: dict[str, str] = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0-line": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC0-1.0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
#: ASCII letters and digits stay (A-Z lower-cased), other ASCII becomes a space; bytes of other characters stay.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
_ids = WordIds()


def templates() -> dict[str, str]:
    """The notices and all files of license_texts, by name."""
    texts = resources.files(__package__) / "license_texts"
    return NOTICES | {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in texts.iterdir() if f.name.endswith(".txt")}


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split() if text else []


def shingles(ws: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """Marks of all runs of k words (of the whole text, if it has fewer; none, if it has no word)."""
    return mixed_runs(_ids.of(ws), min(k, len(ws))) if ws else np.zeros(0, np.uint64)


def bands_for(jaccard: float, miss: float = MISS, rows: int = ROWS) -> int:
    """Bands of ``rows`` rows for which sets of at least that similarity share none with a chance of at most ``miss``."""
    return 1 if jaccard >= 1 else math.ceil(math.log(miss) / math.log1p(-(jaccard**rows)))


def shape(n: int) -> tuple[int, int]:
    """(length of a block, blocks of a window) for a template of n shingles."""
    block = 1 << max(0, (n // 8).bit_length() - 1)
    blocks = -(-(n - 1) // block) + 1
    return block, blocks if block == 1 else next(w for w in WINDOWS if w >= blocks)


class Template:
    def __init__(self, name: str, marks: np.ndarray, least: float):
        self.name, self.run, self.marks = name, len(marks), np.unique(marks)
        self.block, self.blocks = shape(self.run)
        self.needs = math.ceil(least * len(self.marks) - 1e-9)
        #: The least similarity of a window and a template that has ``needs`` of its shingles there.
        self.jaccard = min(1.0, self.needs / (self.block * self.blocks + len(self.marks) - self.needs))
        self.bands = bands_for(self.jaccard)

    def best(self, h: np.ndarray) -> tuple[float, int]:
        """(containment, first place) of the run of the template's own length that holds most of its distinct shingles; the first of such."""
        places = np.flatnonzero(np.isin(h, self.marks))
        held, first, top, at, distinct = defaultdict(int), 0, 0, 0, 0
        for p in places.tolist():
            held[h[p]] += 1
            distinct += held[h[p]] == 1
            while p - places[first] >= self.run:
                old = h[places[first]]
                held[old] -= 1
                distinct -= held[old] == 0
                first += 1
            if distinct > top:
                top, at = distinct, int(places[first])
        return top / len(self.marks), at


class Class:
    """Templates whose windows have one shape, by their bands' keys."""

    def __init__(self, members: list[Template], minima):
        self.block, self.blocks, self.members = members[0].block, members[0].blocks, members
        self.bands = max(m.bands for m in members)
        self.known: list[dict[int, list[Template]]] = []
        self.maybe = np.zeros((self.bands, 1 << 16), bool)
        for b in range(self.bands):
            own: dict[int, list[Template]] = defaultdict(list)
            for m in members:
                if b < m.bands:
                    own[int(band_key([x.min(keepdims=True) for x in minima(m.marks, b)])[0])].append(m)
            self.maybe[b][[k >> 48 for k in own]] = True
            self.known.append(own)


def band_key(rows: list[np.ndarray]) -> np.ndarray:
    key = rows[0]
    for r in rows[1:]:
        key = (key ^ (r >> np.uint64(17))) * np.uint64(0x9E3779B97F4A7C15) + r
    return key * np.uint64(0xC2B2AE3D27D4EB4F)


class Scanner:
    def __init__(self, texts: dict[str, str], shingle: int = SHINGLE, least: float = LEAST):
        self.shingle = shingle
        self.least = least
        known = [Template(name, m, least) for name, text in sorted(texts.items()) if len(m := shingles(words(text), shingle))]
        rng = np.random.default_rng(12)
        functions = ROWS * max((t.bands for t in known), default=0)
        self.mul, self.add = rng.integers(0, 1 << 63, functions, np.uint64) << np.uint64(1) | np.uint64(1), rng.integers(0, 1 << 63, functions, np.uint64)
        by: dict[tuple[int, int], list[Template]] = defaultdict(list)
        for t in known:
            by[t.block, t.blocks].append(t)
        self.classes = [Class(members, self._hashed) for _, members in sorted(by.items())]
        self.bands = max((c.bands for c in self.classes), default=0)

    def _hashed(self, h: np.ndarray, band: int) -> list[np.ndarray]:
        out = []
        for f in range(band * ROWS, (band + 1) * ROWS):
            x = (h ^ self.add[f]) * self.mul[f]
            x ^= x >> np.uint64(31)
            out.append(x)
        return out

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, float, int, int]]]:
        """Per text (template, containment, first word, windows) of each template found: the best run's containment and place, and how many windows hold such a run."""
        ws = [words(x) for x in texts]
        out: list[list] = [[] for _ in texts]
        group, held = [], 0
        for i, w in enumerate(ws):
            if w:
                group.append(i)
                held += len(w)
            if group and (held >= GROUP or i == len(ws) - 1):
                for d, found in zip(group, self._group([ws[k] for k in group])):
                    out[d] = found
                group, held = [], 0
        if group:
            for d, found in zip(group, self._group([ws[k] for k in group])):
                out[d] = found
        return out

    def _group(self, texts: list[list[bytes]]) -> list[list[tuple[str, float, int, int]]]:
        each = [shingles(w, self.shingle) for w in texts]
        size = np.array([len(x) for x in each])
        room = -(-size // PAD) * PAD  # texts begin at whole blocks of up to PAD shingles; what is between them is above all minima
        first = np.cumsum(room) - room
        h, empty = np.zeros(int(room.sum()), np.uint64), np.ones(int(room.sum()), bool)
        place = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        h[place], empty[place] = np.concatenate(each), False
        empty = np.flatnonzero(empty)
        longest = max((c.block for c in self.classes), default=1)
        start, text, merge, n, block = {}, {}, {}, room, 1
        while True:
            start[block], text[block] = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
            if block >= max(PAD, longest):
                break
            if block >= PAD:  # where blocks twice as long begin; they start anew in each text
                m = -(-n // 2)
                merge[block] = np.repeat(start[block], m) + 2 * (np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m))
                n = m
            else:
                n = n // 2
            block *= 2
        windows: dict[tuple[int, Template], set[tuple[int, int]]] = defaultdict(set)  # (text, template): (first shingle, shingles) of windows
        for b in range(self.bands):
            rows, at, whole = self._hashed(h, b), 1, None
            for x in rows:
                x[empty] = _MOST
            todo = [c for c in self.classes if b < c.bands]
            for block in sorted({PAD, *(c.block for c in todo)}):
                while at < block:
                    rows = [np.minimum(x[::2], x[1::2]) if at < PAD else np.minimum.reduceat(x, merge[at]) for x in rows]
                    at *= 2
                if block == PAD:
                    whole = band_key([np.minimum.reduceat(x, start[PAD]) for x in rows])
                powers = {1: rows}
                for c in [c for c in todo if c.block == block]:
                    window = self._slide(powers, c.blocks)
                    if len(window[0]):
                        self._look(c, b, band_key(window), text[block], -(-size // block), start[block], windows)
            for c in todo:  # a text of fewer blocks is a window
                for d in np.flatnonzero(c.maybe[b][(whole >> np.uint64(48)).astype(np.int64)] & (-(-size // c.block) < c.blocks)).tolist():
                    for t in c.known[b].get(int(whole[d]), ()):
                        windows[d, t].add((0, int(size[d])))
        out: list[list] = [[] for _ in texts]
        for (d, t), some in sorted(windows.items(), key=lambda x: (x[0][0], x[0][1].name)):
            got = [(share, lo + at) for lo, n in sorted(some) for share, at in [t.best(h[first[d] + lo : first[d] + min(lo + n, int(size[d]))])] if share >= self.least]
            if got:
                share, at = max(got, key=lambda x: (x[0], -x[1]))
                out[d].append((t.name, share, at, len(got)))
        return out

    @staticmethod
    def _slide(powers: dict[int, list[np.ndarray]], width: int) -> list[np.ndarray]:
        """Minima over ``width`` neighbours, from those over powers of two."""
        half = 1
        while 2 * half <= width:
            if 2 * half not in powers:
                powers[2 * half] = [np.minimum(x[:-half], x[half:]) if len(x) > half else x[:0] for x in powers[half]]
            half *= 2
        rest = width - half
        return [(np.minimum(x[:-rest], x[rest:]) if len(x) > rest else x[:0]) if rest else x for x in powers[half]]

    @staticmethod
    def _look(c: Class, b: int, key: np.ndarray, text: np.ndarray, n: np.ndarray, start: np.ndarray, windows) -> None:
        for w in np.flatnonzero(c.maybe[b][(key >> np.uint64(48)).astype(np.int64)]).tolist():
            for t in c.known[b].get(int(key[w]), ()):
                d = int(text[w])
                own = w - int(start[d])
                if own + c.blocks <= n[d]:  # others run on into the next text
                    windows[d, t].add((own * c.block, c.block * c.blocks))


_scanners: dict[tuple, Scanner] = {}
remembers("licenses", _scanners, _ids)


def _scan(texts: dict[str, str], shingle: int, least: float):
    key = (hash(tuple(sorted(texts.items()))), shingle, least)

    def run(batches):
        only("licenses")
        if key not in _scanners:
            _scanners[key] = Scanner(texts, shingle, least)
        for batch in batches:
            for part in sliced(batch, 1):
                rows = [(d, *x) for d, found in zip(part.column(0).to_pylist(), _scanners[key].scan(part.column(1).to_pylist())) for x in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()))], names=["doc_id", "template", "containment", "first_word", "n_windows"])

    return run


def license_scan(docs: DataFrame, texts: dict[str, str] | None = None, shingle: int = SHINGLE, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row and template it holds: doc_id, template, containment (share of the template's distinct shingles in the best run of its own length), first_word, n_windows.

    texts: templates by name (default: all of templates()). Words are runs of ASCII letters and digits (A-Z lower-cased) and of other characters' bytes. Null, empty and word-less texts
    match nothing, and a template without words is never matched; one with fewer words than a shingle is one shingle of all its words, which only a text of
    just these words holds. Very long texts are scanned whole. Repeated rows match each for itself, null ids stay null, other columns are ignored whatever their names.
    An empty table gives no rows. Ties between a template's runs go to the first.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be in (0, 1]")
    rows = text_rows(docs, id_col, text_col)
    return rows.mapInArrow(_scan(texts if texts is not None else templates(), shingle, least), "doc_id long, template string, containment double, first_word long, n_windows long")
