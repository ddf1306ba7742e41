"""Quantizers of vectors: scalar (8 bits a component), product (codebooks of sub-vectors with lookup tables) and binary."""

from __future__ import annotations

import numpy as np


class ScalarQuantizer:
    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.step = low, np.where(high > low, (high - low) / 255, 1.0)

    @classmethod
    def train(cls, x: np.ndarray) -> ScalarQuantizer:
        return cls(x.min(0), x.max(0))

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((x - self.low) / self.step), 0, 255).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.low + codes * self.step

    def distances(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.decode(codes) - q) ** 2).sum(1))


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].astype(np.float64)
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c


class ProductQuantizer:
    def __init__(self, books: list[np.ndarray]):
        self.books = books
        self.cuts = np.cumsum([0, *(b.shape[1] for b in books)])

    @classmethod
    def train(cls, x: np.ndarray, parts: int = 8, words: int = 256, seed: int = 0) -> ProductQuantizer:
        return cls([kmeans(s, min(words, len(x)), seed=seed) for s in np.array_split(x, parts, axis=1)])

    def _split(self, x):
        return [x[..., a:b] for a, b in zip(self.cuts, self.cuts[1:])]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([((b * b).sum(1) - 2 * s @ b.T).argmin(1) for s, b in zip(self._split(x), self.books)], axis=1).astype(np.uint16)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)

    def distances(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        tables = [((b - s) ** 2).sum(1) for s, b in zip(self._split(q), self.books)]
        return np.sqrt(sum(t[codes[:, m]] for m, t in enumerate(tables)))


class BinaryQuantizer:
    @staticmethod
    def encode(x: np.ndarray) -> np.ndarray:
        return np.packbits(x > 0, axis=1)

    @staticmethod
    def distances(q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return np.bitwise_count(np.packbits(q > 0)[None, :] ^ codes).sum(1)
