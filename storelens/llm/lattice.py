"""Piece lattices over words, batched in numpy: words of equal length advance together."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np

from .base import MULTIPLIER, mix


def code_points(words: list[str]) -> np.ndarray:
    """A matrix of code points, one row for each of the equally long words."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


class PieceTable:
    """Finds which substrings of words are pieces: rolling substring hashes probe the sorted keys of the pieces."""

    def __init__(self, pieces: Iterable[str]):
        """Entry i of ``pieces`` has index i; hash collisions between pieces are refused."""
        pieces = list(pieces)
        self.longest = max(map(len, pieces))
        keys = np.empty(len(pieces), np.uint64)
        for length, at in self._by_length(pieces):
            keys[at] = self._names(code_points([pieces[i] for i in at]), length)[:, 0]
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        if len(keys) != len(np.unique(keys)):
            raise ValueError("two pieces have one key")
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(keys >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _by_length(words: list[str]) -> Iterator[tuple[int, list[int]]]:
        found = defaultdict(list)
        for i, w in enumerate(words):
            found[len(w)].append(i)
        yield from sorted(found.items())

    @staticmethod
    def _names(points: np.ndarray, length: int) -> np.ndarray:
        h = np.zeros((len(points), points.shape[1] - length + 1), np.uint64)
        for k in range(length):
            h = h * MULTIPLIER + points[:, k : points.shape[1] - length + 1 + k] + np.uint64(1)
        return mix(h + np.uint64(length))

    def matches(self, points: np.ndarray) -> list[np.ndarray]:
        """For each length l from 1: a matrix with the piece that starts at each place, -1 for none."""
        found, h = [], np.zeros(points.shape, np.uint64)
        for length in range(1, min(self.longest, points.shape[1]) + 1):
            width = points.shape[1] - length + 1
            h = h[:, :width] * MULTIPLIER + points[:, length - 1 :] + np.uint64(1)
            key = mix(h + np.uint64(length))
            out = np.full(key.shape, -1, np.int32)
            maybe = np.nonzero(self.sieve[(key >> np.uint64(44)).astype(np.int64)])
            probe = key[maybe]
            at = np.searchsorted(self.keys, probe)
            at[at == len(self.keys)] = 0
            out[maybe] = np.where(self.keys[at] == probe, self.ids[at], -1)
            found.append(out)
        return found

    def groups(self, words: list[str], most: int = 200_000) -> Iterator[tuple[list[int], np.ndarray]]:
        """Indices and code points of equally long words, at most about ``most`` characters at once."""
        for length, at in self._by_length(words):
            step = max(1, most // max(length, 1))
            for k in range(0, len(at), step):
                some = at[k : k + step]
                yield some, code_points([words[i] for i in some])
