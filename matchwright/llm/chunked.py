"""Texts to token ids by way of distinct chunks.

Where a tokenizer never joins what lies on both sides of certain places, a
text's ids are the ids of the chunks between those places, one after another.
Each distinct chunk goes through the tokenizer once; a text is then a gather
from a pool of ids. When the pool outgrows its bound it keeps the chunks that
came more than once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class _Numbered(dict):
    """Numbers its keys as they are first asked for; ``new`` has those to encode."""

    def __init__(self, pool: "Chunks", lead: str):
        self.pool, self.lead = pool, lead

    def __missing__(self, key: str) -> int:
        pool = self.pool
        self[key] = n = pool.known + len(pool.new)
        pool.new.append(self.lead + key)
        pool.held += len(key)
        return n


class Chunks:
    STEP = 4000

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], lead: str, most: int = 3_000_000):
        """encode: the ids of some chunks, one after another, and how many each has. lead: what stands before each chunk
        but the first, and is left out of its key. most: characters of keys held."""
        self.encode, self.lead, self.most = encode, lead, most
        self.clear()

    def clear(self) -> None:
        self.first, self.later = _Numbered(self, ""), _Numbered(self, self.lead)
        self.new: list[str] = []
        self.known = self.held = self.used = 0
        self.pool = np.empty(1 << 16, dtype=np.uint32)
        self.starts = np.empty(1 << 14, dtype=np.int64)
        self.sizes = np.empty(1 << 14, dtype=np.int64)
        self.hits = np.zeros(1 << 14, dtype=np.int64)

    def _shrink(self) -> None:
        """Keep the chunks that came at least twice; with more than half of the bound
        still held, those that came more often."""
        least, hits = 2, self.hits[: self.known].copy()
        size = np.zeros(self.known, dtype=np.int32)
        for d in (self.first, self.later):
            size[np.fromiter(d.values(), dtype=np.int64, count=len(d))] = np.fromiter(map(len, d), dtype=np.int32, count=len(d))
        while int(size[hits >= least].sum()) > self.most // 2:
            least *= 2
        keep = hits >= least
        number = np.cumsum(keep) - 1
        kept = [[(key, int(number[n])) for key, n in d.items() if keep[n]] for d in (self.first, self.later)]
        at, lengths, pool = self.starts[: self.known][keep], self.sizes[: self.known][keep], self.pool
        self.clear()
        for d, pairs in zip((self.first, self.later), kept):
            d.update(pairs)
        self.held = int(size[keep].sum())
        ends = np.cumsum(lengths)
        self.known, self.used = len(lengths), int(ends[-1]) if len(ends) else 0
        self._room(0, 0)
        self.pool[: self.used] = pool[np.repeat(at - (ends - lengths), lengths) + np.arange(self.used)]
        self.starts[: self.known], self.sizes[: self.known] = ends - lengths, lengths
        self.hits[: self.known] = hits[keep] // 2

    def _room(self, chunks: int, ids: int) -> None:
        while self.used + ids > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while self.known + chunks > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.empty_like(self.sizes)])
            self.hits = np.concatenate([self.hits, np.zeros_like(self.hits)])

    def _learn(self) -> None:
        for at in range(0, len(self.new), self.STEP):  # a tokenizer's own objects are many times its ids
            ids, sizes = self.encode(self.new[at : at + self.STEP])
            self._room(len(sizes), len(ids))
            self.pool[self.used : self.used + len(ids)] = ids
            ends = self.used + np.cumsum(sizes)
            self.starts[self.known : self.known + len(sizes)] = ends - sizes
            self.sizes[self.known : self.known + len(sizes)] = sizes
            self.known += len(sizes)
            self.used += len(ids)
        self.new = []

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each given as its chunks, and how many each text has."""
        if self.held > self.most:
            self._shrink()
        counts = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        which = np.empty(int(counts.sum()), dtype=np.int64)
        first, later, at = self.first.__getitem__, self.later.__getitem__, 0
        for parts in texts:
            n = len(parts)
            if n:
                which[at] = first(parts[0])
                if n > 1:
                    which[at + 1 : at + n] = np.fromiter(map(later, parts[1:]), dtype=np.int64, count=n - 1)
            at += n
        if self.new:
            self._learn()
        self.hits[: self.known] += np.bincount(which, minlength=self.known)
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        out = self.pool[np.repeat(self.starts[which] - (ends - sizes), sizes) + np.arange(total)]
        edges = np.concatenate([[0], np.cumsum(counts)])
        ends = np.concatenate([[0], ends])
        return out, ends[edges[1:]] - ends[edges[:-1]]
