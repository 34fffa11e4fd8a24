"""Ids of words, kept in a worker from batch to batch, and their gathering into the ids of whole texts."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable
from itertools import repeat

import numpy as np

Runs = tuple[np.ndarray, np.ndarray]

#: Bytes of words, ids and bookkeeping after which a worker's store starts anew, and what an entry takes beside its word and ids:
#: a place in a hash table, a number, a start and a size.
MOST_BYTES, ENTRY_BYTES = 96 << 20, 160
#: Characters of the longest word that is kept; the ids of longer ones go with the batch that they came in.
LONGEST = 128


def end_to_end(runs: Iterable[np.ndarray]) -> Runs:
    """The ids of all runs, and their sizes."""
    runs = list(runs)
    return np.concatenate([np.empty(0, np.int32), *runs]), np.fromiter(map(len, runs), np.int64, len(runs))


class IdStore:
    """The ids of each word as a run of one growing array. ``encode`` gives the ids of words not yet held, end to end, and the number
    of each one's."""

    def __init__(self, encode: Callable[[list[str]], Runs], most_bytes: int = MOST_BYTES):
        self.encode, self.most_bytes = encode, most_bytes
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = self.bytes = 0

    def lookup(self, distinct: list[str]) -> np.ndarray:
        """Entry numbers of distinct words, which hold until the next call."""
        if self.bytes > self.most_bytes or self.flat.nbytes > 4 * max(self.used, 1 << 16) + self.most_bytes:
            self.clear()
        found = np.fromiter(map(self.index.get, distinct, repeat(-1)), np.int64, len(distinct))
        # Words that are kept come first; the longer ones stand behind them, where the next call writes over them.
        new = np.flatnonzero(found < 0)
        words = list(map(distinct.__getitem__, new.tolist()))
        long = np.fromiter(map(len, words), np.int64, len(words)) > LONGEST
        passing = [words[i] for i in np.flatnonzero(long)]
        words = [words[i] for i in np.flatnonzero(~long)] if passing else words
        kept, n = self._add(words, len(self.index), self.used), len(self.index)
        found[new[~long]] = np.arange(n, n + len(kept))
        self.bytes += sum(map(sys.getsizeof, words)) + 4 * int(kept.sum()) + ENTRY_BYTES * len(kept)
        self.used += int(kept.sum())
        self.index.update(zip(words, range(n, n + len(kept)), strict=True))
        found[new[long]] = len(self.index) + np.arange(len(passing))
        self._add(passing, len(self.index), self.used)
        return found

    def _add(self, words: list[str], entry: int, at: int) -> np.ndarray:
        """Sizes of the ids of ``words``, which are written from ``entry`` and ``at`` on."""
        ids, sizes = self.encode(words) if words else end_to_end([])
        while entry + len(sizes) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        if at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), at + len(ids) - len(self.flat)), np.int32)])
        self.start[entry : entry + len(sizes)] = at + np.cumsum(sizes) - sizes
        self.size[entry : entry + len(sizes)] = sizes
        self.flat[at : at + len(ids)] = ids
        return sizes

    def gather(self, entries: np.ndarray, first: np.ndarray, closing: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose words are entries[first[t]:first[t + 1]], end to end, and the texts' offsets in them; after
        each text comes ``closing``, if given."""
        n, extra = len(first) - 1, closing is not None
        sizes = self.size[entries]
        ahead = np.concatenate([[0], np.cumsum(sizes)])
        offsets = ahead[first] + extra * np.arange(n + 1)
        out = np.full(int(offsets[-1]), closing or 0, np.int32)
        within = np.arange(int(ahead[-1]))
        texts = np.repeat(np.arange(n), np.diff(first))
        ids = self.flat[np.repeat(self.start[entries] - ahead[:-1], sizes) + within]
        if extra:
            out[np.repeat(texts, sizes) + within] = ids
        else:
            out[:] = ids
        return out, offsets
