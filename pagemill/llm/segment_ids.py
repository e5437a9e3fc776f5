"""Ids of text segments that a worker has met, in arrays sorted by 64-bit hash."""

from __future__ import annotations

from itertools import chain

import numpy as np

from pagemill.llm.kneser_ney import find
from pagemill.llm.words import U64

CACHE_SEGMENTS = 1_500_000    # that a worker holds before it lets go of those it met only once


class SegmentIds:
    """``encode`` turns a list of segments (bytes) into lists of ids; each is asked once."""

    def __init__(self, encode, kind=np.uint16):
        self.encode, self.kind = encode, kind
        # hashes (sorted), where their ids begin in the pool, how many, and if met again
        self.old = self.young = (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        self.pool = np.zeros(1 << 16, self.kind)
        self.used = 0

    def _let_go(self):
        """Keep what was met again since the last time."""
        keys, begin, size, again = self._merged(self.old, self.young)
        keys, begin, size = keys[again], begin[again], size[again]
        off = np.cumsum(size) - size
        self.pool = self.pool[np.repeat(begin - off, size) + np.arange(size.sum())]
        self.used = len(self.pool)
        self.old = (keys, off, size, np.zeros(len(keys), bool))
        self.young = tuple(x[:0] for x in self.old)

    def _learn(self, words: list[bytes], hashes: np.ndarray):
        lists = self.encode(words)
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(size.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.used], np.zeros(max(total, len(self.pool)), self.kind)])
        self.pool[self.used:self.used + total] = np.fromiter(chain.from_iterable(lists), self.kind, total)
        begin = np.cumsum(size) - size + self.used
        self.used += total
        self.young = self._merged(self.young, (hashes, begin, size, np.zeros(len(size), bool)))
        if len(self.young[0]) > max(20_000, len(self.old[0]) // 8):
            self.old, self.young = self._merged(self.old, self.young), tuple(x[:0] for x in self.old)

    @staticmethod
    def _merged(a, b):
        both = tuple(np.concatenate(x) for x in zip(a, b))
        order = np.argsort(both[0], kind="stable")
        return tuple(x[order] for x in both)

    def _look_up(self, h: np.ndarray, count: bool = True):
        begin, size = np.zeros(len(h), np.int64), np.full(len(h), -1, np.int64)
        for keys, at, n, again in (self.old, self.young):
            i, hit = find(keys, h)
            i = i[hit]
            begin[hit], size[hit] = at[i], n[i]
            if count:
                again[i] = True
        return begin, size

    def ids(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments in turn, how many of each) for the byte spans of ``buf``."""
        uniq, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.old[0]) > CACHE_SEGMENTS:
            self._let_go()
        begin, size = self._look_up(uniq)
        new = np.flatnonzero(size < 0)
        if len(new):
            data = buf.tobytes()
            self._learn([data[s:e] for s, e in zip(start[at[new]].tolist(), end[at[new]].tolist())], uniq[new])
            begin, size = self._look_up(uniq, count=False)
        n = size[inverse]
        off = np.cumsum(n) - n
        return self.pool[np.repeat(begin[inverse] - off, n) + np.arange(n.sum())] if len(n) else self.pool[:0], n
