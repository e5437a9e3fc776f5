"""Vectorised words, word hashes and n-gram hashes over Arrow string columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; these are single ASCII
bytes, so byte runs and code point runs agree in UTF-8. Hashes are 64 bits wide:
multilinear over the bytes (odd random multipliers from a fixed rule), then mixed. Two
different n-grams share a hash with probability about 2**-64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
SPACES = " \t\n\x0b\x0c\r"
LOWER_BYTES = LOWER.tobytes()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def multipliers(n: int, stream: int) -> np.ndarray:
    """``n`` odd 64-bit numbers of numbered stream ``stream``."""
    with np.errstate(over="ignore"):
        base = mix(np.array([stream + 1], dtype=U64))[0]
        return mix(np.arange(1, n + 1, dtype=U64) * _GOLD + base) | U64(1)


_BYTE_MULT = multipliers(256, 0)


def _byte_multipliers(n: int) -> np.ndarray:
    global _BYTE_MULT
    if n > len(_BYTE_MULT):
        _BYTE_MULT = multipliers(1 << int(n - 1).bit_length(), 0)
    return _BYTE_MULT


@dataclass
class Words:
    """Words of a batch of texts. ``first[d]:first[d + 1]`` are those of text ``d``."""

    buf: np.ndarray      # bytes of all texts
    start: np.ndarray    # byte offsets
    end: np.ndarray
    first: np.ndarray    # len(texts) + 1
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1] \
        if len(col) else np.zeros(1, dtype=np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def slices(t, column: str = "text", most: int = 1 << 19):
    """Consecutive slices of a record batch or table with about ``most`` bytes of text each, and
    one row at least: work arrays take some forty bytes for each byte of text."""
    if not t.num_rows:
        return
    if isinstance(t, pa.Table):
        for b in t.to_batches():
            yield from slices(b, column, most)
        return
    size = pc.binary_length(t.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    total = np.cumsum(size)
    start = 0
    while start < len(total):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + most, side="right")))
        yield t.slice(start, end - start)
        start = end


def split_words(col: pa.Array | pa.ChunkedArray, lower: bool = False) -> Words:
    """Words of each text of a string column (null: none), with A-Z lower-cased if asked."""
    buf, offsets = text_bytes(col)
    if lower:
        buf = LOWER[buf]
    n = len(buf)
    inside = np.empty(n + 1, dtype=bool)
    np.logical_not(IS_SPACE[buf], out=inside[:n])
    inside[n] = False
    edge = np.zeros(n + 1, dtype=bool)      # a text begins here
    edge[offsets] = True
    before = np.empty(n + 1, dtype=bool)    # the byte before belongs to a word of the same text
    before[0] = False
    np.logical_and(inside[:n], ~edge[1:], out=before[1:])
    start = np.flatnonzero(inside & ~before)
    after = inside[:n] & (~inside[1:] | edge[1:])
    end = np.flatnonzero(after) + 1
    first = np.searchsorted(start, offsets).astype(np.int64)
    return Words(buf, start, end, first, hash_spans(buf, start, end))


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``[start, end)`` (disjoint, ascending, not empty)."""
    if not len(start):
        return np.zeros(0, dtype=U64)
    length = end - start
    at = np.zeros(len(start), dtype=np.int64)
    np.cumsum(length[:-1], out=at[1:])
    total = int(at[-1] + length[-1])
    pos = np.arange(total, dtype=np.int64) - np.repeat(at, length)
    mult = _byte_multipliers(int(length.max()))
    with np.errstate(over="ignore"):
        vals = (buf[pos + np.repeat(start, length)].astype(U64) + U64(1)) * mult[pos]
        return mix(np.add.reduceat(vals, at))


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word index, hash) of every run of ``n`` words within one text."""
    total = len(words.hash)
    if total < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    mult = multipliers(n, n)
    m = total - n + 1
    with np.errstate(over="ignore"):
        acc = words.hash[:m] * mult[0]
        for j in range(1, n):
            acc += words.hash[j:m + j] * mult[j]
    # a run must not cross into the next text
    starts = np.arange(m, dtype=np.int64)
    last = np.repeat(words.first[1:], words.counts)[:m]
    ok = starts + n <= last
    return starts[ok], mix(acc[ok])
