"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from functools import wraps

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagemill.llm.words import U64, mix
from pagemill.session import checkpoint_dir, cut_lineage, ensure_defaults  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_defaults(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """A column by its whole name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def n_partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle: the session's setting, which the cluster sizes to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_shard(col: Column, n: int) -> Column:
    """Shard of an integer id; :func:`doc_shard_np` gives the same number in a task."""
    c = F.coalesce(col.cast("long"), F.lit(0).cast("long"))
    return F.pmod(c.bitwiseXOR(F.shiftrightunsigned(c, 7)).bitwiseXOR(F.shiftrightunsigned(c, 13)),
                  F.lit(n).cast("long")).cast("int")


def doc_shard_np(ids: np.ndarray, n: int) -> np.ndarray:
    u = ids.astype(np.int64).view(U64)
    x = (u ^ (u >> U64(7)) ^ (u >> U64(13))).view(np.int64)
    return (x % n).astype(np.int32)


def hash_shard_np(h: np.ndarray, n: int) -> np.ndarray:
    return ((mix(h) >> U64(33)) % U64(n)).astype(np.int32)


def ids_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids with 0 for null, is null) of an integer column."""
    return col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), \
        col.is_null().to_numpy(zero_copy_only=False)


def u64(blob: bytes | None) -> np.ndarray:
    return np.frombuffer(blob or b"", dtype=U64)


def i64(blob: bytes | None) -> np.ndarray:
    return np.frombuffer(blob or b"", dtype=np.int64)


def groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return start, np.r_[start[1:], len(sorted_keys)]


def pack(dest: np.ndarray, *columns: np.ndarray):
    """Yield (destination, bytes of each column) with rows grouped by destination."""
    order = np.argsort(dest, kind="stable")
    dest = dest[order]
    columns = [c[order] for c in columns]
    for a, b in zip(*groups(dest)):
        yield int(dest[a]), *(c[a:b].tobytes() for c in columns)


def packed_bits(on: np.ndarray) -> bytes:
    """A segment's bits as a task sends them: packed, and compressed, since most are zero while a
    filter is far from full."""
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(on, bitorder="little").tobytes())


class Filter:
    """A Bloom filter's segments of equal size, as tasks sent them. The driver passes them on as they
    are and never holds the filter; a worker unpacks them when it first asks."""

    def __init__(self, segments: dict[int, bytes], size: int, segment_size: int):
        self._segments, self._size, self._segment_size = segments, size, segment_size
        self._bits: np.ndarray | None = None

    @property
    def bits(self) -> np.ndarray:
        if self._bits is None:
            n, out = self._segment_size // 8, np.zeros(self._size // 8, np.uint8)
            for i, x in self._segments.items():
                out[i * n:(i + 1) * n] = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
            self._bits, self._segments = out, {}
        return self._bits


def tidy(task: Callable) -> Callable:
    """A map over batches that, when it ends, returns its freed memory to the system: workers
    live on between tasks, and their idle memory counts against the executor's."""
    @wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def rows_to_batches(rows, schema: pa.Schema, size: int = 2048):
    """Record batches of at most ``size`` rows from an iterator of tuples."""
    buffer = []
    for row in rows:
        buffer.append(row)
        if len(buffer) >= size:
            yield _batch(buffer, schema)
            buffer = []
    if buffer:
        yield _batch(buffer, schema)


def _batch(rows, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def bytes_of(words, i: int) -> bytes:
    return words.buf[words.start[i]:words.end[i]].tobytes()
