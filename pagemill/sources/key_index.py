"""Which keys were seen before, without reading all of them (T3, K5, K6 across batches).

Keys lie in folders by a prefix of their hash. Each bucket has a Bloom filter, rewritten with the
batches that add to it. A batch tests its keys against the filters of the buckets they fall in;
only buckets with a suspected repeat are read, and there an exact join decides. Filters start
with ``START_BITS`` and are rebuilt four times as large when they pass eight keys a byte, so the
share of new keys that still cause a read stays small as the index grows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pagemill.session import cut_lineage
from pagemill.sources.batches import BatchTable

START_BITS = 1 << 13
PROBES = 5
KEYS = T.StructType([T.StructField("key", T.StringType()), T.StructField("bucket", T.IntegerType())])
FILTERS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("bits", T.BinaryType())])
_FILTER_DDL = "bucket int, n long, bits binary"


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit numbers of each 64-bit hash, one row a probe."""
    h = h.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(h + np.uint64(i) * step) % np.uint64(bits) for i in range(PROBES)]).astype(np.int64)


def _hashes(t: pa.Table) -> np.ndarray:
    return t.column("h").to_numpy().view(np.uint64)


def _held(filters: pa.Table) -> tuple[int, np.ndarray]:
    """(keys, bits) of a bucket's filter."""
    if not filters.num_rows:
        return 0, np.zeros(START_BITS // 8, np.uint8)
    return filters.column("n")[0].as_py(), np.frombuffer(filters.column("bits")[0].as_py(), np.uint8).copy()


class KeyIndex:
    """Seen keys under ``path``; buckets are ``buckets`` (a power of two) ranges of the key's hash."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.buckets = spark, buckets
        self.keys = BatchTable(spark, f"{path}/keys", KEYS, ("bucket",))
        self.filters = BatchTable(spark, f"{path}/filters", FILTERS)
        self.buckets_read: list[int] = []       # of the last look-up

    def _bucketed(self, keys: DataFrame) -> DataFrame:
        h = F.xxhash64("key")
        return keys.select("key", h.alias("h"), F.pmod(h, F.lit(self.buckets)).cast("int").alias("bucket"))

    def _filters(self, before: int | None) -> DataFrame:
        """The newest filter of each bucket; every batch writes all filters, so it is one folder."""
        numbers = [n for n in self.filters.commits() if before is None or n < before]
        return (self.filters.read(since=max(numbers), before=before) if numbers else self.filters.read(before=-1)).drop("batch")

    def known(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """Those of the distinct ``key`` values that batches before ``before`` have added."""
        schema = pa.schema([("key", pa.string()), ("bucket", pa.int32())])

        def test(asked: pa.Table, filters: pa.Table) -> pa.Table:
            if not filters.num_rows or not asked.num_rows:
                return schema.empty_table()
            _, bits = _held(filters)
            p = _positions(_hashes(asked), 8 * len(bits))
            return asked.filter(pa.array(((bits[p >> 3] >> (p & 7)) & 1).all(axis=0))).select(["key", "bucket"]).cast(schema)

        asked = self._bucketed(keys.where(F.col("key").isNotNull()).select("key").distinct())
        suspects = cut_lineage(asked.groupBy("bucket").cogroup(self._filters(before).groupBy("bucket"))
                               .applyInArrow(test, "key string, bucket int"))
        # at most one number for each bucket
        self.buckets_read = sorted(r.bucket for r in suspects.select("bucket").distinct().collect())
        if not self.buckets_read:
            return suspects.select("key")
        rows = self.keys.read(before=before).where(F.col("bucket").isin(self.buckets_read))      # prunes folders
        return suspects.join(rows.select("key", "bucket"), ["bucket", "key"], "left_semi").select("key")

    def add(self, batch: int, keys: DataFrame) -> None:
        """Add the ``key`` values of a batch (a replay puts them in place of its first try)."""
        new = cut_lineage(self._bucketed(keys.where(F.col("key").isNotNull()).select("key").distinct()))
        staged = self.keys.stage(batch, new.select("key", "bucket"))
        out = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("bits", pa.binary())])

        def fold(added: pa.Table, filters: pa.Table) -> pa.Table:
            bucket = (added if added.num_rows else filters).column("bucket")[0].as_py()
            n, bits = _held(filters)
            if added.num_rows:
                p = _positions(_hashes(added), 8 * len(bits)).ravel()
                np.bitwise_or.at(bits, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))
            return pa.Table.from_arrays([pa.array([bucket], pa.int32()), pa.array([n + added.num_rows]), pa.array([bits.tobytes()], pa.binary())], schema=out)

        folded = cut_lineage(new.groupBy("bucket").cogroup(self._filters(batch).groupBy("bucket")).applyInArrow(fold, _FILTER_DDL))
        full = [r.bucket for r in folded.where(F.col("n") > F.length("bits")).select("bucket").collect()]
        if full:
            folded = folded.where(~F.col("bucket").isin(full)).unionByName(self._rebuilt(batch, new, folded, full))
        self.filters.write(batch, folded)
        self.keys.commit(batch, staged)

    def _rebuilt(self, batch: int, new: DataFrame, folded: DataFrame, full: list[int]) -> DataFrame:
        """Filters of four times the size, from all keys of the buckets: bits of each task meet by
        bucket, so no task holds a bucket's keys."""
        size = {r.bucket: 4 * 8 * r.size for r in folded.where(F.col("bucket").isin(full)).select("bucket", F.length("bits").alias("size")).collect()}
        part = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("bits", pa.binary())])

        def bits_of(batches):
            for b in batches:
                bucket, h = b.column("bucket").to_numpy(), _hashes(b)
                rows = [(k, int((bucket == k).sum()), np.unique(_positions(h[bucket == k], size[k])).tobytes()) for k in np.unique(bucket).tolist()]
                yield pa.RecordBatch.from_pylist([dict(zip(part.names, r)) for r in rows], schema=part)

        def merge(t: pa.Table) -> pa.Table:
            k = t.column("bucket")[0].as_py()
            on = np.zeros(size[k], bool)
            for x in t.column("bits"):
                on[np.frombuffer(x.as_py(), np.int64)] = True
            return pa.Table.from_arrays([pa.array([k], pa.int32()), pa.array([sum(t.column("n").to_pylist())]),
                                         pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], schema=part)

        old = self.keys.read(before=batch).where(F.col("bucket").isin(full)).select("key", F.xxhash64("key").alias("h"), "bucket")
        both = old.unionByName(new.where(F.col("bucket").isin(full)))
        return both.mapInArrow(bits_of, _FILTER_DDL).groupBy("bucket").applyInArrow(merge, _FILTER_DDL)


def key_of(*cols: Column) -> Column:
    """One key of several columns."""
    return F.concat_ws(":", *[c.cast("string") for c in cols])
