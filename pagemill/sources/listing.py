"""Listings by key (O6, O7): pages found by seeking past the last id instead of by an offset.

Rows lie in folders of ``block_rows`` consecutive ids, sorted by id within a file. A page reads the
folders below the id that the page before ended with, the next one first, then two, four and so on
until enough rows match. So page 10,000 reads what page 1 reads: a folder if most rows match, twice
the folders that it takes if few do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pagemill.session import path_exists

BLOCK_ROWS = 1 << 20


class Listing:
    """A table with a unique integer ``key``; rows with a null key are not listed."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, block_rows: int = BLOCK_ROWS):
        self.spark, self.path, self.schema, self.key, self.block_rows = spark, path.rstrip("/"), schema, key, block_rows

    def add(self, rows: DataFrame) -> None:
        """Append rows; each task writes the blocks of a range of ids."""
        k = F.col(self.key)
        block = F.expr(f"({self.key} - pmod({self.key}, {self.block_rows})) div {self.block_rows}")
        rows.where(k.isNotNull()).select(*self.schema.names).withColumn("id_block", block).repartitionByRange("id_block", k) \
            .sortWithinPartitions("id_block", k.desc()).write.mode("append").partitionBy("id_block").parquet(self.path)

    def blocks(self) -> list[int]:
        """Numbers of the blocks, the newest first, from the names of their folders."""
        if not path_exists(self.spark, self.path):
            return []
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        names = [f.getPath().getName() for f in p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
        return sorted((int(n[9:]) for n in names if n.startswith("id_block=")), reverse=True)

    def _read(self, blocks: list[int]) -> DataFrame:
        if not blocks:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/id_block={b}" for b in blocks])

    def page(self, after: int | None = None, per_page: int = 50, condition: Column | None = None) -> DataFrame:
        """The ``per_page`` rows of the largest ids below ``after`` (None: all) that meet
        ``condition``, newest first. The next page follows the smallest id of this one."""
        left = [b for b in self.blocks() if after is None or b * self.block_rows < after]
        read, taken, step = [], [], 1
        while left and len(taken) < per_page:
            now, left, step = left[:step], left[step:], 2 * step
            read += now
            found = self._match(self._read(now), after, condition).select(self.key).orderBy(F.col(self.key).desc())
            taken += [r[0] for r in found.limit(per_page - len(taken)).collect()]      # at most a page
        rows = self._match(self._read(read), after, condition)
        if len(taken) == per_page:
            rows = rows.where(F.col(self.key) >= taken[-1])
        return rows.orderBy(F.col(self.key).desc()).limit(per_page)

    def _match(self, rows: DataFrame, after: int | None, condition: Column | None) -> DataFrame:
        rows = rows if after is None else rows.where(F.col(self.key) < after)
        return rows if condition is None else rows.where(condition)
