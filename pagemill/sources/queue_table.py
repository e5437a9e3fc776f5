"""S7 for the periodic jobs: the queue as snapshots of open items plus changes since.

A pass appends the rows that it changed. ``compact`` folds the changes into a new snapshot of the
items that are still open and moves finished ones to an archive, which passes do not read: what a
pass reads depends on how much is open, not on how long the queue has run. Items may be reopened
(a change of a finished item opens it again).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.schema import QUEUE, conform
from pagemill.sources.batches import BatchTable

FINISHED = ("success", "skipped", "failed")
_KEPT = ("url", "url_hash", "rule_id", "discovered_at")      # a change may leave these out


def _fold(rows: DataFrame) -> DataFrame:
    """Latest row of each item by batch; what a change leaves out stays as it was."""
    cols = [f.name for f in QUEUE.fields if f.name != "queue_id"]
    last = rows.groupBy("queue_id").agg(
        F.max_by(F.struct(*cols), "batch").alias("_l"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("batch"))).alias(c) for c in _KEPT])
    return last.select(*[F.col("queue_id") if f.name == "queue_id" else F.col(f.name) if f.name in _KEPT
                         else F.col(f"_l.{f.name}").alias(f.name) for f in QUEUE.fields])


class QueueTable:
    """Queue rows under ``path``. Batch numbers are those of the writer's passes, ascending."""

    def __init__(self, spark: SparkSession, path: str):
        self.changes = BatchTable(spark, f"{path}/changes", QUEUE)
        self.snapshots = BatchTable(spark, f"{path}/snapshots", QUEUE)
        self.archive = BatchTable(spark, f"{path}/archive", QUEUE)

    def append(self, batch: int, rows: DataFrame) -> None:
        """Add new items or new states of items."""
        self.changes.write(batch, conform(rows, QUEUE))

    def _snapshot(self, before: int | None) -> int | None:
        """Number of the newest snapshot: it holds all changes before that number."""
        return max((n for n in self.snapshots.commits() if before is None or n <= before), default=None)

    def _current(self, before: int | None) -> DataFrame:
        at = self._snapshot(before)
        rows = self.changes.read(since=at, before=before)
        if at is not None:
            # older than every change that follows it
            rows = rows.unionByName(self.snapshots.read(since=at, before=at + 1).withColumn("batch", F.lit(at - 1).cast("long")))
        return _fold(rows)

    def open_items(self, before: int | None = None) -> DataFrame:
        """Items that are not finished, as of the changes before ``before``."""
        return self._current(before).where(~F.col("status").isin(*FINISHED))

    def state(self, before: int | None = None) -> DataFrame:
        """Current state of every item, finished ones included (reports read this)."""
        at = self._snapshot(before)
        archived = self.archive.read(before=None if at is None else at + 1) if at is not None else self.archive.read(before=-1)
        recent = self._current(before).withColumn("batch", F.lit(1 << 62))
        return _fold(archived.unionByName(recent))

    def compact(self, upto: int) -> None:
        """Fold all changes before ``upto``. The snapshot's commit comes last: until then readers
        go on with the one before."""
        from pagemill.session import cut_lineage

        now = cut_lineage(self._current(upto))
        done = F.col("status").isin(*FINISHED)
        self.archive.write(upto, now.where(done))
        self.snapshots.write(upto, now.where(~done))

    def bytes_of_pass(self, before: int | None = None) -> int:
        """Bytes that reading the open items takes."""
        at = self._snapshot(before)
        return self.changes.bytes(since=at, before=before) + (0 if at is None else self.snapshots.bytes(since=at, before=at + 1))
