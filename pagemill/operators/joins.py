"""Join helpers: size-checked broadcast and skew-safe ranking within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# A side is broadcast only when the optimizer's size estimate is below this (bytes);
# otherwise the join is left to the planner/AQE (shuffle join, runtime re-plan).
BROADCAST_CAP_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of ``df`` (no job is run); None if unavailable."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:  # noqa: BLE001 - e.g. Spark Connect
        return None


def small(df: DataFrame, cap: int = BROADCAST_CAP_BYTES) -> DataFrame:
    """``broadcast(df)`` if its estimated size is within ``cap``, else ``df`` unchanged
    (AQE may still broadcast it at runtime from measured sizes)."""
    n = estimated_bytes(df)
    return F.broadcast(df) if n is not None and n <= cap else df


def rank_in_group(df: DataFrame, group: list[str], order: list[Column | str], out: str = "rank",
                  partitions: int | None = None) -> DataFrame:
    """Exact 1-based row number within ``group`` by ``order`` without sending a group to
    one task: range-partition on (group, order) so a hot group is split over several
    partitions, number rows locally, then add the counts of the group's rows in earlier
    partitions (a table of at most partitions + groups rows).

    ``order`` must make rows unique within a group (add a key as the last column). The
    partitioned rows are written to the shared checkpoint folder once, with their partition
    and local number, and both the counts and the rows are read from there: two range
    exchanges of one frame would sample different bounds."""
    from pagemill.session import cut_lineage

    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    r = cut_lineage(df.repartitionByRange(n, *[F.col(g) for g in group], *order_cols)
                    .sortWithinPartitions(*[F.col(g) for g in group], *order_cols)
                    .withColumn("_pid", F.spark_partition_id())
                    .withColumn("_mono", F.monotonically_increasing_id()))
    firsts = r.groupBy("_pid", *group).agg(F.min("_mono").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = firsts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    joined = r.join(offsets.select("_pid", *group, "_first", "_before"), ["_pid", *group])
    return joined.withColumn(out, (F.col("_before") + F.col("_mono") - F.col("_first") + 1).cast("long")) \
        .drop("_pid", "_mono", "_first", "_before")


def first_in_group(df: DataFrame, group: list[str], order_key: str, out: str = "is_first") -> DataFrame:
    """Flag the row with the smallest ``order_key`` of each group: a partial (map-side)
    min per group joined back — a hot group costs one aggregate row, not one task."""
    mins = df.groupBy(*group).agg(F.min(order_key).alias("_min_key"))
    return df.join(mins, group, "left").withColumn(out, F.col(order_key) == F.col("_min_key")).drop("_min_key")
