"""Sinks and table I/O: articles (S6), queue (S7), logs (S8), diagnostics (S9), conform.

All sinks are appends of immutable rows; a micro-batch writes under its own batch-id
folder and replaces it on retry, so a re-run batch does not duplicate rows.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagemill.functions.text import strip_tags, trim_set
from pagemill.operators import reports as R
from pagemill.schema import LOGS, QUEUE, conform


def write_articles(df: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append articles partitioned by status; with ``batch_id`` the batch's own folder
    is overwritten, which makes a retried micro-batch idempotent."""
    if batch_id is None:
        df.write.mode("append").partitionBy("status").parquet(path)
    else:
        df.write.mode("overwrite").partitionBy("status").parquet(os.path.join(path, f"batch={batch_id}"))


def write_queue(transitions: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append queue transition rows (state is folded on read, Q12)."""
    if batch_id is None:
        transitions.write.mode("append").parquet(path)
    else:
        transitions.write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """Current queue state = latest transition per item (Q12 fold)."""
    from pagemill.operators.queue import queue_state

    ev = spark.read.option("mergeSchema", "true").parquet(path)
    if "seq" not in ev.columns:
        ev = ev.withColumn("seq", F.lit(0))
    if "event_ts" not in ev.columns:
        ev = ev.withColumn("event_ts", F.coalesce("finished_at", "started_at", "discovered_at"))
    return queue_state(ev)


def normalize_log_rows(df: DataFrame, as_of=None) -> DataFrame:
    """Level lower-cased and reduced to [a-z0-9_-], message without tags, URL trimmed."""
    level = F.regexp_replace(F.lower(F.col("level")), r"[^a-z0-9_\-]", "")
    out = df.withColumn("level", level).withColumn("message", strip_tags(F.col("message"))) \
        .withColumn("url", trim_set(F.coalesce(F.col("url"), F.lit(""))))
    if as_of is not None and "created_at" not in df.columns:
        out = out.withColumn("created_at", F.lit(as_of).cast("timestamp_ntz"))
    return out


def append_logs(df: DataFrame, path: str, enabled: bool = True, batch_id: int | None = None) -> None:
    """Append normalised log rows (no-op when logging is switched off)."""
    if not enabled:
        return
    rows = conform(normalize_log_rows(df), LOGS)
    if batch_id is None:
        rows.write.mode("append").parquet(path)
    else:
        rows.write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))


def diagnostics(rules: DataFrame, queue: DataFrame, logs: DataFrame, as_of, k: int = 20) -> DataFrame:
    """One JSON document: table totals, counts per status, newest problems and failed
    samples (both bounded top-k lists)."""
    counts = R.status_counts(queue).agg(F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("queue"))
    totals = R.table_totals(rules, queue, logs)
    errs = logs.where(F.col("level").isin("error", "warning")).orderBy(F.col("log_id").desc()).limit(k) \
        .agg(F.collect_list(F.struct("created_at", "rule_id", "queue_id", "level", "message", "url")).alias("recent_errors"))
    fails = R.failed_samples(queue, k).agg(F.collect_list(F.struct("queue_id", "rule_id", "url", "attempts", "last_error",
                                                                   "finished_at")).alias("failed_samples"))
    doc = R.attach_one_row(R.attach_one_row(R.attach_one_row(counts, totals), errs), fails)
    return doc.select(F.lit(as_of).cast("timestamp_ntz").alias("generated_at"), F.to_json(F.struct(
        F.lit(as_of).alias("generated_at"),
        F.struct(F.col("rules_total").alias("rules"), F.col("queue").alias("queue"), F.col("logs_total").alias("logs"))
        .alias("counts"), "recent_errors", "failed_samples")).alias("report"))


def conform_queue(df: DataFrame) -> DataFrame:
    """A queue-like table conformed to the queue schema (missing columns added)."""
    return conform(df, QUEUE, {"attempts": 0, "status": "pending"})


__all__ = ["write_articles", "write_queue", "read_queue", "append_logs", "normalize_log_rows", "diagnostics",
           "conform_queue", "Column"]
