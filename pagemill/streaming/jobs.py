"""Structured Streaming forms of the periodic jobs.

  T1 stream_discovery   new list pages (file stream) -> links -> queue (foreachBatch)
  T2 stream_collect     new queue rows trigger a collect pass -> articles/transitions/logs
  T3                    duplicates across batches: a key index (Bloom filter per hash bucket, then an
                        exact join with the buckets in question), or ``dedupe_within_watermark``
  T4 stream_queue_state per-item state with event-time timers (stuck release, retry due)
  T5 stream_daily       watermark + 1-day windows of transition counts
  T6                    ``maxFilesPerTrigger`` + a per-rule FIFO limit inside the batch
  T7                    log retention applied after every batch

Every sink commits batch by batch (``sources/batches``): a reader never sees half a batch, and a
replayed batch (after a failure or executor loss) takes the place of its first try; checkpoints
live under the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pagemill.operators import queue as Q
from pagemill.session import checkpoint_dir, cut_lineage
from pagemill.sources.batches import BatchTable, retain
from pagemill.sources.key_index import KeyIndex, key_of
from pagemill.sources.queue_table import QueueTable

TRANSITION_SCHEMA = T.StructType([
    T.StructField("queue_id", T.LongType()), T.StructField("rule_id", T.LongType()), T.StructField("seq", T.IntegerType()),
    T.StructField("status", T.StringType()), T.StructField("event_ts", T.TimestampType())])


def _ckpt(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "streams", name)


def _run(writer, trigger_once: bool):
    q = (writer.trigger(availableNow=True) if trigger_once else writer.trigger(processingTime="10 minutes")).start()
    if trigger_once:
        q.awaitTermination()
    return q


# ---------------------------------------------------------------- T1 discovery

DISCOVERED = T.StructType([
    T.StructField("rule_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("url_hash", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("attempts", T.IntegerType()),
    T.StructField("discovered_at", T.TimestampNTZType()), T.StructField("scheduled_at", T.TimestampNTZType()),
    T.StructField("offset", T.LongType()),
    T.StructField("pos", T.StructType([T.StructField("list_pos", T.LongType()), T.StructField("link_pos", T.LongType())]))])


def discovered_items(spark: SparkSession, queue_path: str) -> DataFrame:
    """The committed rows of the discovery stream, with their batch."""
    return BatchTable(spark, queue_path, DISCOVERED).read()


def stream_discovery(spark: SparkSession, pages_src: str, queue_path: str, rules: DataFrame, articles: DataFrame,
                     as_of: str, name: str = "discovery", max_files: int = 1, trigger_once: bool = True,
                     pages_schema: T.StructType | None = None):
    """T1+T3+T6: each micro-batch of new page files is discovered as list pages; new
    (rule, url) items are appended to the queue table unless already present there. What is
    present is asked of a key index: a batch reads only the buckets that its links repeat."""
    from pagemill.plans.discover import corpus_list_pages, discover

    schema = pages_schema or T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                                           T.StructField("html", T.StringType())])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(pages_src)

    def batch(df: DataFrame, batch_id: int):
        index = KeyIndex(spark, os.path.join(queue_path, "_keys"))
        key = key_of(F.col("rule_id"), F.col("url_hash"))

        def queued(links: DataFrame) -> DataFrame:
            asked = links.withColumn("key", key)
            return asked.join(index.known(asked, batch_id), "key", "left_semi").drop("key")

        res = discover(rules, df, queued, articles, as_of, listed=corpus_list_pages(df))
        table = BatchTable(spark, queue_path, DISCOVERED)
        folder = table.stage(batch_id, res.new_items)
        index.add(batch_id, spark.read.parquet(f"{queue_path}/{folder}").select(key.alias("key")))
        table.commit(batch_id, folder)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", _ckpt(spark, name))
    return _run(w, trigger_once)


def dedupe_within_watermark(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """T3 (bounded form): drop repeats of (rule_id, url_hash) seen within the watermark."""
    return stream.withWatermark("discovered_at", delay).dropDuplicatesWithinWatermark(["rule_id", "url_hash"])


# ---------------------------------------------------------------- T2 collect

TRANSITIONS = T.StructType([
    T.StructField("queue_id", T.LongType()), T.StructField("rule_id", T.LongType()), T.StructField("status", T.StringType()),
    T.StructField("attempts", T.IntegerType()), T.StructField("last_error", T.StringType()),
    T.StructField("scheduled_at", T.TimestampNTZType()), T.StructField("finished_at", T.TimestampNTZType()),
    T.StructField("article_id", T.LongType()), T.StructField("pass_no", T.LongType())])
STAMPS = T.StructType([T.StructField("rule_id", T.LongType()), T.StructField("last_collected_at", T.TimestampNTZType())])
PASSES = 1_000_000      # numbers set aside for the passes of one micro-batch
COMPACT_EVERY = 8       # passes of one micro-batch after which changes are folded


class CollectTables:
    """What the collect stream writes under one path; every part commits by pass number."""

    def __init__(self, spark: SparkSession, path: str):
        from pagemill.schema import ARTICLES, LOGS

        articles = T.StructType([*ARTICLES.fields, T.StructField("queue_id", T.LongType()), T.StructField("rule_id", T.LongType())])
        part = lambda name, schema: BatchTable(spark, os.path.join(path, name), schema)
        self.queue = QueueTable(spark, os.path.join(path, "queue"))
        self.transitions, self.articles = part("transitions", TRANSITIONS), part("articles", articles)
        self.logs, self.stamps = part("logs", LOGS), part("stamps", STAMPS)
        self.sources, self.titles = KeyIndex(spark, os.path.join(path, "_sources")), KeyIndex(spark, os.path.join(path, "_titles"))

    def forget(self, first: int, end: int) -> None:
        """Take out what an earlier try of the passes ``first`` up to before ``end`` committed."""
        for t in (self.queue.changes, self.queue.snapshots, self.queue.archive, self.transitions, self.articles, self.logs, self.stamps,
                  self.sources.keys, self.sources.filters, self.titles.keys, self.titles.filters):
            for n in t.commits():
                if first <= n < end:
                    t.drop(n)

    def stamped(self, rules: DataFrame) -> DataFrame:
        """Q6: rules with the time of their latest success."""
        last = self.stamps.read().groupBy("rule_id").agg(F.max("last_collected_at").alias("_at"))
        if "last_collected_at" not in rules.columns:
            rules = rules.withColumn("last_collected_at", F.lit(None).cast("timestamp_ntz"))
        return rules.join(last, "rule_id", "left").withColumn("last_collected_at", F.greatest("last_collected_at", "_at")).drop("_at")


def stream_collect(spark: SparkSession, queue_src: str, out_path: str, rules: DataFrame, pages: DataFrame,
                   articles: DataFrame, as_of: str, name: str = "collect", per_rule_batch: bool = True,
                   log_retention: int = 2000, trigger_once: bool = True, queue_schema: T.StructType | None = None,
                   max_files: int = 16, assets: DataFrame | None = None, responses: DataFrame | None = None):
    """T2+T6+T7: each micro-batch adds its queue rows to the queue table and runs collect
    passes until no item is due: a pass takes each rule's FIFO batch (``per_rule_batch``), the
    others stay pending for the next pass. Items that are due now are all in one of these passes,
    so these run together, in the same jobs however many they are, with the outcomes and pass
    numbers of passes one after the other; only with ``responses`` is it one by one. The passes
    read the open items, so retried ones come back once their time has come, and ask key indexes
    whether earlier ones published a source or title; neither grows with what is finished. Articles,
    transitions, logs (pass by pass) and the rules' stamps are committed, the queue's change last:
    what is cut off leaves nothing that a replay would see. Logs are then trimmed to the newest rows."""
    from pagemill.plans.collect import Seen, collect
    from pagemill.schema import LOGS, QUEUE, conform
    from pagemill.sources.sinks import normalize_log_rows

    stream = spark.readStream.schema(queue_schema or QUEUE).option("maxFilesPerTrigger", max_files).parquet(queue_src)
    if "title" not in articles.columns:
        articles = articles.withColumn("title", F.lit(""))
    if "status" not in articles.columns:
        articles = articles.withColumn("status", F.lit("publish"))
    given = articles.select("source_url", "title", "status")

    def batch(df: DataFrame, batch_id: int):
        out = CollectTables(spark, out_path)
        first = batch_id * PASSES
        out.forget(first, first + PASSES)
        out.queue.append(first, conform(df, QUEUE))
        number = first + 1
        while True:
            state = cut_lineage(out.queue.open_items(number))
            if Q.due_items(Q.release_stuck(state, as_of), rules.select("rule_id", "enabled"), as_of).isEmpty():
                break
            seen = Seen(out.sources, out.titles, number)
            res = collect(state, rules, pages, given, as_of, assets=assets, per_rule_batch=per_rule_batch,
                          responses=responses, seen=seen, every_pass=responses is None)
            turn = lambda df: df.withColumn("pass_no", F.lit(number).cast("long")) if res.turns is None else \
                df.join(res.turns.select("queue_id", (F.col("turn") + number).alias("pass_no")), "queue_id")
            rows = cut_lineage(turn(res.transitions))
            last = rows.agg(F.max("pass_no")).first()[0]
            if last is None:
                break
            if last >= first + PASSES:
                raise RuntimeError("a batch needs more passes than its numbers allow")
            folder = out.articles.stage(number, res.articles)
            written = spark.read.schema(out.articles.schema).parquet(f"{out.articles.path}/{folder}")
            seen.add(written)
            out.transitions.write(number, rows)
            logs = normalize_log_rows(turn(res.logs))
            out.logs.write_each(conform(logs, T.StructType([*LOGS.fields, T.StructField("pass_no", T.LongType())])), "pass_no")
            out.stamps.write(number, res.last_collected)
            out.articles.commit(number, folder)
            out.queue.append(number, rows)
            number = last + 1
            if responses is not None and number % COMPACT_EVERY == 0:
                out.queue.compact(number)
        out.queue.compact(number)
        retain(out.logs, log_retention)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", _ckpt(spark, name))
    return _run(w, trigger_once)


# ---------------------------------------------------------------- T4 per-item state

STATE_OUT = T.StructType([
    T.StructField("queue_id", T.LongType()), T.StructField("rule_id", T.LongType()), T.StructField("seq", T.IntegerType()),
    T.StructField("status", T.StringType()), T.StructField("event_ts", T.TimestampType()),
    T.StructField("timer", T.StringType())])
STATE_SCHEMA = T.StructType([
    T.StructField("rule_id", T.LongType()), T.StructField("seq", T.IntegerType()), T.StructField("status", T.StringType()),
    T.StructField("event_us", T.LongType()), T.StructField("attempts", T.IntegerType()), T.StructField("due", T.LongType())])
DONE = ("success", "skipped", "failed")
BLOCK_BITS = 9          # 512 consecutive ids: the items that share a call, whatever the size of the queue
NO_ID = -(1 << 60)      # block of items without an id


def _times(us: list[int | None]) -> pd.Series:
    return pd.to_datetime(pd.Series(us, dtype="Int64"), unit="us")


class ItemState(StatefulProcessor):
    """The latest transition of each item, with event-time timers.

    An event takes effect if it is newer, by (event time, sequence), than the state; older ones
    are late and change nothing. ``running`` sets a timer at start + max(5, ``stuck_minutes``): when
    the watermark passes it without another event the item is released (Q4). ``failed_try`` events
    count attempts and, with ``retry_limit``, become ``pending`` again after Q5's back-off or
    ``failed``. A pending item with ``retry_after_seconds`` or a back-off reports 'retry_due' at its
    time. A finished item keeps its state for ``keep_minutes`` of event time, so that late events
    find it finished, and is then forgotten; an item that is heard of after that counts as new.

    A call serves a block of consecutive items, each with an entry of its own in the state, since
    a frame and a round trip for every single item cost far more than its events. A block's timers
    are the times at which any of its items is due."""

    def __init__(self, stuck_minutes: int | None = None, retry_after_seconds: int | None = None,
                 retry_limit: int | None = None, keep_minutes: int | None = None):
        self.stuck, self.retry_after, self.retry_limit, self.keep = stuck_minutes, retry_after_seconds, retry_limit, keep_minutes
        self.timers = any(x is not None for x in (stuck_minutes, retry_after_seconds, retry_limit, keep_minutes))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("latest", T.StructType([T.StructField("queue_id", T.LongType())]), STATE_SCHEMA)

    def _held(self) -> dict:
        """Queue id -> state of the block's items."""
        return {k[0]: v for k, v in self.items.iterator()} if self.items.exists() else {}

    def _set(self, held: dict, item: int | None, state: tuple | None) -> None:
        if state is not None:
            held[item] = state
            self.items.updateValue((item,), state)
        elif held.pop(item, None) is not None:
            self.items.removeKey((item,))

    def _set_timers(self, held: dict, fired: int | None = None) -> None:
        """Timers at the times of the items; the one that has ``fired`` goes by itself."""
        if self.timers:
            wanted, given = {v[5] for v in held.values() if v[5] is not None}, set(self.handle.listTimers())
            for t in given - wanted - {fired}:
                self.handle.deleteTimer(t)
            for t in wanted - given:
                self.handle.registerTimer(t)

    def _due(self, status: str, us: int | None, attempts: int, backing_off: bool) -> int | None:
        """When an item in this state is due, in milliseconds."""
        if us is None:
            return None
        if status == "running" and self.stuck:
            return us // 1000 + 60_000 * max(5, self.stuck)
        if status == "pending" and backing_off:
            return us // 1000 + 1000 * min(3600, max(60, 300 * attempts))
        if status == "pending" and self.retry_after:
            return us // 1000 + 1000 * self.retry_after
        if status in DONE and self.keep is not None:
            return us // 1000 + 60_000 * self.keep
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ev = pd.concat(list(rows), ignore_index=True)
        known = lambda c: [None if x != x else int(x) for x in c.tolist()]
        at = ev["event_ts"].astype("datetime64[us]")
        at = [None if null else t for t, null in zip(at.astype("int64").tolist(), at.isna().tolist())]
        events = sorted(zip(known(ev["queue_id"]), at, known(ev["seq"]), ev["status"].tolist(), known(ev["rule_id"])),
                        key=lambda e: (e[1] is not None, e[1] or 0, e[2]))
        held = self._held()
        now: dict = {}      # queue id -> (event time, sequence, status, rule, attempts, backing off)
        for item, us, seq, status, rule in events:
            best = now.get(item)
            if best is None:
                if (old := held.get(item)) is not None:
                    best = now[item] = (old[3], old[1], old[2], old[0], old[4] or 0, False)
            if best is not None and (us is not None, us or 0, seq) < (best[0] is not None, best[0] or 0, best[1]):
                continue
            attempts, backing_off = best[4] if best is not None else 0, False
            if status == "failed_try" or status == "failed" and self.retry_limit is not None:
                attempts += 1
                backing_off = attempts < (self.retry_limit or 0)
                status = "pending" if backing_off else "failed"
            elif status in ("success", "skipped"):
                attempts = 0
            now[item] = (us, seq, status, rule, attempts, backing_off)
        for item, (us, seq, status, rule, attempts, backing_off) in now.items():
            old = held.get(item)
            if status in DONE and not self.timers:
                self._set(held, item, None)     # nothing will ask for it
            elif old is None or (us, seq) != (old[3], old[1]):
                self._set(held, item, (rule, seq, status, us, attempts, self._due(status, us, attempts, backing_off)))
        self._set_timers(held)
        yield self._rows([(item, b[3], b[1], b[2], b[0], None) for item, b in now.items()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, at, out = self._held(), expiredTimerInfo.getExpiryTimeInMs(), []
        for item, (rule, seq, status, us, attempts, due) in list(held.items()):
            if due is None or due > at:
                continue
            if status == "running":
                us, seq = due * 1000, seq + 1
                self._set(held, item, (rule, seq, "pending", us, attempts, self._due("pending", us, attempts, False)))
                out.append((item, rule, seq, "pending", us, "stuck_release"))
            elif status == "pending":
                self._set(held, item, (rule, seq, status, us, attempts, None))
                out.append((item, rule, seq, "pending", us, "retry_due"))
            else:
                self._set(held, item, None)
        self._set_timers(held, at)
        if out:
            yield self._rows(out)

    @staticmethod
    def _rows(rows: list[tuple]) -> pd.DataFrame:
        item, rule, seq, status, us, timer = zip(*rows)
        return pd.DataFrame({"queue_id": pd.Series(item, dtype="Int64"), "rule_id": pd.Series(rule, dtype="Int64"), "seq": seq,
                             "status": status, "event_ts": _times(list(us)), "timer": pd.Series(timer, dtype="object")})

    def close(self) -> None:
        pass


def queue_state_stream(events: DataFrame, stuck_minutes: int | None = None, retry_after_seconds: int | None = None,
                       watermark: str = "1 hour", retry_limit: int | None = None, keep_minutes: int | None = None) -> DataFrame:
    """T4: latest state per item as a stateful stream over typed RocksDB state (see
    :class:`ItemState`); readers take the latest emitted row per item. With timers, finished items
    stay for ``keep_minutes`` (the watermark's hour unless given); without, they are forgotten at once."""
    spark = events.sparkSession
    # this operator keeps its state in RocksDB; the setting holds for streams started from now on
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if keep_minutes is None and any(x is not None for x in (stuck_minutes, retry_after_seconds, retry_limit)):
        keep_minutes = 60
    item = ItemState(stuck_minutes, retry_after_seconds, retry_limit, keep_minutes)
    block = F.coalesce(F.shiftright("queue_id", BLOCK_BITS), F.lit(NO_ID).cast("long"))
    return events.withWatermark("event_ts", watermark).withColumn("block", block).groupBy("block").transformWithStateInPandas(
        item, STATE_OUT, "Update", "EventTime" if item.timers else "None")


def transitions_stream(spark: SparkSession, events_path: str, as_of: str, max_files: int = 1) -> DataFrame:
    """The fixture's transition events derived from the event file stream (3 per item at
    most: discovered, started, finished), event time as TIMESTAMP (watermark-ready)."""
    from pagemill.fixtures import Tables

    ev_schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
                              T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
                              T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])
    src = spark.readStream.schema(ev_schema).option("maxFilesPerTrigger", max_files).parquet(events_path)

    class _T(Tables):
        def base(self, name):
            return src

    t = _T(spark, "")
    tr = t.f_transitions
    return tr.select("queue_id", "rule_id", F.col("seq").cast("int").alias("seq"), "status",
                     F.col("event_ts").cast("timestamp").alias("event_ts"))


def stream_queue_state(spark: SparkSession, events_path: str, out_path: str, as_of: str, name: str = "queue_state",
                       stuck_minutes: int | None = None, trigger_once: bool = True) -> DataFrame:
    """T4 end to end: run the state stream to the end of the available files and return
    the folded current state (latest emitted row per item)."""
    st = queue_state_stream(transitions_stream(spark, events_path, as_of), stuck_minutes)

    def batch(df: DataFrame, batch_id: int):
        df.write.mode("overwrite").parquet(os.path.join(out_path, f"batch={batch_id}"))

    _run(st.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", _ckpt(spark, name)),
         trigger_once)
    out = spark.read.parquet(out_path)
    latest = out.groupBy("queue_id").agg(F.max_by(F.struct("rule_id", "seq", "status", "event_ts"),
                                                  F.struct("event_ts", "seq")).alias("s"))
    return latest.select("queue_id", "s.rule_id", "s.seq", "s.status", F.col("s.event_ts").cast("timestamp_ntz").alias("event_ts"))


# ---------------------------------------------------------------- T5 daily counters

def daily_counts_stream(transitions: DataFrame, watermark: str = "1 day") -> DataFrame:
    """T5: per 1-day event-time window: transitions, successes, failures. Rows later than
    the watermark are dropped by the engine (counted by the query's progress metrics)."""
    return (transitions.withWatermark("event_ts", watermark)
            .groupBy(F.window("event_ts", "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("total_count"),
                 F.count_if(F.col("status") == "success").alias("success_count"),
                 F.count_if(F.col("status") == "failed").alias("failed_count")))


def late_rows(query) -> int:
    """Rows that the watermark has dropped so far, from the query's progress."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


def stream_daily(spark: SparkSession, events_path: str, out_path: str, as_of: str, name: str = "daily",
                 trigger_once: bool = True, watermark: str = "1 day") -> DataFrame:
    """T5 end to end, in update mode: a batch writes the windows that it changed, the engine
    forgets windows that the watermark has passed, and a window's row is that of its latest
    batch."""
    agg = daily_counts_stream(transitions_stream(spark, events_path, as_of), watermark)

    def batch(df: DataFrame, batch_id: int):
        df.write.mode("overwrite").parquet(os.path.join(out_path, f"batch={batch_id}"))

    _run(agg.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", _ckpt(spark, name)),
         trigger_once)
    out = spark.read.parquet(out_path).groupBy(F.to_date(F.col("w.start")).alias("day")).agg(
        F.max_by(F.struct("total_count", "success_count", "failed_count"), "batch").alias("c"))
    return out.select("day", "c.*")
