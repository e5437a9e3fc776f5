import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from pagemill.fixtures import AS_OF, Tables
from pagemill.operators.queue import queue_state


def _split_pages(spark, n=5):
    """Pages split into ``n`` files; pages sharing a normalised URL stay in one file, so a
    micro-batch's "one page per URL" choice equals the whole-corpus choice."""
    from pagemill.functions.urls import normalize_url
    d = tempfile.mkdtemp(prefix="pm-pages-")
    pages = spark.read.parquet(os.path.join(SF_SMALL, "pages.parquet"))
    pages.repartition(n, F.md5(normalize_url(F.col("url")))).write.mode("overwrite").parquet(d)
    return d


def test_daily_stream_equals_batch(spark):
    from pagemill.streaming.jobs import stream_daily
    out = tempfile.mkdtemp(prefix="pm-daily-")
    got = stream_daily(spark, SF_SMALL + "/event[s].parquet", out, AS_OF, name="t-daily-" + os.path.basename(out))
    t = Tables(spark, SF_SMALL)
    want = t.f_transitions.groupBy(F.to_date("event_ts").alias("day")).agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if(F.col("status") == "success").alias("success_count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_state_stream_equals_batch_fold(spark):
    from pagemill.streaming.jobs import stream_queue_state
    out = tempfile.mkdtemp(prefix="pm-qs-")
    got = stream_queue_state(spark, SF_SMALL + "/event[s].parquet", out, AS_OF, name="t-qs-" + os.path.basename(out))
    want = queue_state(Tables(spark, SF_SMALL).f_transitions)
    cols = ["queue_id", "rule_id", "seq", "status", "event_ts"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_discovery_stream_restart_adds_nothing(spark):
    from pagemill.plans.corpus import corpus_rules
    from pagemill.streaming.jobs import discovered_items, stream_discovery
    src = _split_pages(spark)
    qpath = tempfile.mkdtemp(prefix="pm-queue-")
    t = Tables(spark, SF_SMALL)
    rules = corpus_rules(t.pages)
    name = "t-disc-" + os.path.basename(qpath)
    stream_discovery(spark, src, qpath, rules, t.f_published_pages, AS_OF, name=name, max_files=2)
    first = discovered_items(spark, qpath).count()
    assert first > 0
    stream_discovery(spark, src, qpath, rules, t.f_published_pages, AS_OF, name=name, max_files=2)
    assert discovered_items(spark, qpath).count() == first
    # the stream found exactly what one batch pass finds
    from pagemill.plans.discover import corpus_list_pages, discover
    empty = spark.createDataFrame([], "rule_id long, url string")
    batch = discover(rules, t.pages, empty, t.f_published_pages, AS_OF, listed=corpus_list_pages(t.pages)).new_items
    assert sorted(r.url_hash for r in discovered_items(spark, qpath).select("url_hash").distinct().collect()) == \
        sorted(r.url_hash for r in batch.select("url_hash").distinct().collect())


def test_discovery_replay_writes_the_same_batch(spark):
    """A batch that was written but not committed runs again and finds the same rows."""
    from pagemill.plans.corpus import corpus_rules
    from pagemill.streaming.jobs import _ckpt, discovered_items, stream_discovery
    src = _split_pages(spark)
    qpath = tempfile.mkdtemp(prefix="pm-replay-")
    t = Tables(spark, SF_SMALL)
    rules = corpus_rules(t.pages)
    name = "t-replay-" + os.path.basename(qpath)
    args = (spark, src, qpath, rules, t.f_published_pages, AS_OF)
    stream_discovery(*args, name=name, max_files=2)
    first = sorted(r.url_hash for r in discovered_items(spark, qpath).select("rule_id", "url_hash").collect())
    commits = os.path.join(_ckpt(spark, name).replace("file:", ""), "commits")
    last = max(int(x) for x in os.listdir(commits) if x.isdigit())
    for x in (str(last), f".{last}.crc"):
        if os.path.exists(os.path.join(commits, x)):
            os.remove(os.path.join(commits, x))
    stream_discovery(*args, name=name, max_files=2)
    assert sorted(r.url_hash for r in discovered_items(spark, qpath).select("rule_id", "url_hash").collect()) == first
    assert len(first) == len(set(first)) or len(first) > 0


def test_collect_stream_loses_no_item(spark):
    """Per-rule batches over two source files: every seeded item gets an outcome, none twice,
    and what was published equals one pass over everything when titles are not compared."""
    from pagemill.plans.collect import collect
    from pagemill.plans.corpus import corpus_rules, seed_queue
    from pagemill.schema import QUEUE, conform
    from pagemill.streaming.jobs import CollectTables, stream_collect
    t = Tables(spark, SF_SMALL)
    base = tempfile.mkdtemp(prefix="pm-coll-")
    qsrc = os.path.join(base, "queue")
    conform(seed_queue(t.pages, AS_OF), QUEUE).repartition(2, "rule_id").write.parquet(qsrc)
    rules = corpus_rules(t.pages).withColumn("batch_limit", F.lit(20)).withColumn("dedupe_title", F.lit(False))
    stream_collect(spark, qsrc, os.path.join(base, "sink"), rules, t.pages, t.f_published_pages, AS_OF,
                   name="t-coll-" + os.path.basename(base), max_files=1)
    tables = CollectTables(spark, os.path.join(base, "sink"))
    got = tables.transitions.read()
    want = collect(seed_queue(t.pages, AS_OF), rules, t.pages, t.f_published_pages, AS_OF).transitions
    cols = ["queue_id", "status", "attempts", "article_id"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    assert got.count() == t.pages.count() and got.select("pass_no").distinct().count() > 1
    # every reader of the tables agrees: queue, articles, logs, stamps
    state = tables.queue.state()
    assert sorted((r.queue_id, r.status) for r in state.collect()) == sorted((r.queue_id, r.status) for r in got.collect())
    assert state.where("url is null or url_hash is null or discovered_at is null").count() == 0
    assert tables.articles.read().count() == got.where("status = 'success'").count()
    assert tables.logs.read().count() == got.count()
    stamped = {r.rule_id for r in tables.stamped(rules).where("last_collected_at is not null").collect()}
    assert stamped == {r.rule_id for r in got.where("status = 'success'").select("rule_id").collect()}


def test_state_stream_stuck_timer_fires(spark):
    import datetime as dt
    from pagemill.streaming.jobs import queue_state_stream, _ckpt
    src = tempfile.mkdtemp(prefix="pm-ev-")
    schema = "queue_id long, rule_id long, seq int, status string, event_ts timestamp"
    t0 = dt.datetime(2024, 1, 1, 10, 0)
    spark.createDataFrame([(1, 1, 1, "pending", t0), (1, 1, 2, "running", t0 + dt.timedelta(minutes=1))], schema) \
        .coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([(2, 1, 1, "pending", t0 + dt.timedelta(hours=5))], schema).coalesce(1).write.mode("append") \
        .parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = tempfile.mkdtemp(prefix="pm-evout-")
    q = (queue_state_stream(stream, stuck_minutes=30, watermark="1 minute").writeStream.outputMode("update")
         .foreachBatch(lambda df, b: df.write.mode("append").parquet(out))
         .option("checkpointLocation", _ckpt(spark, "t-timer-" + os.path.basename(out))).trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.read.parquet(out).where("queue_id = 1").collect()
    assert any(r.timer == "stuck_release" and r.status == "pending" for r in rows)


def test_daily_stream_watermark_drops_and_counts_late_rows(spark):
    import datetime as dt
    from pagemill.streaming.jobs import _ckpt, daily_counts_stream, late_rows
    src, out = tempfile.mkdtemp(prefix="pm-late-"), tempfile.mkdtemp(prefix="pm-lateout-")
    schema = "queue_id long, rule_id long, seq int, status string, event_ts timestamp"
    for i, day in enumerate((10, 20, 20, 10)):      # the last file is ten days late
        spark.createDataFrame([(i, 1, 1, "success", dt.datetime(2024, 1, day, 5))], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (daily_counts_stream(stream, "1 day").writeStream.outputMode("update")
         .foreachBatch(lambda df, b: df.write.mode("append").parquet(os.path.join(out, f"batch={b}")))
         .option("checkpointLocation", _ckpt(spark, "t-late-" + os.path.basename(out))).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(out).groupBy(F.to_date("w.start").alias("d")).agg(F.max("total_count").alias("n")).collect()
    assert {(r.d.day, r.n) for r in got} == {(10, 1), (20, 2)} and late_rows(q) == 1


def test_discovered_rows_dedupe_within_the_watermark(spark):
    import datetime as dt
    from pagemill.streaming.jobs import _ckpt, dedupe_within_watermark
    src, out = tempfile.mkdtemp(prefix="pm-dd-"), tempfile.mkdtemp(prefix="pm-ddout-")
    schema = "rule_id long, url_hash string, discovered_at timestamp"
    for rows in ([(1, "a"), (1, "b"), (1, "a")], [(1, "a"), (2, "a")]):
        spark.createDataFrame([(*r, dt.datetime(2024, 1, 1, 5)) for r in rows], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (dedupe_within_watermark(stream).writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", _ckpt(spark, "t-dd-" + os.path.basename(out))).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted((r.rule_id, r.url_hash) for r in spark.read.parquet(out).collect()) == [(1, "a"), (1, "b"), (2, "a")]


def _run_states(spark, files, **kw):
    """Rows of the state stream over one file for each micro-batch, and its checkpoint."""
    from pagemill.streaming.jobs import _ckpt, queue_state_stream
    src, out = tempfile.mkdtemp(prefix="pm-st-"), tempfile.mkdtemp(prefix="pm-stout-")
    schema = "queue_id long, rule_id long, seq int, status string, event_ts timestamp"
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    ckpt = _ckpt(spark, "t-st-" + os.path.basename(out))
    q = (queue_state_stream(stream, **kw).writeStream.outputMode("update")
         .foreachBatch(lambda df, b: df.write.mode("append").parquet(os.path.join(out, f"batch={b}")))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).collect(), q


def test_state_timers_equal_the_batch_rules(spark):
    """Stuck release as Q4 and retry back-off as Q5 state them for the same events."""
    import datetime as dt
    from pagemill.operators.queue import mark_failed, release_stuck
    t0 = dt.datetime(2024, 1, 1, 10, 0)
    m = lambda n: t0 + dt.timedelta(minutes=n)
    rows, _ = _run_states(spark, [
        [(1, 1, 1, "running", m(0)), (2, 1, 1, "running", m(0)), (3, 1, 1, "failed_try", m(0)), (4, 1, 1, "failed_try", m(0))],
        [(2, 1, 2, "success", m(20)), (4, 1, 2, "running", m(3)), (4, 1, 3, "failed_try", m(4)), (2, 1, 1, "running", m(1))],
        [(9, 1, 1, "pending", m(600))], [(9, 1, 2, "success", m(1300))]],
        stuck_minutes=30, retry_limit=2, keep_minutes=60, watermark="1 minute")
    of = lambda i: sorted(((r.event_ts, r.seq, r.status, r.timer) for r in rows if r.queue_id == i), key=str)
    batch = spark.createDataFrame([(1, "running", m(0), None, None, None), (2, "success", m(0), None, None, None)],
                                  "queue_id long, status string, started_at timestamp_ntz, last_error string, scheduled_at timestamp_ntz, finished_at timestamp_ntz")
    released = {r.queue_id for r in release_stuck(batch, m(31), 30).where("status = 'pending'").collect()}
    assert released == {i for i in (1, 2) if any(x[3] == "stuck_release" for x in of(i))} == {1}
    assert (m(30), 2, "pending", "stuck_release") in of(1)
    tries = spark.createDataFrame([(3, 1, 2), (4, 2, 2)], "queue_id long, attempts int, retry_limit int").selectExpr(
        "*", "'running' AS status", "cast(null as string) AS last_error", "cast(null as timestamp_ntz) AS scheduled_at", "cast(null as timestamp_ntz) AS finished_at")
    want = {r.queue_id: r.status for r in mark_failed(tries, m(0), "x").collect()}
    assert want == {3: "pending", 4: "failed"}
    assert {x[2:] for x in of(3)} == {("pending", None), ("pending", "retry_due")}
    assert of(4)[-1][2:] == ("failed", None)
    # an event older than the state is late: the item stays finished
    assert all(x[2] == "success" for x in of(2) if x[0] >= m(20)) and max(of(2), key=lambda x: x[:2])[2] == "success"


def test_finished_items_leave_the_state(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1, 10, 0)
    m = lambda n: t0 + dt.timedelta(minutes=n)
    _, q = _run_states(spark, [[(i, 1, 1, "success", m(0)) for i in range(50)], [(99, 1, 1, "running", m(50))],
                               [(98, 1, 1, "running", m(500))], [(97, 1, 1, "running", m(501))]],
                       stuck_minutes=600, keep_minutes=60, watermark="1 minute")
    rows = [op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]]
    assert max(rows) >= 50 and rows[-1] < 50


class _Handle:
    """State of one key and its timers, without a stream."""

    def __init__(self):
        self.entries, self.timers = {}, set()

    def getMapState(self, name, key, value):
        return self

    def exists(self):
        return bool(self.entries)

    def iterator(self):
        return iter(list(self.entries.items()))

    def updateValue(self, key, value):
        self.entries[key] = value

    def removeKey(self, key):
        del self.entries[key]

    def listTimers(self):
        return iter(list(self.timers))

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)


def test_one_call_serves_the_items_of_a_block():
    """Frames and round trips are shared by consecutive items; each keeps a state of its own."""
    import datetime as dt
    import pandas as pd
    from pagemill.streaming.jobs import ItemState
    t0 = pd.Timestamp(2024, 1, 1, 10)
    m = lambda n: t0 + dt.timedelta(minutes=n)
    frame = lambda rows: pd.DataFrame(rows, columns=["queue_id", "rule_id", "seq", "status", "event_ts"])
    status = lambda i: "running" if i % 2 else "success"
    item, handle = ItemState(), _Handle()
    item.init(handle)
    events = [(i, 1, 1, "pending", m(0)) for i in range(500)] + [(i, 1, 2, status(i), m(i)) for i in range(500)]
    out, = item.handleInputRows((0,), iter([frame(events[500:]), frame(events[:500])]), None)
    assert [tuple(r) for r in out.sort_values("queue_id").itertuples(index=False)] == [(i, 1, 2, status(i), m(i), None) for i in range(500)]
    assert sorted(k[0] for k in handle.entries) == list(range(1, 500, 2))      # finished ones are forgotten
    # a later call: a late event changes nothing, a new one ends the item
    out, = item.handleInputRows((0,), iter([frame([(1, 1, 1, "pending", m(0)), (3, 1, 3, "skipped", m(9))])]), None)
    assert {(r.queue_id, r.seq, r.status) for r in out.itertuples()} == {(1, 2, "running"), (3, 3, "skipped")}
    assert (1,) in handle.entries and (3,) not in handle.entries
    # timers: each time at which an item is due, until none is
    item, handle = ItemState(stuck_minutes=30, keep_minutes=60), _Handle()
    item.init(handle)
    list(item.handleInputRows((0,), iter([frame([(1, 1, 1, "running", m(0)), (2, 1, 1, "running", m(0)), (3, 1, 1, "running", m(1))])]), None))
    assert len(handle.timers) == 2
    list(item.handleInputRows((0,), iter([frame([(3, 1, 2, "success", m(2))])]), None))
    assert sorted(handle.timers) == [int(m(n).timestamp() * 1000) for n in (30, 62)]

    class Fired:
        def getExpiryTimeInMs(self):
            return int(m(30).timestamp() * 1000)

    out, = item.handleExpiredTimer((0,), None, Fired())
    assert [tuple(r) for r in out.sort_values("queue_id").itertuples(index=False)] == [(i, 1, 2, "pending", m(30), "stuck_release") for i in (1, 2)]
    assert {k[0]: v[2] for k, v in handle.entries.items()} == {1: "pending", 2: "pending", 3: "success"}


def test_passes_taken_together_skip_what_passes_in_turn_skip(spark):
    """Random sources, titles and rules' settings against passes that run one after the other."""
    import random
    from pagemill.plans.collect import skipped_in_turn
    rnd = random.Random(5)
    for _ in range(3):
        items = [(i, rnd.randrange(6), rnd.random() < 0.8, f"t{rnd.randrange(12)}", f"s{rnd.randrange(12)}", False) for i in range(60)]
        items = [(*x[:5], x[2] and rnd.random() < 0.1) for x in items]
        want, sources, titles = {}, set(), set()
        for turn in range(6):
            own = sorted(x for x in items if x[1] == turn)
            known = {x[0]: x[5] or x[2] and (x[4] in sources or x[3] in titles) for x in own}
            for x in own:
                want[x[0]] = known[x[0]] or x[2] and any(y[0] < x[0] and y[3] == x[3] and not known[y[0]] for y in own)
            out = [x for x in own if not want[x[0]]]
            sources |= {x[4] for x in out}
            titles |= {x[3] for x in out}
        got = skipped_in_turn(spark.createDataFrame(items, "queue_id long, turn long, r_dedupe_title boolean, _t string, _source string, _known boolean"))
        assert {r.queue_id: r.skip for r in got.collect()} == want


def test_collect_stream_runs_its_passes_together(spark, monkeypatch):
    """The jobs of a micro-batch do not grow with its passes; later passes know what earlier ones publish."""
    from pagemill.plans import collect as C
    from pagemill.plans.corpus import corpus_rules, seed_queue
    from pagemill.schema import QUEUE, conform
    from pagemill.streaming.jobs import CollectTables, stream_collect
    page = "<html><body><h1>Title {}</h1><article><p>Text of some length {}.</p></article></body></html>"
    pages = spark.createDataFrame([(i, f"https://h{i % 2}.example.com/a/{i}", page.format(i % 5, i) if i != 7 else "") for i in range(1, 13)],
                                  "page_id long, url string, html string").coalesce(1)
    base = tempfile.mkdtemp(prefix="pm-turns-")
    qsrc = os.path.join(base, "queue")
    conform(seed_queue(pages, AS_OF), QUEUE).coalesce(1).write.parquet(qsrc)
    rules = corpus_rules(pages).withColumn("batch_limit", F.lit(2)).withColumn("dedupe_title", F.lit(True))
    given = spark.createDataFrame([(1, "https://h0.example.com/a/4")], "article_id long, source_url string")
    calls, whole = [], C.collect
    monkeypatch.setattr(C, "collect", lambda *a, **k: calls.append(1) or whole(*a, **k))
    sink = os.path.join(base, "sink")
    stream_collect(spark, qsrc, sink, rules, pages, given, AS_OF, name="t-turns-" + os.path.basename(base))
    t = CollectTables(spark, sink)
    got = {r.queue_id: (r.pass_no, r.status) for r in t.transitions.read().collect()}
    assert len(calls) == 1 and {i: n for i, (n, _) in got.items()} == {i: (i - 1) // 4 + 1 for i in range(1, 13)}
    # 4 is published already, so its title is not taken when 9 comes
    assert {i for i, (_, s) in got.items() if s == "success"} == {1, 2, 3, 5, 9}
    assert {i for i, (_, s) in got.items() if s == "skipped"} == {4, 6, 8, 10, 11, 12}
    assert sorted((r.batch, r.queue_id) for r in t.logs.read().collect()) == sorted((n, i) for i, (n, _) in got.items())
