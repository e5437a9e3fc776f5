import datetime as dt

from pyspark.sql import Window, functions as F

from pagemill.operators import queue as Q
from pagemill.operators.joins import rank_in_group

AS_OF = "2024-01-30 12:00:00"


def test_mark_failed_backoff(spark):
    rows = [(1, 1, 3), (2, 2, 3), (3, 12, 3), (4, 1, 0)]
    df = spark.createDataFrame(rows, "queue_id long, attempts int, retry_limit int").withColumn("status", F.lit("running")) \
        .withColumn("last_error", F.lit(None).cast("string")).withColumn("scheduled_at", F.lit(None).cast("timestamp_ntz")) \
        .withColumn("finished_at", F.lit(None).cast("timestamp_ntz"))
    out = {r.queue_id: r for r in Q.mark_failed(df, AS_OF, "boom").collect()}
    now = dt.datetime(2024, 1, 30, 12)
    assert out[1].status == "pending" and out[1].scheduled_at == now + dt.timedelta(seconds=300)
    assert out[2].status == "pending" and out[2].scheduled_at == now + dt.timedelta(seconds=600)
    assert out[3].status == "failed" and out[3].scheduled_at == now
    assert out[4].status == "failed" and out[4].last_error == "boom"


def test_queue_state_order_independent(spark):
    ev = [(1, 1, 1, "pending", dt.datetime(2024, 1, 1)), (1, 1, 2, "running", dt.datetime(2024, 1, 2)),
          (1, 1, 3, "success", dt.datetime(2024, 1, 2)), (2, 1, 1, "pending", dt.datetime(2024, 1, 1))]
    schema = "queue_id long, rule_id long, seq int, status string, event_ts timestamp_ntz"
    a = Q.queue_state(spark.createDataFrame(ev, schema)).orderBy("queue_id").collect()
    b = Q.queue_state(spark.createDataFrame(list(reversed(ev)), schema).repartition(3)).orderBy("queue_id").collect()
    assert a == b and a[0].status == "success"


def test_rank_in_group_exact_under_skew(spark):
    """Payload columns, a hot group, inputs above the range sample: contiguous ranks and all
    rows at any number of partitions."""
    rows = spark.range(0, 6000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 40).alias("g"), F.hash("id").alias("pos"), "id",
        F.md5(F.col("id").cast("string")).alias("payload"))
    for n in (2, 4, 8, 200):
        got = rank_in_group(rows, ["g"], ["pos", "id"], "r", partitions=n)
        per = got.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"),
                                   F.countDistinct("r").alias("d")).collect()
        assert sum(r.n for r in per) == 6000 and all(r.lo == 1 and r.hi == r.n == r.d for r in per)
        w = Window.partitionBy("g").orderBy("pos", "id")
        assert got.withColumn("want", F.row_number().over(w)).where("want <> r").isEmpty()


def test_enqueue_dedupes_and_spaces(spark):
    links = spark.createDataFrame([(1, "https://a.example.com/x/", 0), (1, "https://A.example.com/x?utm_source=q", 1),
                                   (1, "https://a.example.com/y", 2), (1, "http://127.0.0.1/z", 3),
                                   (2, "https://a.example.com/x", 0)], "rule_id long, url string, pos long")
    queue = spark.createDataFrame([(2, "https://a.example.com/x")], "rule_id long, url string")
    arts = spark.createDataFrame([("https://a.example.com/y",)], "source_url string")
    rules = spark.createDataFrame([(1, 5), (2, 0)], "rule_id long, request_delay int")
    out = Q.enqueue(links, queue, arts, rules, AS_OF).orderBy("rule_id", "pos").collect()
    assert [(r.rule_id, r.url, r.offset) for r in out] == [(1, "https://a.example.com/x", 0)]


def test_dedupe_title_and_batch_first(spark):
    items = spark.createDataFrame([(1, "A"), (2, "<b>A</b>"), (3, "B"), (4, "C")], "queue_id long, title string")
    arts = spark.createDataFrame([("C", "publish"), ("B", "trash")], "title string, status string")
    kept, skipped = Q.dedupe_title(items, arts)
    assert sorted(r.queue_id for r in skipped.collect()) == [4]
    firsts = {r.queue_id: r.batch_duplicate for r in Q.first_of_equal_titles(items).collect()}
    assert firsts == {1: False, 2: True, 3: False, 4: False}
