"""Response status in collect and discovery; manual URLs in discovery; free dates in coercion."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_SMALL, one
from pagemill.fixtures import AS_OF
from pagemill.functions.text import coerce_date
from pagemill.plans.collect import collect, page_scan
from pagemill.plans.corpus import corpus_rules, seed_queue
from pagemill.plans.discover import discover

PAGE = "page_id long, url string, html string, status int"


def test_status_of_the_page_that_is_read(spark):
    pages = spark.createDataFrame([(1, "https://a.example.com/1", "x", 404), (2, "https://a.example.com/1", "x", 200), (3, "https://a.example.com/3", "x", None),
                                   (4, "https://a.example.com/4", "", 500), (5, "https://a.example.com/5", "", 204), (6, "https://a.example.com/6", "x", 299)], PAGE)
    items = spark.createDataFrame([(i, f"https://a.example.com/{i}") for i in (1, 3, 4, 5, 6, 7)], "queue_id long, url string")
    got = {r.queue_id: (r.html, r.fetch_error) for r in page_scan(items, pages).collect()}
    assert got == {1: (None, "HTTP status 404"), 3: ("x", None), 4: (None, "HTTP status 500"), 5: (None, "page fetch failed"), 6: ("x", None),
                   7: (None, "page fetch failed")}


def test_status_fails_items_of_the_collect_job(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").limit(8)
    gone = {r.page_id for r in pages.collect()[:3]}
    pages = pages.withColumn("status", F.when(F.col("page_id").isin(*gone), 503).otherwise(200))
    none = spark.createDataFrame([], "article_id long, source_url string, title string, status string")
    res = collect(seed_queue(pages, AS_OF), corpus_rules(pages), pages, none, AS_OF)
    lost = {r.queue_id for r in res.transitions.where(F.col("last_error") == "HTTP status 503").collect()}
    assert lost == gone and not {r.queue_id for r in res.articles.collect()} & gone


def test_discovery_queues_manual_urls_first(spark):
    pages = spark.createDataFrame([(1, "https://l.example.com/list", '<a href="/x">x</a><a href="/m2">m</a>', 200),
                                   (2, "https://l.example.com/gone", '<a href="/never">x</a>', 410)], PAGE)
    rules = corpus_rules(pages.limit(1)).withColumn("manual_urls_text", F.lit("https://l.example.com/m1\nnot a url\nhttps://l.example.com/m2\n"))
    rid = rules.first().rule_id
    listed = spark.createDataFrame([(rid, 0, "https://l.example.com/list"), (rid, 1, "https://l.example.com/gone")], "rule_id long, list_pos int, url string")
    none = spark.createDataFrame([], "article_id long, source_url string, title string, status string")
    rules = rules.withColumn("request_delay", F.lit(10))
    new = discover(rules, pages, seed_queue(pages.limit(0), AS_OF), none, AS_OF, listed=listed).new_items
    order = [r.url for r in new.orderBy("scheduled_at", "url").collect()]
    assert sorted(order) == [f"https://l.example.com/{x}" for x in ("m1", "m2", "x")]
    assert order == [f"https://l.example.com/{x}" for x in ("m1", "m2", "x")]


def test_coercion_takes_free_dates(spark):
    now = F.lit(AS_OF).cast("timestamp_ntz")
    assert one(spark, coerce_date(F.col("d"), now), d="2 days ago") == dt.datetime(2024, 1, 28, 23, 59, 59)
    assert one(spark, coerce_date(F.col("d")), d="2 days ago") is None
    assert one(spark, coerce_date(F.col("d")), d="Tue, 2 Jan 2024 03:04 EST") == dt.datetime(2024, 1, 2, 8, 4)
