import json

from pyspark.sql import functions as F

from conftest import one
from pagemill.operators import images as I
from pagemill.operators.preview import preview_links
from pagemill.schema import QUEUE, conform
from pagemill.sources import rules_io as RIO
from pagemill.sources.sinks import diagnostics


def test_image_sources_vectors(spark):
    html = ('<img src=" " data-src="/a.jpg" srcset="/b.png 1x, /c.webp 2x"><img data-echo="/d.gif">'
            '<div style="background-image: url(\'/e.jpeg\')"></div><img src="/a.jpg">')
    assert one(spark, I.image_sources(F.col("h")), h=html) == ["/a.jpg", "/b.png", "/c.webp", "/d.gif", "/e.jpeg"]


def test_image_pipeline_cap_and_localise(spark):
    arts = spark.createDataFrame([(1, "https://s.example.com/p/1",
                                   '<img src="/1.jpg"><img src="/2.svg"><img src="http://10.0.0.1/x.png">'
                                   '<img src="/3.png"><img src="/4.jpg"><img src="/5.jpg">')],
                                 "article_id long, source_url string, content string")
    assets = spark.createDataFrame([("https://s.example.com/1.jpg", 10, "image/jpeg"),
                                    ("https://s.example.com/3.png", 10, "text/html"),
                                    ("https://s.example.com/4.jpg", 10, "image/jpeg"),
                                    ("https://s.example.com/5.jpg", 10, "image/jpeg")], "url string, bytes long, mime string")
    capped = I.image_cap(I.image_gate(I.image_candidates(arts), assets), 2)
    st = [r.status for r in capped.orderBy("pos").collect()]
    assert st == ["downloaded", "skipped", "failed", "failed", "downloaded", "unprocessed"]
    out = I.localize_images(arts, assets, 2).collect()[0]
    assert out.downloaded == 2 and out.failed == 2 and out.skipped == 1 and out.found == 6
    assert out.featured_image.startswith("/uploads/") and '"/1.jpg"' not in out.content and '"/5.jpg"' in out.content
    assert out.image_warning is True


def test_validate_rules_vectors(spark):
    rules = spark.createDataFrame([(1, "-7", 99, 77, 0, 0, 5, 2, 900, "bogus", "weird", "x", "retry", "bad!")],
                                  "rule_id long, batch_limit string, retry_limit int, request_delay int, page_start int, "
                                  "page_end int, publish_delay_min int, publish_delay_max int, excerpt_length int, "
                                  "post_status string, publish_mode string, seo_family string, rewrite_on_failure string, "
                                  "json_source string")
    v = RIO.validate_rules(rules).collect()[0]
    assert (v.batch_limit, v.retry_limit, v.request_delay, v.page_start, v.page_end) == (7, 10, 30, 1, 1)
    assert (v.publish_delay_min, v.publish_delay_max, v.excerpt_length) == (5, 5, 500)
    assert (v.post_status, v.publish_mode, v.seo_family, v.rewrite_on_failure, v.json_source) == \
        ("draft", "immediate", "none", "fallback", "__NEXT_DATA__")
    assert "batch_limit" in v.violations and "json_source" in v.violations


def test_conform_adds_missing_columns(spark):
    df = spark.createDataFrame([(1, "https://x.example.com/")], "queue_id long, url string")
    out = conform(df, QUEUE, {"attempts": 0, "status": "pending"})
    assert out.columns == [f.name for f in QUEUE.fields]
    r = out.collect()[0]
    assert r.attempts == 0 and r.status == "pending" and r.url_hash is None


def test_diagnostics_document(spark):
    from pagemill.fixtures import Tables
    from conftest import SF_SMALL
    t = Tables(spark, SF_SMALL)
    doc = json.loads(diagnostics(t.f_rules, t.f_queue, t.f_logs, "2024-01-30 12:00:00").collect()[0].report)
    assert set(doc["counts"]["queue"]) == {"pending", "running", "success", "failed", "skipped"}
    assert len(doc["recent_errors"]) <= 20 and len(doc["failed_samples"]) <= 20


def test_preview_links_counts(spark):
    links = spark.createDataFrame([(1, i, f"https://s.example.com/a/{i}") for i in range(60)], "page_id long, pos int, url string")
    arts = spark.createDataFrame([("https://s.example.com/a/3",), ("https://s.example.com/a/55",)], "source_url string")
    p = preview_links(links, arts).collect()[0]
    assert (p.links, p.ready, p.duplicates) == (50, 49, 1)
    assert len(p.ready_sample) == 20 and len(p.duplicate_sample) == 1


def test_preview_links_counts_all_links(spark):
    links = spark.createDataFrame([(1, i, f"https://s.example.com/a/{i}") for i in range(300)], "page_id long, pos int, url string")
    arts = spark.createDataFrame([("https://s.example.com/a/3",), ("https://s.example.com/a/255",)], "source_url string")
    p = preview_links(links, arts, most=None).collect()[0]
    assert (p.links, p.ready, p.duplicates) == (300, 298, 2)
    assert len(p.ready_sample) == 20 and [x.pos for x in p.duplicate_sample] == [3, 255]


def test_sinks_idempotent_and_queue_fold(spark):
    import datetime as dt
    import tempfile
    from pagemill.sources.sinks import read_queue, write_articles, write_queue
    d = tempfile.mkdtemp(prefix="pm-sink-")
    arts = spark.createDataFrame([(1, "T", "publish"), (2, "U", "draft")], "article_id long, title string, status string")
    write_articles(arts, d + "/articles", batch_id=7)
    write_articles(arts, d + "/articles", batch_id=7)          # replayed batch: overwritten, not appended
    assert spark.read.parquet(d + "/articles").count() == 2
    t0 = dt.datetime(2024, 1, 1)
    ev1 = spark.createDataFrame([(1, 1, "pending", 1, t0), (2, 1, "pending", 1, t0)],
                                "queue_id long, rule_id long, status string, seq int, event_ts timestamp_ntz")
    ev2 = spark.createDataFrame([(1, 1, "running", 2, t0 + dt.timedelta(minutes=1)),
                                 (1, 1, "success", 3, t0 + dt.timedelta(minutes=2))],
                                "queue_id long, rule_id long, status string, seq int, event_ts timestamp_ntz")
    write_queue(ev1, d + "/queue", batch_id=0)
    write_queue(ev2, d + "/queue", batch_id=1)
    state = {r.queue_id: r.status for r in read_queue(spark, d + "/queue").collect()}
    assert state == {1: "success", 2: "pending"}
