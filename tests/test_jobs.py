from pyspark.sql import functions as F

from conftest import SF_SMALL
from pagemill.fixtures import AS_OF, Tables
from pagemill.functions.urls import normalize_url
from pagemill.operators import extract as X
from pagemill.operators.selectors import sel_literal
from pagemill.operators.shred import shred
from pagemill.plans.collect import collect
from pagemill.plans.corpus import corpus_rules, seed_queue


def test_collect_semantics(spark):
    t = Tables(spark, SF_SMALL)
    rules = corpus_rules(t.pages)
    queue = seed_queue(t.pages, AS_OF)
    published = t.f_published_pages.withColumn("title", F.lit("")).withColumn("status", F.lit("publish"))
    res = collect(queue, rules, t.pages, published, AS_OF)
    tr = {r.queue_id: r for r in res.transitions.collect()}
    # every due item has exactly one outcome
    assert len(tr) == queue.count() == res.transitions.count()
    # published sources are skipped when the rule dedupes
    pub = {r.h for r in published.select(F.md5(normalize_url(F.col("source_url"))).alias("h")).collect()}
    ded = {r.rule_id: r.dedupe_title for r in rules.select("rule_id", "dedupe_title").collect()}
    for r in queue.select("queue_id", "rule_id", "url_hash").collect():
        if r.url_hash in pub and ded[r.rule_id]:
            assert tr[r.queue_id].status == "skipped"
    # titles of h1 rules without replacements are the page's first <h1> text
    arts = {r.article_id: r for r in res.articles.collect()}
    h1 = {r.page_id: r.t for r in shred(t.pages).select("page_id", X.select_text(sel_literal("h1")).alias("t")).collect()}
    plain = {r.rule_id for r in rules.where((F.col("title.selector") == "//h1") & (F.size("replacements") == 0))
             .select("rule_id").collect()}
    # rules with replacements have them applied ('%%% =>' deletes, '### => #')
    replaced = {r.rule_id for r in rules.where(F.size("replacements") > 0).select("rule_id").collect()}
    checked = replaced_checked = 0
    for qid, a in arts.items():
        assert a.status in ("draft", "publish", "future")
        if tr[qid].rule_id in plain:
            assert a.title == h1[qid]
            checked += 1
        if tr[qid].rule_id in replaced:
            assert "%%%" not in a.title and "###" not in a.title and "%%%" not in a.content
            replaced_checked += 1
    assert checked > 0 and replaced_checked > 0


def _items(spark, rows):
    return spark.createDataFrame(rows, "queue_id long, url string")


def test_page_scan_gates_and_cuts(spark):
    from pagemill.plans.collect import MSG_FETCH, page_scan
    big = "é" * 50
    pages = spark.createDataFrame([(1, "https://a.example.com/x", big), (2, "https://a.example.com/y", ""), (3, "https://a.example.com/x/", "later")],
                                  "page_id long, url string, html string")
    items = _items(spark, [(10, "https://a.example.com/x"), (11, "https://a.example.com/y"), (12, "http://127.0.0.1/z"), (13, "https://a.example.com/none")])
    whole = {r.queue_id: r for r in page_scan(items, pages).collect()}
    assert whole[10].html == big and whole[10].fetch_error is None
    assert whole[11].fetch_error == MSG_FETCH and whole[13].fetch_error == MSG_FETCH and whole[12].fetch_error == "unsafe URL"
    cut = {r.queue_id: r for r in page_scan(items, pages, page_bytes=51).collect()}   # splits a two-byte character
    assert cut[10].html.startswith("é" * 25) and len(cut[10].html) <= 26


def test_skipped_item_does_not_hide_its_title(spark):
    """Of two pages with one title the first is already published under another title: the
    second publishes."""
    page = "<html><body><h1>Same title</h1><article><p>" + "word " * 60 + "</p></article></body></html>"
    pages = spark.createDataFrame([(1, "https://a.example.com/one", page), (2, "https://a.example.com/two", page),
                                   (3, "https://a.example.com/three", page)], "page_id long, url string, html string")
    rules = corpus_rules(pages).withColumn("dedupe_title", F.lit(True)) \
        .withColumn("title", F.col("title").withField("selector", F.lit("//h1")).withField("before", F.lit("")).withField("after", F.lit(""))) \
        .withColumn("content", F.col("content").withField("selector", F.lit("//article")).withField("before", F.lit("")).withField("after", F.lit("")))
    published = spark.createDataFrame([("https://a.example.com/one", "Other title", "publish")], "source_url string, title string, status string")
    res = collect(seed_queue(pages, AS_OF), rules, pages, published, AS_OF)
    got = {r.queue_id: r.status for r in res.transitions.collect()}
    assert got == {1: "skipped", 2: "success", 3: "skipped"}
    assert {r.queue_id: r.article_id for r in res.transitions.collect()} == {1: None, 2: 2, 3: None}
    assert res.last_collected.count() == 1


def test_collect_applies_rewrites_by_policy(spark):
    import json
    from pagemill.operators.rewrite import MSG_EMPTY
    body = "word " * 60
    pages = spark.createDataFrame(
        [(i, f"https://h{i}.example.com/p", f"<html><body><h1>Title {i}</h1><article><p>{body}{i}</p></article></body></html>") for i in range(1, 5)],
        "page_id long, url string, html string")
    rules = corpus_rules(pages).withColumn("rewrite", F.col("name") != "h4.example.com").withColumn("replacements", F.expr("slice(replacements, 1, 0)")) \
        .withColumn("retry_limit", F.lit(1)).withColumn("rewrite_on_failure", F.when(F.col("name") == "h3.example.com", "fail").otherwise("fallback")) \
        .withColumn("title", F.col("title").withField("selector", F.lit("//h1")).withField("before", F.lit("")).withField("after", F.lit(""))) \
        .withColumn("content", F.col("content").withField("selector", F.lit("//article")).withField("before", F.lit("")).withField("after", F.lit("")))
    good = json.dumps({"title": "New", "content": "<p>" + "fresh " * 60 + "</p>"})
    responses = spark.createDataFrame([(1, good), (2, "")], "queue_id long, response string")
    none = spark.createDataFrame([], "source_url string, title string, status string")
    res = collect(seed_queue(pages, AS_OF), rules, pages, none, AS_OF, responses=responses)
    got = {r.queue_id: (r.status, r.last_error) for r in res.transitions.collect()}
    assert got == {1: ("success", None), 2: ("success", None), 3: ("failed", MSG_EMPTY), 4: ("success", None)}
    arts = {r.article_id: r for r in res.articles.collect()}
    assert arts[1].title == "New" and "fresh" in arts[1].content and arts[2].title == "Title 2" and arts[4].title == "Title 4"
