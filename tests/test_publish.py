"""The publish filter, embedded JSON, rule imports, and pages read in part."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import one
from pagemill.functions import text as C
from pagemill.functions.jsonpage import page_json

HOSTILE = {
    '<p onclick="x()">a</p>': "<p>a</p>",
    "<P STYLE='color:red' Class=k>a</P >": "<p Class=k>a</p>",
    '<a href="javascript:alert(1)">a</a>': "<a>a</a>",
    '<a href=" java\tscript:alert(1)" title="t">a</a>': '<a title="t">a</a>',
    '<a href="&#106;avascript:alert(1)">a</a>': "<a>a</a>",
    '<a href="javascript&colon;alert(1)">a</a>': "<a>a</a>",
    "<a href=data:text/html,x>a</a>": "<a>a</a>",
    '<a href="HTTPS://e.com/a:b?c=&amp;d">a</a>': '<a href="HTTPS://e.com/a:b?c=&amp;d">a</a>',
    '<a href="/x/y:z" rel="nofollow">a</a>': '<a href="/x/y:z" rel="nofollow">a</a>',
    '<a href="mailto:a@b.c">a</a>': '<a href="mailto:a@b.c">a</a>',
    '<img src=x onerror=alert(1) alt="a > b">': '<img src=x alt="a > b">',
    "<img src='vbscript:x'/>": "<img>",
    "<svg/onload=alert(1)><p>a": "<p>a",
    '<iframe src="//e.com"></iframe>b': "b",
    "<scr<script>x</script>ipt>alert(1)</script>": "alert(1)",
    "<p title=\"unclosed onclick=x()>a": "&lt;p title=\"unclosed onclick=x()>a",
    "1 < 2 <b>c</b> <": "1 &lt; 2 <b>c</b> &lt;",
    "<!-- <p onclick=x> --><td colspan=2 bgcolor=red>": "<td colspan=2>",
    '<video controls poster="javascript:x" src="/v.mp4"></video>': '<video controls src="/v.mp4"></video>',
    "": "", "plain": "plain",
}


@pytest.mark.parametrize("html,want", HOSTILE.items())
def test_publish_filter(spark, html, want):
    assert one(spark, C.allow_html(F.col("h")), h=html) == want


def test_filtered_twice_is_filtered_once(spark):
    d = spark.createDataFrame([(h,) for h in HOSTILE], "h string").select(C.allow_html(F.col("h")).alias("a"))
    assert d.where(C.allow_html(F.col("a")) != F.col("a")).count() == 0


def test_unescape_keeps_nulls_and_plain_texts(spark):
    d = spark.createDataFrame([(None,), ("plain",), ("&eacute;&nbsp;&amp;lt;",), ("",)], "t string")
    assert [r.v for r in d.select(C.html_unescape(F.col("t")).alias("v")).collect()] == [None, "plain", "é\xa0&lt;", ""]


PAGES = [("<script id='__NEXT_DATA__' type=x>{\"a\":1}</script>", "", '{"a":1}'),
         ("<script>1</script><SCRIPT data-id='no' ID=\"__next_data__\"> {&quot;a&quot;:2} </SCRIPT>", "next", '{"a":2}'),
         ("<script type=\"application/ld+json\">{\"a\":1}</script><script type='application/ld+json'>[2]</script><script type='application/ld+json'>x</script>", "ld+json", '[{"a":1},[2]]'),
         ("<script id=\"s\">[1]</script>", "id:s", "[1]"), ("<script id=\"s\">[1]</script>", "id:t", None),
         ("<script>window.D = {\"a\":{\"b\":\"}\"}} ; D = [1]</script>", "var:D", '{"a":{"b":"}"}}'),
         ("<script>D=[1,[2]]</script>", "var:D", "[1,[2]]"), ("no script", "", None), (None, "", None)]


def test_page_json_sources(spark):
    d = spark.createDataFrame([(i, h, s) for i, (h, s, _) in enumerate(PAGES)], "i int, h string, s string")
    got = {r.i: r.v for r in d.select("i", page_json(F.col("h"), F.col("s")).alias("v")).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(PAGES)}


def test_broken_rules_are_refused_with_reasons(spark):
    from pyspark.sql import types as T
    from pagemill.sources.rules_io import import_rules, refused_rules
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("page_start", T.IntegerType())])
    path = tempfile.mkdtemp(prefix="pm-rules-")
    with open(os.path.join(path, "a.json"), "w") as f:
        f.write('{"name": "one", "page_start": 2, "unknown": 1}\n{"name": "cut\n\n"text"\n{"name": "two", "page_start": "many"}\n')
    with open(os.path.join(path, "b.json"), "w") as f:
        f.write('{"version": 1, "rules": [{"name": "three"}, 7, {"page_start": 4}]}\n')
    got = [tuple(r) for r in import_rules(spark, path, {"name": "none", "page_start": 1}, schema).orderBy("rule_id").collect()]
    assert got == [(1, "one", 2), (2, "three", 1), (3, "none", 4)]
    assert [(r.pos, r.reason) for r in refused_rules(spark, path, schema).orderBy("pos").collect()] == [
        (1, "not valid JSON"), (2, "not an object"), (3, "a value does not fit its key"), (5, "not an object")]


def test_export_has_no_ids_and_keeps_the_order(spark):
    from pyspark.sql import types as T
    from pagemill.sources.rules_io import export_rules, import_rules
    rules = spark.range(1, 701).select(F.col("id").alias("rule_id"), F.concat(F.lit("n"), F.col("id")).alias("name"),
                                       F.lit(None).cast("timestamp").alias("created_at")).repartition(7)
    path = os.path.join(tempfile.mkdtemp(prefix="pm-export-"), "x")
    export_rules(rules, path)
    assert spark.read.json(path).columns == ["name"]
    back = import_rules(spark, path, {}, T.StructType([T.StructField("name", T.StringType())]))
    assert sorted((r.rule_id, r.name) for r in back.collect()) == [(i, f"n{i}") for i in range(1, 701)]


def test_page_read_in_part_is_not_published(spark):
    from pagemill.plans.collect import MSG_PART, collect
    from pagemill.plans.corpus import corpus_rules, seed_queue
    as_of = "2024-01-01 00:00:00"
    body = "<html><body><h1>Title</h1><article><p>Some body text.</p></article>{}</body></html>"
    deep = "<div>" * 1500 + "x" + "</div>" * 1500
    pages = spark.createDataFrame([(1, "https://a.example.com/1", body.format("")), (2, "https://a.example.com/2", body.replace("Title", "Other").format(deep))],
                                  "page_id long, url string, html string")
    none = spark.createDataFrame([], "source_url string")
    res = collect(seed_queue(pages, as_of), corpus_rules(pages), pages, none, as_of)
    got = {r.queue_id: (r.status, r.last_error) for r in res.transitions.collect()}
    assert got[1][0] == "success" and got[2][0] != "success" and got[2][1].startswith(MSG_PART)
    assert [r.queue_id for r in res.articles.collect()] == [1]
