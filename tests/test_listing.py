"""Listings by key, and selectors that the engine refuses."""

import tempfile

import pytest
from pyspark.sql import functions as F, types as T

from pagemill.operators import reports as R
from pagemill.operators.selectors import compile_selector, refusal, refused_selectors
from pagemill.sources.listing import Listing

ROW = T.StructType([T.StructField("queue_id", T.LongType()), T.StructField("rule_id", T.LongType()), T.StructField("status", T.StringType())])


def listing(spark, n, block_rows=100):
    out = Listing(spark, tempfile.mkdtemp(prefix="pm-listing-") + "/l", ROW, "queue_id", block_rows)
    out.add(spark.range(n).select(F.col("id").alias("queue_id"), (F.col("id") % 3).alias("rule_id"),
                                  F.when(F.col("id") % 2 == 0, "failed").otherwise("pending").alias("status")))
    return out


def ids(df):
    return [r.queue_id for r in df.collect()]


def test_pages_chain_over_all_rows(spark):
    table, seen, after = listing(spark, 1000), [], None
    while page := ids(table.page(after, 70, F.col("status") == "failed")):
        seen += page
        after = page[-1]
    assert seen == list(range(998, -1, -2))


def test_deep_page_reads_as_few_files_as_the_first(spark):
    table = listing(spark, 4000)
    assert len(table.blocks()) == 40
    files = [len(table.page(after, 50).inputFiles()) for after in (None, 2100, 150)]
    assert files == [files[0]] * 3 and files[0] <= 2
    rare = table.page(None, 5, F.col("queue_id").isin(3950, 7, 3))       # few match: all blocks, once
    assert ids(rare) == [3950, 7, 3]


def test_listing_edges(spark):
    empty = Listing(spark, tempfile.mkdtemp(prefix="pm-listing-") + "/l", ROW, "queue_id")
    assert ids(empty.page()) == [] and empty.blocks() == []
    table = listing(spark, 10, 4)
    table.add(spark.createDataFrame([(-3, 1, "failed"), (None, 1, "failed"), (10, 1, "failed")], ROW))
    assert ids(table.page(None, 3)) == [10, 9, 8] and ids(table.page(1, 5)) == [0, -3] and ids(table.page(-3, 5)) == []
    rules = spark.createDataFrame([(1, "one")], "rule_id long, name string")
    got = {r.queue_id: r.rule_name for r in R.list_queue_after(table, rules, 9, 3, status="failed").collect()}
    assert got == {8: None, 6: None, 4: "one"}


@pytest.mark.parametrize("selector,reason", [
    ("h1", None), ("", None), (None, None), ("div > p.x", None), ('//a[@href="x"]', None), ("(//p)[2]", None),
    ("a:hover", "not a tag, #id or .class: a:hover"), ("p, div", "not a tag, #id or .class: p,"), (">", "no element named"),
    ("//a[last()]", "step not supported: a[last()]"), ('//a[@b="c"]/d', "attribute test before the last step"),
    ("(//p", "brackets without a position"), ("//", "step not supported: "), ("(p)[1]", "not a path of / and // steps"),
])
def test_refusal(selector, reason):
    assert refusal(selector) == reason
    assert (reason is None) == (compile_selector(selector).supported or not selector)


def test_refused_selectors(spark):
    rules = spark.createDataFrame([(1, "a:b", ["p", "q+r"]), (2, None, None), (3, "a:b", [None, ""])], "rule_id long, t string, l array<string>")
    got = {(r.rule_id, r.slot, r.selector) for r in refused_selectors(rules, {"title": F.col("t"), "remove": F.col("l")}).collect()}
    assert got == {(1, "title", "a:b"), (1, "remove", "q+r"), (3, "title", "a:b")}
