"""Keyword lists over texts: against the one-by-one expressions, list bounds, blocks."""

import random

from pyspark.sql import functions as F

from pagemill.functions import text as C
from pagemill.operators.keywords import first_category, hit_tags, keyword_hits

ROWS = "list_id string, pos int, keyword string, value long"


def test_hits_by_list_and_position(spark):
    kws = spark.createDataFrame([("a", 0, "zebra", 9), ("a", 1, "Ab", 0), ("a", 2, "b", 4), ("a", 3, "ab", 7), ("b", 0, "x", 3),
                                 ("a", 4, "", 1), ("a", 5, None, 1), (None, 0, "b", 1), ("a", 6, "été", 2)], ROWS)
    docs = spark.createDataFrame([(1, "a", "xABx"), (2, "b", "xABx"), (3, "c", "b"), (4, None, "b"), (5, "a", None), (6, "a", ""),
                                  (7, "a", "En ÉTÉ"), (8, "a", "😀b")], "id long, l string, t string")
    got = {r.id: (r.c, r.tags) for r in keyword_hits(docs, F.col("t"), F.col("l"), kws)
           .select("id", first_category(F.col("hits")).alias("c"), hit_tags(F.col("hits")).alias("tags")).collect()}
    assert got == {1: (4, ["Ab", "b", "ab"]), 2: (3, ["x"]), 3: (0, []), 4: (0, []), 5: (0, []), 6: (0, []), 7: (2, ["été"]), 8: (4, ["b"])}


def test_empty_lists_and_rows(spark):
    docs = spark.createDataFrame([(1, "a", "x")], "id long, l string, t string")
    none = spark.createDataFrame([], ROWS)
    assert keyword_hits(docs, F.col("t"), F.col("l"), none).select("hits").collect()[0][0] == []
    some = spark.createDataFrame([("a", 0, "x", 1)], ROWS)
    assert keyword_hits(docs.limit(0), F.col("t"), F.col("l"), some).count() == 0


def test_equals_one_by_one_in_any_blocks(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcAB") for _ in range(rng.randint(1, 4)))
    words = [(word(), rng.randint(0, 3)) for _ in range(120)]
    docs = spark.createDataFrame([(i, "l", " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(60)],
                                 "id long, l string, t string")
    kws = spark.createDataFrame([("l", i, w, v) for i, (w, v) in enumerate(words)], ROWS)
    rules = F.array(*[F.struct(F.lit(w).alias("keyword"), F.lit(v).cast("long").alias("category_id")) for w, v in words])
    want = {r.id: (r.c, r.tags) for r in docs.select("id", C.match_category(F.col("t"), rules).alias("c"), C.auto_tags(
        F.col("t"), F.array(*[F.lit(w) for w, _ in words])).alias("tags")).collect()}
    for size in (1 << 20, 50, 1):
        out = keyword_hits(docs, F.col("t"), F.col("l"), kws if size > 1 else kws.where("pos < 12"), block_chars=size)
        got = {r.id: (r.c, r.tags) for r in out.select("id", first_category(F.col("hits")).alias("c"), hit_tags(F.col("hits")).alias("tags")).collect()}
        if size > 1:
            assert got == want
        else:
            few = {w for w, _ in words[:12]}
            assert {i: t for i, (_, t) in got.items()} == {i: [w for w in t if w in few] for i, (_, t) in want.items()}


def test_ten_thousand_keywords_one_pass(spark):
    kws = spark.range(10000).select(F.lit("l").alias("list_id"), F.col("id").cast("int").alias("pos"),
                                    F.concat(F.lit("key"), F.col("id").cast("string"), F.lit(";")).alias("keyword"), F.col("id").alias("value"))
    docs = spark.range(200).select("id", F.concat(F.repeat(F.lit("filler "), 200), F.lit("KEY"), (F.col("id") * 7).cast("string"), F.lit(";")).alias("t"))
    out = keyword_hits(docs, F.col("t"), F.lit("l"), kws).select("id", "hits.keyword").collect()
    assert all(r.keyword == [f"key{r.id * 7};"] for r in out) and len(out) == 200
