import datetime as dt

from pyspark.sql import functions as F

from conftest import one
from pagemill.functions import text as C


def test_strip_collapse(spark):
    h = "<p>a <b>b</b></p><script>var t='</p>';</script><style>p{}</style><!-- c -->x < y"
    assert one(spark, C.strip_tags(F.col("h")), h=h) == "a bx < y"
    assert one(spark, C.collapse_ws(F.col("h")), h=" a  \n b ") == "a b"


def test_replacements(spark):
    pairs = C.parse_pairs(F.lit("a=>b\nb=>c\nno arrow\n=>z\nx =>"))
    assert one(spark, C.apply_replacements(F.col("t"), pairs), t="a x b") == "c  c"
    assert one(spark, C.apply_replacements(F.col("t"), C.parse_pairs(F.lit("q=>w"))), t="abc") == "abc"


def test_excerpt_clamp(spark):
    long = "word " * 300
    assert len(one(spark, C.excerpt(F.col("t"), 10), t=long)) == 50
    assert len(one(spark, C.excerpt(F.col("t"), 900), t=long)) == 500


def test_template_single_pass(spark):
    got = one(spark, C.render_template(F.lit("{title} / {excerpt} / {site}"), F.col("t"), F.lit("E"), F.lit("S"), F.lit("u")),
              t="<b>T {excerpt}</b>")
    assert got == "T {excerpt} / E / S"
    assert one(spark, C.render_template(F.lit(""), F.lit("T"), F.lit(""), F.lit(""), F.lit(""))) == "T"


def test_categories_tags(spark):
    rules = C.parse_category_rules(F.lit("zzz=>9\nHello => 4\nworld=>0"))
    assert one(spark, C.match_category(F.col("t"), rules), t="hello world") == 4
    assert one(spark, C.auto_tags(F.col("t"), F.array(F.lit("World"), F.lit("x"), F.lit("world"))), t="hello world") == \
        ["World", "world"]
    assert one(spark, C.fixed_tags(F.col("t")), t=" a, b ,,a,0") == ["a", "b", "0"]


def test_coerce_date(spark):
    want = dt.datetime(2023, 11, 14, 22, 13, 20)
    assert one(spark, C.coerce_date(F.col("d")), d="1700000000123") == want
    assert one(spark, C.coerce_date(F.col("d")), d="1700000000") == want
    assert one(spark, C.coerce_date(F.col("d")), d="2024-01-02") == dt.datetime(2024, 1, 2)
    assert one(spark, C.coerce_date(F.col("d")), d="2024/1/2") == dt.datetime(2024, 1, 2)
    assert one(spark, C.coerce_date(F.col("d")), d="text") is None
    assert one(spark, C.coerce_date(F.col("d")), d="") is None


def test_status_and_redaction(spark):
    assert one(spark, C.article_status(F.lit("bogus"), F.lit(None).cast("timestamp_ntz"))) == "draft"
    assert one(spark, C.article_status(F.lit("future"), F.lit(None).cast("timestamp_ntz"))) == "draft"
    r = one(spark, C.redact_excerpt(F.col("t"), 10), t="key sk-ABCDEFGHIJKLMNOP and Bearer abc.def")
    assert "sk-***" in r and "Bearer ***" in r and "ABCDEF" not in r
    assert one(spark, C.sanitize_json_source(F.col("s")), s="bad source!") == "__NEXT_DATA__"
    assert one(spark, C.sanitize_json_source(F.col("s")), s=" var:__S1 ") == "var:__S1"
