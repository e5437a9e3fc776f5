from pyspark.sql import functions as F

from conftest import one
from pagemill.functions import urls as U


def test_normalize_url_vectors(spark):
    cases = {
        "HTTPS://Example.COM/a/b/?utm_source=x&id=3&from=y#frag": "HTTPS://example.com/a/b/?id=3",
        "https://example.com/?utm_source=x&utm_medium=y": "https://example.com",
        "https://example.com/p?a=1&spm=2": "https://example.com/p?a=1",
        "https://user:pw@example.com:8080/x/": "https://example.com:8080/x",
        "mailto:x": "mailto:x",
        "  https://example.com/a  ": "https://example.com/a",
        "": "",
    }
    for raw, want in cases.items():
        assert one(spark, U.normalize_url(F.col("u")), u=raw) == want, raw


def test_normalize_is_idempotent(spark):
    for raw in ["https://A.b/c/?utm_term=1&q=2#x", "http://x.org", "https://x.org/a//"]:
        n1 = one(spark, U.normalize_url(F.col("u")), u=raw)
        assert one(spark, U.normalize_url(F.col("u")), u=n1) == n1


def test_public_url_and_ip(spark):
    unsafe = ["http://localhost/x", "https://a.local/", "http://127.0.0.1/", "http://10.1.2.3/", "http://172.16.0.1/",
              "http://192.168.1.1/", "http://169.254.1.1/", "http://0.0.0.0/", "http://240.0.0.1/", "http://[::1]/",
              "http://[fc00::1]/", "ftp://example.com/x", "https://us er@example.com/", "https://ex ample.com/"]
    safe = ["http://8.8.8.8/x", "https://example.com/a?b=1", "https://sub.example.org"]
    for u in unsafe:
        assert one(spark, U.is_safe_public_url(F.col("u")), u=u) is False, u
    for u in safe:
        assert one(spark, U.is_safe_public_url(F.col("u")), u=u) is True, u
    assert one(spark, U.is_public_ip(F.col("u")), u="300.1.1.1") is False


def test_absolute_url_vectors(spark):
    base = "https://site.example.com/news/2024/item.html"
    cases = {
        "//cdn.example.net/x.png": "https://cdn.example.net/x.png",
        "/x": "https://site.example.com/x",
        "x": "https://site.example.com/news/2024/x",
        "node/1": "https://site.example.com/node/1",
        "newsroom": "https://site.example.com/newsroom",
        "https://other.example.org/a": "https://other.example.org/a",
        "/a?b=1&amp;c=2": "https://site.example.com/a?b=1&c=2",
    }
    for src, want in cases.items():
        assert one(spark, U.absolute_url(F.col("s"), F.col("b")), s=src, b=base) == want, src
    assert one(spark, U.absolute_url(F.col("s"), F.col("b")), s="x", b="https://h.example.com") == "https://h.example.com/x"


def test_lines_and_list_pages(spark):
    assert one(spark, U.lines(F.col("t")), t=" a \r\n\nb\r0\n  ") == ["a", "b", "0"]
    got = one(spark, U.list_page_urls(F.lit(""), F.lit("https://l.example.com/p/{page}"), F.lit(0), F.lit(3)))
    assert got == [f"https://l.example.com/p/{i}" for i in range(1, 4)]
    assert one(spark, F.size(U.list_page_urls(F.lit(""), F.lit("https://l.example.com/{page}"), F.lit(1), F.lit(900)))) == 501
    assert one(spark, U.list_page_urls(F.lit(""), F.lit("https://l.example.com/{page}"), F.lit(5), F.lit(2))) == \
        ["https://l.example.com/5"]
    assert one(spark, U.list_page_urls(F.lit(""), F.lit("https://l.example.com/x"), F.lit(1), F.lit(3))) == []


def test_clamp_and_ext(spark):
    for raw, want in {"12": 12, "12.9": 12, "abc": 5, "": 5, "-4": 1, "999": 50, " 7 ": 7}.items():
        assert one(spark, U.clamp_int(F.col("x"), 1, 50, 5), x=raw) == want, raw
    assert one(spark, U.url_ext(F.col("u")), u="https://x.org/a/B.JPG?x=1") == "jpg"
    assert one(spark, U.url_ext(F.col("u")), u="https://x.org/a/") == ""
