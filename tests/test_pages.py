import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import one
from pagemill.functions import jsonpage as J
from pagemill.functions.markers import slice_between
from pagemill.operators import extract as X
from pagemill.operators.clean import clean_html
from pagemill.operators.selectors import compile_selector, sel_literal
from pagemill.operators.shred import offsets_nest, shred, shred_html

DOC = ('<html><body><div id="main" class="ad wide"><article><h1>T &amp; U</h1><p>a</p><p class="x y">b</p>'
       '</article></div><nav><ul><li><a href="/x">x</a></li><li><a href="/y">y</a></li></ul></nav></body></html>')


def _py_matches(sel, html):
    text, nodes = shred_html(html)
    c = compile_selector(sel)
    if not c.supported:
        return []
    m = [n["tag"] for n in nodes if re.search(c.regex, n["path"]) and all(n["attrs"].get(k) == v for k, v in c.attr_eq)]
    return m[c.nth - 1:c.nth] if c.nth else m


def test_selector_vectors():
    assert _py_matches("h1", DOC) == ["h1"]
    assert _py_matches(".ad", DOC) == ["div"]
    assert _py_matches("div.ad", DOC) == ["div"]
    assert _py_matches("#main .x", DOC) == ["p"]
    assert _py_matches("div > article", DOC) == ["article"]
    assert _py_matches("body > article", DOC) == []
    assert _py_matches("a:hover", DOC) == []          # unsupported -> nothing, never everything
    assert _py_matches("//h1", DOC) == ["h1"]
    assert _py_matches("(//p)[2]", DOC) == ["p"]
    assert _py_matches("//li[2]", DOC) == ["li"]
    assert _py_matches('//div[contains(@class,"wid")]', DOC) == ["div"]
    assert _py_matches('//a[@href="/y"]', DOC) == ["a"]


def test_shred_repairs_and_raw_text():
    text, nodes = shred_html('<p><b>bold<p>next</p><script>var t="</p>";</script>')
    assert [n["tag"] for n in nodes] == ["p", "b", "p", "script"]
    assert nodes[0]["last"] == 1 and offsets_nest(nodes)
    assert 'var t="</p>";' in text


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<br>", "x", "&amp;", " ", "<li>",
                                 "<ul>", "</ul>", "<img src=a>", "</span>"]), max_size=40))
def test_shred_intervals_nest(parts):
    html = "".join(parts)
    text, nodes = shred_html(html)
    assert offsets_nest(nodes)
    for n in nodes:
        assert html[n["src_start"]] == "<"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["<div>", "</div>", "<p>", "</p>", "word ", "<a href=/q>", "</a>", "<p> </p>",
                                 "<section>", "</section>", "kw"]), max_size=30))
def test_clean_output_is_subsequence(parts):
    html = "".join(parts)
    out = clean_html(html, ["section"], True, ["kw"], True)
    it = iter(html)
    assert all(ch in it for ch in out)


def test_clean_keeps_wrapper_and_drops_blocks():
    h = "<div><p>keep</p><p>drop KW here</p><div><div>nested kw</div></div></div><p></p>"
    assert clean_html(h, [], False, ["kw"], True) == "<div><p>keep</p></div>"
    assert clean_html("text kw only", [], False, ["kw"], True) == "text kw only"


def test_extraction_on_dataframe(spark):
    df = spark.createDataFrame([(1, "https://s.example.com/a/b", DOC)], "page_id long, url string, html string")
    sh = shred(df)
    row = sh.select(X.select_text(sel_literal("h1")).alias("t"), X.select_html(sel_literal("//article")).alias("h"),
                    X.selector_count(sel_literal("li")).alias("n"),
                    X.select_links(sel_literal("nav li"), F.col("url")).alias("l"),
                    X.anchor_links(F.col("html"), F.col("url")).alias("a")).collect()[0]
    assert row.t == "T & U" and row.h.startswith("<h1>") and row.n == 2
    assert row.l == ["https://s.example.com/x", "https://s.example.com/y"] == row.a


def test_json_paths(spark):
    js = '{"a":{"b":[{"u":"/1"},"//c.example.org/2",{"slug":"node/3"}],"t":"T"}}'
    assert one(spark, J.json_path(F.col("j"), F.lit("$.a.t")), j=js) == "T"
    assert one(spark, J.json_path(F.col("j"), F.lit("a.b[0].u")), j=js) == "/1"
    assert one(spark, J.json_path(F.col("j"), F.lit("a.b[*].u")), j=js).startswith("[")
    assert one(spark, J.json_path(F.col("j"), F.lit("a.zz")), j=js) is None
    assert one(spark, J.json_match_count(F.col("j"), F.lit("a.b")), j=js) == 3
    links = one(spark, X.json_links(F.col("j"), F.lit("a.b"), F.lit(""), F.lit("https://s.example.com/x/y")), j=js)
    assert links == ["https://c.example.org/2", "https://s.example.com/node/3"]
    html = '<script id="__NEXT_DATA__">{"x":1}</script><script>window.S = [1,2];</script>'
    assert one(spark, J.page_json(F.col("h"), F.lit("next")), h=html) == '{"x":1}'
    assert one(spark, J.page_json(F.col("h"), F.lit("var:S")), h=html) == "[1,2]"


def test_marker_vectors(spark):
    h = "<div>  <h1>Title</h1>\n<p>body &amp; more</p></div>"
    sb = lambda b, a: one(spark, slice_between(F.col("h"), F.lit(b), F.lit(a)), h=h)
    assert sb("", "") == h
    assert sb("<h1>", "</h1>") == "Title"
    assert sb("nope", "</h1>") == ""
    assert sb("<h1>", "nope") == ""
    assert sb("</h1>", "<h1>") == ""
    assert sb("&lt;h1&gt;", "&lt;/h1&gt;") == "Title"
    assert sb("</h1>  <p>", "</p>") == "body &amp; more"   # flexible whitespace
    assert sb("</h1> <p>", "</p>") == ""                  # single-spaced marker: no fallback


def test_persisted_shred_prunes_and_reports(spark, tmp_path):
    from pagemill.operators.shred import MAX_DEPTH, shred, write_shredded
    deep = "<div>" * (MAX_DEPTH + 5) + "x" + "</div>" * (MAX_DEPTH + 5)
    pages = spark.createDataFrame([(i, f"<p id='a{i}'>t{i}</p>") for i in range(20)] + [(99, deep)], "page_id long, html string")
    write_shredded(pages, str(tmp_path / "shred"), buckets=4)
    back = spark.read.parquet(str(tmp_path / "shred"))
    assert back.count() == 21 and back.select("shard").distinct().count() <= 4
    errors = {r.page_id: r.page_error for r in shred(pages).select("page_id", "page_error").collect()}
    assert "deeper" in errors.pop(99) and not any(errors.values())


def test_selectors_of_any_length(spark):
    from pagemill.operators.selectors import compile_css, compile_xpath
    long_css = " > ".join(["div"] * 12) + " a.b#c"
    assert compile_css(long_css).supported and compile_xpath("/div" * 12 + "//a").supported
    for bad in ("", ">", "a[b]", "a:hover", "a,b", "#", ".", "a..b", "1a", "a#b#c", "**"):
        assert not compile_css(bad).supported, bad


def test_unwrap_external_links_only():
    from pagemill.operators.clean import clean_html
    html = '<p><a href="/x">in</a> <a href="https://h.example.com/y">own</a> <a href="//o.example.org/z">out</a> <a href="https://[bad">odd</a></p>'
    got = clean_html(html, unwrap_links=True, unwrap_mode="external", base_url="https://h.example.com/p")
    assert got == html.replace('<a href="//o.example.org/z">out</a>', "out")
    assert "<a" not in clean_html(html, unwrap_links=True)
