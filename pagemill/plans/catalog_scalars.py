"""Registered scalar queries: URL functions U1–U10 and text/content functions C5–C22."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.fixtures import AS_OF, Tables
from pagemill.functions import text as C
from pagemill.functions import urls as U
from pagemill.plans import duck as D
from pagemill.plans.registry import register

ANCHOR_RE_SPARK = r"""(?is)<a\b[^>]*\shref\s*=\s*(["'])(.*?)\1"""
ANCHOR_RE_DUCK = r"""(?is)<a\b[^>]*\shref\s*=\s*("[^"]*"|'[^']*')"""


def _anchor_rows(t: Tables):
    """Every quoted anchor href of every page with its page URL and position."""
    return t.pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR_RE_SPARK),
                                                                              F.lit(2))).alias("pos", "href"))


_ANCHOR_ROWS_SQL = f"""a AS (SELECT page_id, url, unnest(l) AS raw, unnest(range(len(l))) AS pos
  FROM (SELECT page_id, url, regexp_extract_all(html, {D.q(ANCHOR_RE_DUCK)}, 1) AS l FROM pages)),
h AS (SELECT page_id, url, pos, substr(raw, 2, length(raw) - 2) AS href FROM a)"""


def _url_pool(t: Tables):
    """URLs seen by the engine: page URLs, list-URL lines of the rules and anchor hrefs
    resolved against their page."""
    pages = t.pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("src"), F.col("url").alias("u"))
    lines = t.f_rule_set.select("rule_id", F.posexplode(U.lines(F.col("list_urls_text"))).alias("pos", "u")) \
        .select(F.concat(F.lit("r"), F.col("rule_id").cast("string"), F.lit("-"), F.col("pos").cast("string")).alias("src"), "u")
    hrefs = _anchor_rows(t).select(
        F.concat(F.lit("a"), F.col("page_id").cast("string"), F.lit("-"), F.col("pos").cast("string")).alias("src"),
        U.absolute_url(F.col("href"), F.col("url")).alias("u"))
    return pages.unionByName(lines).unionByName(hrefs)


_URL_POOL_SQL = f"""{_ANCHOR_ROWS_SQL},
pool AS (
  SELECT 'p' || CAST(page_id AS VARCHAR) AS src, url AS u FROM pages
  UNION ALL SELECT 'r' || CAST(rule_id AS VARCHAR) || '-' || CAST(pos AS VARCHAR), u FROM (
     SELECT rule_id, unnest(l) AS u, unnest(range(len(l))) AS pos FROM (SELECT rule_id, {D.lines('list_urls_text')} AS l FROM f_rule_set))
  UNION ALL SELECT 'a' || CAST(page_id AS VARCHAR) || '-' || CAST(pos AS VARCHAR), {D.absolute_url('href', 'url')} FROM h)"""


@register("lines", f"""SELECT rule_id, unnest(range(len(l))) AS pos, unnest(l) AS line
FROM (SELECT rule_id, {D.lines('list_urls_text')} AS l FROM f_rule_set)""", ("f_rule_set",))
def q_lines(t: Tables):
    """Rule text blocks split into trimmed, non-empty lines."""
    return t.f_rule_set.select("rule_id", F.posexplode(U.lines(F.col("list_urls_text"))).alias("pos", "line")) \
        .withColumn("pos", F.col("pos").cast("long"))


@register("normalize_url", f"WITH {_URL_POOL_SQL} SELECT src, u, {D.normalize_url('u')} AS normalized FROM pool",
          ("f_rule_set",))
def q_normalize_url(t: Tables):
    """Normalise every URL of the pool."""
    return _url_pool(t).select("src", "u", U.normalize_url(F.col("u")).alias("normalized"))


@register("is_safe_public_url", f"WITH {_URL_POOL_SQL} SELECT src, u, {D.is_safe_url('u')} AS safe FROM pool",
          ("f_rule_set",))
def q_is_safe_public_url(t: Tables):
    """Public-URL filter over the pool."""
    return _url_pool(t).select("src", "u", U.is_safe_public_url(F.col("u")).alias("safe"))


def _ip_pool(t: Tables):
    e, u = F.col("event_id"), F.col("user_id")
    v4 = F.concat_ws(".", (u % 260).cast("string"), (e % 256).cast("string"), (e % 7).cast("string"),
                     (e % 250).cast("string"))
    v6 = F.concat(F.when(e % 3 == 0, F.lit("fc00::")).when(e % 3 == 1, F.lit("2001:db8::")).otherwise(F.lit("2606:4700::")),
                  F.lower(F.hex(e % 4096)))
    ip = F.when(e % 5 == 0, v6).when(e % 11 == 0, F.concat(v4, F.lit(".9"))).otherwise(v4)
    return t.events.select("event_id", ip.alias("ip"))


@register("is_public_ip", f"""WITH pool AS (SELECT event_id,
  CASE WHEN event_id % 5 = 0 THEN (CASE WHEN event_id % 3 = 0 THEN 'fc00::' WHEN event_id % 3 = 1 THEN '2001:db8::' ELSE '2606:4700::' END) || lower(hex(event_id % 4096))
       WHEN event_id % 11 = 0 THEN concat_ws('.', CAST(user_id % 260 AS VARCHAR), CAST(event_id % 256 AS VARCHAR), CAST(event_id % 7 AS VARCHAR), CAST(event_id % 250 AS VARCHAR)) || '.9'
       ELSE concat_ws('.', CAST(user_id % 260 AS VARCHAR), CAST(event_id % 256 AS VARCHAR), CAST(event_id % 7 AS VARCHAR), CAST(event_id % 250 AS VARCHAR)) END AS ip
  FROM events)
SELECT event_id, ip, {D.is_public_ip('lower(ip)')} AS public FROM pool""")
def q_is_public_ip(t: Tables):
    """U4: public-IP predicate over addresses derived from the event stream."""
    return _ip_pool(t).select("event_id", "ip", U.is_public_ip(F.col("ip")).alias("public"))


@register("absolute_url", f"WITH {_ANCHOR_ROWS_SQL} SELECT page_id, pos, href, {D.absolute_url('href', 'url')} AS absolute FROM h")
def q_absolute_url(t: Tables):
    """Every anchor href resolved against its page URL."""
    return _anchor_rows(t).select("page_id", F.col("pos").cast("bigint").alias("pos"), "href",
                                  U.absolute_url(F.col("href"), F.col("url")).alias("absolute"))


@register("url_hash", f"SELECT page_id, md5({D.normalize_url('url')}) AS url_hash FROM pages")
def q_url_hash(t: Tables):
    """md5 of the normalised page URL."""
    return t.pages.select("page_id", U.url_hash(F.col("url")).alias("url_hash"))


def _ordered_distinct_sql(src_cte: str, key: str) -> str:
    """DuckDB: first-occurrence order of distinct values per key, 0-based position."""
    return f"""firsts AS (SELECT {key}, u, min(i) AS i FROM {src_cte} GROUP BY {key}, u)
SELECT {key}, u AS url, CAST(row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS BIGINT) AS pos FROM firsts"""


@register("parse_urls", f"""WITH l AS (SELECT rule_id, {D.lines('list_urls_text')} AS ls FROM f_rule_set),
x AS (SELECT rule_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM l),
y AS (SELECT rule_id, {D.normalize_url('line')} AS u, i FROM x),
z AS (SELECT * FROM y WHERE {D.is_safe_url('u')}),
{_ordered_distinct_sql('z', 'rule_id')}""", ("f_rule_set",))
def q_parse_urls(t: Tables):
    """Each rule's list-URL text -> ordered distinct safe normalised URLs."""
    return t.f_rule_set.select("rule_id", F.posexplode(U.parse_urls(F.col("list_urls_text"))).alias("pos", "url")) \
        .withColumn("pos", F.col("pos").cast("bigint"))


@register("list_pages", f"""WITH l AS (SELECT rule_id, {D.lines('list_urls_text')} AS ls, trim(coalesce(pagination_pattern, ''), {D.WS}) AS pat,
    greatest(1, page_start) AS s, greatest(greatest(1, page_start), least(greatest(1, page_start) + 500, page_end)) AS e FROM f_rule_set),
x AS (SELECT rule_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM l),
y AS (SELECT rule_id, {D.normalize_url('line')} AS u, i FROM x),
st AS (SELECT rule_id, u, i FROM y WHERE {D.is_safe_url('u')}),
pg AS (SELECT rule_id, {D.normalize_url("replace(pat, '{page}', CAST(p AS VARCHAR))")} AS u, 1000000 + p AS i
       FROM (SELECT rule_id, pat, unnest(range(s, e + 1)) AS p FROM l WHERE contains(pat, '{{page}}'))),
pgs AS (SELECT * FROM pg WHERE {D.is_safe_url('u')}),
z AS (SELECT * FROM st UNION ALL SELECT * FROM pgs),
{_ordered_distinct_sql('z', 'rule_id')}""", ("f_rule_set",))
def q_list_pages(t: Tables):
    """U8: list pages of every rule: static list URLs then the {page} range."""
    urls = U.list_page_urls(F.col("list_urls_text"), F.col("pagination_pattern"), F.col("page_start"), F.col("page_end"))
    return t.f_rule_set.select("rule_id", F.posexplode(urls).alias("pos", "url")).withColumn("pos", F.col("pos").cast("bigint"))


def _clamp_sql(x: str, lo: int, hi: int, d: int) -> str:
    v = f"coalesce(TRY_CAST({D.trim_set(x)} AS DOUBLE), {float(d)})"
    v = f"(CASE WHEN abs({v}) < 1e15 THEN {v} ELSE {float(d)} END)"
    return f"CAST(least(greatest(CAST(trunc({v}) AS BIGINT), {lo}), {hi}) AS INTEGER)"


@register("clamp_int", f"""WITH s AS (SELECT event_id,
  CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 3 = 1 THEN CAST(round(value, 2) AS VARCHAR) ELSE ' ' || CAST(event_id % 90 - 20 AS VARCHAR) END AS raw
  FROM events)
SELECT event_id, raw, {_clamp_sql('raw', 1, 50, 5)} AS clamped FROM s""")
def q_clamp_int(t: Tables):
    """Clamp raw numeric text (JSON text, decimals, padded integers) to 1..50, default 5."""
    e = F.col("event_id")
    raw = F.when(e % 3 == 0, F.col("props")).when(e % 3 == 1, F.round("value", 2).cast("string")) \
        .otherwise(F.concat(F.lit(" "), (e % 90 - 20).cast("string")))
    return t.events.select("event_id", raw.alias("raw")).select("event_id", "raw", U.clamp_int(F.col("raw"), 1, 50, 5).alias("clamped"))


@register("url_ext", f"WITH {_URL_POOL_SQL} SELECT src, lower(regexp_extract({D.url_part('u', 3)}, '\\.([^./]+)$', 1)) AS ext FROM pool",
          ("f_rule_set",))
def q_url_ext(t: Tables):
    """Lower-case path extension of every URL of the pool."""
    return _url_pool(t).select("src", U.url_ext(F.col("u")).alias("ext"))


# ------------------------------------------------------------------ text

@register("strip_tags", f"SELECT page_id, {D.strip_tags('html')} AS text FROM pages")
def q_strip_tags(t: Tables):
    """Whole pages with script/style bodies, comments and tags removed."""
    return t.pages.select("page_id", C.strip_tags(F.col("html")).alias("text"))


@register("html_unescape", f"SELECT page_id, {D.unescape(D.strip_tags('html'))} AS text FROM pages")
def q_html_unescape(t: Tables):
    """Page text with entities decoded (full HTML5 table; Arrow batches)."""
    return t.pages.select("page_id", C.html_unescape(C.strip_tags(F.col("html"))).alias("text"))


@register("collapse_ws", f"SELECT doc_id, {D.collapse('text')} AS text FROM documents")
def q_collapse_ws(t: Tables):
    """Documents with whitespace runs collapsed and trimmed."""
    return t.documents.select("doc_id", C.collapse_ws(F.col("text")).alias("text"))


def allow_sql(x: str) -> str:
    """The publish filter in SQL: tokens, then each tag's allowed attributes."""
    s = f"regexp_replace({x}, '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g')"
    s = f"regexp_replace({s}, '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g')"
    s = f"regexp_replace({s}, '(?s)<!--.*?-->', '', 'g')"
    names = lambda v: ", ".join(D.q(i) for i in v)
    attr = "lower(regexp_extract(a, '^[^\\s=]+', 0))"
    bare = "regexp_replace(regexp_extract(a, '(?s)=\\s*(.*)$', 1), '[\\x00-\\x20\"'']', '', 'g')"
    safe = f"(regexp_matches({bare}, '(?i)^(?:{'|'.join(C.ALLOWED_SCHEMES)}):') OR NOT regexp_matches(regexp_extract({bare}, '^[^/?#]*', 0), '[:&]'))"
    name = "lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9]*)', 1))"
    kept = (f"list_filter(regexp_extract_all(regexp_replace(t, '^<[A-Za-z][A-Za-z0-9]*', ''), {D.q(C.ATTRIBUTE)}), "
            f"lambda a: ({attr} IN ({names(C.ALLOWED_ATTRIBUTES)}) OR {name} || '.' || {attr} IN ({names(C.ALLOWED_ON_TAG)})) "
            f"AND ({attr} NOT IN ({names(C.ADDRESS_ATTRIBUTES)}) OR {safe}))")
    return (f"array_to_string(list_transform(regexp_extract_all({s}, {D.q(C.TAG_TOKENS)}), lambda t: CASE WHEN t = '<' THEN '&lt;' "
            f"WHEN NOT regexp_matches(t, '^</?[A-Za-z]') THEN t WHEN {name} NOT IN ({names(C.ALLOWED_TAGS)}) THEN '' "
            f"WHEN starts_with(t, '</') THEN '</' || {name} || '>' "
            f"ELSE '<' || {name} || array_to_string(list_transform({kept}, lambda a: ' ' || a), '') || '>' END), '')")


# Pages with attributes that must not pass, by page id.
_HOSTILE = [("<p>", """<p onclick="steal('>')" title='a > b' style=color:red>"""), ('<a href="', '<a HREF=" java\tscript:x" href="&#106;avascript:y" rel=me href="'),
            ("<b>", "<B oNmouseover = x class=k data-x='1' id><img src=x onerror=go() alt=\"<i>\"><svg/onload=z>"), ("<h1>", "<h1 lang=de>1 < 2 <unclosed title=\"")]


@register("allow_html", "SELECT page_id, " + allow_sql("CASE page_id % 5 " + " ".join(
    f"WHEN {k} THEN replace(html, {D.q(a)}, {D.q(b)})" for k, (a, b) in enumerate(_HOSTILE)) + " ELSE html END") + " AS content FROM pages")
def q_allow_html(t: Tables):
    """Pages, most of them with hostile attributes put in, as the publish filter leaves them."""
    html = F.col("html")
    for k, (a, b) in enumerate(_HOSTILE):
        html = F.when(F.col("page_id") % 5 == k, F.replace(F.col("html"), F.lit(a), F.lit(b))).otherwise(html)
    return t.pages.select("page_id", C.allow_html(html).alias("content"))


REPL_TEXT = "the => THE\nTHE=>x\r\nde =>\nno arrow here\n=>y\nund=>&amp;"


def _repl_sql(x: str) -> str:
    out = x
    for a, b in [("the", "THE"), ("THE", "x"), ("de", ""), ("und", "&amp;")]:
        out = f"replace({out}, {D.q(a)}, {D.q(b)})"
    return out


@register("apply_replacements", f"SELECT doc_id, {_repl_sql('text')} AS text FROM documents")
def q_apply_replacements(t: Tables):
    """Ordered replacement rules (chained, deleting, malformed lines skipped)."""
    pairs = C.parse_pairs(F.lit(REPL_TEXT))
    return t.documents.select("doc_id", C.apply_replacements(F.col("text"), pairs).alias("text"))


@register("excerpt", f"""SELECT article_id, substr({D.text_of('content')}, 1, least(greatest(CAST(article_id * 37 % 700 AS INTEGER), 50), 500)) AS excerpt
FROM f_articles""", ("f_articles",))
def q_excerpt(t: Tables):
    """Excerpts with lengths clamped to 50..500."""
    n = (F.col("article_id") * 37 % 700).cast("int")
    return t.f_articles.select("article_id", C.excerpt(F.col("content"), n).alias("excerpt"))


def _tpl_spark():
    k = F.col("article_id") % 5
    return (F.when(k == 0, F.lit("{title} | {site}")).when(k == 1, F.lit(""))
            .when(k == 2, F.lit("{excerpt}{title}")).when(k == 3, F.lit("{source} - {title} {excerpt}"))
            .otherwise(F.lit("x{unknown}y {site}")))


_TPL_SQL = ("CASE article_id % 5 WHEN 0 THEN '{title} | {site}' WHEN 1 THEN '' WHEN 2 THEN '{excerpt}{title}' "
            "WHEN 3 THEN '{source} - {title} {excerpt}' ELSE 'x{unknown}y {site}' END")
SITE = "Pagemill Site"


def _render_sql(tpl: str, title: str, exc: str, site: str, source: str) -> str:
    t = f"(CASE WHEN coalesce({tpl}, '') = '' THEN '{{title}}' ELSE {tpl} END)"
    s = t
    for i, k in enumerate(["title", "excerpt", "site", "source"]):
        s = f"replace({s}, '{{{k}}}', chr({i + 1}))"
    for i, v in enumerate([D.strip_tags(title), D.strip_tags(exc), site, D.trim_set(source)]):
        s = f"replace({s}, chr({i + 1}), coalesce({v}, ''))"
    return s


_TPL_TITLE = "CASE WHEN article_id % 7 = 0 THEN '<b>{excerpt}</b> ' || title ELSE title END"


@register("render_template", f"""SELECT article_id, {_render_sql(_TPL_SQL, _TPL_TITLE, f"substr({D.text_of('content')}, 1, 160)", D.q(SITE), 'source_url')} AS rendered
FROM f_articles""", ("f_articles",))
def q_render_template(t: Tables):
    """Templates rendered in one pass (inserted '{excerpt}' text is not re-expanded)."""
    title = F.when(F.col("article_id") % 7 == 0, F.concat(F.lit("<b>{excerpt}</b> "), F.col("title"))).otherwise(F.col("title"))
    return t.f_articles.select("article_id", C.render_template(_tpl_spark(), title, C.excerpt(F.col("content"), 160),
                                                               F.lit(SITE), F.col("source_url")).alias("rendered"))


def _seo_family():
    k = F.col("article_id") % 5
    return F.when(k == 0, "rank_math").when(k == 1, "yoast").when(k == 2, "aioseo").when(k == 3, "none").otherwise("other")


@register("seo_fields", f"""WITH a AS (SELECT *, CASE article_id % 5 WHEN 0 THEN 'rank_math' WHEN 1 THEN 'yoast' WHEN 2 THEN 'aioseo' WHEN 3 THEN 'none' ELSE 'other' END AS fam,
   substr({D.text_of('content')}, 1, 160) AS exc FROM f_articles)
SELECT article_id,
  CASE fam WHEN 'rank_math' THEN 'rank_math_title' WHEN 'yoast' THEN '_yoast_wpseo_title' WHEN 'aioseo' THEN '_aioseo_title' END AS seo_title_key,
  CASE WHEN fam IN ('rank_math', 'yoast', 'aioseo') THEN {_render_sql("CASE WHEN article_id % 2 = 0 THEN '' ELSE '{title} - {site}' END", 'title', 'exc', D.q(SITE), 'source_url')} END AS seo_title,
  CASE fam WHEN 'rank_math' THEN 'rank_math_description' WHEN 'yoast' THEN '_yoast_wpseo_metadesc' WHEN 'aioseo' THEN '_aioseo_description' END AS seo_desc_key,
  CASE WHEN fam IN ('rank_math', 'yoast', 'aioseo') THEN {_render_sql("'{excerpt}'", 'title', 'exc', D.q(SITE), 'source_url')} END AS seo_desc
FROM a""", ("f_articles",))
def q_seo_fields(t: Tables):
    """C11: SEO title/description keys and values per family."""
    title_tpl = F.when(F.col("article_id") % 2 == 0, F.lit("")).otherwise(F.lit("{title} - {site}"))
    s = C.seo_fields(_seo_family(), F.col("title"), C.excerpt(F.col("content"), 160), F.lit(SITE), F.col("source_url"),
                     title_tpl, F.lit(""))
    return t.f_articles.select("article_id", *[v.alias(k) for k, v in s.items()])


CATEGORY_TEXT = "the=>5\nDE => 7\nund=>0\n=>3\nla=>x9\nbe=> 11abc"
TAG_WORDS = ["the", "De", "und", "la", "ZZZ", "the"]
FIXED_TAGS = " news, tech ,,news,0, "


def _ctx_spark():
    return F.concat(F.col("title"), F.lit("\n"), C.strip_tags(F.col("content")))


_CTX_SQL = f"lower(title || chr(10) || {D.strip_tags('content')})"


@register("match_category", f"""SELECT article_id,
  CAST(CASE WHEN contains({_CTX_SQL}, 'the') THEN 5 WHEN contains({_CTX_SQL}, 'de') THEN 7
            WHEN contains({_CTX_SQL}, 'be') THEN 11 ELSE 0 END AS BIGINT) AS category_id
FROM f_articles""", ("f_articles",))
def q_match_category(t: Tables):
    """First category keyword line found in title + text (ids must be > 0)."""
    rules = C.parse_category_rules(F.lit(CATEGORY_TEXT))
    return t.f_articles.select("article_id", C.match_category(_ctx_spark(), rules).alias("category_id"))


def _auto_tags_sql() -> str:
    parts = [f"CASE WHEN contains({_CTX_SQL}, {D.q(w.lower())}) THEN {D.q(w)} END" for w in ["the", "De", "und", "la", "ZZZ"]]
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), '|')"


@register("auto_tags", f"SELECT article_id, {_auto_tags_sql()} AS tags FROM f_articles", ("f_articles",))
def q_auto_tags(t: Tables):
    """Keywords found (listed order, distinct), joined with '|'."""
    return t.f_articles.select("article_id", F.array_join(C.auto_tags(_ctx_spark(), F.array(*[F.lit(w) for w in TAG_WORDS])), "|")
                               .alias("tags"))


@register("fixed_tags", """SELECT doc_id, array_to_string(list_filter([d.lang, 'news', 'tech', '0'], lambda x: x IS NOT NULL), '|') AS tags
FROM (SELECT doc_id, lang FROM documents) d""")
def q_fixed_tags(t: Tables):
    """C14: comma tag lists (language first) trimmed, empties dropped, distinct."""
    lst = F.concat(F.col("lang"), F.lit(","), F.lit(FIXED_TAGS), F.lit(","), F.col("lang"))
    return t.documents.select("doc_id", F.array_join(C.fixed_tags(lst), "|").alias("tags"))


@register("article_tags", f"""SELECT article_id, array_to_string(list_filter(['news', 'tech', '0'] || CASE WHEN article_id % 2 = 0 THEN
   list_filter([{', '.join(f"CASE WHEN contains({_CTX_SQL}, {D.q(w.lower())}) THEN {D.q(w)} END" for w in ['the', 'De', 'und', 'la'])}], lambda x: x IS NOT NULL)
   ELSE [] END, lambda x: x IS NOT NULL), '|') AS tags
FROM f_articles""", ("f_articles",))
def q_article_tags(t: Tables):
    """Fixed tags then auto tags (enabled on even articles), distinct."""
    auto = C.auto_tags(_ctx_spark(), F.array(*[F.lit(w) for w in ["the", "De", "und", "la", "news"]]))
    return t.f_articles.select("article_id", F.array_join(
        C.article_tags(C.fixed_tags(F.lit(FIXED_TAGS)), auto, F.col("article_id") % 2 == 0), "|").alias("tags"))


@register("article_category", f"""SELECT article_id,
  CAST(coalesce(nullif(CASE WHEN contains({_CTX_SQL}, 'und') THEN 9 ELSE 0 END, 0), nullif(article_id % 3, 0)) AS BIGINT) AS category_id
FROM f_articles""", ("f_articles",))
def q_article_category(t: Tables):
    """Matched category, else the rule default (article_id % 3), else null."""
    m = C.match_category(_ctx_spark(), C.parse_category_rules(F.lit("und=>9")))
    return t.f_articles.select("article_id", C.article_category(m, F.col("article_id") % 3).cast("bigint").alias("category_id"))


def _date_raw_spark():
    d = F.col("doc_id")
    k = d % 6
    return (F.when(k == 0, (F.lit(1700000000000) + d * 1000 + 123).cast("string"))
            .when(k == 1, (F.lit(1700000000) + d).cast("string"))
            .when(k == 2, F.concat(F.lit("2024-01-"), F.lpad((d % 28 + 1).cast("string"), 2, "0"), F.lit(" 03:04:05")))
            .when(k == 3, F.concat(F.lit("2024/1/"), (d % 28 + 1).cast("string")))
            .when(k == 4, F.substring("text", 1, 12)).otherwise(F.lit("")))


@register("coerce_date", """WITH r AS (SELECT doc_id, CASE doc_id % 6
   WHEN 0 THEN CAST(1700000000000 + doc_id * 1000 + 123 AS VARCHAR) WHEN 1 THEN CAST(1700000000 + doc_id AS VARCHAR)
   WHEN 2 THEN '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || ' 03:04:05'
   WHEN 3 THEN '2024/1/' || CAST(doc_id % 28 + 1 AS VARCHAR) WHEN 4 THEN substr(text, 1, 12) ELSE '' END AS raw FROM documents)
SELECT doc_id, raw, CASE
  WHEN regexp_matches(raw, '^[0-9]{13}$') THEN make_timestamp(CAST(raw AS BIGINT) // 1000 * 1000000)
  WHEN regexp_matches(raw, '^[0-9]{10}$') THEN make_timestamp(CAST(raw AS BIGINT) * 1000000)
  ELSE try_strptime(raw, ['%Y-%m-%d %H:%M:%S', '%Y/%m/%d']) END AS published_at
FROM r""")
def q_coerce_date(t: Tables):
    """C17: epoch ms / epoch s / declared formats / unparsable -> null."""
    return t.documents.select("doc_id", _date_raw_spark().alias("raw")).select(
        "doc_id", "raw", C.coerce_date(F.col("raw")).alias("published_at"))


@register("article_status", f"""SELECT article_id, CASE WHEN st = 'future' AND article_id % 4 <> 0 THEN 'draft' ELSE st END AS status
FROM (SELECT article_id, CASE WHEN s IN ('draft', 'publish', 'future', 'pending', 'private') THEN s ELSE 'draft' END AS st
      FROM (SELECT article_id, CASE article_id % 5 WHEN 0 THEN 'future' WHEN 1 THEN 'publish' WHEN 2 THEN 'bogus' WHEN 3 THEN status ELSE 'pending' END AS s
            FROM f_articles))""", ("f_articles",))
def q_article_status(t: Tables):
    """Unknown statuses become draft; future without a schedule becomes draft."""
    k = F.col("article_id") % 5
    s = F.when(k == 0, "future").when(k == 1, "publish").when(k == 2, "bogus").when(k == 3, F.col("status")).otherwise("pending")
    sched = F.when(F.col("article_id") % 4 == 0, F.lit(AS_OF).cast("timestamp_ntz"))
    return t.f_articles.select("article_id", C.article_status(s, sched).alias("status"))


def schedule_minutes_sql(key: str, lo: str, hi: str, seed: int = 17) -> str:
    """DuckDB: the minutes of ``schedule_delay_minutes``."""
    number = f"CAST('0x' || substr(md5('{seed}:' || {key}), 1, 15) AS BIGINT)"
    return f"CAST(CASE WHEN {hi} > {lo} THEN {number} % ({hi} - {lo} + 1) + {lo} ELSE {lo} END AS INTEGER)"


@register("schedule_publish", f"""WITH b AS (SELECT article_id, source_url, greatest(0, article_id % 30) AS lo,
  greatest(greatest(0, article_id % 30), article_id % 50) AS hi FROM f_articles)
SELECT article_id, {schedule_minutes_sql('source_url', 'lo', 'hi')} AS minutes, 'future' AS status FROM b""", ("f_articles",))
def q_schedule_publish(t: Tables):
    """Random future publication in [min, max] minutes (seeded, reproducible)."""
    d = C.schedule_delay_minutes(F.col("source_url"), (F.col("article_id") % 30).cast("int"), (F.col("article_id") % 50).cast("int"))
    return t.f_articles.select("article_id", d.alias("minutes"), F.lit("future").alias("status"))


@register("redact_excerpt", f"""WITH s AS (SELECT conv_id, turn, text || ' key sk-' || md5(text) || ' Authorization: bearer ' || substr(md5(role), 1, 20) || '.x-y' AS raw
  FROM conversations)
SELECT conv_id, turn, substr({D.collapse("regexp_replace(regexp_replace(" + D.strip_tags('raw') + ", 'sk-[A-Za-z0-9_\\-]{12,}', 'sk-***', 'g'), '(?i)Bearer\\s+[A-Za-z0-9._\\-]+', 'Bearer ***', 'g')")}, 1, 300) AS excerpt
FROM s""")
def q_redact_excerpt(t: Tables):
    """Conversation excerpts with API keys and bearer tokens masked."""
    raw = F.concat(F.col("text"), F.lit(" key sk-"), F.md5("text"), F.lit(" Authorization: bearer "),
                   F.substring(F.md5("role"), 1, 20), F.lit(".x-y"))
    return t.conversations.select("conv_id", "turn", C.redact_excerpt(raw, 300).alias("excerpt"))


@register("sanitize_rule_text", f"""SELECT rule_id,
  CASE WHEN regexp_matches(s, '{C.JSON_SOURCE_PATTERN.replace("'", "''")}') THEN s ELSE '__NEXT_DATA__' END AS json_source,
  substr(trim(regexp_replace(list_urls_text, '\\r\\n|\\r', chr(10), 'g'), {D.WS}), 1, 20000) AS marker
FROM (SELECT rule_id, list_urls_text, substr(trim(coalesce(json_source, ''), {D.WS}), 1, 100) AS s FROM f_rule_set)""", ("f_rule_set",))
def q_sanitize_rule_text(t: Tables):
    """JSON-source mode validation and marker newline/NUL/length sanitising."""
    return t.f_rule_set.select("rule_id", C.sanitize_json_source(F.col("json_source")).alias("json_source"),
                               C.sanitize_marker(F.col("list_urls_text")).alias("marker"))
