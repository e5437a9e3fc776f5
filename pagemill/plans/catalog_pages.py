"""Registered queries over pages: shred, selectors, extraction, JSON, markers, links, images."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.fixtures import Tables
from pagemill.functions import jsonpage as J
from pagemill.functions.text import BASIC_ENTITIES, excerpt
from pagemill.functions.urls import normalize_url
from pagemill.operators import extract as X
from pagemill.operators.selectors import sel_literal
from pagemill.operators.shred import shred
from pagemill.plans import duck as D
from pagemill.plans.registry import register


def h1_text_sql(html: str = "html") -> str:
    return D.collapse(D.unescape(D.strip_tags(f"regexp_extract({html}, '(?s)<h1[^>]*>(.*?)</h1>', 1)")))


def article_html_sql(html: str = "html") -> str:
    return D.trim_set(f"regexp_extract({html}, '(?s)<article[^>]*>(.*)</article>', 1)")


@register("select_text", f"SELECT page_id, {h1_text_sql()} AS title FROM pages")
def q_select_text(t: Tables):
    """Text of the first <h1> of every page."""
    return shred(t.pages).select("page_id", X.select_text(sel_literal("h1")).alias("title"))


@register("select_html", f"SELECT page_id, {article_html_sql()} AS content FROM pages")
def q_select_html(t: Tables):
    """Inner HTML of the first <article> (source slice) of every page."""
    return shred(t.pages).select("page_id", X.select_html(sel_literal("//article")).alias("content"))


def minimal_articles(pages):
    """Step-0 slice: normalise URLs, keep the first page of each normalised URL, shred,
    take the h1 text as title and the article HTML as content, excerpt of 160."""
    keyed = pages.select("page_id", "html", normalize_url(F.col("url")).alias("source_url"))
    first = keyed.groupBy("source_url").agg(F.min("page_id").alias("page_id"))
    uniq = keyed.join(first, ["source_url", "page_id"], "left_semi")
    s = shred(uniq)
    content = X.select_html(sel_literal("//article"))
    return s.select("page_id", "source_url", X.select_text(sel_literal("//h1")).alias("title"),
                    content.alias("content"), excerpt(content, 160).alias("excerpt"))


_MIN_SQL = f"""WITH k AS (SELECT page_id, html, {D.normalize_url('url')} AS source_url FROM pages),
u AS (SELECT * FROM k WHERE page_id IN (SELECT min(page_id) FROM k GROUP BY source_url))
SELECT page_id, source_url, {h1_text_sql()} AS title, {article_html_sql()} AS content,
       substr({D.text_of(article_html_sql())}, 1, 160) AS excerpt
FROM u"""


@register("minimal_articles", _MIN_SQL)
def q_minimal_articles(t: Tables):
    """Flagship slice: pages -> deduplicated normalised URLs -> title/content/excerpt."""
    return minimal_articles(t.pages)


__all__ = ["minimal_articles"]


# ------------------------------------------------------------------ JSON in pages

ANCHOR_D = r"""(?is)<a\b[^>]*\shref\s*=\s*("[^"]*"|'[^']*')"""

NEXT_RE_D = r"""(?is)<script\b[^>]*\bid=["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""
LD_RE_D = r"""(?is)<script\b[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
VAR_RE_D = r"""(?is)(?:window\.)?__STATE__\s*=\s*(\{.*?\}|\[.*?\])\s*(?:;|</script>)"""
MODES = ["__NEXT_DATA__", "ld+json", "id:__NEXT_DATA__", "var:__STATE__", "next", "json-ld", "id:missing", "bogus"]


def _dec_sql(x: str) -> str:
    t = D.trim_set(D.unescape(x))
    return f"(CASE WHEN {t} <> '' AND json_valid({t}) THEN {t} END)"


_PAGE_JSON_SQL = f"""WITH m AS (SELECT page_id, html, unnest([{', '.join(D.q(m) for m in MODES)}]) AS mode FROM f_pages_json),
v AS (SELECT page_id, mode,
  CASE WHEN mode IN ('__NEXT_DATA__', 'next', 'id:__NEXT_DATA__') THEN {_dec_sql(f"regexp_extract(html, {D.q(NEXT_RE_D)}, 1)")}
       WHEN mode IN ('ld+json', 'json-ld') THEN (SELECT CASE WHEN len(l) = 1 THEN l[1] WHEN len(l) > 1 THEN '[' || array_to_string(l, ',') || ']' END
            FROM (SELECT list_filter(list_transform(regexp_extract_all(html, {D.q(LD_RE_D)}, 1), lambda s: {_dec_sql('s')}), lambda s: s IS NOT NULL) AS l))
       WHEN mode = 'var:__STATE__' THEN {_dec_sql(f"regexp_extract(html, {D.q(VAR_RE_D)}, 1)")}
  END AS json
FROM m)
SELECT page_id, mode, json FROM v"""


@register("page_json", _PAGE_JSON_SQL, ("f_pages_json",))
def q_page_json(t: Tables):
    """The page JSON for every source mode (next data, ld+json, id:, var:)."""
    m = t.f_pages_json.select("page_id", "html", F.explode(F.array(*[F.lit(x) for x in MODES])).alias("mode"))
    return m.select("page_id", "mode", J.page_json(F.col("html"), F.col("mode")).alias("json"))


PATHS = [("$.props.pageProps.title", "$.props.pageProps.title"), ("props.pageProps.items[0].url", "$.props.pageProps.items[0].url"),
         ("props.pageProps.items[*].url", "$.props.pageProps.items"), ("props.pageProps.missing", "$.props.pageProps.missing"),
         ("$", "$"), ("props.pageProps.items[5]", "$.props.pageProps.items[5]"), ("props . pageProps.created", "$.props.pageProps.created"),
         ("props.pageProps", "$.props.pageProps")]


def _next_json_sql() -> str:
    return _dec_sql(f"regexp_extract(html, {D.q(NEXT_RE_D)}, 1)")


@register("json_path", "WITH j AS (SELECT page_id, " + _next_json_sql() + " AS js FROM f_pages_json)\n"
          + "\nUNION ALL\n".join(f"SELECT page_id, {D.q(p)} AS path, json_extract_string(js, {D.q(dp)}) AS value FROM j"
                                 for p, dp in PATHS), ("f_pages_json",))
def q_json_path(t: Tables):
    """Values at paths ('$.', dots, [n], [*] ends the path, missing -> null)."""
    js = t.f_pages_json.select("page_id", J.page_json(F.col("html"), F.lit("__NEXT_DATA__")).alias("js"))
    m = js.select("page_id", "js", F.explode(F.array(*[F.lit(p) for p, _ in PATHS])).alias("path"))
    return m.select("page_id", "path", J.json_path(F.col("js"), F.col("path")).alias("value"))


def _links_sql(items_cte: str, key: str) -> str:
    """DuckDB: raw link values -> absolute -> safe -> normalised -> ordered distinct."""
    return f"""ab AS (SELECT {key}, i, {D.absolute_url('raw', 'base')} AS a FROM {items_cte} WHERE raw IS NOT NULL AND {D.trim_set('raw')} <> ''),
nz AS (SELECT {key}, i, {D.normalize_url('a')} AS u FROM ab WHERE {D.is_safe_url('a')}),
firsts AS (SELECT {key}, u, min(i) AS i FROM nz GROUP BY {key}, u)
SELECT {key}, u AS url, CAST(row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS BIGINT) AS pos FROM firsts"""


_JSON_ITEMS_SQL = f"""j AS (SELECT page_id, url AS base, {_next_json_sql()} AS js FROM f_pages_json),
it AS (SELECT page_id, base, unnest(json_extract(js, '$.props.pageProps.items[*]')) AS e, unnest(range(len(json_extract(js, '$.props.pageProps.items[*]')))) AS i FROM j),
raw AS (SELECT page_id, base, i, CASE WHEN json_type(e) = 'VARCHAR' THEN json_extract_string(e, '$')
   WHEN json_type(e) = 'OBJECT' THEN coalesce({', '.join(f"nullif(json_extract_string(e, '$.{k}'), '')" for k in J.LINK_FIELDS)}) END AS raw FROM it)"""


@register("json_links", f"WITH {_JSON_ITEMS_SQL},\n{_links_sql('raw', 'page_id')}", ("f_pages_json",))
def q_json_links(t: Tables):
    """Links from the page JSON items (named field / string / first link-like field)."""
    js = t.f_pages_json.select("page_id", "url", J.page_json(F.col("html"), F.lit("__NEXT_DATA__")).alias("js"))
    links = X.json_links(F.col("js"), F.lit("props.pageProps.items"), F.lit(""), F.col("url"))
    return js.select("page_id", F.posexplode(links).alias("pos", "url")).withColumn("pos", F.col("pos").cast("bigint"))


@register("json_field", f"""WITH j AS (SELECT page_id, {_next_json_sql()} AS js FROM f_pages_json)
SELECT page_id, {D.text_of("coalesce(json_extract_string(js, '$.props.pageProps.title'), '')")} AS title,
  {D.trim_set("coalesce(json_extract_string(js, '$.props.pageProps.created'), '')")} AS created,
  {D.trim_set("coalesce(json_extract_string(js, '$.props.pageProps.items'), '')")} AS items,
  {D.trim_set("coalesce(json_extract_string(js, '$.props.nope'), '')")} AS missing
FROM j""", ("f_pages_json",))
def q_json_field(t: Tables):
    """Field values from page JSON (text mode for the title; arrays as compact JSON)."""
    js = t.f_pages_json.select("page_id", J.page_json(F.col("html"), F.lit("__NEXT_DATA__")).alias("js"))
    return js.select("page_id", J.json_field("js", F.lit("props.pageProps.title"), True).alias("title"),
                     J.json_field("js", F.lit("props.pageProps.created"), False).alias("created"),
                     J.json_field("js", F.lit("props.pageProps.items"), False).alias("items"),
                     J.json_field("js", F.lit("props.nope"), False).alias("missing"))


@register("json_match_count", f"""WITH j AS (SELECT page_id, {_next_json_sql()} AS js FROM f_pages_json)
SELECT page_id, CAST(json_array_length(js, '$.props.pageProps.items') AS INTEGER) AS items_n,
  CAST(CASE WHEN json_extract_string(js, '$.props.pageProps.title') IS NULL THEN 0 ELSE 1 END AS INTEGER) AS title_n,
  CAST(0 AS INTEGER) AS missing_n,
  CAST(len(json_keys(js, '$.props.pageProps')) AS INTEGER) AS object_n
FROM j""", ("f_pages_json",))
def q_json_match_count(t: Tables):
    """Match counts: array length, object key count, 1 for a scalar, 0 if absent."""
    js = t.f_pages_json.select("page_id", J.page_json(F.col("html"), F.lit("__NEXT_DATA__")).alias("js"))
    return js.select("page_id", J.json_match_count("js", F.lit("props.pageProps.items")).alias("items_n"),
                     J.json_match_count("js", F.lit("props.pageProps.title")).alias("title_n"),
                     J.json_match_count("js", F.lit("props.none")).alias("missing_n"),
                     J.json_match_count("js", F.lit("props.pageProps")).alias("object_n"))


# ------------------------------------------------------------------ markers

MARKERS = [("<article>", "</article>"), ("<h1>", "</h1>"), ("&lt;h1&gt;", "&lt;/h1&gt;"), ("<nav>", "ZZZ-none"),
           ("", "</head>"), ("<footer>", ""), ('<div  class="ad">', "</div>"), ("</h1>", "<h1>"), ("", "")]


def _marker_sql(html: str, before: str, after: str) -> str:
    """DuckDB: slice between constant markers, variants computed here in Python."""
    import re as _re

    def variants(m: str):
        m = m.replace("\r\n", "\n").replace("\r", "\n").strip()
        out = [m]
        dec = m
        for ent, ch in BASIC_ENTITIES:
            dec = dec.replace(ent, ch)
        if dec != m:
            out.append(dec)
        enc = m.replace("&", "&amp;").replace('"', "&quot;").replace("'", "&apos;").replace("<", "&lt;").replace(">", "&gt;")
        if enc != m and enc != dec:
            out.append(enc)
        compact = _re.sub(r"\s+", " ", m).strip()
        rx = None
        if compact and compact != m:
            rx = "\\s+".join(_re.escape(p) for p in compact.split(" "))
        return m, out, rx

    def find(m: str, frm: str):
        """(pos, len) SQL: 1-based position at/after frm (1-based), 0 if none."""
        m, vs, rx = variants(m)
        pos_expr, len_expr = "0", "0"
        for v in reversed(vs):
            p = f"(CASE WHEN instr(substr({html}, {frm}), {D.q(v)}) > 0 THEN instr(substr({html}, {frm}), {D.q(v)}) + {frm} - 1 ELSE 0 END)"
            pos_expr = f"(CASE WHEN {p} > 0 THEN {p} ELSE {pos_expr} END)"
            len_expr = f"(CASE WHEN {p} > 0 THEN {len(v)} ELSE {len_expr} END)"
        if rx:
            hit = f"regexp_extract(substr({html}, {frm}), {D.q(rx)}, 0)"
            rpos = f"(CASE WHEN {hit} <> '' THEN instr(substr({html}, {frm}), {hit}) + {frm} - 1 ELSE 0 END)"
            pos_expr = f"(CASE WHEN {pos_expr} = 0 THEN {rpos} ELSE {pos_expr} END)"
            len_expr = f"(CASE WHEN {pos_expr} = {rpos} AND {rpos} > 0 THEN length({hit}) ELSE {len_expr} END)"
        return pos_expr, len_expr

    b = before.strip()
    a = after.strip()
    if not b and not a:
        return html
    bpos, blen = find(b, "1") if b else ("1", "0")
    start = f"({bpos} - 1 + {blen})" if b else "0"
    apos, _ = find(a, f"({start} + 1)") if a else ("0", "0")
    end = f"({apos} - 1)" if a else f"length({html})"
    ok = f"(({bpos} > 0) AND ({apos} > 0 OR {D.q(a)} = '') AND {end} > {start})" if b else f"({apos} > 0 AND {end} > {start})"
    return f"(CASE WHEN {ok} THEN substr({html}, {start} + 1, {end} - {start}) ELSE '' END)"


@register("slice_between", "\nUNION ALL\n".join(
    f"SELECT page_id, CAST({i} AS INTEGER) AS marker_set, {_marker_sql('html', b, a)} AS slice FROM pages"
    for i, (b, a) in enumerate(MARKERS)))
def q_slice_between(t: Tables):
    """X1+X2: marker slices (raw, entity-decoded, entity-encoded, whitespace-flexible
    variants; missing marker -> '')."""
    ms = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(b).alias("b"), F.lit(a).alias("a")) for i, (b, a) in enumerate(MARKERS)])
    from pagemill.functions.markers import slice_between
    x = t.pages.select("page_id", "html", F.explode(ms).alias("m"))
    return x.select("page_id", F.col("m.i").alias("marker_set"), slice_between(F.col("html"), F.col("m.b"), F.col("m.a")).alias("slice"))


# ------------------------------------------------------------------ selectors

SELECTORS = ["h1", ".ad", "div.ad", "nav a", "ul > li", "//li[2]", "(//a)[3]", "a:hover", "#main .x", "//div[contains(@class,\"a\")]",
             "body > article > h1", "//*[@href=\"/to\"]", "li a", "html", "*"]


def _count_sql(sel: str) -> str:
    n_a = "len(regexp_extract_all(html, '<a\\b'))"
    nav = "regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)"
    m = {
        "h1": "len(regexp_extract_all(html, '<h1\\b'))",
        ".ad": "len(regexp_extract_all(html, '<[a-z0-9]+ [^>]*class=\"([^\"]* )?ad( [^\"]*)?\"'))",
        "div.ad": "len(regexp_extract_all(html, '<div [^>]*class=\"([^\"]* )?ad( [^\"]*)?\"'))",
        "nav a": f"len(regexp_extract_all({nav}, '<a\\b'))",
        "ul > li": "len(regexp_extract_all(html, '<li\\b'))",
        "//li[2]": "CASE WHEN len(regexp_extract_all(html, '<li\\b')) >= 2 THEN 1 ELSE 0 END",
        "(//a)[3]": f"CASE WHEN {n_a} >= 3 THEN 1 ELSE 0 END",
        "a:hover": "0",
        "#main .x": "0",
        "//div[contains(@class,\"a\")]": "len(regexp_extract_all(html, '<div [^>]*class=\"[^\"]*a[^\"]*\"'))",
        "body > article > h1": "len(regexp_extract_all(html, '(?s)<body>.*<article><h1\\b'))",
        "//*[@href=\"/to\"]": "len(regexp_extract_all(html, '<[a-z]+ [^>]*href=\"/to\"'))",
        "li a": "len(regexp_extract_all(html, '<li><a\\b'))",
        "html": "len(regexp_extract_all(html, '<html\\b'))",
        "*": "len(regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9]*'))",
    }
    return f"CAST({m[sel]} AS INTEGER)"


@register("selector_count", "\nUNION ALL\n".join(
    f"SELECT page_id, {D.q(s)} AS selector, {_count_sql(s)} AS n FROM pages" for s in SELECTORS))
def q_selector_count(t: Tables):
    """X4+X7: match counts of CSS/XPath selectors (unsupported -> 0, never 'everything'),
    all selectors evaluated in one pass over each shredded page."""
    sh = shred(t.pages)
    counts = sh.select("page_id", *[X.selector_count(sel_literal(s)).alias(f"c{i}") for i, s in enumerate(SELECTORS)])
    pairs = ", ".join(f"'{s.replace(chr(39), chr(39) * 2)}', c{i}" for i, s in enumerate(SELECTORS))
    return counts.selectExpr("page_id", f"stack({len(SELECTORS)}, {pairs}) AS (selector, n)")


@register("outer_sample", """SELECT page_id, substr(regexp_extract(html, '(?s)<h1[^>]*>.*?</h1>', 0), 1, 200) AS h1_sample,
  substr(regexp_extract(html, '(?s)<article[^>]*>.*</article>', 0), 1, 1500) AS article_sample FROM pages""")
def q_outer_sample(t: Tables):
    """Outer HTML samples of the first match (>= 200 chars cap)."""
    sh = shred(t.pages)
    return sh.select("page_id", X.outer_sample(sel_literal("h1"), 100).alias("h1_sample"),
                     X.outer_sample(sel_literal("//article"), 1500).alias("article_sample"))


_NAV_HREFS_SQL = f"""n AS (SELECT page_id, url AS base, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), {D.q(ANCHOR_D)}, 1) AS l FROM pages),
raw AS (SELECT page_id, base, unnest(range(len(l))) AS i, substr(unnest(l), 2, length(unnest(l)) - 2) AS raw FROM n)"""


@register("select_links", f"WITH {_NAV_HREFS_SQL},\n{_links_sql('raw', 'page_id')}")
def q_select_links(t: Tables):
    """Links of the elements matched by 'nav li' (own href or first descendant <a>)."""
    sh = shred(t.pages)
    return sh.select("page_id", F.posexplode(X.select_links(sel_literal("nav li"), F.col("url"))).alias("pos", "url")) \
        .withColumn("pos", F.col("pos").cast("bigint"))


_ALL_HREFS_SQL = f"""n AS (SELECT page_id, url AS base, regexp_extract_all(html, {D.q(ANCHOR_D)}, 1) AS l FROM pages),
raw AS (SELECT page_id, base, unnest(range(len(l))) AS i, substr(unnest(l), 2, length(unnest(l)) - 2) AS raw FROM n)"""


@register("anchor_links", f"WITH {_ALL_HREFS_SQL},\n{_links_sql('raw', 'page_id')}")
def q_anchor_links(t: Tables):
    """Every quoted anchor href of the page, cleaned (absolute, safe, normalised, distinct)."""
    return t.pages.select("page_id", F.posexplode(X.anchor_links(F.col("html"), F.col("url"))).alias("pos", "url")) \
        .withColumn("pos", F.col("pos").cast("bigint"))


def link_slot(selector: str, before: str, after: str, json_path: str, field: str = ""):
    return F.struct(F.lit(selector).alias("selector"), F.lit(before).alias("before"), F.lit(after).alias("after"),
                    F.lit(json_path).alias("json_path"), F.lit(field).alias("json_url_field"),
                    sel_literal(selector).alias("sel"))


def field_slot(selector: str, before: str, after: str, json_path: str):
    return F.struct(F.lit(selector).alias("selector"), F.lit(before).alias("before"), F.lit(after).alias("after"),
                    F.lit(json_path).alias("json_path"), sel_literal(selector).alias("sel"))


# Fixed per-page strategies (page_id % 4): JSON items; marker slice over the nav; selector
# 'nav li'; no configuration (all anchors).
LINK_STRATEGIES = [("", "", "", "props.pageProps.items"), ("", "<nav>", "</nav>", ""), ("nav li", "", "", ""),
                   ("", "", "", "")]


def _strategy(col_key, slots):
    k = F.col("page_id") % len(slots)
    out = slots[-1]
    for i in range(len(slots) - 2, -1, -1):
        out = F.when(k == i, slots[i]).otherwise(out)
    return out


@register("discover_links", f"""WITH {_JSON_ITEMS_SQL},
{_ALL_HREFS_SQL.replace('FROM pages', 'FROM f_pages_json').replace('n AS (', 'an AS (').replace('FROM n)', 'FROM an)').replace('raw AS (', 'araw AS (')},
nv AS (SELECT page_id, url AS base, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), {D.q(ANCHOR_D)}, 1) AS l FROM f_pages_json),
nraw AS (SELECT page_id, base, unnest(range(len(l))) AS i, substr(unnest(l), 2, length(unnest(l)) - 2) AS raw FROM nv),
pick AS (SELECT page_id, base, i, raw FROM raw WHERE page_id % 4 = 0
   UNION ALL SELECT page_id, base, i, raw FROM nraw WHERE page_id % 4 IN (1, 2)
   UNION ALL SELECT page_id, base, i, raw FROM araw WHERE page_id % 4 = 3),
{_links_sql('pick', 'page_id')}""", ("f_pages_json",))
def q_discover_links(t: Tables):
    """X11: link discovery with precedence JSON > marker slice > selector > all anchors,
    one strategy per page (rules differ per page)."""
    sh = shred(t.f_pages_json)
    js = J.page_json(F.col("html"), F.lit("__NEXT_DATA__"))
    slots = [link_slot(*s) for s in LINK_STRATEGIES]
    links = X.discover_links(F.col("url"), js, _strategy("page_id", slots))
    return sh.select("page_id", F.posexplode(links).alias("pos", "url")).withColumn("pos", F.col("pos").cast("bigint"))


@register("link_match_count", f"""WITH j AS (SELECT page_id, html, {_next_json_sql()} AS js FROM f_pages_json)
SELECT page_id, CAST(CASE page_id % 4 WHEN 0 THEN 3
  WHEN 1 THEN len(list_distinct(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), {D.q(ANCHOR_D)}, 1)))
  WHEN 2 THEN len(regexp_extract_all(html, '<li\\b'))
  ELSE len(list_distinct(regexp_extract_all(html, {D.q(ANCHOR_D)}, 1))) END AS INTEGER) AS n
FROM j""", ("f_pages_json",))
def q_link_match_count(t: Tables):
    """X15 (links): match counts with the same precedence as discovery."""
    sh = shred(t.f_pages_json)
    js = J.page_json(F.col("html"), F.lit("__NEXT_DATA__"))
    slots = [link_slot(*s) for s in LINK_STRATEGIES]
    return sh.select("page_id", X.link_match_count(js, _strategy("page_id", slots)).alias("n"))


# per page (page_id % 4): JSON title; h1 inside the article slice; selector only; marker slice only
TITLE_STRATEGIES = [("", "", "", "props.pageProps.title"), ("h1", "<article>", "</article>", ""), ("//h1", "", "", ""),
                    ("", "<h1>", "</h1>", "")]
CONTENT_STRATEGIES = [("", "", "", "props.pageProps.items"), ("article", "<body>", "</body>", ""),
                      ("//h2", "", "", ""), ("", "<article>", "</article>", "")]


# by JSON path, none, by selector, between markers
DATE_STRATEGIES = [("", "", "", "props.pageProps.created"), ("", "", "", ""), ("//h1", "", "", ""), ("", "<h1>", "</h1>", "")]


@register("extract_field", f"""WITH j AS (SELECT page_id, html, {_next_json_sql()} AS js FROM f_pages_json),
x AS (SELECT page_id,
  CASE page_id % 4 WHEN 0 THEN {D.text_of("coalesce(json_extract_string(js, '$.props.pageProps.title'), '')")}
       WHEN 3 THEN {D.text_of("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}
       ELSE {h1_text_sql()} END AS title,
  CASE page_id % 4 WHEN 0 THEN {D.trim_set("coalesce(json_extract_string(js, '$.props.pageProps.items'), '')")}
       WHEN 1 THEN CASE WHEN contains(html, '</body>') THEN {article_html_sql()} ELSE '' END WHEN 2 THEN ''
       ELSE {D.trim_set("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")} END AS content,
  CASE page_id % 4 WHEN 0 THEN coalesce(json_extract_string(js, '$.props.pageProps.created'), '')
       WHEN 2 THEN {h1_text_sql()} WHEN 3 THEN {D.text_of("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} ELSE '' END AS date
  FROM j)
SELECT page_id, title, content, date, CASE WHEN title = '' OR content = '' THEN 'title or content extraction failed' END AS extract_error
FROM x""", ("f_pages_json",))
def q_extract_field(t: Tables):
    """title/content with JSON > slice > selector precedence; empty -> failed."""
    sh = shred(t.f_pages_json).withColumn("page_json", J.page_json(F.col("html"), F.lit("__NEXT_DATA__")))
    sh = sh.withColumn("title", _strategy("page_id", [field_slot(*s) for s in TITLE_STRATEGIES])) \
        .withColumn("content", _strategy("page_id", [field_slot(*s) for s in CONTENT_STRATEGIES])) \
        .withColumn("date", _strategy("page_id", [field_slot(*s) for s in DATE_STRATEGIES]))
    out = X.extract_articles(sh)
    return out.select("page_id", F.col("x_title").alias("title"), F.col("x_content").alias("content"), F.col("x_date").alias("date"), "extract_error")


@register("field_match_count", f"""WITH j AS (SELECT page_id, html, {_next_json_sql()} AS js FROM f_pages_json)
SELECT page_id, CAST(CASE page_id % 4 WHEN 0 THEN CASE WHEN json_extract(js, '$.props.pageProps.title') IS NULL THEN 0 ELSE 1 END
    WHEN 3 THEN CASE WHEN {D.text_of("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} = '' THEN 0 ELSE 1 END
    ELSE len(regexp_extract_all(html, '<h1[ >]')) END AS INTEGER) AS title_n,
  CAST(CASE page_id % 4 WHEN 0 THEN 3 WHEN 1 THEN CASE WHEN contains(html, '</body>') THEN 1 ELSE 0 END WHEN 2 THEN 0 ELSE 1 END AS INTEGER) AS content_n
FROM j""", ("f_pages_json",))
def q_field_match_count(t: Tables):
    """X15 (fields): JSON count > selector count in slice > 1 if the slice has text."""
    sh = shred(t.f_pages_json).withColumn("page_json", J.page_json(F.col("html"), F.lit("__NEXT_DATA__")))
    ts = _strategy("page_id", [field_slot(*s) for s in TITLE_STRATEGIES])
    cs = _strategy("page_id", [field_slot(*s) for s in CONTENT_STRATEGIES])
    return sh.select("page_id", X.field_match_count(F.col("page_json"), ts).alias("title_n"),
                     X.field_match_count(F.col("page_json"), cs).alias("content_n"))


@register("shred", """SELECT page_id, CAST(len(regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9]*')) AS INTEGER) AS elements,
  CAST(len(regexp_extract_all(html, '<(?:img|br|meta|hr|input|link)\\b')) AS INTEGER) AS void_elements FROM pages""")
def q_shred(t: Tables):
    """The page shred: one element row per start tag (void elements included)."""
    from pagemill.operators.shred import explode_nodes
    n = explode_nodes(shred(t.pages))
    return n.groupBy("page_id").agg(F.count(F.lit(1)).cast("int").alias("elements"),
                                    F.count_if(F.col("tag").isin("img", "br", "meta", "hr", "input", "link"))
                                    .cast("int").alias("void_elements"))
