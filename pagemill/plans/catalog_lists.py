"""Registered queries on long keyword lists (C12, C13), free-form dates (C17), listings by key (O6,
O7), refused selectors (X4b) and the status gate (S2)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagemill.fixtures import AS_OF, Tables
from pagemill.functions.dates import date_coverage
from pagemill.functions.text import coerce_date
from pagemill.functions.urls import normalize_url
from pagemill.operators import keywords as K
from pagemill.operators import reports as R
from pagemill.operators.joins import rank_in_group
from pagemill.operators.selectors import refused_selectors
from pagemill.plans import duck as D
from pagemill.plans.collect import page_scan
from pagemill.plans.registry import register
from pagemill.session import scratch_path
from pagemill.sources.listing import Listing

# ------------------------------------------------------------------ keyword lists

_KEYWORDS_SQL = """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS keyword FROM benchmark),
k AS (SELECT CASE WHEN length(keyword) % 2 = 0 THEN 'even' ELSE 'odd' END AS list_id, keyword, length(keyword) % 5 AS value FROM w),
kw AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY keyword) - 1 AS pos FROM k),
d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS list_id, lower(text) AS t FROM documents),
hit AS (SELECT doc_id, pos, keyword, value FROM d JOIN kw USING (list_id) WHERE contains(t, lower(keyword)))
"""


@register("keyword_lists", _KEYWORDS_SQL + """SELECT d.doc_id, coalesce(c.category_id, 0) AS category_id, coalesce(h.n_tags, 0) AS n_tags, coalesce(h.tags, '') AS tags FROM d
LEFT JOIN (SELECT doc_id, count(*) AS n_tags, string_agg(keyword, '|' ORDER BY pos) AS tags FROM hit GROUP BY doc_id) h USING (doc_id)
LEFT JOIN (SELECT doc_id, arg_min(value, pos) AS category_id FROM hit WHERE value > 0 GROUP BY doc_id) c USING (doc_id)""")
def q_keyword_lists(t: Tables):
    """C12+C13 with long lists: every word of the benchmark is a keyword of one of two lists; per
    document the category of its first keyword and all its tags, in one pass over its text."""
    words = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("keyword")).distinct()
    of = lambda n: F.when(n % 2 == 0, F.lit("even")).otherwise(F.lit("odd"))
    listed = words.select(of(F.length("keyword")).alias("list_id"), "keyword", (F.length("keyword") % 5).alias("value"))
    kws = rank_in_group(listed, ["list_id"], ["keyword"], "n").select("list_id", (F.col("n") - 1).alias("pos"), "keyword", "value")
    hits = K.keyword_hits(t.documents, F.col("text"), of(F.col("doc_id")), kws)
    tags = K.hit_tags(F.col("hits"))
    return hits.select("doc_id", K.first_category(F.col("hits")).alias("category_id"), F.size(tags).cast("long").alias("n_tags"),
                       F.array_join(tags, "|").alias("tags"))


# ------------------------------------------------------------------ listings by key

def _listing(t: Tables, rows, key: str) -> Listing:
    out = Listing(t.spark, scratch_path(t.spark, f"listing-{uuid.uuid4().hex}"), rows.schema, key)
    out.add(rows)
    return out


@register("list_queue_after", f"""WITH m AS (SELECT * FROM f_queue WHERE status = 'failed' AND contains(lower(last_error), 'image')
                          AND (scheduled_at IS NULL OR scheduled_at <= TIMESTAMP '{AS_OF}') AND queue_id < (SELECT max(queue_id) // 2 FROM f_queue))
SELECT p.queue_id, p.rule_id, p.status, p.last_error, r.name AS rule_name
FROM (SELECT * FROM m ORDER BY queue_id DESC LIMIT 50) p LEFT JOIN f_rules r ON p.rule_id = r.rule_id""", ("f_queue", "f_rules"))
def q_list_queue_after(t: Tables):
    """O6 by key: the page of failed due items with image errors below the middle id."""
    after = (t.f_queue.agg(F.max("queue_id")).first()[0] or 0) // 2
    out = R.list_queue_after(_listing(t, t.f_queue, "queue_id"), t.f_rules, after, status="failed", error_has="IMAGE", due="ready", as_of=AS_OF)
    return out.select("queue_id", "rule_id", "status", "last_error", "rule_name")


@register("list_logs_after", """WITH m AS (SELECT * FROM f_logs WHERE level = 'info' AND (contains(lower(message), 'rewrite') OR contains(lower(url), 'rewrite'))
                          AND log_id < (SELECT max(log_id) // 3 FROM f_logs))
SELECT p.log_id, p.rule_id, p.message, r.name AS rule_name
FROM (SELECT * FROM m ORDER BY log_id DESC LIMIT 80) p LEFT JOIN f_rules r ON p.rule_id = r.rule_id""", ("f_logs", "f_rules"))
def q_list_logs_after(t: Tables):
    """O7 by key: the page of info logs on rewriting below a third of the ids."""
    after = (t.f_logs.agg(F.max("log_id")).first()[0] or 0) // 3
    out = R.list_logs_after(_listing(t, t.f_logs, "log_id"), t.f_rules, after, level="info", text="Rewrite")
    return out.select("log_id", "rule_id", "message", "rule_name")


# ------------------------------------------------------------------ refused selectors

# (title selector, why it is refused or null), by part key; {n} is the part's size.
_SELECTORS = [
    ("h1", None), ("a:hover", "not a tag, #id or .class: a:hover"), ("div > .c{n}", None),
    ("ul li:nth-child({n})", "not a tag, #id or .class: li:nth-child({n})"), ("//li[{n}]", None),
    ('//p[text()="{n}"]', 'step not supported: p[text()="{n}"]'), ('//div[@data-k="{n}"]/p', "attribute test before the last step"),
    ("(//p)[last()]", "brackets without a position"), ("#a{n}#b", "not a tag, #id or .class: #a{n}#b"), ("", None),
    ("//ul/following-sibling::p", "step not supported: following-sibling::p"), (">", "no element named"),
]
_REMOVE = [(".ad{n}", None), ("p + p", "not a tag, #id or .class: +"), ("[role=note]", "not a tag, #id or .class: [role=note]")]


def _cases_sql(cases, of: int, field: int) -> str:
    text = lambda s: "NULL" if s is None else "replace(" + D.q(s) + ", '{n}', CAST(p_size AS VARCHAR))"
    return f"CASE p_partkey % {of} " + " ".join(f"WHEN {i} THEN {text(c[field])}" for i, c in enumerate(cases)) + " END"


@register("refused_selectors", f"""SELECT * FROM (
SELECT p_partkey AS rule_id, 'title' AS slot, {_cases_sql(_SELECTORS, len(_SELECTORS), 0)} AS selector, {_cases_sql(_SELECTORS, len(_SELECTORS), 1)} AS reason FROM part
UNION ALL SELECT p_partkey, 'remove', {_cases_sql(_REMOVE, len(_REMOVE), 0)}, {_cases_sql(_REMOVE, len(_REMOVE), 1)} FROM part)
WHERE reason IS NOT NULL""")
def q_refused_selectors(t: Tables):
    """Selectors of a rule table (one rule a part) that the engine refuses, with reasons."""
    def pick(cases):
        out = F.lit(None).cast("string")
        for i, (s, _) in enumerate(cases):
            out = F.when(F.col("p_partkey") % len(cases) == i, F.replace(F.lit(s), F.lit("{n}"), F.col("p_size").cast("string"))).otherwise(out)
        return out

    rules = t.part.select(F.col("p_partkey").alias("rule_id"), pick(_SELECTORS).alias("title"), F.array(pick(_REMOVE), F.lit("div")).alias("remove"))
    return refused_selectors(rules, {"title": F.col("title"), "remove": F.col("remove")})


# ------------------------------------------------------------------ free-form dates

# (raw text, time it names): Spark format of the time, or a template; and DuckDB's of the same.
_TS = f"TIMESTAMP '{AS_OF}'"
_DATES = [
    ("date_format(d, 'd MMMM yyyy')", "strftime(d, '%-d %B %Y')", "date_trunc('day', d)"),
    ("date_format(d, 'EEE, dd MMM yyyy HH:mm:ss') || ' +0800'", "strftime(d, '%a, %d %b %Y %H:%M:%S') || ' +0800'", "d - INTERVAL 8 HOUR"),
    ("date_format(d, 'MMM d, yyyy') || ' at ' || date_format(d, 'h:mm a')", "strftime(d, '%b %-d, %Y at %-I:%M %p')", "date_trunc('minute', d)"),
    ("date_format(d, 'M/d/yyyy HH:mm')", "strftime(d, '%-m/%-d/%Y %H:%M')", "date_trunc('minute', d)"),
    ("date_format(d, 'd.M.yyyy')", "strftime(d, '%-d.%-m.%Y')", "date_trunc('day', d)"),
    ("date_format(d, 'MMMM yyyy')", "strftime(d, '%B %Y')", "date_trunc('month', d)"),
    ("cast(n % 90 as string) || ' days ago'", "CAST(n % 90 AS VARCHAR) || ' days ago'", f"{_TS} - to_days(CAST(n % 90 AS INTEGER))"),
    ("'yesterday ' || date_format(d, 'HH:mm')", "'yesterday ' || strftime(d, '%H:%M')",
     f"date_trunc('day', {_TS}) - INTERVAL 1 DAY + (date_trunc('minute', d) - date_trunc('day', d))"),
    ("'day ' || cast(n as string)", "'day ' || CAST(n AS VARCHAR)", "CAST(NULL AS TIMESTAMP)"),
    ("''", "''", "CAST(NULL AS TIMESTAMP)"),
]
_DATES_SQL = f"""WITH e AS (SELECT doc_id AS n, source, TIMESTAMP '2021-03-04 05:06:07' + to_seconds(doc_id * 98765) AS d FROM documents),
r AS (SELECT n AS doc_id, source, CASE n % {len(_DATES)} {' '.join(f'WHEN {i} THEN {c[1]}' for i, c in enumerate(_DATES))} END AS raw,
  CASE n % {len(_DATES)} {' '.join(f'WHEN {i} THEN {c[2]}' for i, c in enumerate(_DATES))} END AS published_at FROM e)
"""


def _dated(t: Tables):
    e = t.documents.select(F.col("doc_id").alias("n"), "source", F.timestamp_add("SECOND", F.col("doc_id") * 98765, F.lit("2021-03-04 05:06:07").cast("timestamp_ntz")).alias("d"))
    raw = F.lit(None).cast("string")
    for i, (text, _, _) in enumerate(_DATES):
        raw = F.when(F.col("n") % len(_DATES) == i, F.expr(text)).otherwise(raw)
    rows = e.select(F.col("n").alias("doc_id"), "source", raw.alias("raw"))
    return rows.withColumn("published_at", coerce_date("raw", F.lit(AS_OF).cast("timestamp_ntz")))


@register("free_dates", _DATES_SQL + "SELECT doc_id, raw, published_at FROM r")
def q_free_dates(t: Tables):
    """C17: dates by month name, number order, zone, clock of twelve hours and relative to a time."""
    return _dated(t).select("doc_id", "raw", "published_at")


@register("date_coverage", _DATES_SQL + """SELECT source, count_if(raw = '') AS empty, count_if(raw <> '' AND published_at IS NOT NULL) AS understood,
  count_if(raw <> '' AND published_at IS NULL) AS refused FROM r GROUP BY source""")
def q_date_coverage(t: Tables):
    """C17: per source how many dates were empty, understood and refused."""
    return date_coverage(_dated(t), ["source"], "raw", "published_at")


# ------------------------------------------------------------------ status gate

@register("status_gate", f"""WITH k AS (SELECT md5({D.normalize_url('url')}) AS h, min(page_id) AS page_id FROM pages GROUP BY 1),
s AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 199 WHEN 2 THEN 299 WHEN 3 THEN 300 WHEN 4 THEN NULL ELSE 200 END AS status, html FROM pages)
SELECT p.page_id AS queue_id, k.page_id, CASE WHEN NOT {D.is_safe_url(D.normalize_url('p.url'))} THEN 'unsafe URL' WHEN s.status < 200 OR s.status > 299 THEN 'HTTP status ' || CAST(s.status AS VARCHAR)
  WHEN coalesce(s.html, '') = '' THEN 'page fetch failed' END AS fetch_error
FROM pages p JOIN k ON md5({D.normalize_url('p.url')}) = k.h JOIN s ON s.page_id = k.page_id""")
def q_status_gate(t: Tables):
    """Pages with a response status; what is not 200 to 299 fails with its status."""
    k = F.col("page_id") % 7
    status = F.when(k == 0, 404).when(k == 1, 199).when(k == 2, 299).when(k == 3, 300).when(k == 4, F.lit(None)).otherwise(200)
    items = t.pages.select(F.col("page_id").alias("queue_id"), normalize_url(F.col("url")).alias("url"))
    return page_scan(items, t.pages.withColumn("status", status)).select("queue_id", "page_id", "fetch_error")
