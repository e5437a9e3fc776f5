"""Registered queries (see registry)."""

from pyspark.sql import functions as F

from pagemill.fixtures import AS_OF, Tables
from pagemill.plans.collect import collect
from pagemill.plans.corpus import corpus_rules, seed_queue
from pagemill.plans.discover import corpus_list_pages, discover
from pagemill.plans.registry import register


def collect_corpus(t: Tables):
    """The collect job over the whole page corpus: one rule per host, every page a due
    item; published articles of the fixture count for duplicate tests."""
    from pagemill.plans.catalog_content import _assets
    from pagemill.operators.images import image_candidates
    rules = corpus_rules(t.pages)
    queue = seed_queue(t.pages, AS_OF)
    published = t.f_published_pages.withColumn("title", F.lit("")).withColumn("status", F.lit("publish"))
    cands = image_candidates(t.pages.select(F.col("page_id").alias("article_id"), F.col("url").alias("source_url"),
                                            F.col("html").alias("content")))
    return collect(queue, rules, t.pages, published, AS_OF, assets=_assets(cands))


# ------------------------------------------------------------------ rewrite hand-off

from pagemill.operators import rewrite as W  # noqa: E402
from pagemill.plans import duck as D  # noqa: E402
from pagemill.plans.catalog_scalars import _URL_POOL_SQL, _url_pool, schedule_minutes_sql  # noqa: E402
from pagemill.operators.queue import MSG_DUPLICATE  # noqa: E402
from pagemill.plans.catalog_pages import _ALL_HREFS_SQL, _links_sql, article_html_sql, h1_text_sql  # noqa: E402


def _discover_sql(queued: bool) -> str:
    """Discovery in SQL: every page is a list page of its host's rule; links in page order,
    first occurrence per rule, without published (and already queued) ones."""
    rid = f"CAST('0x' || substr(md5(lower({D.host_of('url')})), 1, 15) AS BIGINT)"
    seen = "AND NOT EXISTS (SELECT 1 FROM f_queue q WHERE q.rule_id = f.rule_id AND md5(" + D.normalize_url("q.url") + ") = f.h)" if queued else ""
    page_links = _links_sql("raw", "page_id").replace("\nSELECT page_id,", ",\npage_links AS (SELECT page_id,")
    return f"""WITH {_ALL_HREFS_SQL},
{page_links}),
keys AS (SELECT md5({D.normalize_url('url')}) AS h, min(page_id) AS src FROM pages GROUP BY 1),
listed AS (SELECT page_id AS list_pos, {rid} AS rule_id, md5({D.normalize_url('url')}) AS h FROM pages WHERE {D.host_of('url')} <> ''),
found AS (SELECT l.rule_id, row(l.list_pos, p.pos) AS pos, {D.normalize_url('p.url')} AS u
  FROM listed l JOIN keys k ON l.h = k.h JOIN page_links p ON p.page_id = k.src),
one AS (SELECT rule_id, u AS url, md5(u) AS h, min(pos) AS pos FROM found WHERE {D.is_safe_url('u')} GROUP BY rule_id, u),
fresh AS (SELECT * FROM one f WHERE h NOT IN (SELECT md5({D.normalize_url('source_url')}) FROM f_published_pages) {seen})
"""


_DISCOVER_COLS = f"""SELECT rule_id, url, h AS url_hash, 'pending' AS status, 0 AS attempts,
  CAST('{AS_OF}' AS TIMESTAMP) AS discovered_at, CAST('{AS_OF}' AS TIMESTAMP) AS scheduled_at,
  row_number() OVER (PARTITION BY rule_id ORDER BY pos, h) - 1 AS "offset", pos[1] AS list_pos, pos[2] AS link_pos FROM fresh"""


@register("discover_links_job", _discover_sql(True) + _DISCOVER_COLS, ("f_queue", "f_published_pages"))
def q_discover_links_job(t: Tables):
    """§3.1 end to end: every page as a list page of its host's rule -> new queue items."""
    rules = corpus_rules(t.pages)
    res = discover(rules, t.pages, t.f_queue, t.f_published_pages, AS_OF, listed=corpus_list_pages(t.pages))
    return res.new_items.select("*", "pos.*").drop("pos")


def _collect_sql() -> str:
    """The collect job in SQL, up to each item's outcome: page by address, title and article by
    the host's rule, replacements, published sources, titles within the batch."""
    url = D.normalize_url("url")
    return f"""WITH items AS (
  SELECT page_id AS queue_id, CAST('0x' || substr(md5(lower({D.host_of('url')})), 1, 15) AS BIGINT) AS rule_id, {url} AS url FROM pages),
rules AS (SELECT *, rule_id % 1000 AS k FROM items),
keys AS (SELECT md5({url}) AS h, min(page_id) AS src FROM pages GROUP BY 1),
fetched AS (
  SELECT r.*, p.html, CASE WHEN NOT {D.is_safe_url('r.url')} THEN 'unsafe URL'
    WHEN p.html IS NULL OR p.html = '' THEN 'page fetch failed' END AS fetch_error
  FROM rules r LEFT JOIN keys ON md5(r.url) = keys.h LEFT JOIN pages p ON p.page_id = keys.src),
cut AS (
  SELECT *, CASE WHEN k % 4 = 3 THEN {D.text_of("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} ELSE {h1_text_sql()} END AS t0,
    CASE WHEN k % 5 = 4 THEN {D.trim_set("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")} ELSE {article_html_sql()} END AS c0
  FROM fetched),
got AS (
  SELECT *, coalesce(fetch_error, CASE WHEN t0 = '' OR c0 = '' THEN 'title or content extraction failed' END) AS error,
    CASE WHEN k % 2 = 0 THEN replace(replace(replace(t0, '&amp;&amp;&amp;', '&amp;'), '%%%', ''), '###', '#') ELSE t0 END AS title
  FROM cut),
known AS (
  SELECT *, k % 5 <> 2 AND md5(url) IN (SELECT md5({D.normalize_url('source_url')}) FROM f_published_pages) AS published,
    {D.strip_tags('title')} AS bare
  FROM got WHERE error IS NULL),
firsts AS (SELECT bare, min(queue_id) AS q FROM known WHERE NOT published GROUP BY bare),
judged AS (
  SELECT n.*, n.published OR (n.k % 5 <> 2 AND n.queue_id <> f.q) AS skip FROM known n LEFT JOIN firsts f ON n.bare = f.bare)
"""


_COLLECT_OUTCOMES = f"""SELECT queue_id, rule_id, url, CASE WHEN skip THEN 'skipped' ELSE 'success' END AS status, 1 AS attempts,
  CASE WHEN skip THEN '{MSG_DUPLICATE}' END AS last_error, CAST(NULL AS TIMESTAMP) AS scheduled_at, CAST('{AS_OF}' AS TIMESTAMP) AS finished_at,
  CASE WHEN NOT skip THEN queue_id END AS article_id FROM judged
UNION ALL SELECT queue_id, rule_id, url, CASE WHEN 1 >= k % 4 THEN 'failed' ELSE 'pending' END, 1, error,
  CAST('{AS_OF}' AS TIMESTAMP) + CASE WHEN 1 >= k % 4 THEN 0 ELSE 300 END * INTERVAL '1' SECOND, CAST('{AS_OF}' AS TIMESTAMP), NULL
  FROM got WHERE error IS NOT NULL"""


def _collect_articles_sql() -> str:
    """The publish record of every successful item. The corpus's articles hold nothing that the
    rules' cleaning removes, and no images."""
    from pagemill.plans.catalog_scalars import allow_sql

    category = ("CASE WHEN contains(ctx, 'the') THEN 3 WHEN contains(ctx, 'de') THEN 5 WHEN contains(ctx, 'und') THEN 7 "
                "WHEN contains(ctx, 'la') THEN 11 ELSE k % 4 END")
    auto = ", ".join(f"CASE WHEN k % 3 <> 1 AND contains(ctx, '{w}') THEN '{w}' END" for w in ["news", "the", "de", "und"])
    seo = "CASE k % 4 WHEN 0 THEN json_object('_yoast_wpseo_title', seo_title, '_yoast_wpseo_metadesc', seo_desc) " \
          "WHEN 1 THEN json_object('rank_math_title', seo_title, 'rank_math_description', seo_desc) END"
    return _collect_sql() + f""",
bodies AS (SELECT *, {D.trim_set("CASE WHEN k % 2 = 0 THEN replace(replace(replace(c0, '&amp;&amp;&amp;', '&amp;'), '%%%', ''), '###', '#') ELSE c0 END")} AS body
  FROM judged WHERE NOT skip),
texts AS (SELECT *, lower(title || chr(10) || {D.strip_tags('body')}) AS ctx, substr({D.text_of('body')}, 1, CAST(60 + k % 200 AS INTEGER)) AS exc FROM bodies),
ready AS (SELECT *, bare || ' | ' AS seo_title, {D.strip_tags('exc')} AS seo_desc FROM texts)
SELECT queue_id AS article_id, bare AS title, {allow_sql('body')} AS content, exc AS excerpt,
  CASE WHEN k % 7 = 0 THEN 'future' WHEN k % 6 = 0 THEN 'publish' ELSE 'draft' END AS status,
  CASE WHEN k % 7 = 0 THEN CAST('{AS_OF}' AS TIMESTAMP) + {schedule_minutes_sql('url', '10', '90')} * INTERVAL '1' MINUTE END AS published_at,
  CAST(1 AS BIGINT) AS author_id, coalesce(CAST(nullif({category}, 0) AS VARCHAR), '') AS categories,
  array_to_string(['corpus', 'imported'] || list_filter([{auto}], lambda x: x IS NOT NULL), '|') AS tags, url AS source_url,
  CAST({seo} AS VARCHAR) AS seo, CAST(NULL AS VARCHAR) AS featured_image FROM ready"""


@register("collect_articles", _collect_articles_sql(), ("f_published_pages",))
def q_collect_articles(t: Tables):
    """§3.2 end to end: published article records of the corpus collect pass."""
    a = collect_corpus(t).articles
    return a.select("article_id", "title", "content", "excerpt", "status", "published_at", "author_id",
                    F.array_join(F.transform("category_ids", lambda x: x.cast("string")), ",").alias("categories"),
                    F.array_join("tags", "|").alias("tags"), "source_url",
                    F.to_json("seo").alias("seo"), "featured_image")


@register("collect_transitions", _collect_sql() + _COLLECT_OUTCOMES, ("f_published_pages",))
def q_collect_transitions(t: Tables):
    """§3.2 end to end: the queue state written for every processed item."""
    return collect_corpus(t).transitions


def _parse_sql(resp: str) -> str:
    m = f"regexp_replace(regexp_replace({D.trim_set(resp)}, '(?i)^```(?:json)?\\s*', ''), '\\s*```$', '')"
    return f"""p0 AS (SELECT *, {m} AS m FROM src),
p1 AS (SELECT *, CASE WHEN json_valid(m) AND (starts_with(m, '{{') OR starts_with(m, '[')) THEN m
                      WHEN regexp_extract(m, '(?s)\\{{.*\\}}', 0) <> '' AND json_valid(regexp_extract(m, '(?s)\\{{.*\\}}', 0))
                      THEN regexp_extract(m, '(?s)\\{{.*\\}}', 0) END AS js FROM p0),
p2 AS (SELECT *, {D.trim_set(D.strip_tags("CASE WHEN js IS NOT NULL THEN coalesce(json_extract_string(js, '$.title'), '') ELSE '' END"))} AS new_title,
              {D.trim_set("CASE WHEN js IS NOT NULL THEN coalesce(json_extract_string(js, '$.content'), '') ELSE m END")} AS new_content FROM p1),
p3 AS (SELECT *, CASE WHEN new_content = '' THEN {D.q(W.MSG_EMPTY)} WHEN length({D.strip_tags('new_content')}) < 80 THEN {D.q(W.MSG_TOO_SHORT)} END AS error FROM p2)"""


@register("parse_rewrites", f"""WITH src AS (SELECT * FROM f_rewrites), {_parse_sql('response')}
SELECT article_id, new_title AS title, new_content AS content, error FROM p3""", ("f_rewrites",))
def q_parse_rewrites(t: Tables):
    """Model responses parsed (fenced JSON / embedded object / plain text)."""
    r = W.parse_rewrite(F.col("response"))
    return t.f_rewrites.select("article_id", r["title"].alias("title"), r["content"].alias("content"),
                               r["error"].alias("error"))


# Articles with an even id have two images; of their plain-text rewrites those with an id
# divisible by four keep one and the others none.
_TWO_IMAGES = '<img src="https://a.example.com/1.png"><img src="https://a.example.com/2.png">'
_ONE_IMAGE = '<img src="https://a.example.com/1.png">'
_IMAGES_SQL = "((length({0}) - length(replace({0}, '<img', ''))) // 4)"


@register("rewrite_gate", f"""WITH src AS (SELECT article_id, on_failure,
  CASE WHEN article_id % 2 = 0 THEN {D.q(_TWO_IMAGES)} ELSE '' END || original AS original,
  CASE WHEN article_id % 4 = 0 AND response <> '' AND NOT starts_with(response, '```') THEN {D.q(_ONE_IMAGE)} ELSE '' END || response AS response
  FROM f_rewrites), {_parse_sql('response')},
c AS (SELECT *, {_IMAGES_SQL.format('original')} AS n_old, {_IMAGES_SQL.format('new_content')} AS n_new FROM p3),
g AS (SELECT *, CASE WHEN error IS NOT NULL THEN error
        WHEN new_content = '' OR length({D.strip_tags('new_content')}) < greatest(80, CAST(floor(length({D.strip_tags('original')}) * 0.25) AS INTEGER))
        THEN {D.q(W.MSG_TOO_SHORT)} WHEN n_old > 0 AND n_new = 0 THEN {D.q(W.MSG_IMAGES_LOST)} END AS reason FROM c)
SELECT article_id, CASE WHEN reason IS NULL THEN 'rewrite' WHEN on_failure = 'fail' THEN 'fail' ELSE 'fallback' END AS action,
  reason, CASE WHEN reason IS NULL AND n_old > n_new THEN {D.q(W.MSG_IMAGES_FEWER)} END AS warning,
  CASE WHEN reason IS NULL AND new_title <> '' THEN new_title ELSE '' END AS final_title,
  CASE WHEN reason IS NULL THEN new_content ELSE original END AS final_content
FROM g""", ("f_rewrites",))
def q_rewrite_gate(t: Tables):
    """Quality gate and failure policy (fail -> item fails, fallback -> original)."""
    i = F.col("article_id")
    plain = (F.col("response") != "") & ~F.col("response").startswith("```")
    rows = t.f_rewrites.withColumn("original", F.concat(F.when(i % 2 == 0, _TWO_IMAGES).otherwise(""), "original")) \
        .withColumn("response", F.concat(F.when((i % 4 == 0) & plain, _ONE_IMAGE).otherwise(""), "response"))
    out = W.apply_policy(rows.withColumn("title", F.lit("")), "title", "original", "response", "on_failure")
    return out.select("article_id", "action", "reason", "warning", "final_title", "final_content")


@register("rewrite_requests", f"""SELECT article_id, {D.q(W.DEFAULT_PROMPT)} AS system_prompt,
  {D.q(W.USER_TITLE_LABEL)} || {D.strip_tags('title')} || {D.q(W.USER_BODY_LABEL)} || substr(content, 1, 1000) AS user_content,
  0.7 AS temperature FROM f_articles""", ("f_articles",))
def q_rewrite_requests(t: Tables):
    """Request rows (prompt precedence, body cut to the clamped input size)."""
    out = W.rewrite_requests(t.f_articles, max_input_chars=500, temperature=0.7)
    return out.select("article_id", "system_prompt", "user_content", "temperature")


@register("rewrite_requests_whole", f"""SELECT article_id, {D.q(W.DEFAULT_PROMPT)} AS system_prompt,
  {D.q(W.USER_TITLE_LABEL)} || {D.strip_tags('title')} || {D.q(W.USER_BODY_LABEL)} || content AS user_content,
  0.7 AS temperature FROM f_articles""", ("f_articles",))
def q_rewrite_requests_whole(t: Tables):
    """Request rows with the whole body of every article."""
    out = W.rewrite_requests(t.f_articles, temperature=0.7)
    return out.select("article_id", "system_prompt", "user_content", "temperature")


def _responses(t: Tables):
    d = F.col("doc_id")
    js = F.to_json(F.struct(F.concat(F.lit("R "), d.cast("string")).alias("title"), F.col("text").alias("content")))
    resp = F.when(d % 3 == 0, F.concat(F.lit("```json\n"), js, F.lit("\n```"))).when(d % 3 == 1, F.lit("")) \
        .otherwise(F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")))
    return t.documents.select(F.col("doc_id").alias("article_id"), resp.alias("response"))


@register("rewrite_published", f"""WITH src AS (SELECT a.article_id, a.title, a.content,
   CASE d.doc_id % 3 WHEN 0 THEN '```json' || chr(10) || json_object('title', 'R ' || CAST(d.doc_id AS VARCHAR), 'content', d.text) || chr(10) || '```'
                     WHEN 1 THEN '' ELSE '<p>' || d.text || '</p>' END AS response
   FROM f_articles a JOIN documents d ON a.article_id = d.doc_id), {_parse_sql('response')},
g AS (SELECT *, CASE WHEN error IS NOT NULL THEN error
        WHEN new_content = '' OR length({D.strip_tags('new_content')}) < greatest(80, CAST(floor(length({D.strip_tags('content')}) * 0.25) AS INTEGER))
        THEN {D.q(W.MSG_TOO_SHORT)} END AS reason FROM p3)
SELECT article_id, CASE WHEN reason IS NULL AND new_title <> '' THEN new_title ELSE title END AS title,
  CASE WHEN reason IS NULL THEN new_content ELSE content END AS content, reason IS NULL AS rewritten, reason
FROM g""", ("f_articles",))
def q_rewrite_published(t: Tables):
    """Re-rewrite of published articles; any failure leaves the article untouched."""
    return W.rewrite_published(t.f_articles, _responses(t))


# ------------------------------------------------------------------ validation, previews (V)

from pagemill.sources import rules_io as RIO  # noqa: E402
from pagemill.operators import preview as PV  # noqa: E402


def _absint_sql(x: str) -> str:
    return f"CAST(abs(CAST(trunc(coalesce(TRY_CAST(CAST({x} AS VARCHAR) AS DOUBLE), 0)) AS BIGINT)) AS INTEGER)"


_V6 = {
    "batch_limit": f"least(greatest(1, {_absint_sql('batch_limit')}), 50)",
    "retry_limit": f"least({_absint_sql('retry_limit')}, 10)",
    "request_delay": f"least({_absint_sql('request_delay')}, 30)",
    "page_start": f"greatest(1, {_absint_sql('page_start')})",
    "page_end": f"greatest(greatest(1, {_absint_sql('page_end')}), greatest(1, {_absint_sql('page_start')}))",
    "publish_delay_min": _absint_sql("publish_delay_min"),
    "publish_delay_max": f"greatest({_absint_sql('publish_delay_max')}, {_absint_sql('publish_delay_min')})",
    "excerpt_length": f"least(greatest(50, {_absint_sql('excerpt_length')}), 500)",
    "post_status": "CASE WHEN post_status IN ('draft', 'publish', 'future', 'pending') THEN post_status ELSE 'draft' END",
    "publish_mode": "CASE WHEN publish_mode IN ('immediate', 'random_future') THEN publish_mode ELSE 'immediate' END",
    "seo_family": "CASE WHEN seo_family IN ('none', 'rank_math', 'yoast', 'aioseo') THEN seo_family ELSE 'none' END",
    "rewrite_on_failure": "CASE WHEN rewrite_on_failure IN ('fallback', 'fail') THEN rewrite_on_failure ELSE 'fallback' END",
    "json_source": f"CASE WHEN regexp_matches(substr({D.trim_set('json_source')}, 1, 100), "
                   f"'^(?:__NEXT_DATA__|next|ld\\+json|json-ld|id:[A-Za-z0-9_:\\-]+|var:[A-Za-z_$][A-Za-z0-9_$.]*)$') "
                   f"THEN substr({D.trim_set('json_source')}, 1, 100) ELSE '__NEXT_DATA__' END",
}


@register("validate_rules", "SELECT rule_id, " + ", ".join(f"{v} AS {k}" for k, v in _V6.items()) + ", concat_ws(',', "
          + ", ".join(f"CASE WHEN CAST({k} AS VARCHAR) IS DISTINCT FROM CAST({v} AS VARCHAR) THEN '{k}' END" for k, v in _V6.items())
          + ") AS violations FROM f_rule_set", ("f_rule_set",))
def q_validate_rules(t: Tables):
    """V6: clamps, enum repairs, page/delay ordering, JSON-source pattern; repaired fields listed."""
    v = RIO.validate_rules(t.f_rule_set)
    return v.withColumn("violations", F.array_join("violations", ","))


@register("preview_links", f"""WITH {_ALL_HREFS_SQL},
{_links_sql('raw', 'page_id').replace('SELECT page_id, u AS url,', 'SELECT page_id, u AS url, md5(u) AS h,', 1).replace('firsts AS', 'firsts AS', 1)}""".replace(
    "SELECT page_id, u AS url, md5(u) AS h, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS BIGINT) AS pos FROM firsts",
    f"""SELECT page_id, count(*) AS links, count_if(NOT dup) AS ready, count_if(dup) AS duplicates FROM (
  SELECT page_id, u, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos,
         md5({D.normalize_url('u')}) IN (SELECT md5({D.normalize_url('source_url')}) FROM f_published_pages) AS dup FROM firsts)
WHERE pos < 50 GROUP BY page_id"""), ("f_published_pages",))
def q_preview_links(t: Tables):
    """V1: list preview per page: first 50 links, ready vs already published."""
    from pagemill.operators import extract as X
    links = t.pages.select("page_id", F.posexplode(X.anchor_links(F.col("html"), F.col("url"))).alias("pos", "url"))
    p = PV.preview_links(links, t.f_published_pages)
    return p.select("page_id", "links", "ready", "duplicates")


@register("preview_links_whole", f"""WITH {_ALL_HREFS_SQL},
{_links_sql('raw', 'page_id').replace('SELECT page_id, u AS url,', 'SELECT page_id, u AS url, md5(u) AS h,', 1)}""".replace(
    "SELECT page_id, u AS url, md5(u) AS h, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS BIGINT) AS pos FROM firsts",
    f"""SELECT page_id, count(*) AS links, count_if(NOT dup) AS ready, count_if(dup) AS duplicates FROM (
  SELECT page_id, md5({D.normalize_url('u')}) IN (SELECT md5({D.normalize_url('source_url')}) FROM f_published_pages) AS dup FROM firsts)
GROUP BY page_id"""), ("f_published_pages",))
def q_preview_links_whole(t: Tables):
    """V1: list preview per page: all links, ready vs already published."""
    from pagemill.operators import extract as X
    links = t.pages.select("page_id", F.posexplode(X.anchor_links(F.col("html"), F.col("url"))).alias("pos", "url"))
    p = PV.preview_links(links, t.f_published_pages, most=None)
    return p.select("page_id", "links", "ready", "duplicates")


def _corpus_preview(t: Tables):
    from pagemill.functions import jsonpage as J
    from pagemill.operators.queue import due_items
    from pagemill.operators.shred import shred
    from pagemill.plans.corpus import compile_rule_selectors
    rules = compile_rule_selectors(corpus_rules(t.pages))
    items = seed_queue(t.pages, AS_OF)
    due = due_items(items, rules, AS_OF).select("queue_id", "rule_id", "url", "r_title", "r_content", "r_date", "r_clean",
                                                "r_json_source")
    j = due.join(t.pages.select(F.col("page_id").alias("queue_id"), "html"), "queue_id")
    sh = shred(j).withColumn("page_json", J.page_json(F.col("html"), F.col("r_json_source"))) \
        .withColumnRenamed("r_title", "title").withColumnRenamed("r_content", "content") \
        .withColumnRenamed("r_date", "date").withColumnRenamed("r_clean", "clean")
    return PV.preview_articles(sh)


def _preview_sql() -> str:
    """Previews in SQL: the corpus's articles hold nothing to clean and no images."""
    h1, article = "regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)", "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
    hrefs = _ALL_HREFS_SQL.replace("url AS base", f"{D.normalize_url('url')} AS base")
    links = _links_sql("raw", "page_id").replace("\nSELECT page_id,", ",\nanchors AS (SELECT page_id,") + ")"
    return f"""WITH {hrefs},
{links},
items AS (SELECT page_id AS queue_id, html, CAST('0x' || substr(md5(lower({D.host_of('url')})), 1, 15) AS BIGINT) AS rule_id FROM pages WHERE {D.host_of('url')} <> ''),
got AS (SELECT queue_id, rule_id, html, CASE WHEN rule_id % 1000 % 4 = 3 THEN {D.text_of(h1)} ELSE {h1_text_sql()} END AS x_title,
    CASE WHEN rule_id % 1000 % 5 = 4 THEN {D.trim_set(article)} ELSE {article_html_sql()} END AS x_content,
    CASE WHEN rule_id % 1000 % 4 = 3 THEN CAST({D.strip_tags(h1)} <> '' AS INTEGER) ELSE len(regexp_extract_all(html, '<h1[ >]')) END AS title_matches,
    CASE WHEN rule_id % 1000 % 5 = 4 THEN CAST({D.strip_tags(article)} <> '' AS INTEGER) ELSE len(regexp_extract_all(html, '<article[ >]')) END AS content_matches
  FROM items),
preview AS (SELECT queue_id, rule_id, x_title, CAST(length(x_content) AS INTEGER) AS raw_length, CAST(length({D.trim_set('x_content')}) AS INTEGER) AS clean_length,
    0 AS image_count, CAST(coalesce(a.n, 0) AS INTEGER) AS anchor_count, CAST(title_matches AS INTEGER) AS title_matches,
    CAST(content_matches AS INTEGER) AS content_matches,
    concat_ws(',', CASE WHEN x_title = '' THEN 'empty_title' END, CASE WHEN x_content = '' THEN 'empty_content' END,
      CASE WHEN x_content <> '' AND {D.strip_tags('x_content')} = '' THEN 'empty_after_clean' END) AS warnings
  FROM got LEFT JOIN (SELECT page_id, count(*) AS n FROM anchors GROUP BY page_id) a ON a.page_id = queue_id)
"""


@register("preview_articles", _preview_sql() + "SELECT * FROM preview")
def q_preview_articles(t: Tables):
    """V2+V3: article preview of every corpus page under its host's rule, with warnings."""
    p = _corpus_preview(t)
    return p.select("queue_id", "rule_id", "x_title", "raw_length", "clean_length", "image_count", "anchor_count",
                    "title_matches", "content_matches", F.array_join("warnings", ",").alias("warnings"))


@register("rule_coverage", _preview_sql() + "SELECT rule_id, count(*) AS pages, " + ", ".join(
    f"round(avg(CAST(contains(warnings, '{w}') AS INTEGER)), 4) AS {w}_share" for w in ["empty_title", "empty_content", "empty_after_clean", "empty_date"])
    + ", round(avg(title_matches), 4) AS avg_title_matches, round(avg(content_matches), 4) AS avg_content_matches FROM preview GROUP BY rule_id")
def q_rule_coverage(t: Tables):
    """V4: per rule share of pages with each warning and mean match counts."""
    return PV.rule_coverage(_corpus_preview(t))


@register("discovery_log", _discover_sql(True) + f"""SELECT rule_id, 'info' AS level,
  'links discovered: ' || CAST(count(*) AS VARCHAR) AS message, CAST('{AS_OF}' AS TIMESTAMP) AS created_at, count(*) AS added
FROM fresh GROUP BY rule_id""", ("f_queue", "f_published_pages"))
def q_discovery_log(t: Tables):
    """V7: links added per rule by a discovery pass, as log rows."""
    rules = corpus_rules(t.pages)
    res = discover(rules, t.pages, t.f_queue, t.f_published_pages, AS_OF, listed=corpus_list_pages(t.pages))
    return res.logs


# ------------------------------------------------------------------ sources and sinks (S)

from pagemill.plans.collect import page_scan  # noqa: E402
from pagemill.sources import sinks as SK  # noqa: E402


@register("page_scan", f"""WITH {_URL_POOL_SQL},
items AS (SELECT DISTINCT u AS url FROM pool WHERE NOT starts_with(src, 'r')),
keys AS (SELECT md5({D.normalize_url('url')}) AS h, min(page_id) AS page_id FROM pages GROUP BY 1)
SELECT i.url, k.page_id, CASE WHEN NOT {D.is_safe_url('i.url')} THEN 'unsafe URL' WHEN k.page_id IS NULL THEN 'page fetch failed' END AS fetch_error
FROM items i LEFT JOIN keys k ON md5({D.normalize_url('i.url')}) = k.h""", ("f_rule_set",))
def q_page_scan(t: Tables):
    """S1+S2: page URLs and resolved anchor links looked up in the corpus; missing pages
    and unsafe URLs become fetch failures."""
    items = _url_pool(t).where(~F.col("src").startswith("r")).select(F.col("u").alias("url")).distinct()
    return page_scan(items, t.pages).select("url", "page_id", "fetch_error")


@register("manual_urls", f"""WITH l AS (SELECT rule_id, {D.lines('list_urls_text')} AS ls FROM f_rule_set),
x AS (SELECT rule_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM l),
y AS (SELECT rule_id, {D.normalize_url('line')} AS u, i FROM x),
z AS (SELECT * FROM y WHERE {D.is_safe_url('u')}),
firsts AS (SELECT rule_id, u, min(i) AS i FROM z GROUP BY rule_id, u)
SELECT rule_id, u AS url, CAST(row_number() OVER (PARTITION BY rule_id ORDER BY i) - 1 AS INTEGER) AS pos FROM firsts""", ("f_rule_set",))
def q_manual_urls(t: Tables):
    """Manual URL blocks as (rule, position, URL) rows."""
    return RIO.manual_urls(t.f_rule_set, "list_urls_text")


@register("append_logs", f"""SELECT log_id, regexp_replace(lower(CASE WHEN log_id % 3 = 0 THEN upper(level) || ' !' ELSE level END), '[^a-z0-9_\\-]', '', 'g') AS level,
  {D.strip_tags("CASE WHEN log_id % 2 = 0 THEN '<b>' || message || '</b>' ELSE message END")} AS message, {D.trim_set("' ' || url")} AS url
FROM f_logs""", ("f_logs",))
def q_append_logs(t: Tables):
    """Log rows normalised for the sink (level key, tag-free message, trimmed URL)."""
    lg = t.f_logs.select("log_id", F.when(F.col("log_id") % 3 == 0, F.concat(F.upper("level"), F.lit(" !"))).otherwise(F.col("level")).alias("level"),
                         F.when(F.col("log_id") % 2 == 0, F.concat(F.lit("<b>"), F.col("message"), F.lit("</b>"))).otherwise(F.col("message")).alias("message"),
                         F.concat(F.lit(" "), F.col("url")).alias("url"))
    return SK.normalize_log_rows(lg)


_DIAGNOSTICS = ("struct<generated_at:string,counts:struct<rules:bigint,queue:map<string,bigint>,logs:bigint>,recent_errors:array<struct<"
                "rule_id:bigint,queue_id:bigint,level:string,message:string,url:string>>,failed_samples:array<struct<"
                "queue_id:bigint,rule_id:bigint,url:string,attempts:int,last_error:string>>>")


@register("diagnostics", f"""SELECT CAST('{AS_OF}' AS TIMESTAMP) AS generated_at, (SELECT count(*) FROM f_rules) AS rules, (SELECT count(*) FROM f_logs) AS logs,
  (SELECT string_agg(status || '=' || n, ',' ORDER BY status) FROM (SELECT status, count(*) AS n FROM f_queue GROUP BY status)) AS queue,
  (SELECT string_agg(concat_ws('|', rule_id, queue_id, level, message, url), ';' ORDER BY log_id DESC) FROM
    (SELECT * FROM f_logs WHERE level IN ('error', 'warning') ORDER BY log_id DESC LIMIT 20)) AS recent_errors,
  (SELECT string_agg(concat_ws('|', queue_id, rule_id, url, attempts, last_error), ';' ORDER BY queue_id DESC) FROM
    (SELECT * FROM f_queue WHERE status = 'failed' ORDER BY queue_id DESC LIMIT 20)) AS failed_samples""", ("f_rules", "f_queue", "f_logs"))
def q_diagnostics(t: Tables):
    """The diagnostics JSON (totals, status counts, newest problems, failed samples), read back
    into columns."""
    d = SK.diagnostics(t.f_rules, t.f_queue, t.f_logs, AS_OF).select("generated_at", F.from_json("report", _DIAGNOSTICS).alias("r"))
    text = lambda items: F.array_join(F.transform(items, lambda x: F.concat_ws("|", x)), ";")
    fields = lambda name, keys: text(F.transform(F.col(f"r.{name}"), lambda x: F.array_compact(F.array(*[x[k].cast("string") for k in keys]))))
    counts = F.transform(F.array_sort(F.map_entries("r.counts.queue")), lambda e: F.concat(e.key, F.lit("="), e.value))
    return d.select("generated_at", F.col("r.counts.rules").alias("rules"), F.col("r.counts.logs").alias("logs"), F.array_join(counts, ",").alias("queue"),
                    fields("recent_errors", ["rule_id", "queue_id", "level", "message", "url"]).alias("recent_errors"),
                    fields("failed_samples", ["queue_id", "rule_id", "url", "attempts", "last_error"]).alias("failed_samples"))


@register("conform_queue", """SELECT queue_id, rule_id, url, CAST(NULL AS VARCHAR) AS url_hash, status, attempts, last_error,
  CAST(NULL AS BIGINT) AS article_id, discovered_at, scheduled_at, started_at, finished_at FROM f_queue""", ("f_queue",))
def q_conform_queue(t: Tables):
    """The fixture queue conformed to the queue schema (missing columns added)."""
    return SK.conform_queue(t.f_queue)


_IMPORT_SQL = ("WITH imp AS (SELECT rule_id, name, enabled, pagination_pattern, page_start, page_end, batch_limit, retry_limit, "
               "request_delay, excerpt_length, post_status, json_source, 0 AS publish_delay_min, 0 AS publish_delay_max, "
               "'immediate' AS publish_mode, 'none' AS seo_family, 'fallback' AS rewrite_on_failure FROM f_rule_set)\nSELECT rule_id, " + ", ".join(f"{v} AS {k}" for k, v in _V6.items())
               + ", concat_ws(',', " + ", ".join(
                   f"CASE WHEN CAST({k} AS VARCHAR) IS DISTINCT FROM CAST({v} AS VARCHAR) THEN '{k}' END" for k, v in _V6.items())
               + ") AS violations FROM imp")


@register("import_rules", _IMPORT_SQL, ("f_rule_set",))
def q_import_rules(t: Tables):
    """S3+S4: rules exported to JSON (ordered, without ids/timestamps) and imported back
    with allow-listed keys and defaults."""
    from pyspark.sql import types as T
    from pagemill.session import scratch_path
    rs = t.f_rule_set.select("rule_id", "name", "enabled", "pagination_pattern", "page_start", "page_end", "batch_limit",
                             "retry_limit", "request_delay", "excerpt_length", "post_status", "json_source")
    import zlib
    path = scratch_path(t.spark, f"rules-export-{zlib.crc32(t.sf_dir.encode()):08x}")
    RIO.export_rules(rs, path)
    schema = T.StructType([f for f in rs.schema.fields if f.name != "rule_id"] + [T.StructField("author_id", T.LongType())])
    imported = RIO.import_rules(t.spark, path, {"author_id": 0, "enabled": True}, schema)
    return RIO.validate_rules(imported.withColumn("publish_delay_min", F.lit(0)).withColumn("publish_delay_max", F.lit(0))
                              .withColumn("publish_mode", F.lit("immediate")).withColumn("seo_family", F.lit("none"))
                              .withColumn("rewrite_on_failure", F.lit("fallback"))) \
        .withColumn("violations", F.array_join("violations", ","))


# ------------------------------------------------------------------ streaming (T)

def _stream_paths(t: Tables, name: str):
    """Output folder and checkpoint name of one run: every call streams its data anew."""
    import uuid
    from pagemill.session import scratch_path
    tag = f"{name}-{uuid.uuid4().hex}"
    return scratch_path(t.spark, "out-" + tag), tag


@register("stream_daily", """SELECT CAST(event_ts AS DATE) AS day, count(*) AS total_count,
  count_if(status = 'success') AS success_count, count_if(status = 'failed') AS failed_count
FROM f_transitions GROUP BY 1""", ("f_transitions",))
def q_stream_daily(t: Tables):
    """T5: daily transition counters computed by a watermarked windowed stream over the
    event files (AvailableNow), identical to the batch aggregate."""
    from pagemill.streaming.jobs import stream_daily
    out, tag = _stream_paths(t, "daily")
    return stream_daily(t.spark, t.sf_dir + "/event[s].parquet", out, AS_OF, name=tag)


@register("stream_queue_state", """SELECT queue_id, arg_max(rule_id, (event_ts, seq)) AS rule_id, arg_max(seq, (event_ts, seq)) AS seq,
  arg_max(status, (event_ts, seq)) AS status, max(event_ts) AS event_ts
FROM f_transitions GROUP BY queue_id""", ("f_transitions",))
def q_stream_queue_state(t: Tables):
    """T4: per-item state held by ``applyInPandasWithState`` over the transition stream;
    equals the batch fold (Q12) when no timer fires."""
    from pagemill.streaming.jobs import stream_queue_state
    out, tag = _stream_paths(t, "qstate")
    return stream_queue_state(t.spark, t.sf_dir + "/event[s].parquet", out, AS_OF, name=tag)


def _enrich_sql() -> str:
    ctx = f"lower(title || chr(10) || {D.strip_tags('content')})"
    exc = f"substr({D.text_of('content')}, 1, 160)"
    cat = (f"CASE WHEN contains(ctx, 'the') THEN 3 WHEN contains(ctx, 'de') THEN 5 WHEN contains(ctx, 'und') THEN 7 "
           f"WHEN contains(ctx, 'la') THEN 11 ELSE 0 END")
    auto = ", ".join(f"CASE WHEN contains(ctx, '{w}') THEN '{w}' END" for w in ["news", "the", "de", "und"])
    return f"""WITH a AS (SELECT article_id, title, content, source_url, {ctx} AS ctx, {exc} AS exc FROM f_articles)
SELECT article_id, exc AS excerpt, CAST(coalesce(nullif({cat}, 0), nullif(article_id % 4, 0)) AS BIGINT) AS category_id,
  array_to_string(['corpus', 'imported'] || list_filter([{auto}], lambda x: x IS NOT NULL), '|') AS tags,
  {D.strip_tags('title')} || ' | Site' AS seo_title, {D.strip_tags('exc')} AS seo_desc, 'future' AS status,
  CAST('{AS_OF}' AS TIMESTAMP) + {schedule_minutes_sql('source_url', '10', '90')} * INTERVAL '1' MINUTE AS scheduled_at
FROM a"""


@register("enrich_articles", _enrich_sql(), ("f_articles",))
def q_enrich_articles(t: Tables):
    """C9–C19 together on every document-derived article: excerpt, category, tags, SEO,
    status and schedule (the publish record without page extraction)."""
    from pagemill.functions import text as C
    # shared per-row values materialised once (Spark keeps non-trivial projections apart)
    a = t.f_articles.withColumn("_ctx", F.concat(F.col("title"), F.lit("\n"), C.strip_tags(F.col("content")))) \
        .withColumn("_exc", C.excerpt(F.col("content"), 160))
    ctx, exc = F.col("_ctx"), F.col("_exc")
    cats = C.parse_category_rules(F.lit("the=>3\nde=>5\nund=>7\nla=>11"))
    kws = F.split(F.lit("news\nthe\nde\nund"), "\n")
    seo = C.seo_fields(F.lit("yoast"), F.col("title"), exc, F.lit("Site"), F.col("source_url"), F.lit("{title} | {site}"), F.lit(""))
    sched = F.timestamp_add("MINUTE", C.schedule_delay_minutes(F.col("source_url"), F.lit(10), F.lit(90)),
                            F.lit(AS_OF).cast("timestamp_ntz"))
    return a.select("article_id", exc.alias("excerpt"),
                    C.article_category(C.match_category(ctx, cats), F.col("article_id") % 4).alias("category_id"),
                    F.array_join(C.article_tags(C.fixed_tags(F.lit("corpus, imported")), C.auto_tags(ctx, kws), F.lit(True)), "|")
                    .alias("tags"), seo["seo_title"].alias("seo_title"), seo["seo_desc"].alias("seo_desc"),
                    C.article_status(F.lit("future"), sched).alias("status"), sched.alias("scheduled_at"))


@register("stream_discovery", _discover_sql(False) + "SELECT rule_id, url, h AS url_hash, 'pending' AS status FROM fresh",
          ("f_published_pages",))
def q_stream_discovery(t: Tables):
    """T1+T3: the discovery stream over the page files (AvailableNow): new queue items,
    exact duplicate suppression against the queue table across batches."""
    from pagemill.streaming.jobs import discovered_items, stream_discovery
    out, tag = _stream_paths(t, "sdisc")
    stream_discovery(t.spark, t.sf_dir + "/page[s].parquet", out, corpus_rules(t.pages), t.f_published_pages, AS_OF,
                     name=tag)
    return discovered_items(t.spark, out).select("rule_id", "url", "url_hash", "status")


_PER_PASS = 50

_STREAM_COLLECT_SQL = _collect_sql().replace("firsts AS (SELECT bare, min(queue_id) AS q FROM known WHERE NOT published GROUP BY bare)",
    f"""turns AS (SELECT queue_id, 1 + (row_number() OVER (PARTITION BY rule_id ORDER BY queue_id) - 1) // {_PER_PASS} AS pass_no FROM items),
firsts AS (SELECT bare, arg_min(queue_id, (pass_no, queue_id)) AS q FROM known JOIN turns USING (queue_id) WHERE NOT published GROUP BY bare)""") \
    + f"SELECT o.*, pass_no FROM ({_COLLECT_OUTCOMES}) o JOIN turns USING (queue_id)"


@register("stream_collect", _STREAM_COLLECT_SQL.replace("SELECT queue_id, rule_id, url, CASE WHEN skip", "SELECT queue_id, rule_id, CASE WHEN skip")
          .replace("UNION ALL SELECT queue_id, rule_id, url,", "UNION ALL SELECT queue_id, rule_id,"), ("f_published_pages",))
def q_stream_collect(t: Tables):
    """T2+T6+T7: the collect stream: each batch of new queue files runs collect passes (per-rule
    FIFO batches) with images; articles, transitions and logs are committed per pass."""
    import os
    from pagemill.operators.images import image_candidates
    from pagemill.plans.catalog_content import _assets
    from pagemill.streaming.jobs import CollectTables, stream_collect
    from pagemill.schema import QUEUE, conform
    out, tag = _stream_paths(t, "scoll")
    qsrc = os.path.join(out, "queue_src")
    # one file: the oracle counts passes over one micro-batch
    conform(seed_queue(t.pages, AS_OF), QUEUE).coalesce(1).write.parquet(qsrc)
    rules = corpus_rules(t.pages).withColumn("batch_limit", F.lit(_PER_PASS))
    cands = image_candidates(t.pages.select(F.col("page_id").alias("article_id"), F.col("url").alias("source_url"),
                                            F.col("html").alias("content")))
    sink = os.path.join(out, "sink")
    stream_collect(t.spark, qsrc, sink, rules, t.pages, t.f_published_pages, AS_OF, name=tag, assets=_assets(cands))
    return CollectTables(t.spark, sink).transitions.read().drop("batch")
