"""Fixture views derived from the driver tables (see FIXTURES.md).

Each view exists twice: as a Spark DataFrame builder (what jobs read) and as a DuckDB SQL
text (what the oracle inlines as a CTE). Both are pure derivations of the base tables, so
their size grows with the scale factor.
"""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = "2024-01-30 23:59:59"     # the last second that the event table reaches
BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def as_of_col():
    return F.lit(AS_OF).cast("timestamp_ntz")


class Tables:
    """Lazy access to base tables and fixture views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        key = "base:" + name
        if key not in self._cache:
            self._cache[key] = self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
        return self._cache[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in BASE_TABLES:
            return self.base(name)
        if name.startswith("f_"):
            if name not in self._cache:
                self._cache[name] = globals()["_spark_" + name](self)
            return self._cache[name]
        raise AttributeError(name)


# ---------------------------------------------------------------- Spark builders

def _spark_f_rules(t: Tables) -> DataFrame:
    n = F.col("n_nationkey")
    return t.nation.select(
        (n + 1).cast("bigint").alias("rule_id"),
        F.col("n_name").alias("name"),
        ((n % 5) != 4).alias("enabled"),
        (1 + n % 7).alias("batch_limit"),
        (n % 4).alias("retry_limit"),
        (n % 3).alias("request_delay"),
        ((n % 2) == 0).alias("dedupe_title"),
        F.when(n % 6 == 0, F.lit(None).cast("timestamp_ntz"))
        .otherwise(F.timestamp_add("DAY", n, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
        .alias("last_discovered_at"),
        F.concat(F.lit("https://list"), n.cast("string"), F.lit(".example.com/news/page/{page}")).alias("pagination_pattern"),
        (1 + n % 3).alias("page_start"),
        (1 + n).alias("page_end"),
    )


def _queue_status():
    return (F.when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "view", "running")
                 .when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failed")
            .otherwise("skipped"))


def _fixture_url():
    return F.concat(F.lit("https://site"), (F.col("user_id") % 40).cast("string"), F.lit(".example.com/a/"),
                    F.col("event_id").cast("string"))


def _spark_f_queue(t: Tables) -> DataFrame:
    e, ts = F.col("event_id"), F.col("ts")
    et = F.col("event_type")
    return t.events.select(
        (e + 1).alias("queue_id"),
        (F.col("user_id") % 27 + 1).alias("rule_id"),
        _fixture_url().alias("url"),
        _queue_status().alias("status"),
        (e % 5).cast("int").alias("attempts"),
        F.when((et == "error") & (e % 3 == 0), "AI result too short")
        .when((et == "error") & (e % 3 == 1), "image download failed")
        .when(et == "error", "selector matched nothing").alias("last_error"),
        ts.alias("discovered_at"),
        F.when(e % 4 == 0, F.lit(None).cast("timestamp_ntz"))
        .otherwise(F.timestamp_add("SECOND", e % 7200, ts)).alias("scheduled_at"),
        F.when(et.isin("view", "purchase", "error"), F.timestamp_add("SECOND", F.lit(60), ts)).alias("started_at"),
        F.when(et.isin("purchase", "error", "signup"), F.timestamp_add("SECOND", F.lit(120), ts)).alias("finished_at"),
    )


def _spark_f_logs(t: Tables) -> DataFrame:
    e, et = F.col("event_id"), F.col("event_type")
    return t.events.select(
        (e + 1).alias("log_id"),
        (F.col("user_id") % 27 + 1).alias("rule_id"),
        (e + 1).alias("queue_id"),
        F.when(et == "error", "error").when(et == "signup", "warning").when(et == "purchase", "success")
        .otherwise("info").alias("level"),
        F.when(e % 4 == 0, "AI rewrite done").when(e % 4 == 1, "image stats").when(e % 4 == 2, "selector failed")
        .otherwise("collected").alias("message"),
        _fixture_url().alias("url"),
        F.col("ts").alias("created_at"),
    )


def _spark_f_transitions(t: Tables) -> DataFrame:
    q = t.f_queue
    return (q.select("queue_id", "rule_id", F.lit(1).alias("seq"), F.lit("pending").alias("status"),
                     F.col("discovered_at").alias("event_ts"))
            .unionByName(q.where(F.col("started_at").isNotNull())
                         .select("queue_id", "rule_id", F.lit(2).alias("seq"), F.lit("running").alias("status"),
                                 F.col("started_at").alias("event_ts")))
            .unionByName(q.where(F.col("finished_at").isNotNull())
                         .select("queue_id", "rule_id", F.lit(3).alias("seq"), "status",
                                 F.col("finished_at").alias("event_ts"))))


def _spark_f_articles(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return t.documents.select(
        d.alias("article_id"),
        F.substring("text", 1, 60).alias("title"),
        F.concat(F.lit("<p>"), F.replace(F.col("text"), F.lit("\n"), F.lit("</p><p>")), F.lit("</p>")).alias("content"),
        F.when(d % 10 == 0, "trash").when(d % 10 == 1, "draft").otherwise("publish").alias("status"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("lang"), F.lit("/"),
                 d.cast("string")).alias("source_url"),
    )


def _spark_f_published_pages(t: Tables) -> DataFrame:
    return t.pages.where(F.col("page_id") % 3 == 0).select(F.col("page_id").alias("article_id"),
                                                          F.col("url").alias("source_url"))


def _spark_f_pages_json(t: Tables) -> DataFrame:
    p = F.col("page_id").cast("string")
    created = (F.lit(1700000000000) + F.col("page_id") * 1000).cast("string")
    return t.pages.select(
        "page_id", "url",
        F.concat(
            F.col("html"),
            F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"id":'), p,
            F.lit(',"title":"T '), p, F.lit('","created":'), created,
            F.lit(',"items":[{"url":"/a/'), p, F.lit('"},{"alias":"node/'), p,
            F.lit('"},"//cdn.example.net/x?utm_source=f"]}}}</script>'),
            F.when(F.col("page_id") % 2 == 0,
                   F.concat(F.lit('<script type="application/ld+json">{"@type":"Article","headline":"H '), p,
                            F.lit('"}</script>'))).otherwise(F.lit("")),
            F.when(F.col("page_id") % 5 == 0, F.lit('<script type="application/ld+json">{broken</script>'))
            .otherwise(F.lit("")),
            F.lit('<script>window.__STATE__ = {"n":'), p, F.lit("};</script>"),
        ).alias("html"),
    )


def _spark_f_pages_img(t: Tables) -> DataFrame:
    p = F.col("page_id").cast("string")
    insert = F.concat(
        F.lit('<img class="l" data-src="/img/'), p, F.lit('.jpg" srcset="/img/a.png 1x, /img/b.webp 2x">'),
        F.when(F.col("page_id") % 2 == 0, F.lit('<img src="http://10.0.0.1/p.gif"><img src="/doc/x.svg">'))
        .otherwise(F.lit("")),
        F.lit("<div style=\"background-image:url('/bg/"), (F.col("page_id") % 7).cast("string"),
        F.lit(".jpeg')\"></div><p> </p><section>share this</section></article>"),
    )
    return t.pages.select("page_id", "url", F.replace(F.col("html"), F.lit("</article>"), insert).alias("html"))


def _spark_f_rewrites(t: Tables) -> DataFrame:
    u = t.conversations.alias("u")
    a = t.conversations.alias("a")
    j = u.join(a, (F.col("a.conv_id") == F.col("u.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1))
    fenced = F.lit('```json\n{"title":"N","content":"x"}\n```')
    return j.where((F.col("u.role") == "user") & (F.col("a.role") == "assistant")).select(
        (F.col("u.conv_id") * 1000 + F.col("u.turn")).alias("article_id"),
        F.col("u.text").alias("original"),
        F.when(F.col("u.conv_id") % 3 == 0, fenced).when(F.col("u.conv_id") % 3 == 1, F.lit(""))
        .otherwise(F.col("a.text")).alias("response"),
        F.when(F.col("u.conv_id") % 2 == 0, "fail").otherwise("fallback").alias("on_failure"),
    )


def _spark_f_host_ips(t: Tables) -> DataFrame:
    h = F.split_part(F.split_part(F.col("url"), F.lit("/"), F.lit(3)), F.lit(":"), F.lit(1))
    hosts = t.pages.select(h.alias("host")).distinct()
    L = F.length("host") % 4
    return hosts.select("host", F.when(L == 0, "10.1.2.3").when(L == 1, "192.168.0.9").otherwise("8.8.4.4").alias("ip"))


def _spark_f_rule_set(t: Tables) -> DataFrame:
    """A rule table that scales with the data (one rule per supplier) for rule-only
    operators: list pages, validation, export, stalest-first selection."""
    k = F.col("s_suppkey")
    return t.supplier.select(
        (k + 1).alias("rule_id"),
        F.col("s_name").alias("name"),
        ((k % 5) != 4).alias("enabled"),
        F.concat(F.lit("https://list"), (k % 50).cast("string"), F.lit(".example.com/news/"),
                 F.lit("\n  HTTPS://List"), (k % 50).cast("string"), F.lit(".Example.com/hot/?utm_source=x&id="),
                 k.cast("string"), F.lit("\r\nftp://bad.example.com/x\n\nhttp://127.0.0.1/admin\n")).alias("list_urls_text"),
        F.when(k % 3 == 0, F.concat(F.lit("https://m"), (k % 9).cast("string"), F.lit(".example.org/p/{page}/")))
        .when(k % 3 == 1, F.concat(F.lit("https://list"), (k % 50).cast("string"), F.lit(".example.com/news/")))
        .otherwise(F.lit("")).alias("pagination_pattern"),
        (k % 4).cast("int").alias("page_start"),
        F.when(k % 10 == 0, (k % 4 - 1)).when(k % 10 == 1, (k % 4 + 900)).otherwise(k % 4 + k % 13).cast("int").alias("page_end"),
        (k % 70 - 5).cast("int").alias("batch_limit"),
        (k % 6 - 1).cast("int").alias("retry_limit"),
        (k % 40 - 3).cast("int").alias("request_delay"),
        (k % 60).cast("int").alias("publish_delay_min"),
        (k % 45).cast("int").alias("publish_delay_max"),
        (k * 37 % 700).cast("int").alias("excerpt_length"),
        F.when(k % 7 == 0, "bogus").when(k % 7 == 1, "publish").when(k % 7 == 2, "future").otherwise("draft").alias("post_status"),
        F.when(k % 4 == 0, "random_future").when(k % 4 == 1, "weird").otherwise("immediate").alias("publish_mode"),
        F.when(k % 5 == 0, "yoast").when(k % 5 == 1, "rank_math").when(k % 5 == 2, "aioseo")
        .when(k % 5 == 3, "other").otherwise("none").alias("seo_family"),
        F.when(k % 3 == 0, "fail").when(k % 3 == 1, "fallback").otherwise("retry").alias("rewrite_on_failure"),
        F.when(k % 6 == 0, "ld+json").when(k % 6 == 1, F.concat(F.lit("var:__S"), (k % 4).cast("string")))
        .when(k % 6 == 2, "id:app-data").when(k % 6 == 3, "bad source!").otherwise("__NEXT_DATA__").alias("json_source"),
        F.when(k % 8 == 0, F.lit(None).cast("timestamp_ntz"))
        .otherwise(F.timestamp_add("HOUR", k % 500, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))).alias("last_discovered_at"),
    )


# ---------------------------------------------------------------- DuckDB SQL texts

_SQL = {
    "f_rules": """SELECT CAST(n_nationkey + 1 AS BIGINT) AS rule_id, n_name AS name, (n_nationkey % 5) <> 4 AS enabled,
       1 + n_nationkey % 7 AS batch_limit, n_nationkey % 4 AS retry_limit, n_nationkey % 3 AS request_delay,
       (n_nationkey % 2) = 0 AS dedupe_title,
       CASE WHEN n_nationkey % 6 = 0 THEN NULL
            ELSE TIMESTAMP '2024-01-01 00:00:00' + n_nationkey * INTERVAL '1' DAY END AS last_discovered_at,
       'https://list' || CAST(n_nationkey AS VARCHAR) || '.example.com/news/page/{page}' AS pagination_pattern,
       1 + n_nationkey % 3 AS page_start, 1 + n_nationkey AS page_end
FROM nation""",
    "f_queue": """SELECT event_id + 1 AS queue_id, user_id % 27 + 1 AS rule_id,
       'https://site' || CAST(user_id % 40 AS VARCHAR) || '.example.com/a/' || CAST(event_id AS VARCHAR) AS url,
       CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'success'
                       WHEN 'error' THEN 'failed' ELSE 'skipped' END AS status,
       CAST(event_id % 5 AS INTEGER) AS attempts,
       CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'AI result too short'
            WHEN event_type = 'error' AND event_id % 3 = 1 THEN 'image download failed'
            WHEN event_type = 'error' THEN 'selector matched nothing' END AS last_error,
       ts AS discovered_at,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts + (event_id % 7200) * INTERVAL '1' SECOND END AS scheduled_at,
       CASE WHEN event_type IN ('view', 'purchase', 'error') THEN ts + INTERVAL '60' SECOND END AS started_at,
       CASE WHEN event_type IN ('purchase', 'error', 'signup') THEN ts + INTERVAL '120' SECOND END AS finished_at
FROM events""",
    "f_logs": """SELECT event_id + 1 AS log_id, user_id % 27 + 1 AS rule_id, event_id + 1 AS queue_id,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' WHEN 'purchase' THEN 'success' ELSE 'info' END AS level,
       CASE event_id % 4 WHEN 0 THEN 'AI rewrite done' WHEN 1 THEN 'image stats' WHEN 2 THEN 'selector failed' ELSE 'collected' END AS message,
       'https://site' || CAST(user_id % 40 AS VARCHAR) || '.example.com/a/' || CAST(event_id AS VARCHAR) AS url,
       ts AS created_at
FROM events""",
    "f_transitions": """SELECT queue_id, rule_id, 1 AS seq, 'pending' AS status, discovered_at AS event_ts FROM f_queue
UNION ALL SELECT queue_id, rule_id, 2, 'running', started_at FROM f_queue WHERE started_at IS NOT NULL
UNION ALL SELECT queue_id, rule_id, 3, status, finished_at FROM f_queue WHERE finished_at IS NOT NULL""",
    "f_articles": """SELECT doc_id AS article_id, substr(text, 1, 60) AS title,
       '<p>' || replace(text, chr(10), '</p><p>') || '</p>' AS content,
       CASE doc_id % 10 WHEN 0 THEN 'trash' WHEN 1 THEN 'draft' ELSE 'publish' END AS status,
       'https://' || source || '.example.com/' || lang || '/' || CAST(doc_id AS VARCHAR) AS source_url
FROM documents""",
    "f_published_pages": "SELECT page_id AS article_id, url AS source_url FROM pages WHERE page_id % 3 = 0",
    "f_pages_json": """SELECT page_id, url,
       html || '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"id":' || CAST(page_id AS VARCHAR)
       || ',"title":"T ' || CAST(page_id AS VARCHAR) || '","created":' || CAST(1700000000000 + page_id * 1000 AS VARCHAR)
       || ',"items":[{"url":"/a/' || CAST(page_id AS VARCHAR) || '"},{"alias":"node/' || CAST(page_id AS VARCHAR) || '"},"//cdn.example.net/x?utm_source=f"]}}}</script>'
       || CASE WHEN page_id % 2 = 0 THEN '<script type="application/ld+json">{"@type":"Article","headline":"H ' || CAST(page_id AS VARCHAR) || '"}</script>' ELSE '' END
       || CASE WHEN page_id % 5 = 0 THEN '<script type="application/ld+json">{broken</script>' ELSE '' END
       || '<script>window.__STATE__ = {"n":' || CAST(page_id AS VARCHAR) || '};</script>' AS html
FROM pages""",
    "f_pages_img": """SELECT page_id, url,
       replace(html, '</article>', '<img class="l" data-src="/img/' || CAST(page_id AS VARCHAR) || '.jpg" srcset="/img/a.png 1x, /img/b.webp 2x">'
       || CASE WHEN page_id % 2 = 0 THEN '<img src="http://10.0.0.1/p.gif"><img src="/doc/x.svg">' ELSE '' END
       || '<div style="background-image:url(''/bg/' || CAST(page_id % 7 AS VARCHAR) || '.jpeg'')"></div><p> </p><section>share this</section></article>') AS html
FROM pages""",
    "f_rewrites": """SELECT u.conv_id * 1000 + u.turn AS article_id, u.text AS original,
       CASE u.conv_id % 3 WHEN 0 THEN '```json' || chr(10) || '{"title":"N","content":"x"}' || chr(10) || '```' WHEN 1 THEN '' ELSE a.text END AS response,
       CASE WHEN u.conv_id % 2 = 0 THEN 'fail' ELSE 'fallback' END AS on_failure
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""",
    "f_host_ips": """SELECT DISTINCT h AS host, CASE WHEN length(h) % 4 = 0 THEN '10.1.2.3' WHEN length(h) % 4 = 1 THEN '192.168.0.9' ELSE '8.8.4.4' END AS ip
FROM (SELECT split_part(split_part(url, '/', 3), ':', 1) AS h FROM pages) t""",
    "f_rule_set": """SELECT s_suppkey + 1 AS rule_id, s_name AS name, (s_suppkey % 5) <> 4 AS enabled,
       'https://list' || CAST(s_suppkey % 50 AS VARCHAR) || '.example.com/news/' || chr(10) || '  HTTPS://List'
         || CAST(s_suppkey % 50 AS VARCHAR) || '.Example.com/hot/?utm_source=x&id=' || CAST(s_suppkey AS VARCHAR)
         || chr(13) || chr(10) || 'ftp://bad.example.com/x' || chr(10) || chr(10) || 'http://127.0.0.1/admin' || chr(10) AS list_urls_text,
       CASE WHEN s_suppkey % 3 = 0 THEN 'https://m' || CAST(s_suppkey % 9 AS VARCHAR) || '.example.org/p/{page}/'
            WHEN s_suppkey % 3 = 1 THEN 'https://list' || CAST(s_suppkey % 50 AS VARCHAR) || '.example.com/news/'
            ELSE '' END AS pagination_pattern,
       CAST(s_suppkey % 4 AS INTEGER) AS page_start,
       CAST(CASE WHEN s_suppkey % 10 = 0 THEN s_suppkey % 4 - 1 WHEN s_suppkey % 10 = 1 THEN s_suppkey % 4 + 900
                 ELSE s_suppkey % 4 + s_suppkey % 13 END AS INTEGER) AS page_end,
       CAST(s_suppkey % 70 - 5 AS INTEGER) AS batch_limit, CAST(s_suppkey % 6 - 1 AS INTEGER) AS retry_limit,
       CAST(s_suppkey % 40 - 3 AS INTEGER) AS request_delay, CAST(s_suppkey % 60 AS INTEGER) AS publish_delay_min,
       CAST(s_suppkey % 45 AS INTEGER) AS publish_delay_max, CAST(s_suppkey * 37 % 700 AS INTEGER) AS excerpt_length,
       CASE s_suppkey % 7 WHEN 0 THEN 'bogus' WHEN 1 THEN 'publish' WHEN 2 THEN 'future' ELSE 'draft' END AS post_status,
       CASE s_suppkey % 4 WHEN 0 THEN 'random_future' WHEN 1 THEN 'weird' ELSE 'immediate' END AS publish_mode,
       CASE s_suppkey % 5 WHEN 0 THEN 'yoast' WHEN 1 THEN 'rank_math' WHEN 2 THEN 'aioseo' WHEN 3 THEN 'other' ELSE 'none' END AS seo_family,
       CASE s_suppkey % 3 WHEN 0 THEN 'fail' WHEN 1 THEN 'fallback' ELSE 'retry' END AS rewrite_on_failure,
       CASE s_suppkey % 6 WHEN 0 THEN 'ld+json' WHEN 1 THEN 'var:__S' || CAST(s_suppkey % 4 AS VARCHAR)
            WHEN 2 THEN 'id:app-data' WHEN 3 THEN 'bad source!' ELSE '__NEXT_DATA__' END AS json_source,
       CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + (s_suppkey % 500) * INTERVAL '1' HOUR END AS last_discovered_at
FROM supplier""",
}

_DEPS = {"f_transitions": ["f_queue"]}


def view_sql(name: str) -> str:
    return _SQL[name]


def with_views(*names: str) -> str:
    """``WITH`` prefix defining the named fixture views (dependencies first)."""
    order: list[str] = []

    def add(n):
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return ""
    return "WITH " + ",\n".join(f"{n} AS (\n{_SQL[n]}\n)" for n in order) + "\n"


@lru_cache(maxsize=None)
def fixture_names() -> tuple[str, ...]:
    return tuple(_SQL)
