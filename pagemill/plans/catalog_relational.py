"""Registered relational queries: joins K*, aggregates A*, listings O*, transitions Q*."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.fixtures import AS_OF, Tables
from pagemill.operators import queue as Q
from pagemill.operators import reports as R
from pagemill.plans import duck as D
from pagemill.plans.registry import register

TS = f"TIMESTAMP '{AS_OF}'"
DAY0 = "TIMESTAMP '2024-01-30 00:00:00'"
QV = ("f_queue",)
QR = ("f_queue", "f_rules")
LR = ("f_logs", "f_rules")


# ------------------------------------------------------------------ joins

@register("due_items", f"""SELECT q.queue_id, q.rule_id, q.url, q.attempts, r.name AS r_name, r.batch_limit AS r_batch_limit,
       r.retry_limit AS r_retry_limit, r.request_delay AS r_request_delay
FROM f_queue q JOIN f_rules r ON q.rule_id = r.rule_id
WHERE q.status = 'pending' AND r.enabled AND (q.scheduled_at IS NULL OR q.scheduled_at <= {TS})""", QR)
def q_due_items(t: Tables):
    """K1: pending, due items of enabled rules with prefixed rule columns."""
    d = Q.due_items(t.f_queue, t.f_rules, AS_OF)
    return d.select("queue_id", "rule_id", "url", "attempts", "r_name", "r_batch_limit", "r_retry_limit",
                    "r_request_delay")


@register("logs_with_rule", """SELECT l.log_id, l.rule_id, l.level, r.name AS rule_name
FROM f_logs l LEFT JOIN f_rules r ON l.rule_id = r.rule_id""", LR)
def q_logs_with_rule(t: Tables):
    """K2: every log row with its rule name (unknown rules kept)."""
    return Q.with_rule_name(t.f_logs.select("log_id", "rule_id", "level"), t.f_rules)


@register("queue_with_rule", """SELECT q.queue_id, q.rule_id, q.status, r.name AS rule_name
FROM f_queue q LEFT JOIN f_rules r ON q.rule_id = r.rule_id""", QR)
def q_queue_with_rule(t: Tables):
    """K3: every queue row with its rule name."""
    return Q.with_rule_name(t.f_queue.select("queue_id", "rule_id", "status"), t.f_rules)


_RULE_COUNTS = """SELECT r.rule_id, r.name,
       CAST(coalesce(count_if(q.status = 'pending'), 0) AS BIGINT) AS pending_count,
       CAST(coalesce(count_if(q.status = 'success'), 0) AS BIGINT) AS success_count,
       CAST(coalesce(count_if(q.status = 'failed'), 0) AS BIGINT) AS failed_count,
       CAST(count(q.queue_id) AS BIGINT) AS total_count
FROM f_rules r LEFT JOIN f_queue q ON r.rule_id = q.rule_id GROUP BY r.rule_id, r.name"""


@register("rule_counts", _RULE_COUNTS, QR)
def q_rule_counts(t: Tables):
    """K4: rules preserved, queue counts per rule (0 for rules without items)."""
    return R.rule_counts(t.f_rules, t.f_queue)


@register("not_published", f"""SELECT page_id, url FROM pages
WHERE md5({D.normalize_url('url')}) NOT IN (SELECT md5({D.normalize_url('source_url')}) FROM f_published_pages)""",
          ("f_published_pages",))
def q_not_published(t: Tables):
    """K5: pages whose normalised URL is not already an article's source."""
    return Q.not_published(t.pages.select("page_id", "url"), t.f_published_pages)


_TITLE = D.strip_tags("title")


@register("dedupe_title", f"""WITH live AS (SELECT DISTINCT {_TITLE} AS t FROM f_articles WHERE status NOT IN ('trash', 'auto-draft')),
items AS (SELECT doc_id AS item_id, substr(text, 1, 60) AS title FROM documents)
SELECT item_id, title, ({D.strip_tags('title')} IN (SELECT t FROM live)) AS skipped FROM items""", ("f_articles",))
def q_dedupe_title(t: Tables):
    """K6: incoming items (documents' leading 60 chars as titles) split into kept and
    skipped by exact title equality with live articles."""
    items = t.documents.select(F.col("doc_id").alias("item_id"), F.substring("text", 1, 60).alias("title"))
    kept, skipped = Q.dedupe_title(items, t.f_articles)
    return kept.withColumn("skipped", F.lit(False)).unionByName(skipped.withColumn("skipped", F.lit(True)))


@register("first_of_equal_titles", f"""WITH items AS (SELECT article_id AS queue_id, title FROM f_articles),
k AS (SELECT queue_id, title, {_TITLE} AS t FROM items)
SELECT queue_id, title, queue_id <> min(queue_id) OVER (PARTITION BY t) AS batch_duplicate FROM k""", ("f_articles",))
def q_first_of_equal_titles(t: Tables):
    """In one batch the first item of each title publishes, the rest are duplicates."""
    items = t.f_articles.select(F.col("article_id").alias("queue_id"), "title")
    return Q.first_of_equal_titles(items)


def _k7_inputs(t: Tables):
    q = t.f_queue.withColumn("article_id", F.when(F.col("status") == "success", F.col("queue_id") + 1000000))
    arts = t.f_queue.where(F.col("status").isin("success", "skipped")).select(
        (F.col("queue_id") + 1000000).alias("article_id"),
        F.concat(F.regexp_replace("url", "^https://", "https://WWW."), F.lit("/?utm_source=feed")).alias("source_url"))
    return arts, q


@register("latest_item", f"""WITH q AS (SELECT *, CASE WHEN status = 'success' THEN queue_id + 1000000 END AS article_id FROM f_queue),
a AS (SELECT queue_id + 1000000 AS article_id,
             regexp_replace(url, '^https://', 'https://WWW.') || '/?utm_source=feed' AS source_url
      FROM f_queue WHERE status IN ('success', 'skipped')),
m AS (SELECT a.article_id, q.queue_id, q.rule_id, q.status, 1 AS prio FROM a JOIN q ON md5({D.normalize_url('a.source_url')}) = md5({D.normalize_url('q.url')})
      UNION ALL SELECT a.article_id, q.queue_id, q.rule_id, q.status, 1 FROM a JOIN q ON a.source_url = q.url
      UNION ALL SELECT a.article_id, q.queue_id, q.rule_id, q.status, 2 FROM a JOIN q ON a.article_id = q.article_id)
SELECT article_id, arg_max(queue_id, (-prio, queue_id)) AS queue_id, arg_max(rule_id, (-prio, queue_id)) AS rule_id,
       arg_max(status, (-prio, queue_id)) AS status
FROM m GROUP BY article_id""", QV)
def q_latest_item(t: Tables):
    """K7: per article the newest queue item of its source URL, else of its article id."""
    arts, q = _k7_inputs(t)
    return Q.latest_item(arts, q)


@register("split_ready", f"""SELECT page_id, url, md5({D.normalize_url('url')}) IN (SELECT md5({D.normalize_url('source_url')}) FROM f_published_pages) AS duplicate
FROM pages""", ("f_published_pages",))
def q_split_ready(t: Tables):
    """K8: each page URL flagged duplicate (already published) or ready."""
    return Q.split_ready(t.pages.select("page_id", "url"), t.f_published_pages)


@register("drop_rule", """SELECT queue_id, rule_id FROM f_queue
WHERE rule_id NOT IN (SELECT rule_id FROM f_rules WHERE NOT enabled)""", QR)
def q_drop_rule(t: Tables):
    """K9: queue rows left after deleting the disabled rules (cascade)."""
    dropped = t.f_rules.where(~F.col("enabled")).select("rule_id")
    q, _ = Q.drop_rules(t.f_queue.select("queue_id", "rule_id"), t.f_logs, dropped)
    return q


@register("safe_hosts", f"""SELECT lower(host) AS host, bool_and({D.is_public_ip('ip')}) AS safe FROM f_host_ips GROUP BY lower(host)""",
          ("f_host_ips",))
def q_safe_hosts(t: Tables):
    """Host safety from resolved addresses (every address must be public)."""
    return Q.safe_hosts(t.f_host_ips)


# ------------------------------------------------------------------ aggregates

@register("status_counts", """SELECT s.status, CAST(count(q.queue_id) AS BIGINT) AS n
FROM (VALUES ('pending'), ('running'), ('success'), ('failed'), ('skipped')) s(status)
LEFT JOIN f_queue q ON q.status = s.status GROUP BY s.status""", QV)
def q_status_counts(t: Tables):
    """A1: count per status, all five present."""
    return R.status_counts(t.f_queue)


@register("today_counts", f"""SELECT
  (SELECT count(*) FROM f_queue WHERE discovered_at >= {DAY0}) AS today_discovered,
  (SELECT count(*) FROM f_queue WHERE status = 'success' AND finished_at >= {DAY0}) AS today_success,
  (SELECT count(*) FROM f_queue WHERE status = 'failed' AND finished_at >= {DAY0}) AS today_failed,
  (SELECT count(*) FROM f_logs WHERE level = 'error' AND created_at >= {DAY0}) AS today_logs_error""", ("f_queue", "f_logs"))
def q_today_counts(t: Tables):
    """A2: today's discovered/success/failed items and error logs."""
    return R.today_counts(t.f_queue, t.f_logs, AS_OF)


@register("daily_trend", f"""SELECT CAST(coalesce(finished_at, discovered_at) AS DATE) AS day,
       count(*) AS total_count, CAST(count_if(status = 'success') AS BIGINT) AS success_count,
       CAST(count_if(status = 'failed') AS BIGINT) AS failed_count,
       round(100.0 * count_if(status = 'success') / greatest(1, count_if(status = 'success') + count_if(status = 'failed')), 2) AS success_rate
FROM f_queue WHERE coalesce(finished_at, discovered_at) >= TIMESTAMP '2024-01-24 00:00:00'
GROUP BY 1 ORDER BY day DESC LIMIT 7""", QV)
def q_daily_trend(t: Tables):
    """A3+A4: 7-day trend with success rate, newest first."""
    return R.daily_trend(t.f_queue, AS_OF)


@register("top_rules", f"""SELECT *, round(100.0 * failed_count / greatest(1, success_count + failed_count), 2) AS fail_rate
FROM ({_RULE_COUNTS}) c ORDER BY failed_count DESC, pending_count DESC, rule_id LIMIT 8""", QR)
def q_top_rules(t: Tables):
    """A5: top 8 rules by failures then pending, with fail rate."""
    return R.top_rules(t.f_rules, t.f_queue)


@register("rule_overview", f"""SELECT rule_id, name, pending_count, success_count, failed_count FROM ({_RULE_COUNTS}) c""", QR)
def q_rule_overview(t: Tables):
    """Per-rule pending/success/failed, newest rule first."""
    return R.rule_overview(t.f_rules, t.f_queue)


@register("fail_rate", """SELECT CAST(count_if(status = 'failed') AS BIGINT) AS failed_count,
       CAST(count_if(status = 'success') AS BIGINT) AS success_count,
       round(100.0 * count_if(status = 'failed') / greatest(1, count_if(status = 'success') + count_if(status = 'failed')), 2) AS fail_rate
FROM f_queue""", QV)
def q_fail_rate(t: Tables):
    """Global failure rate."""
    return R.fail_rate(t.f_queue)


@register("stuck_running", f"""SELECT CAST(count_if(status = 'running' AND started_at < {TS} - INTERVAL 30 MINUTE) AS BIGINT) AS stuck_running
FROM f_queue""", QV)
def q_stuck_running(t: Tables):
    """Running items started more than 30 minutes before now."""
    return R.stuck_running(t.f_queue, AS_OF, 30)


@register("last_success", "SELECT max(finished_at) AS last_success FROM f_queue WHERE status = 'success'", QV)
def q_last_success(t: Tables):
    """Latest success time."""
    return R.last_success(t.f_queue)


@register("last_error", """SELECT log_id, created_at, message, url FROM f_logs
WHERE level = 'error' ORDER BY log_id DESC LIMIT 1""", ("f_logs",))
def q_last_error(t: Tables):
    """A10: newest error log row."""
    return R.last_error(t.f_logs)


@register("topic_counts", f"""SELECT CAST(count_if(created_at >= {DAY0} AND contains(message, 'AI')) AS BIGINT) AS today_0,
       CAST(count_if(created_at >= {DAY0} AND contains(message, 'image')) AS BIGINT) AS today_1 FROM f_logs""", ("f_logs",))
def q_topic_counts(t: Tables):
    """today's logs mentioning the rewrite and image topics."""
    return R.topic_counts(t.f_logs, ["AI", "image"], AS_OF)


@register("table_totals", """SELECT (SELECT count(*) FROM f_rules) AS rules_total, (SELECT count(*) FROM f_queue) AS queue_total,
       (SELECT count(*) FROM f_logs) AS logs_total""", ("f_rules", "f_queue", "f_logs"))
def q_table_totals(t: Tables):
    """Table row totals."""
    return R.table_totals(t.f_rules, t.f_queue, t.f_logs)


@register("health", f"""SELECT
  CAST(count_if(status = 'pending') AS BIGINT) AS pending_count, CAST(count_if(status = 'running') AS BIGINT) AS running_count,
  CAST(count_if(status = 'success') AS BIGINT) AS success_count, CAST(count_if(status = 'failed') AS BIGINT) AS failed_count,
  CAST(count_if(status = 'skipped') AS BIGINT) AS skipped_count,
  CAST(count_if(status = 'running' AND started_at < {TS} - INTERVAL 30 MINUTE) AS BIGINT) AS stuck_running,
  max(CASE WHEN status = 'success' THEN finished_at END) AS last_success,
  round(100.0 * count_if(status = 'failed') / greatest(1, count_if(status = 'success') + count_if(status = 'failed')), 2) AS fail_rate,
  (SELECT created_at FROM f_logs WHERE level = 'error' ORDER BY log_id DESC LIMIT 1) AS last_error_at,
  (SELECT message FROM f_logs WHERE level = 'error' ORDER BY log_id DESC LIMIT 1) AS last_error_message,
  (SELECT url FROM f_logs WHERE level = 'error' ORDER BY log_id DESC LIMIT 1) AS last_error_url
FROM f_queue""", ("f_queue", "f_logs"))
def q_health(t: Tables):
    """V5: health snapshot in one row."""
    return R.health(t.f_queue, t.f_logs, AS_OF, 30)


# ------------------------------------------------------------------ filters, sorts, top-k

@register("next_batch", f"""SELECT q.queue_id, q.rule_id, q.url FROM f_queue q JOIN f_rules r ON q.rule_id = r.rule_id
WHERE q.status = 'pending' AND r.enabled AND (q.scheduled_at IS NULL OR q.scheduled_at <= {TS})
QUALIFY row_number() OVER (PARTITION BY q.rule_id ORDER BY q.queue_id) <= least(greatest(r.batch_limit, 1), 50)""", QR)
def q_next_batch(t: Tables):
    """O1 (all rules at once): each rule's first clamp(batch_limit, 1, 50) due items."""
    d = Q.due_items(t.f_queue, t.f_rules, AS_OF)
    return R.next_batch(d, per_rule=True).select("queue_id", "rule_id", "url")


@register("next_batch_global", f"""SELECT q.queue_id, q.rule_id, q.url FROM f_queue q JOIN f_rules r ON q.rule_id = r.rule_id
WHERE q.status = 'pending' AND r.enabled AND (q.scheduled_at IS NULL OR q.scheduled_at <= {TS})
ORDER BY q.queue_id LIMIT 10""", QR)
def q_next_batch_global(t: Tables):
    """O1 (global limit): the first 10 due items by queue id."""
    return R.next_batch(Q.due_items(t.f_queue, t.f_rules, AS_OF), limit=10).select("queue_id", "rule_id", "url")


@register("rules_to_discover", """SELECT rule_id, name FROM f_rule_set WHERE enabled
ORDER BY coalesce(last_discovered_at, TIMESTAMP '1970-01-01 00:00:00'), rule_id LIMIT 20""", ("f_rule_set",))
def q_rules_to_discover(t: Tables):
    """O2: the 20 stalest enabled rules."""
    return R.rules_to_discover(t.f_rule_set, 20).select("rule_id", "name")


@register("retain_logs", "SELECT log_id, level FROM f_logs ORDER BY log_id DESC LIMIT 2000", ("f_logs",))
def q_retain_logs(t: Tables):
    """O3: the 2000 newest logs kept."""
    return R.retain_logs(t.f_logs, 2000).select("log_id", "level")


@register("recent_problems", """SELECT l.log_id, l.rule_id, l.level, l.message, r.name AS rule_name
FROM (SELECT * FROM f_logs WHERE level IN ('error', 'warning') ORDER BY log_id DESC LIMIT 8) l
LEFT JOIN f_rules r ON l.rule_id = r.rule_id""", LR)
def q_recent_problems(t: Tables):
    """Newest 8 errors/warnings with rule names."""
    return R.recent_problems(t.f_logs, t.f_rules, 8).select("log_id", "rule_id", "level", "message", "rule_name")


@register("failed_samples", """SELECT queue_id, rule_id, url, attempts, last_error, finished_at FROM f_queue
WHERE status = 'failed' ORDER BY queue_id DESC LIMIT 20""", QV)
def q_failed_samples(t: Tables):
    """Newest 20 failed items."""
    return R.failed_samples(t.f_queue, 20)


@register("list_queue", f"""WITH m AS (SELECT * FROM f_queue WHERE status = 'failed' AND contains(lower(last_error), 'image')
                          AND (scheduled_at IS NULL OR scheduled_at <= {TS}))
SELECT p.queue_id, p.rule_id, p.status, p.last_error, r.name AS rule_name, (SELECT count(*) FROM m) AS total
FROM (SELECT * FROM m ORDER BY queue_id DESC LIMIT 50 OFFSET 50) p LEFT JOIN f_rules r ON p.rule_id = r.rule_id""", QR)
def q_list_queue(t: Tables):
    """Page 2 of failed items whose error mentions 'image' and that are due."""
    out = R.list_queue(t.f_queue, t.f_rules, page=2, status="failed", error_has="IMAGE", due="ready", as_of=AS_OF)
    return out.select("queue_id", "rule_id", "status", "last_error", "rule_name", "total")


@register("list_logs", """WITH m AS (SELECT * FROM f_logs WHERE level = 'info' AND (contains(lower(message), 'rewrite') OR contains(lower(url), 'rewrite')))
SELECT p.log_id, p.rule_id, p.message, r.name AS rule_name, (SELECT count(*) FROM m) AS total
FROM (SELECT * FROM m ORDER BY log_id DESC LIMIT 80) p LEFT JOIN f_rules r ON p.rule_id = r.rule_id""", LR)
def q_list_logs(t: Tables):
    """First page of info logs mentioning 'rewrite'."""
    return R.list_logs(t.f_logs, t.f_rules, level="info", text="Rewrite").select(
        "log_id", "rule_id", "message", "rule_name", "total")


@register("item_logs", """SELECT log_id, queue_id, level, message,
       row_number() OVER (PARTITION BY queue_id ORDER BY log_id DESC) AS recent_rank
FROM f_logs WHERE contains(message, 'AI') QUALIFY recent_rank <= 5""", ("f_logs",))
def q_item_logs(t: Tables):
    """Per item its newest 5 rewrite-topic logs."""
    return R.item_logs(t.f_logs, "AI", 5).select("log_id", "queue_id", "level", "message", "recent_rank")


# ------------------------------------------------------------------ transitions

def _sel(df):
    return df.select("queue_id", "rule_id", "status", "attempts", "last_error", "scheduled_at", "started_at",
                     "finished_at")


@register("claim", f"""SELECT queue_id, rule_id,
  CASE WHEN c THEN 'running' ELSE status END AS status, CASE WHEN c THEN attempts + 1 ELSE attempts END AS attempts,
  CASE WHEN c THEN NULL ELSE last_error END AS last_error, scheduled_at,
  CASE WHEN c THEN {TS} ELSE started_at END AS started_at, CASE WHEN c THEN NULL ELSE finished_at END AS finished_at
FROM (SELECT *, status = 'pending' AND (scheduled_at IS NULL OR scheduled_at <= {TS}) AS c FROM f_queue) q""", QV)
def q_claim(t: Tables):
    """Q3: claim every due pending item."""
    return _sel(Q.claim(t.f_queue, AS_OF))


@register("release_stuck", f"""SELECT queue_id, rule_id, CASE WHEN c THEN 'pending' ELSE status END AS status, attempts,
  CASE WHEN c THEN 'running timeout released' ELSE last_error END AS last_error,
  CASE WHEN c THEN {TS} ELSE scheduled_at END AS scheduled_at, started_at,
  CASE WHEN c THEN {TS} ELSE finished_at END AS finished_at
FROM (SELECT *, status = 'running' AND started_at < {TS} - INTERVAL 30 MINUTE AS c FROM f_queue) q""", QV)
def q_release_stuck(t: Tables):
    """Q4: release items running longer than 30 minutes."""
    return _sel(Q.release_stuck(t.f_queue, AS_OF, 30))


@register("mark_failed", f"""WITH j AS (SELECT q.*, r.retry_limit, q.status = 'running' AS c,
    greatest(1, q.attempts) AS att FROM f_queue q JOIN f_rules r ON q.rule_id = r.rule_id),
k AS (SELECT *, CASE WHEN att >= retry_limit THEN 'failed' ELSE 'pending' END AS st FROM j)
SELECT queue_id, rule_id, CASE WHEN c THEN st ELSE status END AS status, CASE WHEN c THEN att ELSE attempts END AS attempts,
  CASE WHEN c THEN 'page fetch failed' ELSE last_error END AS last_error,
  CASE WHEN c THEN {TS} + to_seconds(CASE WHEN st = 'pending' THEN least(3600, greatest(60, att * 300)) ELSE 0 END) ELSE scheduled_at END AS scheduled_at,
  started_at, CASE WHEN c THEN {TS} ELSE finished_at END AS finished_at
FROM k""", QR)
def q_mark_failed(t: Tables):
    """Q5: every running item fails now: retry with back-off or fail for good."""
    items = t.f_queue.join(t.f_rules.select("rule_id", "retry_limit"), "rule_id")
    return _sel(Q.mark_failed(items, AS_OF, "page fetch failed", F.col("status") == "running"))


@register("last_collected", """SELECT rule_id, max(finished_at) AS last_collected_at FROM f_queue WHERE status = 'success' GROUP BY rule_id""",
          QV)
def q_last_collected(t: Tables):
    """Q6: each rule's last successful collection time."""
    return Q.last_collected(t.f_queue)


@register("mark_done", f"""SELECT queue_id, rule_id, CASE WHEN c THEN 'skipped' ELSE status END AS status, attempts,
  CASE WHEN c THEN 'duplicate title or source URL' ELSE last_error END AS last_error, scheduled_at, started_at,
  CASE WHEN c THEN {TS} ELSE finished_at END AS finished_at
FROM (SELECT *, status = 'running' AND attempts >= 3 AS c FROM f_queue) q""", QV)
def q_mark_done(t: Tables):
    """Q6: running items with 3+ attempts are marked skipped as duplicates."""
    cond = (F.col("status") == "running") & (F.col("attempts") >= 3)
    return _sel(Q.mark_done(t.f_queue, AS_OF, cond, status="skipped", message=Q.MSG_DUPLICATE))


@register("retry", f"""SELECT queue_id, rule_id, CASE WHEN c THEN 'pending' ELSE status END AS status,
  CASE WHEN c THEN 0 ELSE attempts END AS attempts, CASE WHEN c THEN NULL ELSE last_error END AS last_error,
  CASE WHEN c THEN {TS} ELSE scheduled_at END AS scheduled_at, CASE WHEN c THEN NULL ELSE started_at END AS started_at,
  CASE WHEN c THEN NULL ELSE finished_at END AS finished_at
FROM (SELECT *, status = 'failed' AS c FROM f_queue) q""", QV)
def q_retry(t: Tables):
    """Q7: retry all failed items."""
    return _sel(Q.retry(t.f_queue, AS_OF))


@register("retry_selected", f"""SELECT queue_id, rule_id, CASE WHEN c THEN 'pending' ELSE status END AS status,
  CASE WHEN c THEN 0 ELSE attempts END AS attempts, CASE WHEN c THEN NULL ELSE last_error END AS last_error,
  CASE WHEN c THEN {TS} ELSE scheduled_at END AS scheduled_at, CASE WHEN c THEN NULL ELSE started_at END AS started_at,
  CASE WHEN c THEN NULL ELSE finished_at END AS finished_at
FROM (SELECT q.*, q.queue_id IN (SELECT queue_id FROM f_queue WHERE last_error = 'image download failed') AS c FROM f_queue q) q""", QV)
def q_retry_selected(t: Tables):
    """Q7 (selected ids): retry the items whose error was an image download."""
    ids = t.f_queue.where(F.col("last_error") == "image download failed").select("queue_id")
    return _sel(Q.retry(t.f_queue, AS_OF, ids))


@register("delete_items", """SELECT queue_id, status FROM f_queue WHERE status <> 'success'""", QV)
def q_delete_items(t: Tables):
    """Q8: delete all successful items."""
    return Q.delete_items(t.f_queue, status="success").select("queue_id", "status")


@register("delete_selected", """SELECT queue_id, status FROM f_queue
WHERE queue_id NOT IN (SELECT queue_id FROM f_queue WHERE attempts = 0 AND status = 'skipped')""", QV)
def q_delete_selected(t: Tables):
    """Q8 (selected ids): delete the skipped items never attempted."""
    ids = t.f_queue.where((F.col("attempts") == 0) & (F.col("status") == "skipped")).select("queue_id")
    return Q.delete_items(t.f_queue, ids=ids).select("queue_id", "status")


@register("clean_queue", f"""SELECT queue_id, status FROM f_queue
WHERE NOT coalesce(status = 'success' AND coalesce(finished_at, discovered_at) < {TS} - INTERVAL 10 DAY, false)""", QV)
def q_clean_queue(t: Tables):
    """Q9: delete successful items older than 10 days."""
    return Q.clean_queue(t.f_queue, AS_OF, "success", None, 10).select("queue_id", "status")


@register("throttle", f"""WITH b AS (SELECT q.queue_id, q.rule_id, q.scheduled_at, r.request_delay FROM f_queue q JOIN f_rules r ON q.rule_id = r.rule_id
  WHERE q.status = 'pending' AND r.enabled AND (q.scheduled_at IS NULL OR q.scheduled_at <= {TS})),
i AS (SELECT *, CAST(row_number() OVER (PARTITION BY rule_id ORDER BY queue_id) - 1 AS INTEGER) AS batch_index FROM b)
SELECT queue_id, rule_id, batch_index, batch_index > 0 AND least(greatest(request_delay, 0), 30) > 0 AS postponed,
  CASE WHEN batch_index > 0 AND least(greatest(request_delay, 0), 30) > 0
       THEN {TS} + to_seconds(least(greatest(request_delay, 0), 30) * batch_index) ELSE scheduled_at END AS scheduled_at
FROM i""", QR)
def q_throttle(t: Tables):
    """Q10: request spacing inside each rule's due batch."""
    d = Q.due_items(t.f_queue, t.f_rules, AS_OF).withColumnRenamed("r_request_delay", "request_delay")
    return Q.throttle(d, AS_OF, "queue_id", ["rule_id"]).select("queue_id", "rule_id", "batch_index", "postponed",
                                                                "scheduled_at")


@register("release_all", f"""SELECT queue_id, rule_id, CASE WHEN c THEN 'pending' ELSE status END AS status, attempts,
  CASE WHEN c THEN 'manual release of running item' ELSE last_error END AS last_error,
  CASE WHEN c THEN {TS} ELSE scheduled_at END AS scheduled_at, started_at, CASE WHEN c THEN {TS} ELSE finished_at END AS finished_at
FROM (SELECT *, status = 'running' AS c FROM f_queue) q""", QV)
def q_release_all(t: Tables):
    """Q11: force-release every running item."""
    return _sel(Q.release_all(t.f_queue, AS_OF))


@register("queue_state", """SELECT queue_id, arg_max(rule_id, (event_ts, seq)) AS rule_id, arg_max(seq, (event_ts, seq)) AS seq,
  arg_max(status, (event_ts, seq)) AS status, max(event_ts) AS event_ts
FROM f_transitions GROUP BY queue_id""", ("f_transitions",))
def q_queue_state(t: Tables):
    """Q12: fold transition events to the current state per item."""
    return Q.queue_state(t.f_transitions)


@register("mark_discovered", f"""SELECT rule_id, CASE WHEN enabled THEN {TS} ELSE last_discovered_at END AS last_discovered_at
FROM f_rule_set""", ("f_rule_set",))
def q_mark_discovered(t: Tables):
    """Q13: stamp discovery time on the processed (enabled) rules."""
    processed = t.f_rule_set.where(F.col("enabled")).select("rule_id")
    return Q.mark_discovered(t.f_rule_set, processed, AS_OF).select("rule_id", "last_discovered_at")


# ------------------------------------------------------------------ enqueue (Q1+Q2)

_ANCHOR_SPARK = r"""(?is)<a\b[^>]*\shref\s*=\s*(["'])(.*?)\1"""
_ANCHOR_DUCK = r"""(?is)<a\b[^>]*\shref\s*=\s*("[^"]*"|'[^']*')"""


def _page_links(t: Tables):
    """Discovered links: every anchor of every page, resolved against the page URL, under
    rule ``page_id % 27 + 1`` in (page, anchor) order."""
    from pagemill.functions.urls import absolute_url
    a = t.pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(_ANCHOR_SPARK), F.lit(2)))
                       .alias("p", "href"))
    return a.select((F.col("page_id") % 27 + 1).alias("rule_id"), absolute_url(F.col("href"), F.col("url")).alias("url"),
                    (F.col("page_id") * 100000 + F.col("p")).alias("pos"))


@register("enqueue", f"""WITH a AS (SELECT page_id, url AS base, unnest(l) AS raw, unnest(range(len(l))) AS p
    FROM (SELECT page_id, url, regexp_extract_all(html, {D.q(_ANCHOR_DUCK)}, 1) AS l FROM pages)),
lk AS (SELECT page_id % 27 + 1 AS rule_id, {D.absolute_url("substr(raw, 2, length(raw) - 2)", 'base')} AS u0, page_id * 100000 + p AS pos FROM a),
n AS (SELECT rule_id, {D.normalize_url('u0')} AS url, pos FROM lk),
s AS (SELECT rule_id, url, md5(url) AS url_hash, pos FROM n WHERE {D.is_safe_url('url')}),
f AS (SELECT * FROM s QUALIFY pos = min(pos) OVER (PARTITION BY rule_id, url_hash)),
e AS (SELECT * FROM f WHERE (rule_id, url_hash) NOT IN (SELECT (rule_id, md5({D.normalize_url('url')})) FROM f_queue)
      AND md5({D.normalize_url('url')}) NOT IN (SELECT md5({D.normalize_url('source_url')}) FROM f_published_pages)),
o AS (SELECT e.*, row_number() OVER (PARTITION BY e.rule_id ORDER BY pos, url_hash) - 1 AS off FROM e)
SELECT o.rule_id, o.url, o.url_hash, 'pending' AS status, 0 AS attempts, {TS} AS discovered_at,
  {TS} + to_seconds(least(greatest(coalesce(r.request_delay, 0), 0), 30) * off) AS scheduled_at, off AS "offset", o.pos
FROM o LEFT JOIN f_rules r ON o.rule_id = r.rule_id""", ("f_queue", "f_rules", "f_published_pages"))
def q_enqueue(t: Tables):
    """Q1+Q2: discovered links -> new pending items: normalised, safe, first per (rule,
    URL), not already queued, not published; spaced by the rule's request delay."""
    return Q.enqueue(_page_links(t), t.f_queue, t.f_published_pages, t.f_rules, AS_OF)


@register("resolve_safe", f"""WITH h AS (SELECT lower(host) AS host, bool_and({D.is_public_ip('ip')}) AS safe FROM f_host_ips GROUP BY lower(host)),
u AS (SELECT page_id, url, lower(regexp_replace({D.host_of(D.trim_set('url'))}, '^[\\[\\] ]+|[\\[\\] ]+$', '', 'g')) AS host FROM pages
      WHERE {D.is_safe_url('url')})
SELECT page_id, url FROM u WHERE host IN (SELECT host FROM h WHERE safe)""", ("f_host_ips",))
def q_resolve_safe(t: Tables):
    """K10 end to end: page URLs kept only if public-URL safe and their host resolves to
    public addresses only (host -> IP table instead of live DNS)."""
    return Q.resolve_safe(t.pages.select("page_id", "url"), t.f_host_ips)
