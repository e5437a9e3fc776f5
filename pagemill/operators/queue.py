"""Queue work items: due selection, duplicates, and state transitions.

The queue is a table, never updated in place: a transition is a projection producing the
new row state (or a transition row for the event log); ``queue_state`` folds transition
events back into the current state per item. ``as_of`` is always an explicit literal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pagemill.functions.text import strip_tags
from pagemill.functions.urls import is_public_ip, is_safe_public_url, normalize_url, url_host
from pagemill.operators.joins import first_in_group, rank_in_group, small

# Messages written by transitions.
MSG_STUCK = "running timeout released"
MSG_MANUAL_RELEASE = "manual release of running item"
MSG_DUPLICATE = "duplicate title or source URL"

QUEUE_COLS = ["queue_id", "rule_id", "url", "status", "attempts", "last_error", "discovered_at", "scheduled_at",
              "started_at", "finished_at"]


def _ts(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")


def _plus_seconds(ts: Column, secs: Column) -> Column:
    return F.timestamp_add("SECOND", secs.cast("long"), ts)


def is_due(queue_scheduled: Column, as_of) -> Column:
    return queue_scheduled.isNull() | (queue_scheduled <= _ts(as_of))


# ---------------------------------------------------------------- joins

def due_items(queue: DataFrame, rules: DataFrame, as_of, rule_id: int | None = None) -> DataFrame:
    """K1: pending, due items of enabled rules, with their rule (prefixed columns)."""
    q = queue.where((F.col("status") == "pending") & is_due(F.col("scheduled_at"), as_of))
    if rule_id is not None:
        q = q.where(F.col("rule_id") == rule_id)
    r = rules.where(F.col("enabled")).select(*[F.col(c).alias("r_" + c) if c != "rule_id" else F.col(c)
                                                for c in rules.columns])
    return q.join(small(r), "rule_id")


def with_rule_name(df: DataFrame, rules: DataFrame) -> DataFrame:
    """K2/K3: left join of the rule name (unknown rules keep a null name)."""
    return df.join(small(rules.select("rule_id", F.col("name").alias("rule_name"))), "rule_id", "left")


def source_hash(url: Column) -> Column:
    return F.md5(normalize_url(url))


def not_published(df: DataFrame, articles: DataFrame, url_col: str = "url") -> DataFrame:
    """K5: rows whose normalised URL is not the source of any article (any status)."""
    a = articles.select(source_hash(F.col("source_url")).alias("_h")).distinct()
    return df.withColumn("_h", source_hash(F.col(url_col))).join(a, "_h", "left_anti").drop("_h")


def live_titles(articles: DataFrame) -> DataFrame:
    """Titles of articles that count for duplicate tests (trash and auto-draft ignored).
    An article table without titles contributes none (only source duplicates apply)."""
    if "title" not in articles.columns:
        return articles.sparkSession.createDataFrame([], "_t string")
    if "status" not in articles.columns:
        articles = articles.withColumn("status", F.lit("publish"))
    return articles.where(~F.coalesce(F.col("status"), F.lit("")).isin("trash", "auto-draft")) \
        .select(strip_tags(F.col("title")).alias("_t")).distinct()


def dedupe_title(df: DataFrame, articles: DataFrame, title_col: str = "title") -> tuple[DataFrame, DataFrame]:
    """K6: (kept, skipped) — skipped rows have a title equal (after tag stripping) to a
    live article's title."""
    t = live_titles(articles)
    keyed = df.withColumn("_t", strip_tags(F.col(title_col)))
    return keyed.join(t, "_t", "left_anti").drop("_t"), keyed.join(t, "_t", "left_semi").drop("_t")


def first_of_equal_titles(df: DataFrame, title_col: str = "title", order_key: str = "queue_id") -> DataFrame:
    """Within one batch the first item (by ``order_key``) of each title publishes,
    later ones are duplicates (``batch_duplicate``)."""
    keyed = df.withColumn("_t", strip_tags(F.col(title_col)))
    return first_in_group(keyed, ["_t"], order_key, "_first").withColumn(
        "batch_duplicate", ~F.coalesce(F.col("_first"), F.lit(True))).drop("_t", "_first")


def latest_item(articles: DataFrame, queue: DataFrame) -> DataFrame:
    """K7: per article, the newest queue row matching its source URL (by hash or by raw
    URL), else the newest queue row pointing at the article id. The OR predicate is split
    into equi-joins so each stays a hash join."""
    a = articles.select("article_id", F.col("source_url"))
    q = queue.select(F.col("queue_id").alias("q_id"), F.col("url").alias("q_url"),
                     F.md5(normalize_url(F.col("url"))).alias("q_hash"), F.col("article_id").alias("q_article"),
                     F.col("rule_id").alias("q_rule"), F.col("status").alias("q_status"))
    by_hash = a.join(q, source_hash(a["source_url"]) == q["q_hash"]).select("article_id", "q_id", "q_rule", "q_status",
                                                                         F.lit(1).alias("prio"))
    by_url = a.join(q, a["source_url"] == q["q_url"]).select("article_id", "q_id", "q_rule", "q_status",
                                                            F.lit(1).alias("prio"))
    by_id = a.join(q, a["article_id"] == q["q_article"]).select("article_id", "q_id", "q_rule", "q_status",
                                                               F.lit(2).alias("prio"))
    allm = by_hash.unionByName(by_url).unionByName(by_id)
    best = allm.groupBy("article_id").agg(
        F.max_by(F.struct("q_id", "q_rule", "q_status"), F.struct(-F.col("prio"), F.col("q_id"))).alias("b"))
    return best.select("article_id", F.col("b.q_id").alias("queue_id"), F.col("b.q_rule").alias("rule_id"),
                       F.col("b.q_status").alias("status"))


def split_ready(links: DataFrame, articles: DataFrame, url_col: str = "url") -> DataFrame:
    """K8: flag each discovered link as duplicate (already an article's source) or ready."""
    a = articles.select(source_hash(F.col("source_url")).alias("_h")).distinct().withColumn("_dup", F.lit(True))
    return links.withColumn("_h", source_hash(F.col(url_col))).join(a, "_h", "left") \
        .withColumn("duplicate", F.coalesce(F.col("_dup"), F.lit(False))).drop("_h", "_dup")


def drop_rules(queue: DataFrame, logs: DataFrame, dropped_rule_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K9: queue and log rows of deleted rules removed (cascade)."""
    ids = dropped_rule_ids.select("rule_id").distinct()
    return queue.join(ids, "rule_id", "left_anti"), logs.join(ids, "rule_id", "left_anti")


def safe_hosts(host_ips: DataFrame) -> DataFrame:
    """Hosts whose every resolved address is public (host -> safe flag)."""
    return host_ips.groupBy(F.lower("host").alias("host")).agg(F.bool_and(is_public_ip(F.col("ip"))).alias("safe"))


def resolve_safe(urls: DataFrame, host_ips: DataFrame, url_col: str = "url") -> DataFrame:
    """URLs that pass the public-URL filter and whose host resolves to public
    addresses only (hosts without an address are unsafe)."""
    h = safe_hosts(host_ips).where(F.col("safe")).select(F.col("host").alias("_host"))
    u = urls.where(is_safe_public_url(F.col(url_col))).withColumn("_host", url_host(F.col(url_col)))
    return u.join(h, "_host", "left_semi").drop("_host")


# ---------------------------------------------------------------- transitions

def enqueue(links: DataFrame, queue: DataFrame | Callable[[DataFrame], DataFrame], articles: DataFrame, rules: DataFrame, as_of,
            start_id: Column | int = 0) -> DataFrame:
    """Q1+Q2: new queue rows for discovered links ``(rule_id, url, pos)``.

    Normalise; keep safe URLs; first occurrence per (rule, url_hash); drop those already
    queued for the rule or published; then pending, attempts 0, discovered now, and
    scheduled ``now + clamp(request_delay, 0, 30) * offset`` where offset counts the
    rule's inserted rows before this one (in ``pos`` order). ``queue`` is a table of the rows
    already queued, or a function that is given (rule_id, url_hash) rows and returns those it
    knows, so that a long queue need not be read."""
    n = links.select("rule_id", normalize_url(F.col("url")).alias("url"), "pos") \
        .where(is_safe_public_url(F.col("url"))).withColumn("url_hash", F.md5("url"))
    first = first_in_group(n, ["rule_id", "url_hash"], "pos", "_k").where(F.col("_k")).drop("_k")
    # queue rows carry their url_hash (U6); only a queue without it is re-hashed
    from pagemill.session import cut_lineage

    if callable(queue):
        first = cut_lineage(first)
        existing = queue(first.select("rule_id", "url_hash"))
    else:
        existing = queue.select("rule_id", (F.col("url_hash") if "url_hash" in queue.columns
                                            else F.md5(normalize_url(F.col("url")))).alias("url_hash"))
    new = not_published(first.join(existing, ["rule_id", "url_hash"], "left_anti"), articles)
    # the ranking reads its input three times (range sample, counts, rows): cut it once
    ranked = rank_in_group(cut_lineage(new), ["rule_id"], ["pos", "url_hash"], "_off")
    delay = F.least(F.greatest(F.coalesce(F.col("request_delay"), F.lit(0)), F.lit(0)), F.lit(30))
    out = ranked.join(small(rules.select("rule_id", "request_delay")), "rule_id", "left")
    return out.select(
        "rule_id", "url", "url_hash", F.lit("pending").alias("status"), F.lit(0).alias("attempts"),
        _ts(as_of).alias("discovered_at"),
        _plus_seconds(_ts(as_of), delay * (F.col("_off") - 1)).alias("scheduled_at"),
        (F.col("_off") - 1).alias("offset"), "pos")


def claim(queue: DataFrame, as_of) -> DataFrame:
    """Q3: pending and due -> running, attempts + 1, started now, error/finish cleared."""
    c = (F.col("status") == "pending") & is_due(F.col("scheduled_at"), as_of)
    return _apply(queue, c, {"status": F.lit("running"), "attempts": F.col("attempts") + 1, "started_at": _ts(as_of),
                             "finished_at": F.lit(None).cast("timestamp_ntz"),
                             "last_error": F.lit(None).cast("string")})


def _apply(queue: DataFrame, cond: Column, updates: dict[str, Column]) -> DataFrame:
    return queue.select(*[F.when(cond, updates[k]).otherwise(F.col(k)).alias(k) if k in updates else F.col(k)
                          for k in queue.columns])


def release_stuck(queue: DataFrame, as_of, minutes: int = 30) -> DataFrame:
    """Q4: running items started before now - max(5, minutes) -> pending, scheduled and
    finished now, with a reason; attempts are kept."""
    cutoff = F.timestamp_add("MINUTE", F.lit(-max(5, int(minutes))), _ts(as_of))
    cond = (F.col("status") == "running") & (F.col("started_at") < cutoff)
    return _apply(queue, cond, {"status": F.lit("pending"), "last_error": F.lit(MSG_STUCK),
                                "scheduled_at": _ts(as_of), "finished_at": _ts(as_of)})


def mark_failed(items: DataFrame, as_of, message: Column | str, cond: Column | None = None) -> DataFrame:
    """Q5: for failed items (``cond``): attempts = max(1, attempts); attempts >= the rule's
    retry_limit -> failed, else pending again after clamp(attempts * 300, 60, 3600) s."""
    cond = F.lit(True) if cond is None else cond
    att = F.greatest(F.lit(1), F.coalesce(F.col("attempts"), F.lit(0)))
    st = F.when(att >= F.coalesce(F.col("retry_limit"), F.lit(0)), F.lit("failed")).otherwise(F.lit("pending"))
    delay = F.when(st == "pending", F.least(F.lit(3600), F.greatest(F.lit(60), att * 300))).otherwise(F.lit(0))
    msg = F.lit(message) if isinstance(message, str) else message
    return _apply(items, cond, {"status": st, "attempts": att, "last_error": msg,
                                "scheduled_at": _plus_seconds(_ts(as_of), delay), "finished_at": _ts(as_of)})


def mark_done(items: DataFrame, as_of, cond: Column, status: str = "success",
              article_col: str | None = "article_id", message: str | None = None) -> DataFrame:
    """Q6: success (article id set, error cleared) or skipped (reason) transitions."""
    upd = {"status": F.lit(status), "finished_at": _ts(as_of),
           "last_error": F.lit(message).cast("string") if message else F.lit(None).cast("string")}
    if article_col and article_col in items.columns and status == "success":
        upd[article_col] = F.col(article_col)
    return _apply(items, cond, upd)


def last_collected(queue: DataFrame) -> DataFrame:
    """Q6: per rule, the latest success finish time (rule's last_collected_at)."""
    return queue.where(F.col("status") == "success").groupBy("rule_id").agg(
        F.max("finished_at").alias("last_collected_at"))


def retry(queue: DataFrame, as_of, ids: DataFrame | None = None) -> DataFrame:
    """Q7: selected ids (or all failed) -> pending, attempts 0, scheduled now, cleared."""
    if ids is None:
        cond = F.col("status") == "failed"
        q = queue
    else:
        q = queue.join(ids.select(F.col("queue_id"), F.lit(True).alias("_sel")).distinct(), "queue_id", "left")
        cond = F.coalesce(F.col("_sel"), F.lit(False))
    out = _apply(q, cond, {"status": F.lit("pending"), "attempts": F.lit(0), "last_error": F.lit(None).cast("string"),
                           "scheduled_at": _ts(as_of), "started_at": F.lit(None).cast("timestamp_ntz"),
                           "finished_at": F.lit(None).cast("timestamp_ntz")})
    return out.drop("_sel") if ids is not None else out


def delete_items(queue: DataFrame, ids: DataFrame | None = None, status: str | None = None) -> DataFrame:
    """Q8: remove selected ids, or all items of a status (e.g. all success)."""
    if ids is not None:
        return queue.join(ids.select("queue_id").distinct(), "queue_id", "left_anti")
    return queue.where(~(F.col("status") == status))


def clean_queue(queue: DataFrame, as_of, status: str = "success", rule_id: int | None = None,
                days: int = 30) -> DataFrame:
    """Q9: delete items of ``status`` (optionally one rule) whose finish (else discovery)
    time is older than ``days`` (0..3650; 0 = no age test). Returns the remaining queue."""
    days = max(0, min(3650, int(days)))
    cond = F.col("status") == status
    if rule_id:
        cond = cond & (F.col("rule_id") == rule_id)
    if days > 0:
        cond = cond & (F.coalesce("finished_at", "discovered_at") < F.timestamp_add("DAY", F.lit(-days), _ts(as_of)))
    return queue.where(~F.coalesce(cond, F.lit(False)))


def throttle(batch: DataFrame, as_of, order_key: str = "queue_id", group: list[str] | None = None) -> DataFrame:
    """Q10: within a batch (ordered by ``order_key``) item 0 runs; a later item whose
    rule has request_delay > 0 is postponed to now + delay * index. Adds ``batch_index``
    and ``postponed``; ``scheduled_at`` updated for postponed rows."""
    ranked = rank_in_group(batch.withColumn("_g", F.lit(0)) if not group else batch, group or ["_g"], [order_key],
                           "_i")
    idx = F.col("_i") - 1
    delay = F.least(F.greatest(F.coalesce(F.col("request_delay"), F.lit(0)), F.lit(0)), F.lit(30))
    post = (idx > 0) & (delay > 0)
    out = ranked.withColumn("batch_index", idx.cast("int")).withColumn("postponed", post) \
        .withColumn("scheduled_at", F.when(post, _plus_seconds(_ts(as_of), delay * idx)).otherwise(F.col("scheduled_at")))
    return out.drop("_i", "_g")


def release_all(queue: DataFrame, as_of) -> DataFrame:
    """Q11: every running item -> pending, scheduled and finished now."""
    return _apply(queue, F.col("status") == "running", {
        "status": F.lit("pending"), "last_error": F.lit(MSG_MANUAL_RELEASE),
        "scheduled_at": _ts(as_of), "finished_at": _ts(as_of)})


def queue_state(events: DataFrame, key: str = "queue_id", ts: str = "event_ts", seq: str = "seq") -> DataFrame:
    """Q12: current state per item = its latest transition by (event time, sequence).
    A partial aggregate (map-side max_by), so a busy item costs one row per partition."""
    cols = [c for c in events.columns if c != key]
    latest = events.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.col(ts), F.col(seq))).alias("_s"))
    return latest.select(key, *[F.col("_s." + c).alias(c) for c in cols])


def mark_discovered(rules: DataFrame, processed: DataFrame, as_of) -> DataFrame:
    """Q13: stamp last_discovered_at = now on the processed rules."""
    p = processed.select("rule_id").distinct().withColumn("_p", F.lit(True))
    out = rules.join(p, "rule_id", "left")
    return out.withColumn("last_discovered_at", F.when(F.col("_p"), _ts(as_of)).otherwise(F.col("last_discovered_at"))) \
        .drop("_p")
