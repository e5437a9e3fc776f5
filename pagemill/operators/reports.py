"""Reports over queue and logs: counts, trends, top-k, listings, health.

Conditional aggregates are fused into one pass per table (the dashboard's many scalar
counts become one ``groupBy``/``agg``); top-k uses ``orderBy().limit()`` (planned as
TakeOrderedAndProject) or ``row_number() <= k`` per group (planned with a partial
window group limit before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.operators.joins import small
from pagemill.schema import QUEUE_STATUSES


def _ts(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")


def _cnt(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def rate(num: Column, a: Column, b: Column) -> Column:
    """100 * num / max(1, a + b), 2 decimals (half up)."""
    return F.round(F.lit(100.0) * num / F.greatest(F.lit(1), a + b), 2)


def status_counts(queue: DataFrame) -> DataFrame:
    """A1: count per status; all five statuses always present."""
    spark = queue.sparkSession
    statuses = spark.createDataFrame([(s,) for s in QUEUE_STATUSES], "status string")
    agg = queue.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return statuses.join(agg, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def today_counts(queue: DataFrame, logs: DataFrame, as_of) -> DataFrame:
    """A2: today's discovered / success / failed items and error logs (one row)."""
    day = F.date_trunc("day", _ts(as_of)).cast("timestamp_ntz")
    # one conditional aggregation over both tables (tagged union): one pass, no join
    u = queue.select(F.lit("q").alias("_src"), "discovered_at", "status", "finished_at",
                     F.lit(None).cast("string").alias("level"), F.lit(None).cast("timestamp_ntz").alias("created_at")) \
        .unionByName(logs.select(F.lit("l").alias("_src"), F.lit(None).cast("timestamp_ntz").alias("discovered_at"),
                                 F.lit(None).cast("string").alias("status"),
                                 F.lit(None).cast("timestamp_ntz").alias("finished_at"), "level", "created_at"))
    q = F.col("_src") == "q"
    return u.agg(_cnt(q & (F.col("discovered_at") >= day)).alias("today_discovered"),
                 _cnt(q & (F.col("status") == "success") & (F.col("finished_at") >= day)).alias("today_success"),
                 _cnt(q & (F.col("status") == "failed") & (F.col("finished_at") >= day)).alias("today_failed"),
                 _cnt((F.col("_src") == "l") & (F.col("level") == "error") & (F.col("created_at") >= day))
                 .alias("today_logs_error"))


def daily_trend(queue: DataFrame, as_of, days: int = 7) -> DataFrame:
    """A3+A4: per day of coalesce(finished, discovered) over the last ``days`` days:
    total, success, failed, success rate; newest first."""
    start = F.timestamp_add("DAY", F.lit(-(days - 1)), F.date_trunc("day", _ts(as_of)).cast("timestamp_ntz"))
    t = F.coalesce("finished_at", "discovered_at")
    g = queue.where(t >= start).groupBy(F.to_date(t).alias("day")).agg(
        F.count(F.lit(1)).alias("total_count"),
        _cnt(F.col("status") == "success").alias("success_count"),
        _cnt(F.col("status") == "failed").alias("failed_count"))
    g = g.withColumn("success_rate", rate(F.col("success_count"), F.col("success_count"), F.col("failed_count")))
    return g.orderBy(F.col("day").desc()).limit(days)


def rule_counts(rules: DataFrame, queue: DataFrame) -> DataFrame:
    """K4: per rule pending/success/failed/total — queue aggregated first (partial agg),
    then rules left-joined so rules without items count 0."""
    agg = queue.groupBy("rule_id").agg(
        _cnt(F.col("status") == "pending").alias("pending_count"),
        _cnt(F.col("status") == "success").alias("success_count"),
        _cnt(F.col("status") == "failed").alias("failed_count"),
        F.count(F.col("queue_id")).alias("total_count"))
    out = rules.select("rule_id", "name").join(agg, "rule_id", "left")
    return out.select("rule_id", "name", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in
                                           ["pending_count", "success_count", "failed_count", "total_count"]])


def top_rules(rules: DataFrame, queue: DataFrame, k: int = 8) -> DataFrame:
    """A5: top ``k`` rules by failed desc, pending desc (rule id as tie-break), with fail rate."""
    c = rule_counts(rules, queue).withColumn(
        "fail_rate", rate(F.col("failed_count"), F.col("success_count"), F.col("failed_count")))
    return c.orderBy(F.col("failed_count").desc(), F.col("pending_count").desc(), F.col("rule_id")).limit(k)


def rule_overview(rules: DataFrame, queue: DataFrame) -> DataFrame:
    """Every rule with its pending/success/failed counts, newest rule first."""
    return rule_counts(rules, queue).drop("total_count").orderBy(F.col("rule_id").desc())


def health(queue: DataFrame, logs: DataFrame, as_of, running_timeout_minutes: int = 30) -> DataFrame:
    """V5 (= A1, A7, A8, A9, A10 in one row): one pass over the queue, one over the logs."""
    cutoff = F.timestamp_add("MINUTE", F.lit(-max(5, int(running_timeout_minutes))), _ts(as_of))
    q = queue.agg(
        *[_cnt(F.col("status") == s).alias(f"{s}_count") for s in QUEUE_STATUSES],
        _cnt((F.col("status") == "running") & (F.col("started_at") < cutoff)).alias("stuck_running"),
        F.max(F.when(F.col("status") == "success", F.col("finished_at"))).alias("last_success"))
    q = q.withColumn("fail_rate", rate(F.col("failed_count"), F.col("success_count"), F.col("failed_count")))
    e = logs.where(F.col("level") == "error").agg(
        F.max_by(F.struct("created_at", "message", "url"), F.col("log_id")).alias("e"))
    e = e.select(F.col("e.created_at").alias("last_error_at"), F.col("e.message").alias("last_error_message"),
                 F.col("e.url").alias("last_error_url"))
    return attach_one_row(q, e)


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate to every row of ``df`` (equi-join on a
    constant key; the one-row side is broadcast)."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")


def fail_rate(queue: DataFrame) -> DataFrame:
    """Global failure rate (percent, 2 decimals)."""
    a = queue.agg(_cnt(F.col("status") == "failed").alias("failed_count"),
                  _cnt(F.col("status") == "success").alias("success_count"))
    return a.withColumn("fail_rate", rate(F.col("failed_count"), F.col("success_count"), F.col("failed_count")))


def stuck_running(queue: DataFrame, as_of, minutes: int = 30) -> DataFrame:
    """Running items started before now - max(5, minutes)."""
    cutoff = F.timestamp_add("MINUTE", F.lit(-max(5, int(minutes))), _ts(as_of))
    return queue.agg(_cnt((F.col("status") == "running") & (F.col("started_at") < cutoff)).alias("stuck_running"))


def last_success(queue: DataFrame) -> DataFrame:
    """Latest finish time of a successful item."""
    return queue.where(F.col("status") == "success").agg(F.max("finished_at").alias("last_success"))


def last_error(logs: DataFrame) -> DataFrame:
    """A10: the newest error log row (by id)."""
    e = logs.where(F.col("level") == "error").agg(F.max_by(F.struct("log_id", "created_at", "message", "url"),
                                                           F.col("log_id")).alias("e"))
    return e.select("e.*").where(F.col("log_id").isNotNull())


def topic_counts(logs: DataFrame, terms: list[str], as_of) -> DataFrame:
    """today's log rows whose message contains each term (one column per term)."""
    day = F.date_trunc("day", _ts(as_of)).cast("timestamp_ntz")
    today = F.col("created_at") >= day
    return logs.agg(*[_cnt(today & F.col("message").contains(t)).alias(f"today_{i}") for i, t in enumerate(terms)])


def table_totals(rules: DataFrame, queue: DataFrame, logs: DataFrame) -> DataFrame:
    """Row totals of the three tables (one row)."""
    u = rules.select(F.lit("r").alias("_s")).unionByName(queue.select(F.lit("q").alias("_s"))) \
        .unionByName(logs.select(F.lit("l").alias("_s")))
    return u.agg(F.count_if(F.col("_s") == "r").alias("rules_total"), F.count_if(F.col("_s") == "q").alias("queue_total"),
                 F.count_if(F.col("_s") == "l").alias("logs_total"))


def _batch_cap(rule_limit_col: str) -> Column:
    return F.greatest(F.coalesce(F.col(rule_limit_col), F.lit(5)), F.lit(1))


def batch_numbers(due: DataFrame, rule_limit_col: str = "r_batch_limit", most: int = 50) -> DataFrame:
    """(queue_id, turn): which of the per-rule batches that :func:`next_batch` takes one after the
    other, from 0, each due item falls into. A hot rule is ranked in parts."""
    from pagemill.operators.joins import rank_in_group

    cap = F.least(_batch_cap(rule_limit_col), F.lit(most))
    ranked = rank_in_group(due.select("queue_id", "rule_id", cap.alias("_cap")), ["rule_id"], ["queue_id"], "_rn")
    return ranked.groupBy("queue_id").agg(F.min(F.floor((F.col("_rn") - 1) / F.col("_cap"))).cast("long").alias("turn"))


def next_batch(due: DataFrame, limit: int | None = None, per_rule: bool = False,
               rule_limit_col: str = "r_batch_limit", most: int | None = 50) -> DataFrame:
    """O1: FIFO batch by queue id. Global form: first ``limit`` items. All-rules form: per rule
    the first ``batch_limit`` items. Limits are at least 1 and at most ``most`` (None: any); what is
    not taken stays due for the next batch."""
    if not per_rule:
        n = max(1, int(limit if limit is not None else 10))
        return due.orderBy("queue_id").limit(n if most is None else min(most, n))
    cap = _batch_cap(rule_limit_col)
    if most is None:
        from pagemill.operators.joins import rank_in_group

        # without a literal bound a hot rule is ranked in parts
        return rank_in_group(due, ["rule_id"], ["queue_id"], "_rn").where(F.col("_rn") <= cap).select(*due.columns)
    cap = F.least(cap, F.lit(most))
    w = Window.partitionBy("rule_id").orderBy("queue_id")
    # the literal bound lets Spark plan a map-side group limit (at most ``most`` rows per rule
    # leave each partition), so a rule with a third of the queue stays cheap
    return due.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") <= most) & (F.col("_rn") <= cap)).drop("_rn")


def rules_to_discover(rules: DataFrame, n: int = 20) -> DataFrame:
    """O2: the ``n`` enabled rules of stalest discovery (never-discovered first), rule id
    tie-break. The settings form allows up to 100, the operator any number."""
    n = max(1, int(n))
    key = F.coalesce(F.col("last_discovered_at"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return rules.where(F.col("enabled")).orderBy(key, F.col("rule_id")).limit(n)


def retain_logs(logs: DataFrame, keep: int = 2000) -> DataFrame:
    """O3: keep the newest ``keep`` log rows by id, 100 at least. The settings form allows up to
    20,000, the operator any number (a top-k per task, then one merge)."""
    n = max(100, int(keep))
    return logs.orderBy(F.col("log_id").desc()).limit(n)


def recent_problems(logs: DataFrame, rules: DataFrame, k: int = 8) -> DataFrame:
    """Newest ``k`` error/warning logs with their rule name."""
    p = logs.where(F.col("level").isin("error", "warning")).orderBy(F.col("log_id").desc()).limit(k)
    return p.join(small(rules.select("rule_id", F.col("name").alias("rule_name"))), "rule_id", "left")


def failed_samples(queue: DataFrame, k: int = 20) -> DataFrame:
    """Newest ``k`` failed items."""
    return queue.where(F.col("status") == "failed").orderBy(F.col("queue_id").desc()).limit(k) \
        .select("queue_id", "rule_id", "url", "attempts", "last_error", "finished_at")


def queue_filter(status: str | None = None, rule_id: int | None = None, url_has: str | None = None,
                 error_has: str | None = None, due: str | None = None, as_of=None) -> Column:
    """O6 predicate: optional status, rule, URL substring, error substring (case-
    insensitive plain substrings), due 'ready' / 'scheduled'."""
    c = F.lit(True)
    if status:
        c = c & (F.col("status") == status)
    if rule_id:
        c = c & (F.col("rule_id") == rule_id)
    if url_has:
        c = c & F.lower(F.col("url")).contains(url_has.lower())
    if error_has:
        c = c & F.coalesce(F.lower(F.col("last_error")).contains(error_has.lower()), F.lit(False))
    if due == "ready":
        c = c & (F.col("scheduled_at").isNull() | (F.col("scheduled_at") <= _ts(as_of)))
    elif due == "scheduled":
        c = c & F.coalesce(F.col("scheduled_at") > _ts(as_of), F.lit(False))
    return c


def list_queue(queue: DataFrame, rules: DataFrame, page: int = 1, per_page: int = 50, **filters) -> DataFrame:
    """One page of the filtered queue, newest first, with rule name and the total
    count of matching rows on every row."""
    q = queue.where(queue_filter(**filters))
    total = q.agg(F.count(F.lit(1)).alias("total"))
    rows = q.orderBy(F.col("queue_id").desc()).offset((max(1, page) - 1) * per_page).limit(per_page)
    rows = rows.join(small(rules.select("rule_id", F.col("name").alias("rule_name"))), "rule_id", "left")
    return attach_one_row(rows, total)


def list_queue_after(listing, rules: DataFrame, after: int | None = None, per_page: int = 50, **filters) -> DataFrame:
    """O6 by key: the next page of a queue listing (``sources.listing.Listing``) below the id
    ``after``, newest first, with rule names. Deep pages cost what the first one does."""
    rows = listing.page(after, per_page, queue_filter(**filters))
    return rows.join(small(rules.select("rule_id", F.col("name").alias("rule_name"))), "rule_id", "left")


def log_filter(level: str | None = None, rule_id: int | None = None, text: str | None = None, queue_id: int | None = None) -> Column:
    """O7 predicate: level, rule, substring of message or URL, item."""
    c = F.lit(True)
    if level:
        c = c & (F.col("level") == level)
    if rule_id:
        c = c & (F.col("rule_id") == rule_id)
    if text:
        t = text.lower()
        c = c & (F.lower(F.col("message")).contains(t) | F.lower(F.col("url")).contains(t))
    if queue_id:
        c = c & (F.col("queue_id") == queue_id)
    return c


def list_logs_after(listing, rules: DataFrame, after: int | None = None, per_page: int = 80, **filters) -> DataFrame:
    """O7 by key: the next page of a log listing below the id ``after``, newest first."""
    rows = listing.page(after, per_page, log_filter(**filters))
    return rows.join(small(rules.select("rule_id", F.col("name").alias("rule_name"))), "rule_id", "left")


def list_logs(logs: DataFrame, rules: DataFrame, page: int = 1, per_page: int = 80, level: str | None = None,
              rule_id: int | None = None, text: str | None = None, queue_id: int | None = None) -> DataFrame:
    """One page of filtered logs (level, rule, substring of message or URL, item)."""
    lg = logs.where(log_filter(level, rule_id, text, queue_id))
    total = lg.agg(F.count(F.lit(1)).alias("total"))
    rows = lg.orderBy(F.col("log_id").desc()).offset((max(1, page) - 1) * per_page).limit(per_page)
    rows = rows.join(small(rules.select("rule_id", F.col("name").alias("rule_name"))), "rule_id", "left")
    return attach_one_row(rows, total)


def item_logs(logs: DataFrame, term: str = "AI", k: int = 5) -> DataFrame:
    """O8 (all items at once): per queue item its newest ``k`` logs mentioning ``term``."""
    w = Window.partitionBy("queue_id").orderBy(F.col("log_id").desc())
    return logs.where(F.col("message").contains(term)).withColumn("_rn", F.row_number().over(w)) \
        .where(F.col("_rn") <= k).withColumnRenamed("_rn", "recent_rank")
