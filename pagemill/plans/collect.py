"""Collect job: due queue items -> pages -> articles, transitions, logs.

  K1/O1  due items of enabled rules (optionally the per-rule FIFO batch)
  Q3     claim (running, attempts + 1)
  S1/S2  page scan: join the corpus on the URL hash; missing/empty/unsafe -> failure
  X3     shred the fetched pages once (Arrow)
  X12-14 title/content/date by the rule's JSON path / markers / selectors; empty -> failure
  C8     replacements
  K5/K6/K6b  duplicate source / title (against live articles and within the batch) -> skipped
  C1-C4  cleaning (Arrow)          I1-I9  image localisation (asset table)
  W2-W5  rewrite responses: gate, policy (where responses are given)
  C20    publish record            Q5/Q6  failure / success / skip transitions + logs

Only keys travel through the joins; page HTML joins in once, right before the shred.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from pagemill.functions import jsonpage as J
from pagemill.functions.text import cached_columns
from pagemill.functions.text import (
    allow_html, apply_replacements, article_category, article_status, article_tags, auto_tags, coerce_date, excerpt,
    match_category, schedule_delay_minutes, seo_fields, strip_tags)
from pagemill.functions.urls import is_safe_public_url, normalize_url
from pagemill.operators import extract as X
from pagemill.operators import queue as Q
from pagemill.operators import rewrite as W
from pagemill.operators.clean import clean_content
from pagemill.operators.images import localize_images
from pagemill.operators.joins import small
from pagemill.operators.shred import shred
from pagemill.plans.corpus import compile_rule_selectors
from pagemill.schema import Settings
from pagemill.session import cut_lineage
from pagemill.sources.key_index import KeyIndex

# Failure and log messages.
MSG_FETCH = "page fetch failed"
MSG_STATUS = "HTTP status "
MSG_EXTRACT = "title or content extraction failed"
MSG_SUCCESS = "collected"
MSG_PART = "page read in part"


@dataclass
class Seen:
    """Sources and titles published by earlier passes, as key indexes that a pass asks for its own
    keys only; ``before`` is the number of the pass."""

    sources: KeyIndex
    titles: KeyIndex
    before: int

    def add(self, articles: DataFrame) -> None:
        self.sources.add(self.before, articles.select(Q.source_hash(F.col("source_url")).alias("key")))
        self.titles.add(self.before, Q.live_titles(articles).select(F.md5("_t").alias("key")))


@dataclass
class CollectResult:
    items: DataFrame        # one row per processed queue item with its outcome
    articles: DataFrame     # published records (C20)
    transitions: DataFrame  # new queue state of processed items
    logs: DataFrame         # log rows
    last_collected: DataFrame   # per rule with a success: last_collected_at (Q6)
    turns: DataFrame | None = None  # with ``every_pass``: the pass of each item, from 0


def cut_bytes(text, most: int):
    """The first ``most`` bytes of a text; a character that the cut splits becomes U+FFFD."""
    return F.when(F.octet_length(text) > most,
                  F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string"))).otherwise(text)


def page_scan(items: DataFrame, pages: DataFrame, page_bytes: int | None = None) -> DataFrame:
    """S1+S2: attach page HTML by normalised-URL hash; ``fetch_error`` when the page is
    missing, empty, or the URL is not a safe public URL, or when the corpus has a ``status`` column
    that is not 200 to 299 for it (null: not recorded, taken as read). HTML is whole unless ``page_bytes``
    is given. Unsafe items are set aside first; keys decide which page an item reads, and
    HTML joins only to items that read one, so few due items never move the corpus."""
    gated = items.withColumn("_safe", is_safe_public_url(F.col("url"))) \
        .withColumn("_ph", F.when(F.col("_safe"), F.md5(normalize_url(F.col("url")))))
    asked = gated.where("_safe").select("_ph").distinct()
    # one page per normalised URL: the smallest page id
    status = F.col("status").cast("int") if "status" in pages.columns else F.lit(None).cast("int")
    refused = F.when(~status.between(200, 299), F.concat(F.lit(MSG_STATUS), status.cast("string")))
    keys = pages.select(F.md5(normalize_url(F.col("url"))).alias("_ph"), "page_id", refused.alias("_status"),
                        (F.coalesce(F.col("html"), F.lit("")) != "").alias("_has")) \
        .join(small(asked), "_ph", "left_semi") \
        .groupBy("_ph").agg(F.min(F.struct("page_id", "_has", "_status")).alias("_p"))
    keyed = gated.join(keys, "_ph", "left").drop("_ph") \
        .withColumn("page_id", F.col("_p.page_id")).withColumn("_status", F.col("_p._status")) \
        .withColumn("_has", F.coalesce(F.col("_p._has"), F.lit(False)) & F.col("_status").isNull()).drop("_p")
    found = keyed.where(F.col("_safe") & F.col("_has"))
    html = pages.select("page_id", F.col("html") if page_bytes is None else cut_bytes(F.col("html"), page_bytes).alias("html"))
    cols = ["page_id", *items.columns]
    ok = html.join(small(found), "page_id").select(*cols, "html", F.lit(None).cast("string").alias("fetch_error"))
    err = F.when(~F.col("_safe"), F.lit("unsafe URL")).otherwise(F.coalesce(F.col("_status"), F.lit(MSG_FETCH)))
    bad = keyed.where(~(F.col("_safe") & F.col("_has"))).select(*cols, F.lit(None).cast("string").alias("html"), err.alias("fetch_error"))
    return ok.unionByName(bad)


def build_articles(df: DataFrame, as_of, site_name: str = "") -> DataFrame:
    """C20: the publish record of each collected item (title, filtered content, excerpt,
    status, date, author, categories, tags, SEO keys, source URL, featured image)."""
    ts = F.lit(as_of).cast("timestamp_ntz") if not hasattr(as_of, "_jc") else as_of
    content = F.col("clean_content")
    # shared per-row values materialised once
    df = df.withColumn("_ctx", F.concat(F.col("x_title"), F.lit("\n"), strip_tags(content))) \
        .withColumn("_exc", excerpt(content, F.col("r_excerpt_length")))
    ctx, exc = F.col("_ctx"), F.col("_exc")
    scheduled = F.when(F.col("r_publish_mode") == "random_future",
                       F.timestamp_add("MINUTE", schedule_delay_minutes(F.col("url"), F.col("r_publish_delay_min"),
                                                                        F.col("r_publish_delay_max")), ts))
    st0 = F.when(F.col("r_publish_mode") == "random_future", F.lit("future")).otherwise(F.col("r_post_status"))
    matched = match_category(ctx, F.col("r_category_rules"))
    cat = article_category(matched, F.col("r_category_id"))
    tags = article_tags(F.col("r_fixed_tags"), auto_tags(ctx, F.col("r_auto_tag_keywords")), F.col("r_auto_tags"))
    seo = seo_fields(F.col("r_seo_family"), F.col("x_title"), exc, F.lit(site_name), F.col("url"),
                     F.col("r_seo_title_template"), F.col("r_seo_desc_template"))
    seo_map = F.when(seo["seo_title_key"].isNotNull(),
                     F.create_map(seo["seo_title_key"], seo["seo_title"], seo["seo_desc_key"], seo["seo_desc"]))
    return df.select(
        F.col("queue_id").alias("article_id"), "queue_id", "rule_id",
        strip_tags(F.col("x_title")).alias("title"), allow_html(content).alias("content"),
        F.when(F.col("r_auto_excerpt"), exc).alias("excerpt"),
        article_status(st0, scheduled).alias("status"),
        F.coalesce(scheduled, F.when(F.col("x_date") != "", coerce_date(F.col("x_date"), ts))).alias("published_at"),
        F.nullif(F.col("r_author_id"), F.lit(0)).alias("author_id"),
        F.when(cat.isNotNull(), F.array(cat)).otherwise(F.array().cast("array<bigint>")).alias("category_ids"),
        tags.alias("tags"), F.col("url").alias("source_url"), seo_map.alias("seo"),
        F.when(F.col("r_set_featured"), F.col("featured_image")).alias("featured_image"))


def skipped_in_turn(items: DataFrame) -> DataFrame:
    """(queue_id, skip) of items (queue_id, turn, r_dedupe_title, _t, _source, _known) of several
    passes, as if each ran after the one before: an item that compares titles is known if an earlier
    pass publishes its source or title, and is skipped if it is known or an item of its own pass that
    is not known has its title and a smaller id. What depends on an item that is still undecided
    waits for the next round; a round decides at least one pass, and most of all of them."""
    title = strip_tags(F.col("_t"))     # as published titles are compared
    rows = cut_lineage(items.select("queue_id", "turn", "_t", title.alias("_k"), "_source", F.coalesce("r_dedupe_title", F.lit(False)).alias("_d"))
                       .withColumn("_known", F.when(~F.col("_d"), False)).join(items.where("_known").select("queue_id", F.lit(True).alias("_old")), "queue_id", "left")
                       .withColumn("_known", F.coalesce("_old", "_known")).drop("_old"))
    fresh, open_ = ~F.col("_known"), F.col("_known").isNull()

    def firsts(r: DataFrame) -> DataFrame:
        own = r.groupBy("_k", "turn").agg(F.min(F.when(fresh, F.col("queue_id"))).alias("_first"), F.min(F.when(open_, F.col("queue_id"))).alias("_open"))
        return r.join(own, ["_k", "turn"])

    while not rows.where(open_).isEmpty():
        leads = F.col("queue_id") == F.col("_first")
        unsure = F.coalesce(F.col("_open") < F.col("queue_id"), F.lit(False))
        flagged = firsts(rows).select("_k", "_source", "turn", (fresh & (~F.col("_d") | leads & ~unsure)).alias("_out"),
                                      (open_ | fresh & F.col("_d") & leads & unsure).alias("_may"))
        least = lambda key, a, b: flagged.groupBy(key).agg(
            F.min(F.when(F.col("_out"), F.col("turn"))).alias(a), F.min(F.when(F.col("_may"), F.col("turn"))).alias(b))
        before = lambda a, b: F.coalesce(F.least(a, b) < F.col("turn"), F.lit(False))
        asked = rows.join(least("_source", "_so", "_sm"), "_source", "left") \
            .join(least("_k", "_to", "_tm").withColumnRenamed("_k", "_t"), "_t", "left")
        rows = cut_lineage(asked.withColumn("_known", F.when(F.col("_known").isNotNull(), F.col("_known")).when(before("_so", "_to"), True)
                                            .when(~before("_sm", "_tm"), False)).select(*rows.columns))
    return firsts(rows).select("queue_id", (F.col("_known") | F.col("_d") & (F.col("queue_id") > F.col("_first"))).alias("skip"))


def collect(queue: DataFrame, rules: DataFrame, pages: DataFrame, articles: DataFrame, as_of,
            assets: DataFrame | None = None, settings: Settings = Settings(), per_rule_batch: bool = False,
            responses: DataFrame | None = None, seen: Seen | None = None, every_pass: bool = False) -> CollectResult:
    """Run one collect pass over every due item (or each rule's FIFO batch). Items that hang
    in ``running`` are released first (Q4) and take part if they are due. Duplicates are tested
    against ``articles`` and against what ``seen`` knows of earlier passes. A page that could be
    read in part only fails its item. With ``responses``
    (queue_id, response) articles of rules with ``rewrite`` are replaced by their response if it
    passes the gate (W2-W5); otherwise the rule's policy keeps the original or fails the item.
    ``every_pass`` takes the FIFO batches of all passes at once, with the outcomes that passes one
    after the other have (not with ``responses``, which decide late what is published)."""
    ts = F.lit(as_of).cast("timestamp_ntz")
    rules_c = compile_rule_selectors(rules)
    if "started_at" in queue.columns:
        queue = Q.release_stuck(queue, as_of, settings.running_timeout_minutes)
    due = Q.due_items(queue, rules_c, as_of)
    turns = None
    if per_rule_batch and every_pass:
        if responses is not None:
            raise ValueError("passes with rewrite responses run one by one")
        from pagemill.operators.reports import batch_numbers
        turns = cut_lineage(batch_numbers(due))
    elif per_rule_batch:
        from pagemill.operators.reports import next_batch
        due = next_batch(due, per_rule=True)
    claimed = due.withColumn("attempts", F.col("attempts") + 1).withColumn("status", F.lit("running")) \
        .withColumn("started_at", ts)
    fetched = page_scan(claimed, pages)
    ok_fetch = fetched.where(F.col("fetch_error").isNull())
    sh = shred(ok_fetch)
    # the page JSON is parsed only for rules that read a JSON path
    page_js = cached_columns("collect_page_json", lambda: F.when(
        (F.coalesce(F.col("r_title.json_path"), F.lit("")) != "") | (F.coalesce(F.col("r_content.json_path"), F.lit("")) != "")
        | (F.coalesce(F.col("r_date.json_path"), F.lit("")) != ""), J.page_json(F.col("html"), F.col("r_json_source"))))
    sh = sh.withColumn("page_json", page_js).withColumn("title", F.col("r_title")) \
        .withColumn("content", F.col("r_content")).withColumn("date", F.col("r_date"))
    ex = X.extract_articles(sh).withColumn("extract_error", F.coalesce(
        F.concat(F.lit(MSG_PART + ": "), F.col("page_error")), F.col("extract_error"))) \
        .drop("nodes", "page_text", "page_error", "html", "page_json", "title", "content", "date")
    # several outputs read the extracted items: run the Arrow pass once and cut the
    # lineage in the shared checkpoint folder (survives executor loss, keeps plans small)
    ex = cut_lineage(ex)
    ex = ex.withColumn("x_title", apply_replacements(F.col("x_title"), F.col("r_replacements"))) \
        .withColumn("x_content", apply_replacements(F.col("x_content"), F.col("r_replacements")))
    good = ex.where(F.col("extract_error").isNull())
    # duplicates: source already published or title equal to a live article; of the items
    # that are left, those whose title an earlier one publishes in this batch
    # names only: content does not travel on the title, which may be a hot key
    names = cut_lineage(good.select("queue_id", "url", "r_dedupe_title", strip_tags(F.col("x_title")).alias("_t")))
    source = F.md5(normalize_url(F.col("url")))
    fresh = Q.not_published(names.select("queue_id", "url"), articles)
    if seen is not None:
        old = seen.sources.known(names.select(source.alias("key")), seen.before)
        fresh = fresh.withColumn("key", source).join(old, "key", "left_anti")
    repeat = names.join(Q.live_titles(articles), "_t", "left_semi").select("queue_id")
    if seen is not None:
        old = seen.titles.known(names.select(F.md5("_t").alias("key")), seen.before)
        repeat = repeat.unionByName(names.withColumn("key", F.md5("_t")).join(old, "key", "left_semi").select("queue_id")).distinct()
    judged = names.join(fresh.select("queue_id", F.lit(True).alias("_new")), "queue_id", "left") \
        .join(repeat.withColumn("_dup", F.lit(True)), "queue_id", "left") \
        .withColumn("_known", F.col("r_dedupe_title") & (F.col("_new").isNull() | F.coalesce(F.col("_dup"), F.lit(False))))
    judged = cut_lineage(judged.select("queue_id", "r_dedupe_title", "_t", "_known", source.alias("_source")))
    if turns is not None:
        skipped = skipped_in_turn(judged.join(turns, "queue_id"))
    else:
        later = Q.first_of_equal_titles(judged.where(~F.col("_known")), "_t", "queue_id") \
            .where("batch_duplicate").select("queue_id", F.lit(True).alias("_later"))
        skipped = judged.join(later, "queue_id", "left").select("queue_id", (
            F.col("_known") | (F.col("r_dedupe_title") & F.coalesce(F.col("_later"), F.lit(False)))).alias("skip"))
    good = good.join(skipped, "queue_id")
    keep = good.where(~F.col("skip")).withColumn("clean", F.col("r_clean"))
    cleaned = cut_lineage(clean_content(keep, "x_content", "clean", "clean_content", base_col="url").drop("clean"))
    if assets is not None:
        loc_in = cleaned.where(F.col("r_localize_images"))
        loc = localize_images(loc_in.select(F.col("queue_id").alias("article_id"), F.col("url").alias("source_url"),
                                            F.col("clean_content").alias("content")), assets,
                              settings.max_images_per_post, settings.max_image_size_mb * 1024 * 1024)
        loc = loc.select(F.col("article_id").alias("queue_id"), F.col("content").alias("_loc"), "featured_image",
                         F.col("found").alias("images_found"), F.col("failed").alias("images_failed"))
        cleaned = cleaned.join(loc, "queue_id", "left") \
            .withColumn("clean_content", F.coalesce(F.col("_loc"), F.col("clean_content"))).drop("_loc")
    else:
        cleaned = cleaned.withColumn("featured_image", F.lit(None).cast("string")) \
            .withColumn("images_found", F.lit(None).cast("long")).withColumn("images_failed", F.lit(None).cast("long"))
    lost = None
    if responses is not None:
        todo = cleaned.where(F.coalesce(F.col("r_rewrite"), F.lit(False))).join(responses.select("queue_id", "response"), "queue_id", "left")
        done = cut_lineage(W.apply_policy(todo, "x_title", "clean_content", "response", "r_rewrite_on_failure"))
        lost = done.where(F.col("action") == "fail")
        kept = done.where(F.col("action") != "fail").withColumn("x_title", F.col("final_title")) \
            .withColumn("clean_content", F.col("final_content")).select(*cleaned.columns)
        cleaned = cleaned.where(~F.coalesce(F.col("r_rewrite"), F.lit(False))).unionByName(kept)
    arts = build_articles(cleaned, as_of, settings.site_name)

    # outcomes per item
    base_cols = ["queue_id", "rule_id", "url", "attempts", "r_retry_limit"]
    failed = (fetched.where(F.col("fetch_error").isNotNull()).select(*base_cols, F.col("fetch_error").alias("error"))
              .unionByName(ex.where(F.col("extract_error").isNotNull()).select(*base_cols, F.col("extract_error").alias("error"))))
    if lost is not None:
        failed = failed.unionByName(lost.select(*base_cols, F.col("reason").alias("error")))
    failed = failed.withColumnRenamed("r_retry_limit", "retry_limit").withColumn("status", F.lit("running")) \
        .withColumn("last_error", F.lit(None).cast("string")).withColumn("scheduled_at", F.lit(None).cast("timestamp_ntz")) \
        .withColumn("finished_at", F.lit(None).cast("timestamp_ntz"))
    failed_t = Q.mark_failed(failed, as_of, F.col("error")).select("queue_id", "rule_id", "url", "status", "attempts",
                                                          F.col("last_error"), "scheduled_at", "finished_at",
                                                          F.lit(None).cast("long").alias("article_id"))
    skipped_t = good.where(F.col("skip")).select("queue_id", "rule_id", "url", F.lit("skipped").alias("status"), "attempts",
                                                 F.lit(Q.MSG_DUPLICATE).alias("last_error"),
                                                 F.lit(None).cast("timestamp_ntz").alias("scheduled_at"), ts.alias("finished_at"),
                                                 F.lit(None).cast("long").alias("article_id"))
    success_t = cleaned.select("queue_id", "rule_id", "url", F.lit("success").alias("status"),
                               "attempts", F.lit(None).cast("string").alias("last_error"),
                               F.lit(None).cast("timestamp_ntz").alias("scheduled_at"), ts.alias("finished_at"),
                               F.col("queue_id").alias("article_id"))
    transitions = failed_t.unionByName(skipped_t).unionByName(success_t)
    logs = transitions.select(
        F.col("queue_id").alias("log_id"), "rule_id", "queue_id",
        F.when(F.col("status") == "success", "success").when(F.col("status") == "skipped", "warning")
        .otherwise("error").alias("level"),
        F.coalesce(F.col("last_error"), F.lit(MSG_SUCCESS)).alias("message"), "url", ts.alias("created_at"))
    return CollectResult(items=transitions, articles=arts, transitions=transitions, logs=logs,
                         last_collected=Q.last_collected(transitions), turns=turns)
