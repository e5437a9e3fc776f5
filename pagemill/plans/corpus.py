"""Rules and seed queue derived from a page corpus (used by the jobs, tests and bench).

One rule per host of the corpus, with its settings varied by a hash of the host so all
branches of the jobs are exercised; every page URL is a seed item of its host's rule.
Both are row-level derivations (no list is gathered per host), so a host holding a third
of the corpus costs rows, not one huge value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagemill.functions.text import parse_category_rules, parse_pairs
from pagemill.functions.urls import normalize_url, url_host
from pagemill.operators.selectors import SEL_TYPE

# Texts of the derived rules' enrichment settings.
REPLACE_TEXT = "&amp;&amp;&amp; => &amp;\n%%% =>\n### => #"
CATEGORY_TEXT = "the=>3\nde=>5\nund=>7\nla=>11"
TAG_TEXT = "news\nthe\nde\nund"


def _slot(selector: str, before: str = "", after: str = "", json_path: str = "") -> Column:
    return F.struct(F.lit(selector).alias("selector"), F.lit(before).alias("before"), F.lit(after).alias("after"),
                    F.lit(json_path).alias("json_path"))


def host_rule_id(host: Column) -> Column:
    """Rule id of a host: the first 15 hex digits of its MD5 (stable, no global numbering,
    and the same in any SQL engine)."""
    return F.conv(F.substring(F.md5(host), 1, 15), 16, 10).cast("long")


def corpus_rules(pages: DataFrame) -> DataFrame:
    """One enabled rule per host, its id from :func:`host_rule_id`."""
    from pagemill.functions.text import cached_columns

    hosts = pages.select(url_host(F.col("url")).alias("host")).where(F.col("host") != "").distinct()
    return hosts.select(*cached_columns("corpus_rules", _rule_columns))


def _rule_columns() -> list:
    k = F.pmod(host_rule_id(F.col("host")), F.lit(1000))
    lines = lambda txt: F.split(F.lit(txt), "\n")
    return [
        host_rule_id(F.col("host")).alias("rule_id"), F.col("host").alias("name"), F.lit(True).alias("enabled"),
        F.lit("").alias("pagination_pattern"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"),
        F.struct(F.lit("").alias("selector"), F.lit("").alias("before"), F.lit("").alias("after"),
                 F.lit("").alias("json_path"), F.lit("").alias("json_url_field")).alias("link"),
        F.lit("__NEXT_DATA__").alias("json_source"),
        F.when(k % 4 == 3, _slot("", "<h1>", "</h1>")).otherwise(_slot("//h1")).alias("title"),
        F.when(k % 5 == 4, _slot("", "<article>", "</article>")).otherwise(_slot("//article")).alias("content"),
        _slot("").alias("date"),
        F.struct(F.array(F.lit(".ad")).alias("remove_selectors"), (k % 2 == 0).alias("unwrap_links"),
                 F.when(k % 3 == 0, F.array(F.lit("share this"))).otherwise(F.array().cast("array<string>"))
                 .alias("drop_keywords"), F.lit(True).alias("drop_empty")).alias("clean"),
        F.when(k % 2 == 0, parse_pairs(F.lit(REPLACE_TEXT))).otherwise(
            F.array().cast("array<struct<from:string,to:string>>")).alias("replacements"),
        parse_category_rules(F.lit(CATEGORY_TEXT)).alias("category_rules"),
        (k % 3 != 1).alias("auto_tags"), lines(TAG_TEXT).alias("auto_tag_keywords"),
        F.array(F.lit("corpus"), F.lit("imported")).alias("fixed_tags"),
        (k % 4).cast("long").alias("category_id"), F.lit(1).cast("long").alias("author_id"),
        F.when(k % 6 == 0, "publish").when(k % 6 == 1, "bogus").otherwise("draft").alias("post_status"),
        F.when(k % 7 == 0, "random_future").otherwise("immediate").alias("publish_mode"),
        F.lit(10).alias("publish_delay_min"), F.lit(90).alias("publish_delay_max"),
        F.lit(5).alias("batch_limit"), (k % 4).cast("int").alias("retry_limit"), F.lit(0).alias("request_delay"),
        (k % 5 != 2).alias("dedupe_title"), F.lit(True).alias("auto_excerpt"), (60 + k % 200).cast("int").alias("excerpt_length"),
        F.when(k % 4 == 0, "yoast").when(k % 4 == 1, "rank_math").otherwise("none").alias("seo_family"),
        F.lit("{title} | {site}").alias("seo_title_template"), F.lit("").alias("seo_desc_template"),
        (k % 2 == 1).alias("localize_images"), (k % 2 == 1).alias("set_featured"),
        F.lit("{title}").alias("image_alt_template"),
        F.lit(False).alias("rewrite"), F.lit("").alias("rewrite_prompt"), F.lit("fallback").alias("rewrite_on_failure"),
        F.lit(None).cast("timestamp_ntz").alias("last_discovered_at"),
    ]


def compile_rule_selectors(rules: DataFrame) -> DataFrame:
    """Attach compiled selectors (``sel``) to the link/title/content/date slots. The
    distinct selector strings of all four slots are compiled in one Spark-side pass and
    joined back per slot (a small, size-checked table)."""
    from pagemill.operators.joins import small
    from pagemill.operators.selectors import compile_selector_udf

    slots = ["link", "title", "content", "date"]
    sels = None
    for slot in slots:
        part = rules.select(F.coalesce(F.col(f"{slot}.selector"), F.lit("")).alias("_sel"))
        sels = part if sels is None else sels.unionByName(part)
    comp = small(sels.distinct().select("_sel", compile_selector_udf(F.col("_sel")).alias("_c")))
    out = rules
    for slot in slots:
        c = comp.select(F.col("_sel").alias(f"_{slot}_k"), F.col("_c").alias(f"_{slot}_c"))
        out = out.join(c, F.coalesce(F.col(f"{slot}.selector"), F.lit("")) == F.col(f"_{slot}_k"), "left")
        out = out.withColumn(slot, F.col(slot).withField("sel", F.coalesce(F.col(f"_{slot}_c"), F.lit(None).cast(SEL_TYPE))))
        out = out.drop(f"_{slot}_k", f"_{slot}_c")
    return out


def seed_queue(pages: DataFrame, as_of) -> DataFrame:
    """Every page URL as a pending item of its host's rule (queue_id = page_id)."""
    u = normalize_url(F.col("url"))
    return pages.select(
        F.col("page_id").alias("queue_id"), host_rule_id(url_host(F.col("url"))).alias("rule_id"), u.alias("url"),
        F.md5(u).alias("url_hash"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"),
        F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("long").alias("article_id"),
        F.lit(as_of).cast("timestamp_ntz").alias("discovered_at"), F.lit(None).cast("timestamp_ntz").alias("scheduled_at"),
        F.lit(None).cast("timestamp_ntz").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"))
