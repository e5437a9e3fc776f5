"""Discovery job: list pages -> links -> new queue items.

  O2     stalest enabled rules first (optional limit)
  U8     list pages per rule (static list URLs + {page} range), or corpus pages
  S1     join the corpus on the URL hash (HTML joins in once)
  X3     shred only pages whose rule uses a link selector; JSON / all-anchor rules skip it
  X11    link precedence (JSON > marker slice > selector > all anchors)
  Q1+Q2  enqueue new (rule, url) pairs with spaced schedule; V7 per-rule totals as logs
  Q13    stamp discovery time on the processed rules
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from pagemill.functions import jsonpage as J
from pagemill.functions.text import cached_columns, trim_set
from pagemill.functions.urls import list_page_urls, normalize_url, url_host
from pagemill.operators import extract as X
from pagemill.operators import queue as Q
from pagemill.operators.joins import small
from pagemill.operators.reports import rules_to_discover
from pagemill.operators.shred import NODE_TYPE, shred
from pagemill.plans.corpus import compile_rule_selectors, host_rule_id
from pagemill.session import cut_lineage
from pagemill.sources.rules_io import manual_urls


@dataclass
class DiscoverResult:
    new_items: DataFrame
    logs: DataFrame
    rules: DataFrame


def list_pages(rules: DataFrame) -> DataFrame:
    """U8 as rows: (rule_id, list_pos, url)."""
    urls = list_page_urls(F.col("list_urls_text"), F.col("pagination_pattern"), F.col("page_start"), F.col("page_end"))
    return rules.select("rule_id", F.posexplode(urls).alias("list_pos", "url"))


def corpus_list_pages(pages: DataFrame) -> DataFrame:
    """Corpus mode: every page is a list page of its host's rule, in page order."""
    return pages.select(host_rule_id(url_host(F.col("url"))).alias("rule_id"), F.col("page_id").alias("list_pos"), "url")


def links_of_pages(listed: DataFrame, pages: DataFrame, rules: DataFrame) -> DataFrame:
    """S1 + X3 + X11: (rule_id, pos, url) links of every fetched list page. ``pos`` is the list
    page's position and that within the page, however many links a page has."""
    rules_c = compile_rule_selectors(rules).select("rule_id", "link", "json_source")
    read = F.coalesce(F.col("status").cast("int").between(200, 299), F.lit(True)) if "status" in pages.columns else F.lit(True)
    # one page per normalised URL (smallest id): keys and rules first, HTML last, once, to
    # the rows that need it; only pages that are listed leave the scan if those are few
    keys = pages.select(F.md5(normalize_url(F.col("url"))).alias("_h"), "page_id", read.alias("_read")) \
        .groupBy("_h").agg(F.min(F.struct("page_id", "_read")).alias("_p")).where("_p._read").select("_h", "_p.page_id")
    wanted = listed.withColumn("_h", F.md5(normalize_url(F.col("url")))).drop("url").join(keys, "_h").drop("_h") \
        .join(small(rules_c), "rule_id")
    fetched = pages.select("page_id", F.col("url").alias("page_url"), "html").join(wanted, "page_id").drop("page_id")
    needs_tree = trim_set(F.coalesce(F.col("link.selector"), F.lit(""))) != ""
    with_tree = shred(fetched.where(needs_tree))
    no_tree = fetched.where(~needs_tree).withColumn("page_text", F.lit("")) \
        .withColumn("nodes", F.array().cast(T.ArrayType(NODE_TYPE))).withColumn("page_error", F.lit(None).cast("string"))
    both = with_tree.unionByName(no_tree)
    # the page JSON is parsed only for rules that read links from a JSON path
    links = cached_columns("discover_links", lambda: X.discover_links(
        F.col("page_url"), F.when(F.coalesce(F.col("link.json_path"), F.lit("")) != "",
                                  J.page_json(F.col("html"), F.col("json_source"))), F.col("link")))
    out = both.select("rule_id", "list_pos", F.posexplode(links).alias("link_pos", "url"))
    return out.select("rule_id", F.struct(F.col("list_pos").cast("long").alias("list_pos"), F.col("link_pos").cast("long").alias("link_pos")).alias("pos"), "url")


def discover(rules: DataFrame, pages: DataFrame, queue: DataFrame, articles: DataFrame, as_of,
             listed: DataFrame | None = None, max_rules: int | None = None) -> DiscoverResult:
    """One discovery pass. ``listed`` (rule_id, list_pos, url) overrides U8 expansion. Rules with a
    ``manual_urls_text`` queue those URLs (S5) ahead of the links that they discover; list pages
    whose ``status`` in the corpus is not 200 to 299 give no links."""
    chosen = rules_to_discover(rules, max_rules) if max_rules else rules.where(F.col("enabled"))
    if listed is None:
        listed = list_pages(chosen)
    else:
        listed = listed.join(chosen.select("rule_id"), "rule_id", "left_semi")
    # links feed several steps (dedupe, ranking, anti joins): extract them once and cut the
    # lineage in the shared checkpoint folder
    links = links_of_pages(listed, pages, chosen)
    if "manual_urls_text" in rules.columns:
        given = manual_urls(chosen).select("rule_id", F.struct(F.lit(-1).cast("long").alias("list_pos"), F.col("pos").cast("long").alias("link_pos"))
                                           .alias("pos"), "url")
        links = given.unionByName(links)
    links = cut_lineage(links)
    new = Q.enqueue(links, queue, articles, chosen, as_of)
    ts = F.lit(as_of).cast("timestamp_ntz")
    logs = new.groupBy("rule_id").agg(F.count(F.lit(1)).alias("added")).select(
        "rule_id", F.lit("info").alias("level"),
        F.concat(F.lit("links discovered: "), F.col("added").cast("string")).alias("message"), ts.alias("created_at"),
        "added")
    return DiscoverResult(new_items=new, logs=logs, rules=Q.mark_discovered(rules, chosen, as_of))
