"""Rule previews as corpus jobs (V1–V4): every page of every rule, not one sample page."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagemill.functions.text import strip_tags
from pagemill.operators import extract as X
from pagemill.operators.clean import clean_content
from pagemill.operators.images import image_sources
from pagemill.operators.queue import split_ready

PREVIEW_LINKS = 50
PREVIEW_READY = 20
PREVIEW_DUPLICATES = 10


def preview_links(links: DataFrame, articles: DataFrame, key: str = "page_id", most: int | None = PREVIEW_LINKS) -> DataFrame:
    """V1: per list page the first ``most`` discovered links (None: all of them) split into
    ready (<= 20 shown) and already published (<= 10 shown), with counts. ``links`` = (key,
    pos, url)."""
    first = links if most is None else links.where(F.col("pos") < most)
    flagged = split_ready(first, articles)
    return flagged.groupBy(key).agg(
        F.count(F.lit(1)).alias("links"),
        F.count_if(~F.col("duplicate")).alias("ready"),
        F.count_if(F.col("duplicate")).alias("duplicates"),
        F.slice(F.array_sort(F.collect_list(F.when(~F.col("duplicate"), F.struct("pos", "url")))), 1, PREVIEW_READY)
        .alias("ready_sample"),
        F.slice(F.array_sort(F.collect_list(F.when(F.col("duplicate"), F.struct("pos", "url")))), 1, PREVIEW_DUPLICATES)
        .alias("duplicate_sample"))


def preview_articles(shredded: DataFrame, json_col: str = "page_json") -> DataFrame:
    """V2+V3: per (page, rule) the extracted fields, raw/clean lengths, image and link
    counts, selector match counts, outer-HTML samples and a ``warnings`` array. Uses the
    collection order (replace, then clean) for the cleaned content."""
    ex = X.extract_articles(shredded, json_col)
    ex = ex.withColumn("title_matches", X.field_match_count(F.col(json_col), F.col("title"))) \
        .withColumn("content_matches", X.field_match_count(F.col(json_col), F.col("content"))) \
        .withColumn("content_sample", X.outer_sample(F.col("content.sel"), 1500)) \
        .withColumn("anchor_count", F.size(X.anchor_links(F.col("html"), F.col("url"))))
    ex = ex.drop("nodes", "page_text", "html")
    cleaned = clean_content(ex.withColumn("clean_cfg", F.col("clean")), "x_content", "clean_cfg", "clean_content")
    date_set = X.date_wanted(F.col("date"))
    warnings = F.array_compact(F.array(
        F.when(F.col("x_title") == "", F.lit("empty_title")),
        F.when(F.col("x_content") == "", F.lit("empty_content")),
        F.when((F.col("x_content") != "") & (strip_tags(F.col("clean_content")) == ""), F.lit("empty_after_clean")),
        F.when(date_set & (F.col("x_date") == ""), F.lit("empty_date"))))
    return cleaned.select(
        "*", F.length("x_content").alias("raw_length"), F.length("clean_content").alias("clean_length"),
        F.size(image_sources(F.col("clean_content"))).alias("image_count"), warnings.alias("warnings")).drop("clean_cfg")


def rule_coverage(preview: DataFrame) -> DataFrame:
    """V4: per rule the number of pages, the share of pages with each warning and the mean
    selector match counts (one partial aggregation)."""
    def share(w):
        return F.round(F.avg(F.array_contains("warnings", w).cast("double")), 4)

    return preview.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("pages"),
        share("empty_title").alias("empty_title_share"), share("empty_content").alias("empty_content_share"),
        share("empty_after_clean").alias("empty_after_clean_share"), share("empty_date").alias("empty_date_share"),
        F.round(F.avg("title_matches"), 4).alias("avg_title_matches"),
        F.round(F.avg("content_matches"), 4).alias("avg_content_matches"))
