"""Images in article content.

Sources are pulled out of the content with JVM regexes (I1); each source becomes one row
(article, pos, src) that is resolved and gated (I2, I3), joined to an ``assets`` table
(url, bytes, mime) that stands in for the download (I4), capped per article (I5), and
folded back per article into featured image, rewritten content and stats (I6–I9).
Per-article groups are small (the images of one page), so the per-article window and
fold are bounded; the asset join is an ordinary shuffle join on URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.functions.text import let, render_template, strip_tags, trim_set
from pagemill.functions.urls import absolute_url, is_safe_public_url, normalize_url, url_ext

# Attributes tried for an image source, in order.
SRC_ATTRS = ["src", "data-src", "data-original", "data-lazy-src", "data-original-src", "data-echo"]
# Accepted image extensions (a missing extension is accepted too).
IMAGE_EXTS = ["jpg", "jpeg", "png", "gif", "webp"]
MAX_BYTES_DEFAULT = 5 * 1024 * 1024

_IMG_TAG = r"(?i)<img\b[^>]*>"
# Style declarations whose value begins with url(...): property name and address.
_URL_DECLARATION = r"([A-Za-z-]+)\s*:\s*[uU][rR][lL]\(([^)]+)\)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _attr(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, r"(?i)\s" + name + r"""=["']([^"']+)["']""", 1)


def image_sources(content) -> Column:
    """Per <img> the first non-empty of src, data-src, data-original, data-lazy-src,
    data-original-src, data-echo, plus every srcset candidate; then CSS background
    url(...) values; de-duplicated keeping first occurrences."""

    def per_tag(tag):
        primary = F.coalesce(*[F.nullif(trim_set(_attr(tag, a)), F.lit("")) for a in SRC_ATTRS])
        srcset = F.transform(F.split(_attr(tag, "srcset"), ","),
                             lambda p: trim_set(F.get(F.split(trim_set(p), r"\s+"), 0)))
        srcset = F.filter(srcset, lambda u: F.coalesce(u, F.lit("")) != "")
        return F.concat(F.filter(F.array(primary), lambda u: u.isNotNull()), srcset)

    tags = F.regexp_extract_all(_c(content), F.lit(_IMG_TAG), F.lit(0))
    from_tags = F.flatten(F.transform(tags, per_tag))
    part = lambda n: F.regexp_extract_all(_c(content), F.lit(_URL_DECLARATION), F.lit(n))
    declared = F.zip_with(part(1), part(2), lambda p, u: F.struct(
        F.lower(p).alias("name"), F.btrim(u, F.lit(" \t\n\r\x00\x0b\"'")).alias("url")))
    bg = F.transform(F.filter(declared, lambda d: d["name"].isin("background", "background-image") & (d["url"] != "")), lambda d: d["url"])
    return F.array_distinct(F.concat(from_tags, bg))


def image_candidates(articles: DataFrame, key: str = "article_id", content: str = "content",
                     base: str = "source_url") -> DataFrame:
    """I2+I3: one row per source: resolved URL and a first verdict — 'failed' (not a safe
    public URL), 'skipped' (extension not an image type) or 'candidate'."""
    rows = articles.select(key, base, F.posexplode(image_sources(F.col(content))).alias("pos", "src"))
    rows = rows.withColumn("url", normalize_url(absolute_url(F.col("src"), F.col(base))))
    ext = url_ext(F.col("url"))
    verdict = (F.when(~is_safe_public_url(F.col("url")), F.lit("failed"))
               .when((ext != "") & ~ext.isin(IMAGE_EXTS), F.lit("skipped"))
               .otherwise(F.lit("candidate")))
    return rows.withColumn("ext", ext).withColumn("verdict", verdict)


def image_gate(cands: DataFrame, assets: DataFrame, max_bytes: int = MAX_BYTES_DEFAULT) -> DataFrame:
    """I4: candidates become 'ok' if the asset exists, 0 < bytes <= cap and the MIME type
    is image/*; else 'failed'. Adds ``local_url`` for ok rows."""
    a = assets.select(F.col("url").alias("_aurl"), "bytes", "mime")
    j = cands.join(a, cands["url"] == a["_aurl"], "left")
    ok = F.col("_aurl").isNotNull() & (F.col("bytes") > 0) & (F.col("bytes") <= max_bytes) \
        & F.coalesce(F.col("mime").startswith("image/"), F.lit(False))
    verdict = F.when(F.col("verdict") != "candidate", F.col("verdict")).when(ok, F.lit("ok")).otherwise(F.lit("failed"))
    local = F.when(verdict == "ok", F.concat(F.lit("/uploads/"), F.md5("url"),
                                             F.when(F.col("ext") != "", F.concat(F.lit("."), F.col("ext")))
                                             .otherwise(F.lit(".jpg"))))
    return j.withColumn("verdict", verdict).withColumn("local_url", local).drop("_aurl", "bytes", "mime")


def image_cap(gated: DataFrame, max_images: int = 10, key: str = "article_id") -> DataFrame:
    """Sources are handled in order until ``max_images`` succeeded; later sources are not
    processed ('unprocessed': their number is what the cap cut). A cap of 0 skips every source; the
    settings form allows up to 50, the operator any number."""
    n = max(0, int(max_images))
    if n == 0:
        return gated.withColumn("status", F.lit("skipped")).withColumn("local_url", F.lit(None).cast("string"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ok_before = F.coalesce(F.sum(F.when(F.col("verdict") == "ok", 1).otherwise(0)).over(w), F.lit(0))
    status = F.when(ok_before >= n, F.lit("unprocessed")).when(F.col("verdict") == "ok", F.lit("downloaded")) \
        .otherwise(F.col("verdict"))
    out = gated.withColumn("status", status)
    return out.withColumn("local_url", F.when(F.col("status") == "downloaded", F.col("local_url")))


def image_alt(template, title, base_url) -> Column:
    """Alt text from the template (excerpt is empty here), tags stripped."""
    return strip_tags(render_template(template, title, F.lit(""), F.lit(""), base_url))


def fold_images(capped: DataFrame, key: str = "article_id") -> DataFrame:
    """I6+I8+I9 (per article): featured image (first download), the ordered list of
    (src -> local) replacements, and found/downloaded/failed/skipped counts."""
    return capped.groupBy(key).agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(F.col("status") == "downloaded").alias("downloaded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.min_by(F.col("local_url"), F.when(F.col("status") == "downloaded", F.col("pos"))).alias("featured_image"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "downloaded", F.struct("pos", "src", "local_url"))))
        .alias("replacements"))


def localize_content(content, replacements) -> Column:
    """I8: replace every occurrence of each downloaded source by its local URL, in order."""
    reps = F.coalesce(_c(replacements), F.array().cast("array<struct<pos:int,src:string,local_url:string>>"))
    return F.aggregate(reps, _c(content), lambda acc, r: F.replace(acc, r["src"], r["local_url"]))


def localize_images(articles: DataFrame, assets: DataFrame, max_images: int = 10, max_bytes: int = MAX_BYTES_DEFAULT,
                    key: str = "article_id", content: str = "content", base: str = "source_url") -> DataFrame:
    """I1–I9 end to end: articles gain ``content`` with local image URLs, featured image
    and image stats (``image_warning`` when any image failed)."""
    capped = image_cap(image_gate(image_candidates(articles, key, content, base), assets, max_bytes), max_images, key)
    folded = fold_images(capped, key)
    out = articles.join(folded, key, "left")
    return (out.withColumn(content, localize_content(F.col(content), F.col("replacements")))
            .withColumn("image_warning", F.coalesce(F.col("failed"), F.lit(0)) > 0)
            .drop("replacements"))


__all__ = ["image_sources", "image_candidates", "image_gate", "image_cap", "image_alt", "fold_images",
           "localize_content", "localize_images", "let"]
