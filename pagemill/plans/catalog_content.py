"""Registered queries on article content: images (I1–I9) and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.fixtures import Tables
from pagemill.operators import images as I
from pagemill.operators import extract as X
from pagemill.operators.selectors import sel_literal
from pagemill.operators.shred import shred
from pagemill.plans import duck as D
from pagemill.plans.registry import register

W = D.WS


def _img_articles(t: Tables):
    """Articles of the image fixture: page id, page URL as base, article inner HTML."""
    return shred(t.f_pages_img).select(F.col("page_id").alias("article_id"), F.col("url").alias("source_url"),
                                       X.select_html(sel_literal("//article")).alias("content"))


def _attr_sql(tag: str, name: str) -> str:
    return f"regexp_extract({tag}, '(?i)\\s{name}=[\"'']([^\"'']+)[\"'']', 1)"


_SOURCES_SQL = f"""c AS (SELECT page_id AS article_id, url AS source_url, {D.trim_set("regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1)")} AS content FROM f_pages_img),
tg AS (SELECT article_id, source_url, unnest(tags) AS tag, unnest(range(len(tags))) AS ti FROM (SELECT article_id, source_url, regexp_extract_all(content, '(?i)<img\\b[^>]*>') AS tags FROM c)),
pr AS (SELECT article_id, source_url, ti * 1000 AS i, coalesce({', '.join(f"nullif({D.trim_set(_attr_sql('tag', a))}, '')" for a in I.SRC_ATTRS)}) AS src FROM tg),
sp AS (SELECT article_id, source_url, ti, unnest(string_split({_attr_sql('tag', 'srcset')}, ',')) AS part, unnest(range(len(string_split({_attr_sql('tag', 'srcset')}, ',')))) AS k FROM tg),
ss AS (SELECT article_id, source_url, ti * 1000 + 1 + k AS i, {D.trim_set(f"regexp_split_to_array({D.trim_set('part')}, '\\s+')[1]")} AS src FROM sp),
bgl AS (SELECT article_id, source_url, regexp_extract_all(content, '(?i)background(?:-image)?\\s*:\\s*url\\(([^)]+)\\)', 1) AS l FROM c),
bg AS (SELECT article_id, source_url, 1000000 + unnest(range(len(l))) AS i, trim(unnest(l), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || '"' || '''') AS src FROM bgl),
al AS (SELECT * FROM pr UNION ALL SELECT * FROM ss UNION ALL SELECT * FROM bg),
fi AS (SELECT article_id, source_url, src, min(i) AS i FROM al WHERE src IS NOT NULL AND src <> '' GROUP BY article_id, source_url, src),
srcs AS (SELECT article_id, source_url, src, CAST(row_number() OVER (PARTITION BY article_id ORDER BY i) - 1 AS INTEGER) AS pos FROM fi)"""


@register("image_sources", f"WITH {_SOURCES_SQL}\nSELECT article_id, pos, src FROM srcs", ("f_pages_img",))
def q_image_sources(t: Tables):
    """Image sources of every article (lazy attributes, srcset, CSS backgrounds)."""
    a = _img_articles(t)
    return a.select("article_id", F.posexplode(I.image_sources(F.col("content"))).alias("pos", "src"))


_CANDS_SQL = f"""{_SOURCES_SQL},
cu AS (SELECT article_id, pos, src, {D.normalize_url(D.absolute_url('src', 'source_url'))} AS url FROM srcs),
ce AS (SELECT *, lower(regexp_extract({D.url_part('url', 3)}, '\\.([^./]+)$', 1)) AS ext FROM cu),
cands AS (SELECT article_id, pos, src, url, ext, CASE WHEN NOT {D.is_safe_url('url')} THEN 'failed'
     WHEN ext <> '' AND ext NOT IN ({', '.join(D.q(e) for e in I.IMAGE_EXTS)}) THEN 'skipped' ELSE 'candidate' END AS verdict FROM ce)"""


@register("image_candidates", f"WITH {_CANDS_SQL}\nSELECT article_id, pos, url, verdict FROM cands", ("f_pages_img",))
def q_image_candidates(t: Tables):
    """I2+I3: resolved image URLs with the safety and extension verdicts."""
    return I.image_candidates(_img_articles(t)).select("article_id", "pos", "url", "verdict")


def _cands(t: Tables):
    """Image candidates of the fixture, extracted once (the asset table is derived from
    them, so they are read twice)."""
    from pagemill.session import cut_lineage
    return cut_lineage(I.image_candidates(_img_articles(t)))


def _assets(cands):
    """Asset table standing in for downloads, derived from the candidate URLs: one URL
    pattern is missing, one is oversized, PNGs carry a non-image MIME type."""
    u = cands.where(F.col("verdict") == "candidate").select("url", "ext").distinct()
    u = u.where(~F.col("url").contains("/b.webp"))
    return u.select("url", F.when(F.col("url").contains("/bg/3"), F.lit(6000000)).otherwise(1000 + F.length("url") * 10)
                    .cast("long").alias("bytes"),
                    F.when(F.col("ext") == "png", F.lit("text/plain"))
                    .otherwise(F.concat(F.lit("image/"), F.coalesce(F.nullif(F.col("ext"), F.lit("")), F.lit("jpeg")))).alias("mime"))


_ASSETS_SQL = f"""assets AS (SELECT url, CAST(CASE WHEN contains(url, '/bg/3') THEN 6000000 ELSE 1000 + length(url) * 10 END AS BIGINT) AS bytes,
   CASE WHEN ext = 'png' THEN 'text/plain' ELSE 'image/' || coalesce(nullif(ext, ''), 'jpeg') END AS mime
   FROM (SELECT DISTINCT url, ext FROM cands WHERE verdict = 'candidate') WHERE NOT contains(url, '/b.webp')),
gated AS (SELECT c.*, CASE WHEN c.verdict <> 'candidate' THEN c.verdict
   WHEN a.url IS NOT NULL AND a.bytes > 0 AND a.bytes <= {I.MAX_BYTES_DEFAULT} AND starts_with(a.mime, 'image/') THEN 'ok' ELSE 'failed' END AS v2
   FROM cands c LEFT JOIN assets a ON c.url = a.url)"""


@register("image_gate", f"WITH {_CANDS_SQL},\n{_ASSETS_SQL}\nSELECT article_id, pos, url, v2 AS verdict FROM gated", ("f_pages_img",))
def q_image_gate(t: Tables):
    """I4: asset gate (exists, size within the cap, image MIME type)."""
    c = _cands(t)
    return I.image_gate(c, _assets(c)).select("article_id", "pos", "url", "verdict")


_CAP_SQL = f"""capd AS (SELECT *, CASE WHEN coalesce(sum(CASE WHEN v2 = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY article_id ORDER BY pos
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 2 THEN 'unprocessed' WHEN v2 = 'ok' THEN 'downloaded' ELSE v2 END AS status
   FROM gated)"""


@register("image_cap", f"WITH {_CANDS_SQL},\n{_ASSETS_SQL},\n{_CAP_SQL}\nSELECT article_id, pos, status FROM capd", ("f_pages_img",))
def q_image_cap(t: Tables):
    """At most 2 successful images per article; later sources are not processed."""
    c = _cands(t)
    return I.image_cap(I.image_gate(c, _assets(c)), 2).select("article_id", "pos", "status")


@register("image_cap_zero", f"WITH {_CANDS_SQL}\nSELECT article_id, pos, 'skipped' AS status FROM cands", ("f_pages_img",))
def q_image_cap_zero(t: Tables):
    """A cap of 0 skips every source."""
    c = _cands(t)
    return I.image_cap(I.image_gate(c, _assets(c)), 0).select("article_id", "pos", "status")


@register("image_stats", f"""WITH {_CANDS_SQL},\n{_ASSETS_SQL},\n{_CAP_SQL}
SELECT article_id, count(*) AS found, count_if(status = 'downloaded') AS downloaded, count_if(status = 'failed') AS failed,
  count_if(status = 'skipped') AS skipped,
  arg_min(CASE WHEN status = 'downloaded' THEN '/uploads/' || md5(url) || CASE WHEN ext <> '' THEN '.' || ext ELSE '.jpg' END END,
          CASE WHEN status = 'downloaded' THEN pos END) AS featured_image
FROM capd GROUP BY article_id""", ("f_pages_img",))
def q_image_stats(t: Tables):
    """I6+I9: per article found/downloaded/failed/skipped and the featured image."""
    c = _cands(t)
    f = I.fold_images(I.image_cap(I.image_gate(c, _assets(c)), 2))
    return f.select("article_id", "found", "downloaded", "failed", "skipped", "featured_image")


@register("localize_content", f"""WITH {_CANDS_SQL},\n{_ASSETS_SQL},\n{_CAP_SQL},
r AS (SELECT article_id, list(struct_pack(pos := pos, src := src, loc := '/uploads/' || md5(url) || CASE WHEN ext <> '' THEN '.' || ext ELSE '.jpg' END) ORDER BY pos) AS reps
      FROM capd WHERE status = 'downloaded' GROUP BY article_id)
SELECT c.article_id, list_reduce(list_prepend(struct_pack(pos := -1, src := '', loc := c.content), coalesce(r.reps, [])),
   lambda acc, x: struct_pack(pos := x.pos, src := '', loc := replace(acc.loc, x.src, x.loc))).loc AS content
FROM c LEFT JOIN r ON c.article_id = r.article_id""", ("f_pages_img",))
def q_localize_content(t: Tables):
    """I8: content with each downloaded source replaced by its local URL."""
    a = _img_articles(t)
    c = I.image_candidates(a)
    out = I.localize_images(a, _assets(c), 2)
    return out.select("article_id", "content")


@register("image_alt", f"""SELECT page_id AS article_id,
  {D.strip_tags("replace(replace('Photo: {title} ({source})', '{title}', " + D.strip_tags(D.unescape(D.strip_tags("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)"))) + "), '{source}', '')")} AS alt
FROM f_pages_img""", ("f_pages_img",))
def q_image_alt(t: Tables):
    """Alt text rendered from a template with the article title."""
    sh = shred(t.f_pages_img)
    title = X.select_text(sel_literal("h1"))
    return sh.select(F.col("page_id").alias("article_id"), I.image_alt(F.lit("Photo: {title} ({source})"), title, F.lit(""))
                     .alias("alt"))


def _clean_cfg():
    k = F.col("article_id") % 3
    s = lambda sels, unwrap, kws, empty: F.struct(
        F.array(*[F.lit(x) for x in sels]).cast("array<string>").alias("remove_selectors"), F.lit(unwrap).alias("unwrap_links"),
        F.array(*[F.lit(x) for x in kws]).cast("array<string>").alias("drop_keywords"), F.lit(empty).alias("drop_empty"))
    return (F.when(k == 0, s(["section"], True, [], True)).when(k == 1, s([], False, ["SHARE this"], False))
            .otherwise(s([], False, [], False)))


_ARTICLE_SQL = D.trim_set("regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1)")
_BG_DIV = "<div style=\"background-image:url\\(''/bg/[0-9]+\\.jpeg''\\)\"></div>"


_LEAD = '<p><a href="/r/1">lead</a> tail</p>'     # a link to unwrap before every article


@register("clean_html", f"""SELECT page_id AS article_id, CASE page_id % 3
  WHEN 0 THEN {D.trim_set(f"'<p>lead tail</p>' || replace(replace(regexp_replace({_ARTICLE_SQL}, '{_BG_DIV}', '', 'g'), '<p> </p>', ''), '<section>share this</section>', '')")}
  WHEN 1 THEN {D.trim_set(f"{D.q(_LEAD)} || replace({_ARTICLE_SQL}, '<section>share this</section>', '')")}
  ELSE {D.q(_LEAD)} || {_ARTICLE_SQL} END AS clean_content
FROM f_pages_img""", ("f_pages_img",))
def q_clean_html(t: Tables):
    """Remove by selector, unwrap links, drop keyword blocks, drop empty blocks."""
    from pagemill.operators.clean import clean_content
    a = _img_articles(t).withColumn("clean", _clean_cfg()).withColumn("content", F.concat(F.lit(_LEAD), "content"))
    return clean_content(a, "content", "clean").select("article_id", "clean_content")
