"""Text and content scalars (C5–C22) as Catalyst expressions.

Only ``html_unescape`` (full HTML5 entity table) runs in Python, as an Arrow-batched
pandas UDF; ``unescape_basic`` covers the common named entities JVM-side.
"""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Characters removed by trimming (space, tab, LF, CR, NUL, VT).
TRIM_CHARS = " \t\n\r\x00\x0b"

# Entities decoded JVM-side, in application order ('&amp;' last so that
# '&amp;lt;' decodes once to '&lt;').
BASIC_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"),
    ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&"),
]

# Template placeholders.
TEMPLATE_KEYS = ["title", "excerpt", "site", "source"]

# SEO meta keys per family (title key, description key).
SEO_KEYS = {
    "rank_math": ("rank_math_title", "rank_math_description"),
    "yoast": ("_yoast_wpseo_title", "_yoast_wpseo_metadesc"),
    "aioseo": ("_aioseo_title", "_aioseo_description"),
}

# JSON source modes accepted by validation.
JSON_SOURCE_PATTERN = r"^(?:__NEXT_DATA__|next|ld\+json|json-ld|id:[A-Za-z0-9_:\-]+|var:[A-Za-z_$][A-Za-z0-9_$.]*)$"

# Free-form date formats tried in order after the epoch forms (ours; see README).
DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/M/d HH:mm:ss", "yyyy/M/d HH:mm", "yyyy/M/d", "yyyy.M.d",
    "d MMMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMM yyyy HH:mm:ss Z",
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_COL_CACHE: dict = {}


def cached_columns(key: str, build):
    """Build a fixed set of Column expressions once per Spark context and reuse them.
    Composite page expressions cost seconds of driver time to construct (thousands of
    JVM calls); the same expression over the same column names is reused by every run
    of a job in this process."""
    from pyspark import SparkContext

    k = (id(SparkContext._active_spark_context), key)
    if k not in _COL_CACHE:
        _COL_CACHE[k] = build()
    return _COL_CACHE[k]


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it (possibly many times) in ``body``: a lambda over
    a one-element array. Keeps expression trees linear instead of exponential, which keeps
    analysis time flat for deeply composed URL/marker/selector expressions."""
    return F.get(F.transform(F.array(value), body), 0)


def trim_set(col) -> Column:
    """Trim the PHP whitespace set from both ends (Spark ``trim`` only strips spaces)."""
    return F.btrim(_c(col), F.lit(TRIM_CHARS))


def unescape_basic(col) -> Column:
    """Entity decode for the common named/numeric entities, JVM-side."""
    out = _c(col)
    for ent, ch in BASIC_ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return F.when(_c(col).contains("&"), out).otherwise(_c(col))


@F.pandas_udf(T.StringType())
def _unescape_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _html.unescape(x) if isinstance(x, str) and "&" in x else x)


def html_unescape(col) -> Column:
    """Full HTML5 entity decode (Arrow-batched; Spark has no built-in). Texts without '&' stay
    in the JVM: the Python side gets a null for them."""
    c = _c(col)
    return F.coalesce(_unescape_udf(F.when(c.contains("&"), c)), c)


def strip_tags(col) -> Column:
    """Drop script/style elements with their bodies, comments, then all tags; trim.

    A '<' followed by whitespace is text, not a tag."""
    s = F.regexp_replace(_c(col), r"(?is)<script\b[^>]*>.*?</script\s*>", "")
    s = F.regexp_replace(s, r"(?is)<style\b[^>]*>.*?</style\s*>", "")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", "")
    s = F.regexp_replace(s, r"<[^\s>][^>]*>", "")
    return trim_set(s)


def collapse_ws(col) -> Column:
    """Every run of Unicode whitespace -> one space; trimmed."""
    return trim_set(F.regexp_replace(_c(col), r"(?U)\s+", " "))


def text_of(col) -> Column:
    """Strip tags then collapse whitespace (text mode of extraction)."""
    return collapse_ws(strip_tags(col))


# Tags kept by the publish filter (text of other tags is kept, tags dropped).
ALLOWED_TAGS = ["p", "br", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "strong", "b", "em", "i", "u",
                "a", "img", "blockquote", "pre", "code", "table", "thead", "tbody", "tfoot", "tr", "td", "th",
                "figure", "figcaption", "span", "div", "section", "article", "hr", "sub", "sup", "del", "ins",
                "caption", "video", "audio", "source", "picture"]


# Attributes that the publish filter keeps on every tag, and as tag.attribute on single ones; of
# those that hold addresses, only the ones that name no scheme or one of these.
ALLOWED_ATTRIBUTES = ["class", "id", "title", "lang", "dir"]
ALLOWED_ON_TAG = ["a.href", "a.rel", "a.target", "a.name", "img.src", "img.alt", "img.width", "img.height", "video.src", "video.poster",
                  "video.controls", "video.width", "video.height", "audio.src", "audio.controls", "source.src", "source.type",
                  "td.colspan", "td.rowspan", "th.colspan", "th.rowspan", "th.scope", "ol.start", "ol.type", "blockquote.cite",
                  "del.cite", "ins.cite"]
ADDRESS_ATTRIBUTES = ["href", "src", "poster", "cite"]
ALLOWED_SCHEMES = ["http", "https", "mailto", "tel"]

# A tag with its quoted values whole, text without '<', or a '<' that begins no whole tag.
TAG_TOKENS = r"""</?[A-Za-z](?:"[^"]*"|'[^']*'|[^'">])*>|[^<]+|<"""
ATTRIBUTE = r"""[A-Za-z_:][-A-Za-z0-9_:.]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""


def safe_address(value) -> Column:
    """Whether an attribute's address is relative or of an allowed scheme. Blanks and control
    characters do not hide a scheme, and what stands before the first '/', '?' or '#' may hold
    no entity, which could."""
    u = F.regexp_replace(value, r"[\x00-\x20\"']", "")
    head = F.regexp_extract(u, r"^[^/?#]*", 0)
    return u.rlike("(?i)^(?:" + "|".join(ALLOWED_SCHEMES) + "):") | ~head.rlike("[:&]")


def _kept_tag(tag: Column, tags: list[str]) -> Column:
    """A tag token with its allowed attributes, or nothing if the tag itself is not allowed."""
    name = F.lower(F.regexp_extract(tag, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))

    def attributes(n: Column) -> Column:
        found = F.regexp_extract_all(F.regexp_replace(tag, r"^<[A-Za-z][A-Za-z0-9]*", ""), F.lit(ATTRIBUTE), F.lit(0))

        def keep(x):
            a = F.lower(F.regexp_extract(x, r"^[^\s=]+", 0))
            known = a.isin(*ALLOWED_ATTRIBUTES) | F.concat(n, F.lit("."), a).isin(*ALLOWED_ON_TAG)
            return known & (~a.isin(*ADDRESS_ATTRIBUTES) | safe_address(F.regexp_extract(x, r"(?s)=\s*(.*)$", 1)))

        return F.concat(F.lit("<"), n, F.array_join(F.transform(F.filter(found, keep), lambda x: F.concat(F.lit(" "), x)), ""), F.lit(">"))

    return let(name, lambda n: F.when(~n.isin(*tags), F.lit("")).when(tag.startswith("</"), F.concat(F.lit("</"), n, F.lit(">")))
               .otherwise(attributes(n)))


def allow_html(col, tags: list[str] | None = None) -> Column:
    """The publish filter. Script and style elements go with their bodies, comments go, tags
    outside the allow-list go and their text stays; kept tags are written anew with their allowed
    attributes only, so event attributes, styles and script addresses never pass. A '<' that begins
    no whole tag becomes ``&lt;``."""
    tags = tags or ALLOWED_TAGS
    s = F.regexp_replace(_c(col), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", "")
    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(TAG_TOKENS), F.lit(0)), lambda x: F.when(x == "<", F.lit("&lt;"))
                                    .when(x.rlike("^</?[A-Za-z]"), _kept_tag(x, tags)).otherwise(x)), "")


def parse_pairs(text_col) -> Column:
    """Lines ``from=>to`` -> ARRAY<STRUCT<from,to>>; lines without '=>' or with an empty
    left side are skipped; both sides trimmed."""
    from pagemill.functions.urls import lines

    ls = F.filter(lines(F.coalesce(_c(text_col), F.lit(""))), lambda x: x.contains("=>"))
    pairs = F.transform(ls, lambda x: F.struct(
        trim_set(F.substring_index(x, "=>", 1)).alias("from"),
        trim_set(F.substring(x, F.instr(x, "=>") + 2, 1 << 30)).alias("to")))
    return F.filter(pairs, lambda p: p["from"] != "")


def apply_replacements(col, pairs) -> Column:
    """Ordered literal replacements, each on the previous result, case-sensitive."""
    return F.aggregate(F.coalesce(_c(pairs), F.array().cast("array<struct<from:string,to:string>>")),
                       _c(col), lambda acc, r: F.replace(acc, r["from"], r["to"]))


def excerpt(col, n) -> Column:
    """Strip tags, collapse whitespace, first n characters, n clamped to 50..500."""
    n = F.lit(n) if isinstance(n, int) else F.coalesce(_c(n), F.lit(160))
    n = F.least(F.greatest(n, F.lit(50)), F.lit(500))
    return F.call_function("substring", text_of(col), F.lit(1), n)


_PLACEHOLDER_SPLIT = r"(?=\{(?:title|excerpt|site|source)\})|(?<=\{(?:title|excerpt|site|source)\})"


def render_template(tpl, title, excerpt_, site, source) -> Column:
    """Replace {title} {excerpt} {site} {source} in one simultaneous pass (inserted
    text is never re-expanded); empty template -> '{title}'. The four values are computed
    once per row (bound outside the token lambda)."""
    t = F.when(F.coalesce(_c(tpl), F.lit("")) == "", F.lit("{title}")).otherwise(_c(tpl))
    vals = F.struct(F.coalesce(strip_tags(title), F.lit("")).alias("title"),
                    F.coalesce(strip_tags(excerpt_), F.lit("")).alias("excerpt"),
                    F.coalesce(_c(site), F.lit("")).alias("site"),
                    F.coalesce(trim_set(_c(source)), F.lit("")).alias("source"))

    def body(v):
        def tok(x):
            out = x
            for k in TEMPLATE_KEYS:
                out = F.when(x == "{" + k + "}", v[k]).otherwise(out)
            return out

        return F.array_join(F.transform(F.split(t, _PLACEHOLDER_SPLIT), tok), "")

    return let(vals, body)


def seo_fields(family, title, excerpt_, site, source, title_tpl, desc_tpl) -> dict[str, Column]:
    """C11: SEO meta keys/values of the rule's family; 'none'/unknown -> nulls."""
    fam = _c(family)
    t_tpl = F.when(F.coalesce(_c(title_tpl), F.lit("")) == "", F.lit("{title}")).otherwise(_c(title_tpl))
    d_tpl = F.when(F.coalesce(_c(desc_tpl), F.lit("")) == "", F.lit("{excerpt}")).otherwise(_c(desc_tpl))
    both = let(F.struct(_c(title).alias("t"), _c(excerpt_).alias("e")), lambda v: F.struct(
        render_template(t_tpl, v["t"], v["e"], site, source).alias("title"),
        render_template(d_tpl, v["t"], v["e"], site, source).alias("desc")))
    tk, dk = F.lit(None).cast("string"), F.lit(None).cast("string")
    for f, (a, b) in SEO_KEYS.items():
        tk = F.when(fam == f, F.lit(a)).otherwise(tk)
        dk = F.when(fam == f, F.lit(b)).otherwise(dk)
    return {"seo_title_key": tk, "seo_title": F.when(tk.isNotNull(), both["title"]),
            "seo_desc_key": dk, "seo_desc": F.when(dk.isNotNull(), both["desc"])}


def parse_category_rules(text_col) -> Column:
    """Lines ``keyword=>id`` -> ARRAY<STRUCT<keyword, category_id>> (id = |leading int|)."""
    pairs = parse_pairs(text_col)
    return F.transform(pairs, lambda p: F.struct(
        p["from"].alias("keyword"),
        F.abs(F.coalesce(F.regexp_extract(p["to"], r"^[+-]?[0-9]+", 0).try_cast("long"), F.lit(0))).alias("category_id")))


def match_category(context, cat_rules) -> Column:
    """Id of the first keyword line found (case-insensitive) with id > 0, else 0."""
    rules = F.coalesce(_c(cat_rules), F.array().cast("array<struct<keyword:string,category_id:bigint>>"))

    def body(ctx):
        hit = F.filter(rules, lambda r: (r["keyword"] != "") & (F.instr(ctx, F.lower(r["keyword"])) > 0)
                       & (r["category_id"] > 0))
        return F.coalesce(F.get(hit, 0)["category_id"], F.lit(0).cast("long"))

    return let(F.lower(_c(context)), body)


def auto_tags(context, keywords) -> Column:
    """Keywords (listed order) that occur case-insensitively; distinct."""
    kws = F.coalesce(_c(keywords), F.array().cast("array<string>"))
    return let(F.lower(_c(context)),
               lambda ctx: F.array_distinct(F.filter(kws, lambda k: (k != "") & (F.instr(ctx, F.lower(k)) > 0))))


def fixed_tags(col) -> Column:
    """C14: comma list, trimmed, empty dropped, distinct ('0' is kept)."""
    parts = F.transform(F.split(F.coalesce(_c(col), F.lit("")), ","), lambda x: trim_set(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def article_tags(fixed, auto, auto_enabled) -> Column:
    """Fixed tags then auto tags (when enabled), distinct."""
    a = F.when(F.coalesce(_c(auto_enabled), F.lit(False)), _c(auto)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.coalesce(_c(fixed), F.array().cast("array<string>")), a))


def article_category(matched, default) -> Column:
    """Matched category, else the rule default, else null."""
    return F.coalesce(F.nullif(_c(matched), F.lit(0)), F.nullif(_c(default), F.lit(0)))


def coerce_date(col, as_of: Column | None = None) -> Column:
    """C17: 13 digits = epoch ms, 10 digits = epoch s, else the declared formats, else the free forms
    of ``functions.dates`` (relative ones if ``as_of`` is given); else null."""
    from pagemill.functions.dates import free_date

    s = trim_set(F.coalesce(_c(col), F.lit("")))
    parsed = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in DATE_FORMATS])
    return (F.when(s.rlike(r"^[0-9]{13}$"), F.timestamp_seconds(F.floor(s.cast("long") / 1000)))
            .when(s.rlike(r"^[0-9]{10}$"), F.timestamp_seconds(s.cast("long")))
            .when(s == "", F.lit(None))
            .otherwise(F.coalesce(parsed.cast("timestamp_ntz"), free_date(s, as_of))).cast("timestamp_ntz"))


def article_status(status, scheduled_at) -> Column:
    """Unknown status -> draft; 'future' without a scheduled date -> draft."""
    st = F.when(_c(status).isin(*["draft", "publish", "future", "pending", "private"]), _c(status)).otherwise(F.lit("draft"))
    return F.when((st == "future") & _c(scheduled_at).isNull(), F.lit("draft")).otherwise(st)


def schedule_delay_minutes(key, dmin, dmax, seed: int = 17) -> Column:
    """Reproducible pseudo-random delay in [min, max] minutes (min >= 0, max >= min),
    from the MD5 of seed and key, so that any SQL engine gives the same minutes."""
    lo = F.greatest(F.lit(0), F.coalesce(_c(dmin), F.lit(0)))
    hi = F.greatest(lo, F.coalesce(_c(dmax), lo))
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), _c(key))), 1, 15), 16, 10).cast("long")
    r = F.pmod(number, (hi - lo + 1).cast("long"))
    return F.when(hi > lo, r + lo).otherwise(lo).cast("int")


# What a redacted excerpt masks.
REDACT_KEY = r"sk-[A-Za-z0-9_\-]{12,}"
REDACT_BEARER = r"(?i)Bearer\s+[A-Za-z0-9._\-]+"


def redact_excerpt(col, n: int = 300) -> Column:
    """Strip tags, mask 'sk-…' keys and 'Bearer …' tokens, collapse, cut to >= 80."""
    s = strip_tags(col)
    s = F.regexp_replace(s, REDACT_KEY, "sk-***")
    s = F.regexp_replace(s, REDACT_BEARER, "Bearer ***")
    return F.substring(collapse_ws(s), 1, max(80, int(n)))


def sanitize_marker(col) -> Column:
    """Remove NUL, CRLF/CR -> LF, trim, at most 20000 characters."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(_c(col), F.lit("")), "\x00", ""), r"\r\n|\r", "\n")
    return F.substring(trim_set(s), 1, 20000)


def sanitize_json_source(col) -> Column:
    """Trimmed, cut to 100 chars; empty or not a known mode -> '__NEXT_DATA__'."""
    s = F.substring(trim_set(F.coalesce(_c(col), F.lit(""))), 1, 100)
    return F.when(s.rlike(JSON_SOURCE_PATTERN), s).otherwise(F.lit("__NEXT_DATA__"))
