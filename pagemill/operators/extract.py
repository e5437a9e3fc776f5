"""Selection and extraction over shredded pages.

Every function returns a Column evaluated on one shredded page row (``html``,
``page_text``, ``nodes``) together with that row's rule columns — narrow work with no
shuffle. Marker slices restrict selection to elements inside the slice's source range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagemill.functions import jsonpage as J
from pagemill.functions.markers import let, normalize_marker, slice_between, slice_bounds
from pagemill.functions.text import collapse_ws, text_of, trim_set
from pagemill.functions.urls import absolute_url, is_safe_public_url, normalize_url
from pagemill.operators.selectors import match_nodes
from pagemill.operators.shred import node_inner_html, node_outer_html, node_text

_ANCHOR_RE = r"""(?is)<a\b[^>]*\shref\s*=\s*(["'])(.*?)\1"""


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_links(raw: Column, base) -> Column:
    """Absolutise each raw link against ``base``, keep safe public URLs, normalise, and
    de-duplicate keeping first occurrences."""
    absd = F.transform(raw, lambda x: absolute_url(x, _c(base)))
    safe = F.filter(absd, lambda x: is_safe_public_url(x))
    return F.array_distinct(F.transform(safe, lambda x: normalize_url(x)))


def _matches(sel, before=None, after=None) -> Column:
    """Matches of ``sel``; with markers, only elements inside the marker slice (a failed
    slice selects nothing; two empty markers mean the whole page)."""
    if before is None and after is None:
        return match_nodes("nodes", sel)
    b = normalize_marker(before if before is not None else F.lit(""))
    a = normalize_marker(after if after is not None else F.lit(""))
    bounds = slice_bounds("html", before if before is not None else F.lit(""), after if after is not None else F.lit(""))

    def inside(sb):
        return match_nodes("nodes", sel, within=(F.when(sb["ok"], sb["start"]).otherwise(F.lit(1 << 30)),
                                                 F.when(sb["ok"], sb["end"]).otherwise(F.lit(-1))))

    return F.when((b == "") & (a == ""), match_nodes("nodes", sel)).otherwise(let(bounds, inside))


def select_text(sel, before=None, after=None) -> Column:
    """Text of the first match, whitespace collapsed and trimmed; '' if none."""
    return let(F.get(_matches(sel, before, after), 0),
               lambda m: F.when(m.isNotNull(), collapse_ws(node_text(m))).otherwise(F.lit("")))


def select_html(sel, before=None, after=None) -> Column:
    """Inner HTML of the first match (source slice); the element itself if empty."""
    def body(m):
        inner = trim_set(node_inner_html(m))
        return F.when(m.isNull(), F.lit("")).when(inner != "", inner).otherwise(trim_set(node_outer_html(m)))

    return let(F.get(_matches(sel, before, after), 0), body)


def selector_count(sel, before=None, after=None) -> Column:
    """Number of matching elements."""
    return F.size(_matches(sel, before, after))


def outer_sample(sel, n: int = 1500, before=None, after=None) -> Column:
    """Outer HTML of the first match, cut to max(200, n) characters."""
    return let(F.get(_matches(sel, before, after), 0), lambda m: F.when(m.isNull(), F.lit("")).otherwise(
        F.substring(trim_set(node_outer_html(m)), 1, max(200, int(n)))))


def select_links(sel, base, before=None, after=None) -> Column:
    """Per matched element, its href if it is an <a>, else the first descendant <a>'s
    href; absolutised, safe, normalised, de-duplicated in order."""
    ms = _matches(sel, before, after)

    def href_of(m):
        own = F.when(m["tag"] == "a", F.coalesce(m["attrs"]["href"], F.lit("")))
        desc = F.get(F.filter("nodes", lambda a: (a["tag"] == "a") & (a["pre"] > m["pre"]) & (a["pre"] <= m["last"])), 0)
        return F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(F.coalesce(desc["attrs"]["href"], F.lit("")))

    raw = F.filter(F.transform(ms, href_of), lambda x: x != "")
    return clean_links(raw, base)


def anchor_links(html, base) -> Column:
    """Quoted href of every <a> in ``html`` (regex over the source), cleaned."""
    raw = F.regexp_extract_all(_c(html), F.lit(_ANCHOR_RE), F.lit(2))
    return clean_links(raw, base)


def json_links(json_text, path, url_field, base) -> Column:
    """Links from page JSON, cleaned like every other link list."""
    raw = J.json_link_values(json_text, path, url_field)
    return F.when(trim_set(F.coalesce(_c(path), F.lit(""))) == "", F.array().cast("array<string>")) \
        .otherwise(clean_links(F.coalesce(raw, F.array().cast("array<string>")), base))


def _discover_links(base, json_text, link) -> Column:
    """X11: JSON links if any; else within the marker slice: the selector's links if a
    selector is set, else all anchors of the slice.

    ``link`` is the rule's link struct (selector, before, after, json_path,
    json_url_field) plus ``sel`` (its compiled selector)."""
    has_sel = trim_set(F.coalesce(link["selector"], F.lit(""))) != ""

    def body(jl):
        by_sel = select_links(link["sel"], base, link["before"], link["after"])
        by_anchor = anchor_links(slice_between("html", link["before"], link["after"]), base)
        return F.when(F.size(jl) > 0, jl).when(has_sel, by_sel).otherwise(by_anchor)

    return let(json_links(json_text, link["json_path"], link["json_url_field"], base), body)


def _link_match_count(json_text, link) -> Column:
    """X15 (links): same precedence, counting instead of listing."""
    has_sel = trim_set(F.coalesce(link["selector"], F.lit(""))) != ""
    n_json = F.size(json_links(json_text, link["json_path"], link["json_url_field"], F.lit("https://example.com/")))

    def body(nj):
        sliced = slice_between("html", link["before"], link["after"])
        return (F.when(nj > 0, nj)
                .when(has_sel, selector_count(link["sel"], link["before"], link["after"]))
                .otherwise(F.size(anchor_links(sliced, F.lit("https://example.com/"))))).cast("int")

    return let(n_json, body)


def _extract_field(json_text, slot, text_only: bool) -> Column:
    """JSON value if non-empty; else within the marker slice the selector's first
    match (text or inner HTML); without a selector the whole slice (text mode strips
    tags and collapses whitespace).

    ``slot`` is the rule's field struct (selector, before, after, json_path) plus ``sel``."""
    jv = F.when(trim_set(F.coalesce(slot["json_path"], F.lit(""))) == "", F.lit("")) \
        .otherwise(J.json_field(json_text, slot["json_path"], text_only))
    has_sel = trim_set(F.coalesce(slot["selector"], F.lit(""))) != ""

    def body(v):
        picked = select_text(slot["sel"], slot["before"], slot["after"]) if text_only else \
            select_html(slot["sel"], slot["before"], slot["after"])
        sliced = slice_between("html", slot["before"], slot["after"])
        whole = text_of(sliced) if text_only else trim_set(sliced)
        return F.when(v != "", v).when(has_sel, picked).otherwise(whole)

    return let(jv, body)


def _field_match_count(json_text, slot) -> Column:
    """X15 (fields): JSON count, else selector count in the slice, else 1 if the slice
    has text."""
    jc = F.when(trim_set(F.coalesce(slot["json_path"], F.lit(""))) == "", F.lit(0)) \
        .otherwise(J.json_match_count(json_text, slot["json_path"]))
    has_sel = trim_set(F.coalesce(slot["selector"], F.lit(""))) != ""

    def body(c):
        sliced = slice_between("html", slot["before"], slot["after"])
        return (F.when(c > 0, c)
                .when(has_sel, selector_count(slot["sel"], slot["before"], slot["after"]))
                .otherwise(F.when(trim_set(F.regexp_replace(sliced, r"<[^\s>][^>]*>", "")) == "", 0).otherwise(1))).cast("int")

    return let(jc, body)


def discover_links(base, json_text, link) -> Column:
    """X11 (see ``_discover_links``); the rule struct and page JSON are bound once."""
    return let(F.struct(link.alias("l"), _c(json_text).alias("j")), lambda b: _discover_links(base, b["j"], b["l"]))


def link_match_count(json_text, link) -> Column:
    """X15 links (see ``_link_match_count``)."""
    return let(F.struct(link.alias("l"), _c(json_text).alias("j")), lambda b: _link_match_count(b["j"], b["l"]))


def extract_field(json_text, slot, text_only: bool) -> Column:
    """X12 (see ``_extract_field``); the rule's field struct and page JSON are bound once."""
    return let(F.struct(slot.alias("s"), _c(json_text).alias("j")), lambda b: _extract_field(b["j"], b["s"], text_only))


def field_match_count(json_text, slot) -> Column:
    """X15 fields (see ``_field_match_count``)."""
    return let(F.struct(slot.alias("s"), _c(json_text).alias("j")), lambda b: _field_match_count(b["j"], b["s"]))


def date_wanted(slot) -> Column:
    """A date is extracted only if its selector, markers or JSON path is set."""
    return (F.coalesce(slot["json_path"], F.lit("")) != "") | (F.coalesce(slot["selector"], F.lit("")) != "") \
        | (F.coalesce(slot["before"], F.lit("")) != "") | (F.coalesce(slot["after"], F.lit("")) != "")


def extract_articles(df: DataFrame, json_col: str = "page_json") -> DataFrame:
    """X12–X14 over shredded pages joined to their rule: adds title, content, date and
    ``extract_error`` (non-null -> the item fails with that reason)."""
    from pagemill.functions.text import cached_columns

    title, content, date = cached_columns("extract_articles:" + json_col, lambda: (
        extract_field(F.col(json_col), F.col("title"), True),
        extract_field(F.col(json_col), F.col("content"), False),
        F.when(date_wanted(F.col("date")), extract_field(F.col(json_col), F.col("date"), True)).otherwise(F.lit(""))))
    out = df.withColumn("x_title", title).withColumn("x_content", content).withColumn("x_date", date)
    return out.withColumn("extract_error", F.when((F.col("x_title") == "") | (F.col("x_content") == ""),
                                                  F.lit("title or content extraction failed")))


__all__ = ["select_text", "select_html", "selector_count", "outer_sample", "select_links", "anchor_links",
           "json_links", "discover_links", "link_match_count", "extract_field", "field_match_count",
           "date_wanted", "extract_articles", "clean_links"]
