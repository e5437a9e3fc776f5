"""Content cleaning (C1–C4) in one Arrow pass per batch of articles.

Steps, in order, on the element tree of the content (``shred_html``):
  C1  remove every element matching a selector; script, style, noscript always;
  C2  unwrap links: every <a> loses its tags, its children stay (mode ``external``: only
      links whose address names another host than the page);
  C3  remove p, then div, then section elements whose current text contains a keyword
      (case-insensitive), innermost first;
  C4  remove p, then div elements without text and without an <img>, innermost first.
The wrapper around the content is never removed (the content's top level is kept).
Output is cut from the source: removed subtrees and unwrapped tags are dropped, every
other byte is kept as written (no re-serialisation).

The per-article work is a small helper over one string; Spark distributes the rows and
the Arrow batches carry the content and the rule's ``clean`` struct.
"""

from __future__ import annotations

import re
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from pagemill.operators.selectors import compile_selector
from pagemill.operators.shred import shred_html

# Always removed.
ALWAYS_REMOVE = ["script", "style", "noscript"]

_SEL_CACHE: dict[str, tuple] = {}


def _compiled(sel: str):
    c = _SEL_CACHE.get(sel)
    if c is None:
        s = compile_selector(sel)
        c = (re.compile(s.regex) if s.supported else None, s.attr_eq, s.attr_has, s.nth)
        _SEL_CACHE[sel] = c
    return c


def _matches(nodes, sel: str) -> list[int]:
    rx, eq, has, nth = _compiled(sel)
    if rx is None:
        return []
    out = [n["pre"] for n in nodes
           if rx.search(n["path"]) and all(n["attrs"].get(k) == v for k, v in eq)
           and all(v in (n["attrs"].get(k) or "") for k, v in has)]
    if nth:
        out = out[nth - 1:nth]
    return out


def _external(href: str | None, base_url: str | None) -> bool:
    """Whether an address names a host, and another one than its page."""
    try:
        host = urlsplit((href or "").strip()).hostname
        own = urlsplit(base_url or "").hostname
    except ValueError:
        return False
    return bool(host) and host != own


def clean_html(content: str | None, remove_selectors=None, unwrap_links: bool = False, drop_keywords=None,
               drop_empty: bool = True, unwrap_mode: str = "all", base_url: str | None = None) -> str:
    """C1–C4 on one content string (see module doc)."""
    if not content:
        return "" if content is None else content
    text, nodes = shred_html(content)
    removed = [False] * len(nodes)

    def remove(i: int):
        for k in range(i, nodes[i]["last"] + 1):
            removed[k] = True

    def current_text(i: int) -> str:
        n = nodes[i]
        parts, pos = [], n["text_start"]
        k = i + 1
        while k <= n["last"]:
            if removed[k]:
                d = nodes[k]
                if d["text_start"] > pos:
                    parts.append(text[pos:d["text_start"]])
                pos = max(pos, d["text_end"])
                k = d["last"] + 1
            else:
                k += 1
        if n["text_end"] > pos:
            parts.append(text[pos:n["text_end"]])
        return "".join(parts)

    # C1
    for sel in ALWAYS_REMOVE + [s.strip() for s in (remove_selectors or []) if s and s.strip()]:
        for i in reversed(_matches(nodes, sel)):
            if not removed[i]:
                remove(i)
    # C2
    unwrap: list[tuple[int, int]] = []
    if unwrap_links:
        for n in nodes:
            if n["tag"] == "a" and not removed[n["pre"]] and (unwrap_mode != "external" or _external(n["attrs"].get("href"), base_url)):
                unwrap.append((n["src_start"], n["inner_start"]))
                if n["inner_end"] < n["src_end"]:
                    unwrap.append((n["inner_end"], n["src_end"]))
    # C3
    kws = [k.strip().lower() for k in (drop_keywords or []) if k and k.strip()]
    if kws:
        for tag in ("p", "div", "section"):
            for n in reversed(nodes):
                i = n["pre"]
                if n["tag"] == tag and not removed[i]:
                    t = current_text(i).strip(" \t\n\r\x00\x0b").lower()
                    if any(k in t for k in kws):
                        remove(i)
    # C4 (removed blocks hold no live <img>, so one prefix count of live images taken
    # here stays valid for every test below: O(1) per block instead of a subtree scan)
    if drop_empty:
        live_img = [0] * (len(nodes) + 1)
        for k, n in enumerate(nodes):
            live_img[k + 1] = live_img[k] + (1 if n["tag"] == "img" and not removed[k] else 0)
        for tag in ("p", "div"):
            for n in reversed(nodes):
                i = n["pre"]
                if n["tag"] == tag and not removed[i]:
                    if live_img[n["last"] + 1] - live_img[i + 1] == 0 and \
                            current_text(i).strip(" \t\n\r\x00\x0b") == "":
                        remove(i)
    # cut
    cuts = [(nodes[i]["src_start"], nodes[i]["src_end"]) for i in range(len(nodes))
            if removed[i] and (nodes[i]["parent"] < 0 or not removed[nodes[i]["parent"]])]
    cuts += unwrap
    if not cuts:
        return content.strip(" \t\n\r\x00\x0b")
    cuts.sort()
    out, pos = [], 0
    for a, b in cuts:
        if a > pos:
            out.append(content[pos:a])
        pos = max(pos, b)
    out.append(content[pos:])
    return "".join(out).strip(" \t\n\r\x00\x0b")


def _clean_batches(batches, content_col: str, clean_col: str, out_col: str, base_col: str | None):
    from pagemill.operators.shred import _slices

    for batch in _slices(batches):
        contents = batch.column(batch.schema.get_field_index(content_col)).to_pylist()
        cfgs = batch.column(batch.schema.get_field_index(clean_col)).to_pylist()
        bases = batch.column(batch.schema.get_field_index(base_col)).to_pylist() if base_col else [None] * len(contents)
        res = []
        for c, cfg, base in zip(contents, cfgs, bases):
            cfg = cfg or {}
            res.append(clean_html(c, cfg.get("remove_selectors"), bool(cfg.get("unwrap_links")),
                                  cfg.get("drop_keywords"), cfg.get("drop_empty") is not False,
                                  cfg.get("unwrap_mode") or "all", base))
        yield pa.RecordBatch.from_arrays(list(batch.columns) + [pa.array(res, pa.string())],
                                         names=list(batch.schema.names) + [out_col])


def clean_content(df: DataFrame, content_col: str = "content", clean_col: str = "clean",
                  out_col: str = "clean_content", base_col: str | None = None) -> DataFrame:
    """Add ``out_col`` = C1–C4 applied to ``content_col`` with the row's ``clean_col``
    struct (remove_selectors, unwrap_links, drop_keywords, drop_empty and optionally
    unwrap_mode, which reads the page's address from ``base_col``). Narrow."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out_col, T.StringType())])
    return df.mapInArrow(lambda it: _clean_batches(it, content_col, clean_col, out_col, base_col), schema)


__all__ = ["clean_html", "clean_content", "ALWAYS_REMOVE"]
