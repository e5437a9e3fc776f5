"""X3 page shred: HTML -> element table, once per page, in one Arrow pass.

Each page row gains
  page_text  the decoded text of the page (text nodes in document order)
  nodes      ARRAY<STRUCT<...>> of its elements in document order (pre-order)

so every later selector, text or HTML lookup is a higher-order ``filter`` over the page's
own array plus ``substring`` on the page's own strings: narrow, no shuffle, no join.
``explode_nodes`` gives the flat ``nodes`` table when one is wanted.

Element fields: pre (document order), last (pre of the last descendant), depth, parent,
tag, id, classes, attrs, nth (1-based index among same-tag siblings), path (encoded
ancestor-or-self chain, see ``selectors``), offsets into ``html`` (src_start, inner_start,
inner_end, src_end; 0-based, end exclusive) and into ``page_text`` (text_start, text_end).

Tree repair (fixed rule list; the corpus has unclosed ``<b>``/``<p>``):
  * void elements never have children; ``<x/>`` is empty;
  * a block start tag closes an open ``p`` (up to a table/button boundary);
    ``li`` closes an open ``li``, ``dt/dd`` close ``dt/dd``, ``td/th`` close ``td/th``,
    ``tr`` closes ``tr``, ``option`` closes ``option``; a table section closes the section,
    row and cell before it, a heading a heading, ``a`` an ``a`` and ``optgroup`` an
    ``optgroup`` that is the innermost open element;
  * an end tag closes every element above its nearest open match, but none of a higher rank
    than its own: ``</b>`` ends no ``div``, ``</div>`` no table cell. An end tag without such
    a match is ignored; elements still open at the end close at the end of the document.
script/style bodies are raw text (never tokenised), as in the stdlib parser.
"""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Void elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Start tags that close an open <p>.
CLOSES_P = frozenset(("address article aside blockquote details dialog div dl fieldset figcaption figure footer "
                      "form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul").split())
P_SCOPE = frozenset("table td th caption button html object template marquee applet".split())
# Start tag -> (tags it closes, tags that bound the search).
SELF_CLOSING_GROUPS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
}

# Start tag -> tags that it closes while one of them is the innermost open element.
TOP_CLOSES = {
    **dict.fromkeys(["tbody", "thead", "tfoot"], {"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}),
    "tr": {"td", "th", "caption", "colgroup"}, "colgroup": {"caption", "colgroup"},
    **dict.fromkeys(["h1", "h2", "h3", "h4", "h5", "h6"], {"h1", "h2", "h3", "h4", "h5", "h6"}),
    "a": {"a"}, "optgroup": {"optgroup", "option"}, "body": {"head"},
}

# An end tag closes no open element of a higher rank than its own; others have 100.
END_RANK = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190,
            "head": 200, "body": 200, "html": 220}

# Elements nested deeper keep their text and are siblings of each other; the page says so
# in ``page_error``. Paths hold all ancestors, so their size grows with the square.
MAX_DEPTH = 1024

NODE_TYPE = T.StructType([
    T.StructField("pre", T.IntegerType()), T.StructField("last", T.IntegerType()),
    T.StructField("depth", T.IntegerType()), T.StructField("parent", T.IntegerType()),
    T.StructField("tag", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("nth", T.IntegerType()), T.StructField("path", T.StringType()),
    T.StructField("src_start", T.IntegerType()), T.StructField("inner_start", T.IntegerType()),
    T.StructField("inner_end", T.IntegerType()), T.StructField("src_end", T.IntegerType()),
    T.StructField("text_start", T.IntegerType()), T.StructField("text_end", T.IntegerType()),
])

_ESC = {"%": "%25", "/": "%2F", "#": "%23", ".": "%2E", ":": "%3A"}


def escape_token(s: str) -> str:
    """Escape the path separators inside an id or class token."""
    return "".join(_ESC.get(ch, ch) for ch in s)


class _Shredder(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=False)
        self.html = html
        self.line_starts = [0]
        i = html.find("\n")
        while i >= 0:
            self.line_starts.append(i + 1)
            i = html.find("\n", i + 1)
        self.nodes: list[dict] = []
        self.stack: list[int] = []      # indexes into nodes
        self.child_tag_counts: list[dict] = [{}]  # per open element (+ document root)
        self.text: list[str] = []
        self.text_len = 0
        self.error: str | None = None

    # -- positions
    def _offset(self) -> int:
        line, col = self.getpos()
        return self.line_starts[line - 1] + col

    # -- tree
    def _close_top(self, at: int, inner_end: int | None = None):
        idx = self.stack.pop()
        self.child_tag_counts.pop()
        n = self.nodes[idx]
        n["inner_end"] = at if inner_end is None else inner_end
        n["src_end"] = at
        n["text_end"] = self.text_len
        n["last"] = len(self.nodes) - 1

    def _close_until(self, names: set, bounds: set, at: int) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            tag = self.nodes[self.stack[k]]["tag"]
            if tag in names:
                while len(self.stack) > k:
                    self._close_top(at)
                return
            if tag in bounds:
                return

    def _open(self, tag: str, attrs, start: int, end: int, empty: bool):
        if tag in CLOSES_P:
            self._close_until({"p"}, P_SCOPE, start)
        group = SELF_CLOSING_GROUPS.get(tag)
        if group:
            self._close_until(group[0], group[1], start)
        closed = TOP_CLOSES.get(tag, ())
        while self.stack and self.nodes[self.stack[-1]]["tag"] in closed:
            self._close_top(start)
        if len(self.stack) >= MAX_DEPTH:
            empty = True
            self.error = f"elements nested deeper than {MAX_DEPTH}"
        amap: dict[str, str] = {}
        for k, v in attrs:
            if k not in amap:
                amap[k] = unescape(v) if v is not None else ""
        ident = amap.get("id", "")
        classes = [c for c in amap.get("class", "").split() if c]
        counts = self.child_tag_counts[-1]
        nth = counts.get(tag, 0) + 1
        counts[tag] = nth
        parent = self.stack[-1] if self.stack else -1
        seg = "/" + tag + ":" + str(nth) + "#" + escape_token(ident) + "#" + (
            "." + ".".join(escape_token(c) for c in classes) + "." if classes else "")
        path = (self.nodes[parent]["path"] if parent >= 0 else "") + seg
        node = {
            "pre": len(self.nodes), "last": len(self.nodes), "depth": len(self.stack), "parent": parent,
            "tag": tag, "id": ident, "classes": classes, "attrs": amap, "nth": nth, "path": path,
            "src_start": start, "inner_start": end, "inner_end": end, "src_end": end,
            "text_start": self.text_len, "text_end": self.text_len,
        }
        self.nodes.append(node)
        if not empty and tag not in VOID:
            self.stack.append(node["pre"])
            self.child_tag_counts.append({})

    # -- parser callbacks
    def handle_starttag(self, tag, attrs):
        start = self._offset()
        raw = self.get_starttag_text() or ""
        self._open(tag, attrs, start, start + len(raw), empty=False)

    def handle_startendtag(self, tag, attrs):
        start = self._offset()
        raw = self.get_starttag_text() or ""
        self._open(tag, attrs, start, start + len(raw), empty=True)

    def handle_endtag(self, tag):
        start = self._offset()
        gt = self.html.find(">", start)
        end = len(self.html) if gt < 0 else gt + 1
        rank = END_RANK.get(tag, 100)
        for k in range(len(self.stack) - 1, -1, -1):
            opened = self.nodes[self.stack[k]]["tag"]
            if END_RANK.get(opened, 100) > rank:
                return      # a misplaced end tag: a '</b>' ends no division, a '</div>' no table cell
            if opened == tag:
                while len(self.stack) > k + 1:
                    self._close_top(start)
                self._close_top(end, inner_end=start)
                return

    def _add_text(self, s: str):
        if s:
            self.text.append(s)
            self.text_len += len(s)

    def handle_data(self, data):
        self._add_text(data)

    def _raw_ref(self, prefix: str, name: str) -> str:
        end = self._offset() + len(prefix) + len(name)
        return prefix + name + (";" if self.html[end:end + 1] == ";" else "")

    def handle_entityref(self, name):
        self._add_text(unescape(self._raw_ref("&", name)))

    def handle_charref(self, name):
        self._add_text(unescape(self._raw_ref("&#", name)))

    def finish(self):
        self.close()
        n = len(self.html)
        while self.stack:
            self._close_top(n)
        return "".join(self.text), self.nodes


def shred_html(html: str | None) -> tuple[str, list[dict]]:
    """Parse one page (a small helper run inside the Arrow pass)."""
    return shred_page(html)[:2]


def shred_page(html: str | None) -> tuple[str, list[dict], str | None]:
    """(text, nodes, error) of one page; the error says what of the page is not in them."""
    if not html:
        return "", [], None
    p = _Shredder(html)
    try:
        p.feed(html)
        return *p.finish(), p.error
    except Exception as e:  # malformed beyond repair: keep what was built, and say so
        n = len(html)
        while p.stack:
            p._close_top(n)
        return "".join(p.text), p.nodes, f"page parsed in part: {type(e).__name__}: {e}"


def _arrow_node_type() -> pa.DataType:
    return pa.struct([
        ("pre", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()), ("parent", pa.int32()),
        ("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string())),
        ("attrs", pa.map_(pa.string(), pa.string())), ("nth", pa.int32()), ("path", pa.string()),
        ("src_start", pa.int32()), ("inner_start", pa.int32()), ("inner_end", pa.int32()), ("src_end", pa.int32()),
        ("text_start", pa.int32()), ("text_end", pa.int32()),
    ])


SLICE_ROWS = 32  # pages per yielded Arrow batch: bounds worker memory for 5 MiB pages


def _slices(batches, rows: int = SLICE_ROWS):
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _shred_batches(batches, html_col: str):
    node_list_type = pa.list_(_arrow_node_type())
    for batch in _slices(batches):
        htmls = batch.column(batch.schema.get_field_index(html_col)).to_pylist()
        texts, node_lists, errors = [], [], []
        for h in htmls:
            text, nodes, error = shred_page(h)
            texts.append(text)
            errors.append(error)
            for n in nodes:
                n["attrs"] = list(n["attrs"].items())
            node_lists.append(nodes)
        cols = list(batch.columns) + [pa.array(texts, pa.string()), pa.array(node_lists, node_list_type), pa.array(errors, pa.string())]
        names = list(batch.schema.names) + ["page_text", "nodes", "page_error"]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def shred(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add ``page_text``, ``nodes`` and ``page_error`` (null for a page that was read whole)
    to every page row (narrow; no shuffle).

    Persist the result (parquet, partitioned like ``pages``) when several jobs read it.
    """
    schema = T.StructType(list(pages.schema.fields) + [
        T.StructField("page_text", T.StringType()), T.StructField("nodes", T.ArrayType(NODE_TYPE)),
        T.StructField("page_error", T.StringType())])
    return pages.mapInArrow(lambda it: _shred_batches(it, html_col), schema)


def write_shredded(pages: DataFrame, path: str, buckets: int = 64, key: str = "page_id") -> None:
    """Persist the shred for reuse by several jobs: parquet partitioned by
    ``pmod(xxhash64(key), buckets)`` so a job reading one page set prunes partitions, and
    the nested ``nodes`` column is read only by jobs that select from it."""
    shred(pages).withColumn("shard", F.pmod(F.xxhash64(key), F.lit(buckets))) \
        .repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def explode_nodes(shredded: DataFrame, key: str = "page_id") -> DataFrame:
    """The flat node table: one row per (page, element)."""
    return shredded.select(key, F.explode("nodes").alias("n")).select(key, "n.*")


def node_text(node, page_text="page_text"):
    """Text content of ``node`` (a struct Column) from the page's text."""
    pt = F.col(page_text) if isinstance(page_text, str) else page_text
    return F.substring(pt, node["text_start"] + 1, node["text_end"] - node["text_start"])


def node_inner_html(node, html="html"):
    h = F.col(html) if isinstance(html, str) else html
    return F.substring(h, node["inner_start"] + 1, node["inner_end"] - node["inner_start"])


def node_outer_html(node, html="html"):
    h = F.col(html) if isinstance(html, str) else html
    return F.substring(h, node["src_start"] + 1, node["src_end"] - node["src_start"])


def offsets_nest(nodes: list[dict]) -> bool:
    """Property used by tests: child intervals lie inside their parent's."""
    for n in nodes:
        p = n["parent"]
        if p >= 0:
            q = nodes[p]
            if not (q["src_start"] <= n["src_start"] <= n["src_end"] <= q["src_end"]):
                return False
            if not (q["pre"] < n["pre"] <= n["last"] <= q["last"]):
                return False
    return True


__all__ = ["shred", "shred_html", "write_shredded", "explode_nodes", "node_text", "node_inner_html", "node_outer_html", "NODE_TYPE",
           "escape_token", "offsets_nest"]
