"""Tree repair: misnested inline tags, tables, stray end tags; nesting holds for any tag soup."""

from hypothesis import given, settings, strategies as st

import pytest

from pagemill.operators.shred import VOID, shred_page


def tree(html):
    """The tree as nested text: tag(children) in document order."""
    _, nodes, error = shred_page(html)
    assert error is None

    def show(parent):
        return " ".join(n["tag"] + (f"({show(n['pre'])})" if show(n["pre"]) else "") for n in nodes if n["parent"] == parent)

    return show(-1)


def inner(html, tag):
    text, nodes, _ = shred_page(html)
    return [text[n["text_start"]:n["text_end"]] for n in nodes if n["tag"] == tag]


@pytest.mark.parametrize("html,want", [
    ("<div><b>x</div>y</b><p>z</p>", "div(b) p"),
    ("<b><div>x</b>y<i>z</i></div>w</b>", "b(div(i))"),
    ("<table><tr><td>a</div><b>c</b><td>d</table><i></i>", "table(tr(td(b) td)) i"),
    ("<div><table><tr><td></div><b></b></td></tr></table><i></i></div><u></u>", "div(table(tr(td(b))) i) u"),
    ("<table><thead><tr><th>a<tbody><tr><td>b<tr><td>c<tfoot><tr><td>d</table>", "table(thead(tr(th)) tbody(tr(td) tr(td)) tfoot(tr(td)))"),
    ("<table><caption>x<tr><td>y</table>", "table(caption tr(td))"),
    ("<table><tr><td><table><tr><td>in</table>out</table>", "table(tr(td(table(tr(td)))))"),
    ("<a href=1>x<a href=2>y</a>", "a a"),
    ("<h1>x<h2>y</h2>", "h1 h2"),
    ("<select><optgroup><option>a<optgroup><option>b</select>", "select(optgroup(option) optgroup(option))"),
    ("</p></div><p>x</span></p>", "p"),
    ("<html><head><title>t</title><body><p>x</body></html>", "html(head(title) body(p))"),
    ("<ul><li><b>x<li>y</ul>", "ul(li(b) li)"),
])
def test_repair(html, want):
    assert tree(html) == want


def test_texts_stay_with_their_elements():
    html = "<table><tr><td>a</div>b<td>c</td></tr></table>d"
    assert inner(html, "td") == ["ab", "c"] and inner(html, "table") == ["abc"]
    assert inner("<div>a<b>b</div>c</b>d", "div") == ["ab"]


TAGS = ["a", "b", "i", "p", "div", "ul", "li", "table", "tbody", "thead", "tr", "td", "th", "caption", "h1", "h2", "option", "select", "br", "img", "span"]
PIECES = st.lists(st.one_of(st.sampled_from([f"<{t}>" for t in TAGS]), st.sampled_from([f"</{t}>" for t in TAGS]), st.sampled_from(["x", "yz", " "])), max_size=40)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_any_soup_is_a_tree_with_the_whole_text(pieces):
    html = "".join(pieces)
    text, nodes, error = shred_page(html)
    assert error is None and text == "".join(p for p in pieces if not p.startswith("<"))
    assert len(nodes) == sum(p.startswith("<") and not p.startswith("</") for p in pieces)
    for n in nodes:
        assert n["src_start"] <= n["inner_start"] <= n["inner_end"] <= n["src_end"] and n["pre"] <= n["last"]
        assert n["tag"] not in VOID or n["last"] == n["pre"]
        if n["parent"] >= 0:
            up = nodes[n["parent"]]
            assert up["pre"] < n["pre"] and n["last"] <= up["last"] and n["depth"] == up["depth"] + 1
            assert up["inner_start"] <= n["src_start"] and n["src_end"] <= up["inner_end"]
            assert up["text_start"] <= n["text_start"] and n["text_end"] <= up["text_end"] and n["path"].startswith(up["path"] + "/")
