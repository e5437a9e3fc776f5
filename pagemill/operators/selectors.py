"""Selectors over shredded pages.

A selector compiles (once, per distinct selector) to a ``Sel`` record:
  regex      anchored pattern over a node's ``path`` (ancestor-or-self chain)
  attr_eq    [(attribute, value)] equality tests on the matched node itself
  attr_has   [(attribute, value)] substring tests on the matched node itself
  nth        1-based index into the document-ordered match list, 0 = all
  supported  False -> the selector matches nothing (and is reported), never "everything"

Path segment of one element: ``/tag:nth#id#.c1.c2.`` (``nth`` = index among same-tag
siblings; ``/ # . : %`` inside id/classes are percent-escaped). Hence
  descendant step  ``(?:/[^/]*)*``     child step  ``(nothing)``
  tag              ``tag:[0-9]+``       ``*`` -> ``[^/#:]+:[0-9]+``
  #x               id field equals x   .c -> look-ahead ``(?=[^/]*\\.c\\.)`` on the segment
  XPath [n]        ``tag:n``            contains(@class,"x") -> class field contains x
Matching all elements of a page is ``filter(nodes, n -> n.path RLIKE regex AND tests)``,
a JVM-side higher-order function over the page's own array.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from pagemill.operators.shred import escape_token

SEL_TYPE = T.StructType([
    T.StructField("regex", T.StringType()),
    T.StructField("attr_eq", T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())]))),
    T.StructField("attr_has", T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())]))),
    T.StructField("nth", T.IntegerType()),
    T.StructField("supported", T.BooleanType()),
])

_DESC = r"(?:/[^/]*)*"
_NAME = r"[A-Za-z][A-Za-z0-9_-]*"


@dataclass
class Sel:
    regex: str = "(?!)"
    attr_eq: list = field(default_factory=list)
    attr_has: list = field(default_factory=list)
    nth: int = 0
    supported: bool = False

    def as_row(self) -> dict:
        return {"regex": self.regex, "attr_eq": [{"k": k, "v": v} for k, v in self.attr_eq],
                "attr_has": [{"k": k, "v": v} for k, v in self.attr_has], "nth": self.nth,
                "supported": self.supported}


def _segment(tag: str | None, ident: str | None = None, classes=(), class_has=(), class_eq: str | None = None,
             nth: int | None = None) -> str:
    t = re.escape(tag.lower()) if tag and tag != "*" else r"[^/#:]+"
    n = str(int(nth)) if nth else "[0-9]+"
    look = "".join(r"(?=[^/]*#[^/#]*#[^/]*\." + re.escape(escape_token(c)) + r"\.)" for c in classes)
    look += "".join(r"(?=[^/]*#[^/#]*#[^/]*" + re.escape(escape_token(c)) + ")" for c in class_has)
    idp = re.escape(escape_token(ident)) if ident is not None else "[^/#]*"
    if class_eq is not None:
        toks = [x for x in class_eq.split(" ") if x]
        cls = (r"\." + r"\.".join(re.escape(escape_token(x)) for x in toks) + r"\.") if toks else ""
    else:
        cls = "[^/]*"
    return "/" + look + t + ":" + n + "#" + idp + "#" + cls


def compile_css(selector: str) -> Sel:
    """CSS subset: tag, *, #id, .class (compounded), descendant (space), child (>)."""
    regex, axis, steps = "^", _DESC, 0
    for part in selector.replace(">", " > ").split():
        if part == ">":
            axis = ""
            continue
        step = _compound(part)
        if step is None:
            return Sel()
        tag, ident, classes = step
        # a leading child axis ("> a") is taken as a child of any element
        regex += (axis if steps else _DESC) + _segment(tag, ident, classes)
        axis, steps = _DESC, steps + 1
    return Sel(regex=regex + "$", supported=True) if steps else Sel()


def _name_char(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c in "-_")


def _compound(text: str) -> tuple[str | None, str | None, list[str]] | None:
    """(tag or '*', id, classes) of one compound selector; None if it is none of the subset:
    a tag or '*' first, then '#id' at most once and any number of '.class'."""
    pieces: list[str] = []          # the first is the tag, the others begin with their sign
    for c in text:
        if c in "#.":
            pieces.append(c)
        elif c == "*" or _name_char(c):
            if not pieces:
                pieces.append("")
            pieces[-1] += c
        else:
            return None
    tag = pieces.pop(0) if pieces and pieces[0][0] not in "#." else None
    if tag is not None and tag != "*" and ("*" in tag or not tag[0].isalpha()):
        return None
    names = {sign: [p[1:] for p in pieces if p[0] == sign] for sign in "#."}
    if any(not n or "*" in n for group in names.values() for n in group) or len(names["#"]) > 1:
        return None
    return (tag, names["#"][0] if names["#"] else None, names["."]) if tag or pieces else None


_XSTEP = re.compile(r"^(" + _NAME + r"|\*)((?:\[[^\]]*\])*)$")
_PRED_ATTR = re.compile(r"""^@([A-Za-z_][A-Za-z0-9_:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)')$""")
_PRED_CONTAINS = re.compile(r"""^contains\(\s*@([A-Za-z_][A-Za-z0-9_:.-]*)\s*,\s*(?:"([^"]*)"|'([^']*)')\s*\)$""")


def _split_xpath_steps(path: str):
    """'//div[@id="a"]/p' -> [('//','div[@id="a"]'), ('/','p')]; None if malformed."""
    steps, i, n = [], 0, len(path)
    while i < n:
        if path.startswith("//", i):
            axis, i = "//", i + 2
        elif path[i] == "/":
            axis, i = "/", i + 1
        else:
            return None
        j, depth = i, 0
        while j < n and (depth > 0 or path[j] != "/"):
            if path[j] == "[":
                depth += 1
            elif path[j] == "]":
                depth -= 1
            j += 1
        steps.append((axis, path[i:j]))
        i = j
    return steps


def compile_xpath(xpath: str) -> Sel:
    """XPath subset: ``/`` and ``//`` steps, ``*``, ``[@a="v"]``, ``[contains(@a,"v")]``,
    ``[n]``, and a whole-expression ``(...)[n]``. Attribute tests other than id/class are
    allowed on the last step only."""
    x = xpath.strip()
    doc_nth = 0
    m = re.match(r"^\((.*)\)\s*\[\s*([0-9]+)\s*\]$", x)
    if m:
        x, doc_nth = m.group(1).strip(), int(m.group(2))
    steps = _split_xpath_steps(x)
    if not steps:
        return Sel()
    regex = "^"
    attr_eq, attr_has = [], []
    for k, (axis, step) in enumerate(steps):
        sm = _XSTEP.match(step)
        if not sm:
            return Sel()
        tag, preds = sm.group(1), re.findall(r"\[([^\]]*)\]", sm.group(2) or "")
        ident, classes_has, class_eq, nth = None, [], None, None
        last = k == len(steps) - 1
        for p in preds:
            p = p.strip()
            if re.fullmatch(r"[0-9]+", p):
                nth = int(p)
                continue
            am = _PRED_ATTR.match(p)
            cm = _PRED_CONTAINS.match(p)
            if am:
                a, v = am.group(1), am.group(2) if am.group(2) is not None else am.group(3)
                if a == "id":
                    ident = v
                elif a == "class":
                    class_eq = v
                    if last:
                        attr_eq.append(("class", v))
                elif last:
                    attr_eq.append((a, v))
                else:
                    return Sel()
            elif cm:
                a, v = cm.group(1), cm.group(2) if cm.group(2) is not None else cm.group(3)
                if a == "class" and " " not in v:
                    classes_has.append(v)
                elif last:
                    attr_has.append((a, v))
                else:
                    return Sel()
            else:
                return Sel()
        regex += (_DESC if axis == "//" else "") + _segment(tag, ident, (), classes_has, class_eq, nth)
    return Sel(regex=regex + "$", attr_eq=attr_eq, attr_has=attr_has, nth=doc_nth, supported=True)


def compile_selector(selector: str | None) -> Sel:
    """Strings starting with '/' or '(' are XPath, anything else CSS."""
    s = (selector or "").strip()
    if not s:
        return Sel()
    if s.startswith("/") or s.startswith("("):
        return compile_xpath(s)
    return compile_css(s)


def refusal(selector: str | None) -> str | None:
    """Why a selector matches nothing by its form, or null for a usable or empty one."""
    s = (selector or "").strip()
    if not s or compile_selector(s).supported:
        return None
    if s[0] not in "/(":
        bad = [p for p in s.replace(">", " > ").split() if p != ">" and _compound(p) is None]
        return f"not a tag, #id or .class: {bad[0]}" if bad else "no element named"
    m = re.match(r"^\((.*)\)\s*\[\s*([0-9]+)\s*\]$", s)
    if s[0] == "(" and not m:
        return "brackets without a position"
    steps = _split_xpath_steps(m.group(1).strip() if m else s)
    if not steps:
        return "not a path of / and // steps"
    bad = [step for axis, step in steps if not compile_xpath(axis + step).supported]
    return f"step not supported: {bad[0]}" if bad else "attribute test before the last step"


@F.pandas_udf(T.StringType())
def refusal_udf(s: pd.Series) -> pd.Series:
    """:func:`refusal` of a column of selector strings (run on the distinct ones of the rules)."""
    return s.map(refusal)


def refused_selectors(rules, slots: dict[str, Column]):
    """(rule_id, slot, selector, reason) of the selectors of a rule table that the engine
    refuses, so that they match nothing. ``slots`` names selector columns; an array column holds
    several selectors."""
    from pagemill.operators.joins import small

    types = dict(rules.select(*[c.alias(k) for k, c in slots.items()]).dtypes)
    each = [c if types[k].startswith("array") else F.array(c) for k, c in slots.items()]
    rows = rules.select("rule_id", F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), c.cast("array<string>").alias("l")) for k, c in zip(slots, each)])).alias("s")) \
        .select("rule_id", "s.slot", F.explode("s.l").alias("selector")).where(F.col("selector").isNotNull())
    reasons = rows.select("selector").distinct().withColumn("reason", refusal_udf("selector")).where(F.col("reason").isNotNull())
    return rows.join(small(reasons), "selector").select("rule_id", "slot", "selector", "reason")


def sel_literal(selector: str) -> Column:
    """A compiled selector as a literal struct column (for a selector fixed in the job)."""
    r = compile_selector(selector).as_row()
    return F.struct(
        F.lit(r["regex"]).alias("regex"),
        F.array(*[F.struct(F.lit(t["k"]).alias("k"), F.lit(t["v"]).alias("v")) for t in r["attr_eq"]])
        .cast(SEL_TYPE["attr_eq"].dataType).alias("attr_eq"),
        F.array(*[F.struct(F.lit(t["k"]).alias("k"), F.lit(t["v"]).alias("v")) for t in r["attr_has"]])
        .cast(SEL_TYPE["attr_has"].dataType).alias("attr_has"),
        F.lit(r["nth"]).alias("nth"),
        F.lit(r["supported"]).alias("supported"),
    )


@F.pandas_udf(SEL_TYPE)
def compile_selector_udf(s: pd.Series) -> pd.DataFrame:
    """Compile a column of selector strings (run on the distinct selectors of the rules)."""
    rows = [compile_selector(x).as_row() for x in s]
    return pd.DataFrame(rows, columns=[f.name for f in SEL_TYPE.fields])


def with_compiled(rules, selector_col: str, out: str):
    """Add a compiled-selector struct ``out`` for ``selector_col`` of the (small) rules
    table: compile the distinct selectors Spark-side and join them back by value."""
    distinct = rules.select(F.col(selector_col).alias("_sel")).distinct()
    comp = distinct.select("_sel", compile_selector_udf(F.coalesce(F.col("_sel"), F.lit(""))).alias(out))
    from pagemill.operators.joins import small

    return rules.join(small(comp), rules[selector_col].eqNullSafe(comp["_sel"]), "left").drop("_sel")


def match_nodes(nodes, sel, within=None) -> Column:
    """All elements of the page matching ``sel`` (document order). ``within`` optionally
    restricts to elements whose source range lies inside [start, end) (a marker slice)."""
    nodes = F.col(nodes) if isinstance(nodes, str) else nodes

    def ok(n):
        c = (F.call_function("rlike", n["path"], sel["regex"])
             & F.forall(sel["attr_eq"], lambda t: F.coalesce(n["attrs"][t["k"]] == t["v"], F.lit(False)))
             & F.forall(sel["attr_has"], lambda t: F.coalesce(F.instr(n["attrs"][t["k"]], t["v"]) > 0, F.lit(False))))
        if within is not None:
            c = c & (n["src_start"] >= within[0]) & (n["src_end"] <= within[1])
        return c

    hits = F.filter(nodes, ok)
    picked = F.when(sel["nth"] > 0, F.slice(hits, F.greatest(sel["nth"], F.lit(1)), 1)).otherwise(hits)
    return F.when(sel["supported"], picked).otherwise(F.slice(hits, 1, 0))


def first_match(nodes, sel, within=None) -> Column:
    return F.get(match_nodes(nodes, sel, within), 0)


__all__ = ["compile_selector", "compile_css", "compile_xpath", "sel_literal", "compile_selector_udf",
           "with_compiled", "refusal", "refused_selectors", "match_nodes", "first_match", "SEL_TYPE", "Sel"]
