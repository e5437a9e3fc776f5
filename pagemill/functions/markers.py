"""Marker slices (X1–X2): the text between a 'before' and an 'after' marker.

Markers are rule columns; variants (raw, entity-decoded, entity-encoded, whitespace-
flexible regex) are computed from the marker expression once per row and searched with
``locate`` / ``regexp_instr`` — all JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagemill.functions.text import let, trim_set, unescape_basic

# Characters encoded by the 'encoded' marker variant, in order.
ENCODE_ENTITIES = [("&", "&amp;"), ('"', "&quot;"), ("'", "&apos;"), ("<", "&lt;"), (">", "&gt;")]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_marker(col) -> Column:
    """CRLF/CR -> LF, trimmed; null -> ''."""
    return trim_set(F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"\r\n|\r", "\n"))


def encode_entities(col) -> Column:
    out = _c(col)
    for ch, ent in ENCODE_ENTITIES:
        out = F.replace(out, F.lit(ch), F.lit(ent))
    return out


def _quote_regex(col) -> Column:
    """Java-regex literal of a string (\\Q…\\E, with embedded \\E handled)."""
    return F.concat(F.lit("\\Q"), F.replace(_c(col), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _marker_info(marker: Column) -> Column:
    m = marker
    decoded = unescape_basic(m)
    encoded = encode_entities(m)
    compact = trim_set(F.regexp_replace(m, r"(?U)\s+", " "))
    pattern = F.replace(_quote_regex(compact), F.lit(" "), F.lit("\\E\\s+\\Q"))
    return F.struct(m.alias("m"), decoded.alias("dec"), encoded.alias("enc"), compact.alias("compact"),
                    pattern.alias("pattern"))


def find_marker(html, marker, start) -> Column:
    """STRUCT<p, l>: 1-based position and length of the first match of ``marker`` at or
    after ``start`` (1-based): raw, then decoded, then encoded variant (the first variant
    found wins, not the earliest position), then the whitespace-flexible pattern; (0, 0)
    if none."""
    h = _c(html)

    def body(mk):
        variants = F.array(
            F.struct(mk["m"].alias("v"), F.lit(True).alias("use")),
            F.struct(mk["dec"].alias("v"), (mk["dec"] != mk["m"]).alias("use")),
            F.struct(mk["enc"].alias("v"), ((mk["enc"] != mk["m"]) & (mk["enc"] != mk["dec"])).alias("use")))
        hits = F.filter(F.transform(variants, lambda x: F.struct(
            F.when(x["use"] & (x["v"] != ""), F.call_function("locate", x["v"], h, start)).otherwise(F.lit(0)).alias("p"),
            F.length(x["v"]).alias("l"))), lambda x: x["p"] > 0)
        use_re = (F.size(hits) == 0) & (mk["compact"] != "") & (mk["compact"] != mk["m"])

        def by_regex(tail):
            rpos = F.call_function("regexp_instr", tail, mk["pattern"])
            return F.struct(F.when(rpos > 0, rpos + start - 1).otherwise(F.lit(0)).alias("p"),
                            F.when(rpos > 0, F.length(F.call_function("regexp_substr", tail, mk["pattern"])))
                            .otherwise(F.lit(0)).alias("l"))

        none = F.struct(F.lit(0).alias("p"), F.lit(0).alias("l"))
        return (F.when(F.size(hits) > 0, F.get(hits, 0))
                .when(use_re, let(F.call_function("substring", h, start), by_regex))
                .otherwise(none))

    return let(_marker_info(_c(marker)), body)


def slice_bounds(html, before, after) -> Column:
    """STRUCT<ok, start, end>: 0-based [start, end) of the slice; ok False -> ''."""
    h = F.coalesce(_c(html), F.lit(""))
    b, a = normalize_marker(before), normalize_marker(after)

    def with_b(bm):
        start = F.when(b == "", F.lit(0)).otherwise(bm["p"] - 1 + bm["l"])

        def with_start(st):
            def with_a(am):
                end = F.when(a == "", F.length(h)).otherwise(am["p"] - 1)
                ok = ((b == "") | (bm["p"] > 0)) & ((a == "") | (am["p"] > 0)) & (end > st)
                return F.struct(ok.alias("ok"), st.alias("start"), end.alias("end"))

            return let(F.when(a == "", F.struct(F.lit(0).alias("p"), F.lit(0).alias("l")))
                       .otherwise(find_marker(h, a, st + 1)), with_a)

        return let(start, with_start)

    return let(F.when(b == "", F.struct(F.lit(0).alias("p"), F.lit(0).alias("l"))).otherwise(find_marker(h, b, F.lit(1))),
               with_b)


def slice_between(html, before, after) -> Column:
    """Text after the first 'before' up to the next 'after'; both empty -> whole html;
    a marker set but not found -> ''."""
    h = F.coalesce(_c(html), F.lit(""))
    b, a = normalize_marker(before), normalize_marker(after)

    def body(sb):
        return (F.when((b == "") & (a == ""), h)
                .when(sb["ok"] & (F.length(h) > 0),
                      F.call_function("substring", h, sb["start"] + 1, sb["end"] - sb["start"]))
                .otherwise(F.lit("")))

    return F.when((b == "") & (a == ""), h).otherwise(let(slice_bounds(h, before, after), body))


__all__ = ["slice_between", "slice_bounds", "find_marker", "normalize_marker", "encode_entities"]
