"""URL scalars (U1–U10) as Catalyst expressions: no Python on the hot path.

All functions take and return ``Column``s; they are composable in ``select``/``filter``
and stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagemill.functions.text import TRIM_CHARS, let, trim_set, unescape_basic

# Query keys removed by normalisation.
DROP_QUERY_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "from", "spm"]
# Relative links starting with these words resolve against the site root.
ROOT_RELATIVE_PREFIX = r"(?i)^(node|article|news|story|post)"

# scheme :// authority path ?query #fragment
_URL_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_parts(col) -> dict[str, Column]:
    """Split a URL into scheme, host (as written), port, path, query (without '?')."""
    u = _c(col)
    scheme = F.regexp_extract(u, _URL_RE, 1)
    authority = F.regexp_extract(u, _URL_RE, 2)
    host_port = F.regexp_replace(authority, r"^.*@", "")
    host = F.regexp_extract(host_port, r"^(\[[^\]]*\]|[^:]*)", 1)
    port = F.regexp_extract(host_port, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)
    return {
        "scheme": scheme,
        "authority": authority,
        "userinfo": F.regexp_extract(authority, r"^(.*)@", 1),
        "host": host,
        "port": port,
        "path": F.regexp_extract(u, _URL_RE, 3),
        "query": F.substring(F.regexp_extract(u, _URL_RE, 4), 2, 1 << 30),
    }


def lines(col) -> Column:
    """Split on CRLF/CR/LF, trim (space, tab, CR, LF, NUL, VT), drop empty lines."""
    parts = F.split(_c(col), r"\r\n|\r|\n")
    return F.filter(F.transform(parts, lambda x: trim_set(x)), lambda x: x != F.lit(""))


def normalize_url(col, drop_port: bool = False) -> Column:
    """Lower-case host, drop tracking query keys, fragment and user info, strip
    trailing '/'. A URL without scheme or host is returned trimmed, otherwise as is.
    The port is kept unless ``drop_port``; query bytes and order are kept."""

    def body(u):
        p = url_parts(u)
        kept = F.filter(F.split(p["query"], "&"),
                        lambda x: ~F.split_part(x, F.lit("="), F.lit(1)).isin(DROP_QUERY_KEYS))
        q = F.array_join(kept, "&")
        port = F.lit("") if drop_port else F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise(F.lit(""))
        rebuilt = F.concat(p["scheme"], F.lit("://"), F.lower(p["host"]), port, p["path"],
                           F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
        rebuilt = F.regexp_replace(rebuilt, "/+$", "")
        return F.when(u.rlike(_URL_RE) & (p["host"] != ""), rebuilt).otherwise(u)

    return let(trim_set(_c(col)), body)


def _ipv4_octets(h: Column) -> Column:
    return F.split(h, r"\.")


def is_ipv4(h) -> Column:
    h = _c(h)
    o = _ipv4_octets(h)
    valid = h.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$")
    return valid & F.forall(o, lambda x: x.cast("int") <= 255)


def is_ipv6(h) -> Column:
    h = _c(h)
    return h.contains(":") & h.rlike(r"^[0-9A-Fa-f:.]+$") & h.rlike("::|^([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$") \
        & (F.size(F.split(h, ":::")) == 1)


def is_public_ip(col) -> Column:
    """U4: a valid IP that is neither private nor reserved.

    v4 private: 10/8, 172.16/12, 192.168/16; reserved: 0/8, 127/8, 169.254/16, 240/4.
    v6 private: fc00::/7; reserved: ::, ::1, fe80::/10, ::ffff:0:0/96 (mapped), 2001:db8::/32.
    """

    def body(h):
        o = _ipv4_octets(h)
        a = o.getItem(0).cast("int")
        b = o.getItem(1).cast("int")
        v4_public = ~((a == 10) | ((a == 172) & (b >= 16) & (b <= 31)) | ((a == 192) & (b == 168))
                      | (a == 0) | (a == 127) | ((a == 169) & (b == 254)) | (a >= 240))
        v6_public = ~(h.isin("::", "::1") | h.rlike("^f[cd]") | h.rlike("^fe[89ab]") | h.startswith("::ffff:")
                      | h.startswith("2001:db8:") | h.startswith("2001:0db8:"))
        return F.when(is_ipv4(h), v4_public).when(is_ipv6(h), v6_public).otherwise(F.lit(False))

    return let(F.lower(_c(col)), body)


def url_host(col) -> Column:
    """Host of an absolute URL, brackets and set-trimmed, lower case; '' if none."""
    p = url_parts(trim_set(_c(col)))
    return F.lower(F.regexp_replace(p["host"], r"^[\[\] \t\n\r\x00\x0b]+|[\[\] \t\n\r\x00\x0b]+$", ""))


def _clean_host(host: Column) -> Column:
    return F.lower(F.regexp_replace(host, r"^[\[\] \t\n\r\x00\x0b]+|[\[\] \t\n\r\x00\x0b]+$", ""))


def is_safe_public_url(col) -> Column:
    """http/https with a host, no user info, no whitespace; host not localhost,
    localhost.localdomain or ``*.local``; an IP host must be public (U4). Host-name
    resolution is not done here: join ``safe_hosts`` (K10) for that."""

    def body(u):
        p = url_parts(u)

        def with_host(host):
            return F.coalesce(
                (u != "") & u.rlike(_URL_RE) & ~u.rlike(r"\s") & ~p["authority"].contains("@")
                & F.lower(p["scheme"]).isin("http", "https") & (host != "")
                & ~host.isin("localhost", "localhost.localdomain") & ~host.endswith(".local")
                & F.when(is_ipv4(host) | is_ipv6(host), is_public_ip(host)).otherwise(F.lit(True)),
                F.lit(False))

        return let(_clean_host(p["host"]), with_host)

    return let(trim_set(_c(col)), body)


def absolute_url(src, base) -> Column:
    """Resolve ``src`` against ``base``.

    Entity-decode + trim; an absolute URL (any scheme) is kept; ``//x`` gets ``https:``;
    ``/x`` resolves to the site root; ``node|article|news|story|post...`` to the root too;
    anything else to the directory of the base path (``../`` is not collapsed). A base
    without scheme or host leaves ``src`` unchanged.
    """

    def body(v):
        s, base_ = v["s"], v["b"]
        b = url_parts(base_)
        root = F.concat(b["scheme"], F.lit("://"), b["host"],
                        F.when(b["port"] != "", F.concat(F.lit(":"), b["port"])).otherwise(F.lit("")))
        base_ok = base_.rlike(_URL_RE) & (b["host"] != "")
        dir_ = F.regexp_replace(F.regexp_replace(F.regexp_replace(b["path"], "/+$", ""), "/[^/]*$", ""), "/+$", "")
        ltrimmed = F.regexp_replace(s, "^/+", "")
        return (F.when(s.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), s)
                .when(s.startswith("//"), F.concat(F.lit("https:"), s))
                .when(~base_ok, s)
                .when(s.startswith("/"), F.concat(root, s))
                .when(s.rlike(ROOT_RELATIVE_PREFIX), F.concat(root, F.lit("/"), ltrimmed))
                .otherwise(F.concat(root, dir_, F.lit("/"), ltrimmed)))

    return let(F.struct(trim_set(unescape_basic(_c(src))).alias("s"), _c(base).alias("b")), body)


def url_hash(col) -> Column:
    """md5 hex of the normalised URL."""
    return F.md5(normalize_url(col))


def parse_urls(col) -> Column:
    """Text block -> ordered distinct array of normalised safe URLs."""
    urls = F.transform(lines(col), lambda x: normalize_url(x))
    return F.array_distinct(F.filter(urls, lambda x: is_safe_public_url(x)))


def list_pages_cut(page_start, page_end, most: int = 500) -> Column:
    """U8: how many pattern pages ``list_page_urls`` leaves out because of ``most``."""
    start = F.greatest(F.lit(1), _c(page_start).cast("int"))
    return F.greatest(F.lit(0), _c(page_end).cast("int") - start - most)


def list_page_urls(list_urls_text, pattern, page_start, page_end, most: int | None = 500) -> Column:
    """U8: static list URLs, then ``{page}`` pattern pages start..end with start >= 1 and at most
    ``most`` pages after the first (None: all); safe, normalised, distinct, in order."""
    start = F.greatest(F.lit(1), _c(page_start).cast("int"))
    last = _c(page_end).cast("int")
    end = F.greatest(start, last if most is None else F.least(start + most, last))
    pat = trim_set(F.coalesce(_c(pattern), F.lit("")))
    pages = F.transform(F.sequence(start, end),
                        lambda i: normalize_url(F.replace(pat, F.lit("{page}"), i.cast("string"))))
    pages = F.when(pat.contains("{page}"), F.filter(pages, lambda x: is_safe_public_url(x))) \
        .otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(parse_urls(F.coalesce(_c(list_urls_text), F.lit(""))), pages))


def clamp_int(col, lo: int, hi: int, default: int) -> Column:
    """Numeric (int or decimal text) truncated to int, else ``default``; then clamped."""
    v = F.coalesce(trim_set(_c(col).cast("string")).try_cast("double"), F.lit(float(default)))
    v = F.when(F.abs(v) < 1e15, v).otherwise(F.lit(float(default)))
    return F.least(F.greatest(v.cast("long"), F.lit(lo)), F.lit(hi)).cast("int")


def url_ext(col) -> Column:
    """Lower-case extension of the URL path's last segment ('' if none)."""
    path = url_parts(_c(col))["path"]
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


__all__ = ["lines", "normalize_url", "is_public_ip", "is_safe_public_url", "absolute_url", "url_hash",
           "parse_urls", "list_page_urls", "clamp_int", "url_ext", "url_parts", "url_host", "TRIM_CHARS"]
