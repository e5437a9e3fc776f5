"""DuckDB SQL expression builders used only by the correctness oracle (``oracle_sql``).

They restate the operators' rules in DuckDB's dialect (RE2 regexes without look-around
or back-references, ``lambda x:`` list functions, 'g' flag for global replace), so the
oracle is an independent implementation of the same semantics.
"""

from __future__ import annotations

from pagemill.functions.text import BASIC_ENTITIES
from pagemill.functions.urls import DROP_QUERY_KEYS

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim_set(x: str) -> str:
    return f"trim({x}, {WS})"


def collapse(x: str) -> str:
    return trim_set(f"regexp_replace({x}, '[\\s\\p{{Z}}]+', ' ', 'g')")


def unescape(x: str) -> str:
    out = x
    for ent, ch in BASIC_ENTITIES:
        out = f"replace({out}, {q(ent)}, {q(ch)})"
    return out


def strip_tags(x: str) -> str:
    s = f"regexp_replace({x}, '(?is)<script[^>]*>.*?</script\\s*>', '', 'g')"
    s = f"regexp_replace({s}, '(?is)<style[^>]*>.*?</style\\s*>', '', 'g')"
    s = f"regexp_replace({s}, '(?s)<!--.*?-->', '', 'g')"
    s = f"regexp_replace({s}, '<[^\\s>][^>]*>', '', 'g')"
    return trim_set(s)


def text_of(x: str) -> str:
    return collapse(strip_tags(x))


URL_RE = "^([A-Za-z][A-Za-z0-9+.\\-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?(#.*)?$"


def url_part(x: str, n: int) -> str:
    return f"regexp_extract({x}, {q(URL_RE)}, {n})"


def host_of(x: str) -> str:
    hp = f"regexp_replace({url_part(x, 2)}, '^.*@', '')"
    return f"regexp_extract({hp}, '^(\\[[^\\]]*\\]|[^:]*)', 1)"


def port_of(x: str) -> str:
    hp = f"regexp_replace({url_part(x, 2)}, '^.*@', '')"
    return f"regexp_extract({hp}, '^(?:\\[[^\\]]*\\]|[^:]*):(.*)$', 1)"


def normalize_url(x: str) -> str:
    u = trim_set(x)
    keys = ", ".join(q(k) for k in DROP_QUERY_KEYS)
    query = f"substr({url_part(u, 4)}, 2)"
    kept = f"array_to_string(list_filter(string_split({query}, '&'), lambda t: split_part(t, '=', 1) NOT IN ({keys})), '&')"
    port = f"CASE WHEN {port_of(u)} <> '' THEN ':' || {port_of(u)} ELSE '' END"
    rebuilt = (f"rtrim({url_part(u, 1)} || '://' || lower({host_of(u)}) || {port} || {url_part(u, 3)} || "
               f"CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END, '/')")
    return f"(CASE WHEN regexp_matches({u}, {q(URL_RE)}) AND {host_of(u)} <> '' THEN {rebuilt} ELSE {u} END)"


def is_public_ip(h: str) -> str:
    a = f"TRY_CAST(split_part({h}, '.', 1) AS INTEGER)"
    b = f"TRY_CAST(split_part({h}, '.', 2) AS INTEGER)"
    v4 = (f"regexp_matches({h}, '^(0|[1-9][0-9]{{0,2}})(\\.(0|[1-9][0-9]{{0,2}})){{3}}$') AND "
          f"list_bool_and(list_transform(string_split({h}, '.'), lambda o: TRY_CAST(o AS INTEGER) <= 255))")
    v4pub = (f"NOT ({a} = 10 OR ({a} = 172 AND {b} BETWEEN 16 AND 31) OR ({a} = 192 AND {b} = 168) OR {a} = 0 "
             f"OR {a} = 127 OR ({a} = 169 AND {b} = 254) OR {a} >= 240)")
    v6 = (f"(contains({h}, ':') AND regexp_matches({h}, '^[0-9A-Fa-f:.]+$') AND "
          f"regexp_matches({h}, '::|^([0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}$') AND NOT contains({h}, ':::'))")
    v6pub = (f"NOT ({h} IN ('::', '::1') OR regexp_matches({h}, '^f[cd]') OR regexp_matches({h}, '^fe[89ab]') "
             f"OR starts_with({h}, '::ffff:') OR starts_with({h}, '2001:db8:') OR starts_with({h}, '2001:0db8:'))")
    return f"(CASE WHEN {v4} THEN {v4pub} WHEN {v6} THEN {v6pub} ELSE false END)"


def is_safe_url(x: str) -> str:
    u = trim_set(x)
    host = f"lower(regexp_replace({host_of(u)}, '^[\\[\\] \\t\\n\\r]+|[\\[\\] \\t\\n\\r]+$', '', 'g'))"
    return (f"coalesce({u} <> '' AND regexp_matches({u}, {q(URL_RE)}) AND NOT regexp_matches({u}, '\\s') "
            f"AND NOT contains({url_part(u, 2)}, '@') AND lower({url_part(u, 1)}) IN ('http', 'https') "
            f"AND {host} <> '' AND {host} NOT IN ('localhost', 'localhost.localdomain') AND NOT ends_with({host}, '.local') "
            f"AND (CASE WHEN regexp_matches({host}, '^[0-9.]+$') OR contains({host}, ':') THEN {is_public_ip(host)} "
            f"ELSE true END), false)")


def absolute_url(src: str, base: str) -> str:
    s = trim_set(unescape(src))
    root = (f"{url_part(base, 1)} || '://' || {host_of(base)} || "
            f"CASE WHEN {port_of(base)} <> '' THEN ':' || {port_of(base)} ELSE '' END")
    path = url_part(base, 3)
    dir_ = f"rtrim(regexp_replace(regexp_replace({path}, '/+$', ''), '/[^/]*$', ''), '/')"
    return (f"(CASE WHEN regexp_matches({s}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN {s} "
            f"WHEN starts_with({s}, '//') THEN 'https:' || {s} "
            f"WHEN NOT (regexp_matches({base}, {q(URL_RE)}) AND {host_of(base)} <> '') THEN {s} "
            f"WHEN starts_with({s}, '/') THEN {root} || {s} "
            f"WHEN regexp_matches({s}, '^(?i)(node|article|news|story|post)') THEN {root} || '/' || ltrim({s}, '/') "
            f"ELSE {root} || {dir_} || '/' || ltrim({s}, '/') END)")


def lines(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '\\r\\n|\\r|\\n'), lambda l: {trim_set('l')}), lambda l: l <> '')"
