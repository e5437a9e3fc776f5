"""Secret scans with multipart credential linking.

Strong patterns (an assignment, an access identifier, a long hex run) are reported wherever they
match. Weak candidates - a free-standing forty-character secret, an endpoint address - are
common in clean text and are reported only where complementary parts of one credential meet: a
secret within ``SCOPE`` code points of an access identifier, and an endpoint within ``SCOPE`` of
both, where an assignment is a secret too.

Texts are scanned once; counts, spans and parts go on without the text. Linking is an interval
join in Spark: the text is cut into blocks of ``SCOPE`` code points, spans are placed in every block
that they touch, identifiers widened by the scope, and parts meet within a block. Spans of one kind are disjoint and of nine characters
or more, which limits a block to a fixed number of parts, so no document makes it quadratic.

Defined cases: null and empty texts have no spans; each row is reported, and rows equal in id and
text share their links; ids may be null.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import cut_lineage, named, table, tidy
from pagemill.llm.words import slices

SCOPE = 400     # code points between the parts of one credential

# The base patterns: fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")      # as every run of these characters of 24 or more
KINDS = ("assign", "access", "hex", "secret", "endpoint")

WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(r"\b(?:https?|s3|wss?|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~%@:/?#&=+-]{4,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the strong patterns, by start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def weak_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of free-standing secrets and endpoints."""
    found = [(m.start(), 3, m.end()) for m in WEAK_SECRET.finditer(text)
             if re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0])]
    if "://" in text:
        found += [(m.start(), 4, m.end()) for m in ENDPOINT.finditer(text)]
    return found


def show(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_SCAN_ARROW = pa.schema([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()),
                         ("base", pa.list_(_SPAN)), ("weak", pa.list_(_SPAN))])
_SPAN_SQL = "array<struct<start: long, kind: int, end: long>>"


@tidy
def _scan(batches):
    for b in (x for batch in batches for x in slices(batch)):
        rows = []
        for text in b.column("text").to_pylist():
            base = base_spans(text or "")
            n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            # without an access identifier no weak candidate can be reported
            weak = weak_spans(text) if n[1] else []
            rows.append((*n, hashlib.sha256(show(base).encode()).hexdigest(),
                         *([{"start": s, "kind": k, "end": e} for s, k, e in x] for x in (base, weak))))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), *(pa.array(c, f.type) for c, f in zip(zip(*rows), _SCAN_ARROW))],
                                         names=["doc_id", "h", *_SCAN_ARROW.names])


def link_parts(parts: DataFrame, keys: list[str], scope: int = SCOPE) -> DataFrame:
    """Weak parts (keys, kind, start, end) that complementary parts co-occur with."""
    # Spans are placed in every block that they touch, the others widened by the scope.
    def blocks(low, high):
        return F.explode(F.sequence(F.floor(low / scope).cast("long"), F.floor(high / scope).cast("long"))).alias("block")

    weak = parts.filter("kind in (3, 4)").select(*keys, "kind", "start", "end", blocks(F.col("start"), F.col("end")))
    other = parts.filter("kind in (0, 1, 3)").select(
        *keys, F.col("kind").alias("okind"), F.col("start").alias("ostart"), F.col("end").alias("oend"),
        blocks(F.col("start") - scope, F.col("end") + scope))
    gap = F.greatest(F.col("ostart") - F.col("end"), F.col("start") - F.col("oend"), F.lit(0))
    met = (weak.join(other, [*keys, "block"]).filter((gap <= scope) & (F.col("kind") != F.col("okind")))
           .groupBy(*keys, "kind", "start", "end")
           .agg(F.max((F.col("okind") == 1).cast("int")).alias("access"), F.max(F.col("okind").isin(0, 3).cast("int")).alias("secret")))
    return met.filter("access = 1 and (kind = 3 or secret = 1)").select(*keys, "kind", "start", "end")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row: doc_id, h (hash of the text), n_assign, n_access, n_hex, base_sha256, found
    (array of start, kind number, end; all spans by start, then kind)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .withColumn("h", F.xxhash64("text"))
    scanned = cut_lineage(src.mapInArrow(
        _scan, f"doc_id long, h long, n_assign long, n_access long, n_hex long, base_sha256 string, base {_SPAN_SQL}, weak {_SPAN_SQL}"))
    parts = (scanned.filter(F.size("weak") > 0).select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"),
                                                       "h", F.explode(F.concat(F.filter("base", lambda s: s["kind"] <= 1), "weak")).alias("s"))
             .select("doc_id", "no_id", "h", "s.*").distinct())
    keys = ["doc_id", "no_id", "h"]
    linked = (link_parts(parts, keys, scope).groupBy(*keys)
              .agg(F.collect_set(F.struct("start", "kind", "end")).alias("linked")))
    return (scanned.withColumn("no_id", F.col("doc_id").isNull()).withColumn("id", F.coalesce("doc_id", F.lit(-1)))
            .join(linked.withColumnRenamed("doc_id", "id"), ["id", "no_id", "h"], "left")
            .select("doc_id", "h", "n_assign", "n_access", "n_hex", "base_sha256",
                    F.when(F.col("linked").isNull(), F.col("base"))
                    .otherwise(F.array_sort(F.concat("base", "linked"))).alias("found")))


def spans_text():
    """Column ``found`` as text."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform("found", lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def mask(text: str, spans: list[dict], mark: str) -> str:
    """``text`` with ``mark`` for its spans (by start); overlapping ones are one hole. Linear in
    the text and the spans."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at:s["start"]], mark]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def _masked(mark: str):
    @F.arrow_udf("string")
    def run(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array((None if t is None else mask(t, f, mark) for t, f in zip(iter_py(text), iter_py(spans))), pa.string())

    return run


def iter_py(column: pa.Array):
    """The values of a column one by one: only one text at a time is a Python object."""
    return (x.as_py() for x in column)


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mark``; other columns stay."""
    found = (secret_spans(docs, id_col, text_col).filter(F.size("found") > 0)
             .select(F.coalesce("doc_id", F.lit(-1)).alias("_k"), F.col("doc_id").isNull().alias("_n"), F.col("h").alias("_h"), F.col("found").alias("_f"))
             .dropDuplicates(["_k", "_n", "_h"]))
    packed = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("_doc"), F.col(text_col).cast("string").alias("text"),
                         F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("_k"), F.col(id_col).isNull().alias("_n")) \
        .withColumn("_h", F.xxhash64("text"))
    joined = packed.join(found.hint("shuffle_hash"), ["_k", "_n", "_h"], "left")
    spans = F.transform("_f", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    text = F.when(F.col("_f").isNull(), F.col("text")).otherwise(
        _masked(mark)(F.when(F.col("_f").isNotNull(), F.col("text")), spans))
    return joined.select(*[(text if c == text_col else F.col("_doc")[c]).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """Contract rows of :func:`secret_spans` over all documents."""
    return secret_spans(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans_text().alias("spans"))
