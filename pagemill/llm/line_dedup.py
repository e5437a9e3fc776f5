"""Line dedup with two Bloom filters.

1. Each task hashes its line keys and sends, per filter segment, the bits of keys it saw once
   and of keys it saw twice. A segment's bits of all tasks are merged: a bit that two tasks
   sent is twice-seen. The merge yields the twice-seen filter, which has no false negatives.
2. The twice-seen filter is broadcast. Its size is ``FILTER_BITS``, whatever the input; beyond
   some hundred million keys it lets more keys through, which costs shuffle and not results.
3. Only keys that it holds - suspected repeats - are shuffled, as whole strings: Spark counts
   their documents and takes the largest id, summed up before the shuffle. Confirmed keys go
   back to their documents.

A key is a line without the characters ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z
lower-cased. Keys of ``min_chars`` code points or more in ``min_docs`` documents or more lose all
their lines, except in the largest id that holds the key.

Defined cases: a null or empty text is one empty line; each row is a document, also if rows
repeat; of a key's rows with the largest id all keep it; a null id is smaller than any other, and
rows with null ids keep a key that only such rows hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import Filter, cut_lineage, named, pack, packed_bits, rows_to_batches, table, tidy
from pagemill.llm.words import LOWER_BYTES, SPACES, U64, mix

FILTER_BITS = 1 << 28       # 32 MB for each filter
SEGMENT_BITS = 1 << 22
MIN_CHARS, MIN_DOCS = 20, 3


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    line = line.strip(SPACES)
    return line.encode().translate(LOWER_BYTES) if len(line) >= min_chars else None


def key_hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def _bits(h: np.ndarray) -> np.ndarray:
    """Both bit positions of each hash."""
    return np.concatenate([h, mix(h)]) % U64(FILTER_BITS)


def _doc_hashes(text: str | None, min_chars: int):
    return {key_hash(k) for line in (text or "").split("\n") if (k := line_key(line, min_chars)) is not None}


def _task_bits(min_chars: int):
    """Per task: (segment, bits of all keys, bits of keys in two of its documents or more)."""
    schema = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def send(parts):
        h, seen = np.unique(np.concatenate(parts), return_counts=True)
        once = np.unique(_bits(h))
        twice = np.unique(_bits(h[seen > 1]))
        bits = np.concatenate([once, twice])
        kind = np.r_[np.zeros(len(once), np.uint8), np.ones(len(twice), np.uint8)]
        for segment, b, k in pack((bits // U64(SEGMENT_BITS)).astype(np.int32), (bits % U64(SEGMENT_BITS)).astype(np.uint32), kind):
            b, k = np.frombuffer(b, np.uint32), np.frombuffer(k, np.uint8)
            yield segment, b[k == 0].tobytes(), b[k == 1].tobytes()

    @tidy
    def run(batches):
        def rows():
            parts, held = [], 0
            for b in batches:
                for text in b.column("text").to_pylist():
                    h = np.fromiter(_doc_hashes(text, min_chars), U64)
                    parts.append(h)
                    held += len(h)
                if held > 2_000_000:
                    yield from send(parts)
                    parts, held = [], 0
            if held:
                yield from send(parts)

        yield from rows_to_batches(rows(), schema, 64)

    return run


def _merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One segment: its twice-seen bits, as a bitmap."""
    once, twice = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
    for t in batches:
        for o, w in zip(t.column("once"), t.column("twice")):
            o, w = np.frombuffer(o.as_py(), np.uint32), np.frombuffer(w.as_py(), np.uint32)
            twice[o] |= once[o]
            once[o] = True
            twice[w] = True
    yield pa.RecordBatch.from_pydict({"segment": pa.array([key[0].as_py()], pa.int32()),
                                      "twice": pa.array([packed_bits(twice)], pa.binary())})


def twice_seen(src: DataFrame, min_chars: int) -> Filter:
    """The twice-seen filter of column ``text``: FILTER_BITS bits."""
    merged = (src.select("text").mapInArrow(_task_bits(min_chars), "segment int, once binary, twice binary")
              .groupBy("segment").applyInArrow(_merge, "segment int, twice binary"))
    return Filter({row.segment: bytes(row.twice) for row in merged.toLocalIterator()}, FILTER_BITS, SEGMENT_BITS)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row: doc (struct of the input's columns), doc_id, n_lines, n_dropped, kept_text."""
    spark = docs.sparkSession
    idc, textc = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    # documents meet their dropped keys by id, those without an id by text
    place = F.coalesce(idc, F.xxhash64(textc))
    src = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("doc"), idc.alias("doc_id"), textc.alias("text"),
                      place.alias("place"), idc.isNull().alias("no_id"))
    filter_ = spark.sparkContext.broadcast(twice_seen(src, min_chars))

    @tidy
    def suspects(batches):
        schema = pa.schema([("key", pa.string()), ("h", pa.int64()), ("place", pa.int64()), ("no_id", pa.bool_()), ("doc_id", pa.int64())])
        twice = filter_.value.bits

        def rows():
            for b in batches:
                for text, place, no_id, doc in zip(*(b.column(c).to_pylist() for c in ("text", "place", "no_id", "doc_id"))):
                    keys = {k for line in (text or "").split("\n") if (k := line_key(line, min_chars)) is not None}
                    if not keys:
                        continue
                    keys = list(keys)
                    h = np.fromiter(map(key_hash, keys), U64, len(keys))
                    bit = _bits(h)
                    hit = ((twice[(bit >> U64(3)).astype(np.int64)] >> (bit & U64(7)).astype(np.uint8)) & 1).reshape(2, -1).all(axis=0)
                    for i in np.flatnonzero(hit):
                        yield keys[i].decode(), int(h[i].view(np.int64)), place, no_id, doc

        yield from rows_to_batches(rows(), schema)

    found = cut_lineage(src.select("text", "place", "no_id", "doc_id").mapInArrow(
        suspects, "key string, h long, place long, no_id boolean, doc_id long"))
    filter_.destroy()       # its readers are written
    # written, so that the join below has a shuffle of its own, whose hot keys Spark can split
    confirmed = cut_lineage(found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
                            .filter(F.col("n") >= min_docs).select("key", "last"))
    dropped = (found.join(confirmed, "key").filter(~F.col("doc_id").eqNullSafe(F.col("last")))
               .groupBy("no_id", "place").agg(F.collect_set("h").alias("gone")))

    out = pa.schema([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.string())])

    def cut(batches):
        for b in batches:
            rows = []
            for text, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist()):
                lines = (text or "").split("\n")
                kept = lines
                if gone:
                    gone = {x % (1 << 64) for x in gone}
                    kept = [x for x in lines if (k := line_key(x, min_chars)) is None or key_hash(k) not in gone]
                rows.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
            cols = [pa.array(c, f.type) for c, f in zip(zip(*rows), out)] if rows else [pa.array([], f.type) for f in out]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("doc_id"), *cols], names=["doc", "doc_id", *out.names])

    schema = src.select("doc", "doc_id").schema
    for name, kind in (("n_lines", "long"), ("n_dropped", "long"), ("kept_text", "string")):
        schema = schema.add(name, kind)
    return (src.drop("text").join(dropped.hint("shuffle_hash"), ["no_id", "place"], "left")
            .select("doc", "doc_id", F.col("doc")[text_col].cast("string").alias("text"), "gone").mapInArrow(cut, schema))


def query(spark, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`dedup_lines` over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, i, list_extract(ls, i) AS line, n_lines
  FROM (SELECT doc_id, ls, len(ls) AS n_lines, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
drops AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.*, d.key IS NOT NULL AND k.doc_id <> d.last AS gone FROM keyed k LEFT JOIN drops d ON k.key = d.key)
SELECT doc_id, CAST(max(n_lines) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
