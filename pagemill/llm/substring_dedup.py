"""Substring dedup by seed and extend.

Every window of ``min_words`` words has one winnowed anchor: the hash of ``seed`` words that
is smallest in it (the rightmost of equal ones), so equal windows have equal anchors at the
same place. Three steps, each a map over documents and one shuffle of packed 64-bit hashes:

1. Seed: anchors meet on their hash; those of two documents or more are shared.
2. Extend: around a shared anchor, the match is extended both ways to every window of
   ``min_words`` words that it is the anchor of; these meet on their hash, and all but the
   smallest document's are repeats.
3. Merge: a document's overlapping repeated windows join to maximal repeats.

Equal hashes within one task are settled there, and only the smallest holder of each travels,
so a passage that a third of all documents share costs a shard one row per task. Nothing is
paired within a group, capped or sampled. Two different word sequences share a 64-bit hash
with probability 2**-64.

Defined cases: a null or empty text has no words; a document of fewer than ``min_words``
words loses none; a null id takes no part and loses nothing; rows of one id are one document
for judging repeats, and each row is reported; words repeated only within one document stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import (U64, doc_shard, doc_shard_np, groups, hash_shard_np, i64, ids_of, n_partitions, pack,
                                 rows_to_batches, tidy, u64)
from pagemill.llm.words import Words, ngrams, slices, split_words

ROUTE = "shard int, h binary, doc binary, kind binary"
FLAGGED = "shard int, h binary, doc binary"
ROUTE_ARROW = pa.schema([("shard", pa.int32()), ("h", pa.binary()), ("doc", pa.binary()), ("kind", pa.binary())])
FLAGGED_ARROW = pa.schema([("shard", pa.int32()), ("h", pa.binary()), ("doc", pa.binary())])
FLUSH = 1_000_000   # pairs held by a task before they are settled and sent


def window_anchors(words: Words, min_words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, anchor hash) of every window of ``min_words`` words within one text."""
    at, h = ngrams(words, seed)
    span = min_words - seed + 1
    m = len(at) - span + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    best = h[:m].copy()
    for j in range(1, span):
        np.minimum(best, h[j:m + j], out=best)
    ok = at[span - 1:] - at[:m] == span - 1     # all seeds lie in one text
    return at[:m][ok], best[ok]


def _settle(h: np.ndarray, doc: np.ndarray, shards: int):
    """Packed rows of (hash, document) pairs: kind 0 and 1 are the task's smallest holder of a
    hash, 1 if the task has others, which are sent as kind 2 to a shard of their document."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    start, end = groups(h)
    kind = np.full(len(h), 2, np.uint8)
    kind[start] = end - start > 1
    dest = np.where(kind == 2, doc_shard_np(doc, shards), hash_shard_np(h, shards))
    yield from pack(dest, h, doc, kind)


def _route(pairs, shards: int):
    """Settle and pack a task's (hashes, documents) in bounded pieces."""
    hs, ds, held = [], [], 0
    for h, doc in pairs:
        hs.append(h)
        ds.append(doc)
        held += len(h)
        if held >= FLUSH:
            yield from _settle(np.concatenate(hs), np.concatenate(ds), shards)
            hs, ds, held = [], [], 0
    if held:
        yield from _settle(np.concatenate(hs), np.concatenate(ds), shards)


def _meet(shards: int, later_only: bool):
    """Per partition: the (hash, document) pairs whose hash another document has too, or, with
    ``later_only``, a smaller document."""

    @tidy
    def run(batches):
        hs, ds, ks = [], [], []
        for b in batches:
            for h, d, k in zip(b.column("h"), b.column("doc"), b.column("kind")):
                hs.append(u64(h.as_py()))
                ds.append(i64(d.as_py()))
                ks.append(np.frombuffer(k.as_py(), np.uint8))
        if not hs:
            return
        h, doc, kind = np.concatenate(hs), np.concatenate(ds), np.concatenate(ks)
        del hs, ds, ks
        known = kind == 2
        out_h, out_d = [h[known]], [doc[known]]
        h, doc, kind = h[~known], doc[~known], kind[~known]
        order = np.lexsort((doc, h))
        h, doc, kind = h[order], doc[order], kind[order]
        start, end = groups(h)
        size = end - start
        if len(h):
            low = np.repeat(doc[start], size)
            if later_only:
                hit = doc > low
            else:
                several = (doc[end - 1] > doc[start]) | (np.maximum.reduceat(kind, start) > 0)
                hit = np.repeat(several, size)
            out_h.append(h[hit])
            out_d.append(doc[hit])
        h, doc = np.concatenate(out_h), np.concatenate(out_d)
        yield from rows_to_batches(pack(doc_shard_np(doc, shards), h, doc), FLAGGED_ARROW)

    return run


def _flags(left: pa.Table) -> dict[int, np.ndarray]:
    """document -> sorted hashes."""
    if not left.num_rows:
        return {}
    h = np.concatenate([u64(x.as_py()) for x in left.column("h")])
    doc = np.concatenate([i64(x.as_py()) for x in left.column("doc")])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    return {int(doc[a]): h[a:b] for a, b in zip(*groups(doc))}


def _isin(h: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    at = np.searchsorted(allowed, h)
    at[at == len(allowed)] = 0
    return allowed[at] == h


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 13,
                    seed: int = 7) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text, repeats (array of word ranges that were
    removed, end exclusive). See the module for what counts as a repeat."""
    spark = docs.sparkSession
    shards = n_partitions(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    @tidy
    def anchors(batches):
        def pairs():
            for b in (x for batch in batches for x in slices(batch)):
                ids, null = ids_of(b.column("doc_id"))
                w = split_words(b.column("text"))
                at, h = window_anchors(w, min_words, seed)
                doc = w.doc()[at] if len(at) else at
                ok = ~null[doc]
                if len(h):      # one pair for each run of windows with the same anchor
                    ok &= np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
                yield h[ok], ids[doc[ok]]

        yield from rows_to_batches(_route(pairs(), shards), ROUTE_ARROW)

    def windows(key, texts, flags):
        shared = _flags(flags)

        def pairs():
            for t in slices(texts):
                ids, null = ids_of(t.column("doc_id"))
                w = split_words(t.column("text"))
                at, anchor = window_anchors(w, min_words, seed)
                first, whole = ngrams(w, min_words)
                assert len(at) == len(first)
                bounds = np.searchsorted(at, w.first)
                for d in np.flatnonzero(np.diff(bounds)):
                    allowed = None if null[d] else shared.get(int(ids[d]))
                    if allowed is not None:
                        a, b = bounds[d], bounds[d + 1]
                        hit = whole[a:b][_isin(anchor[a:b], allowed)]
                        yield hit, np.full(len(hit), ids[d])

        rows = list(_route(pairs(), shards))
        return pa.Table.from_batches(rows_to_batches(rows, ROUTE_ARROW), ROUTE_ARROW)

    out_arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                           ("kept_text", pa.string()), ("repeats", pa.list_(pa.list_(pa.int64())))])

    def remove(key, texts, flags):
        repeated = _flags(flags)

        def rows():
            for t in slices(texts):
                ids, null = ids_of(t.column("doc_id"))
                w = split_words(t.column("text"))
                first, whole = ngrams(w, min_words)
                bounds = np.searchsorted(first, w.first)
                data = w.buf.tobytes()
                for d in range(len(ids)):
                    lo, hi = int(w.first[d]), int(w.first[d + 1])
                    gone = np.zeros(hi - lo, bool)
                    allowed = None if null[d] else repeated.get(int(ids[d]))
                    spans = []
                    if allowed is not None:
                        a, b = bounds[d], bounds[d + 1]
                        hits = first[a:b][_isin(whole[a:b], allowed)] - lo
                        cover = np.zeros(hi - lo + 1, np.int64)
                        np.add.at(cover, hits, 1)
                        np.add.at(cover, hits + min_words, -1)
                        gone = np.cumsum(cover)[:-1] > 0
                        edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
                        spans = edge.reshape(-1, 2).tolist()
                    keep = np.flatnonzero(~gone) + lo
                    text = b" ".join([data[s:e] for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist())])
                    yield (None if null[d] else int(ids[d]), hi - lo, int(gone.sum()), text.decode(), spans)

        return pa.Table.from_batches(rows_to_batches(rows(), out_arrow, 256), out_arrow)

    placed = src.withColumn("shard", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int"))
                            .otherwise(doc_shard(F.col("doc_id"), shards)))
    shared = (src.mapInArrow(anchors, ROUTE).repartition(shards, "shard")
              .mapInArrow(_meet(shards, later_only=False), FLAGGED))
    candidates = (placed.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(windows, ROUTE))
    repeated = candidates.repartition(shards, "shard").mapInArrow(_meet(shards, later_only=True), FLAGGED)
    return placed.groupBy("shard").cogroup(repeated.groupBy("shard")).applyInArrow(
        remove, "doc_id long, n_words long, n_removed long, kept_text string, repeats array<array<long>>")


def query(spark, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`substring_dedup` over all documents."""
    from pagemill.llm.common import table

    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
firsts AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
dup AS (SELECT win.doc_id, win.i FROM win JOIN firsts ON win.k = firsts.k WHERE firsts.f < win.doc_id),
words AS (SELECT doc_id, j, ws[j] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w)),
marked AS (
  SELECT words.doc_id, words.j, words.word,
         max(CASE WHEN dup.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY words.doc_id ORDER BY words.j ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM words LEFT JOIN dup ON dup.doc_id = words.doc_id AND dup.i = words.j)
SELECT d.doc_id, count(m.j) AS n_words, CAST(coalesce(sum(m.gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.j) FILTER (WHERE m.gone = 0), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""
