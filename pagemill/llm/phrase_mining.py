"""Operator 12: collocations of two to five words by partitioned, depth-truncated suffix trees.

Vertical partitioning as in ERA: Spark counts word prefixes of growing length. Words, then pairs,
that occur often enough pass a Bloom filter of fixed size to the workers (what a filter lets
through by mistake is counted and dropped later). Longer runs of such pairs are counted in hashed
cells of a fixed number, as by Park, Chen and Yu: a cell that stays below the least count holds no
phrase, so a suffix is cut where its next run falls into one. Pairs have their counts by then, so
only suffixes of three words and more are sent. Prefixes are grouped so that a group's suffixes fit
a memory budget; a prefix with more suffixes than the budget is extended by its next word, as often
as needed. A group then builds its subtree alone: its suffixes, sorted, with the counts that each
task has already added up for equal ones, give every node's count as the total of the leaves below
it. Nodes above an extended prefix get their totals from several groups, which Spark adds.

Words are 64-bit hashes of language and word (two differ in hash but for 2**-64); strings join
in again at the end. A pair is counted by a 64-bit key (two pairs of one first word differ in it but
for 2**-48), which gives its words back by two joins with the frequent words. Scores are exact: decimals of 38 digits.

Defined cases: a null language is ``und``, a null text is empty; null ids, repeated rows and extra
columns change nothing but counts. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pagemill.llm.common import Filter, cut_lineage, groups, n_partitions, pack, packed_bits, table, tidy
from pagemill.llm.lm_score import squeeze, unsqueeze
from pagemill.llm.words import LOWER, U64, hash_spans, mix, multipliers, slices, text_bytes

DEPTH, MIN_COUNT, TOP = 5, 100, 2000
FILTER_BITS, SEGMENT_BITS = 1 << 28, 1 << 22        # 32 MB a filter, whatever the input
GROUP_SUFFIXES = 1 << 20                            # some 50 MB a group
HELD = 1 << 20                                      # rows that a task adds up before it sends them
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
APART = ENDS.copy()
APART[[0x20, 0x09]] = True
_MARK = U64(0xA5A5F00D)     # key of a language's word total
FIRST = 48                  # a pair's key: above these bits those of the first word
_LOW = (1 << FIRST) - 1


def lang_hash(lang: str | None) -> int:
    return xxhash.xxh3_64_intdigest((lang if lang is not None else "und").encode())


def scan(batches):
    """Slices of the texts: (bytes, start, end, hash, language number, piece, languages); two
    words with one piece number lie in one piece."""
    for b in batches:
        for t in slices(b):
            buf, offsets = text_bytes(t.column("text"))
            buf = LOWER[buf]
            edge = np.zeros(len(buf) + 1, bool)
            edge[offsets] = True
            inside = np.r_[~APART[buf], False]
            before = np.r_[False, inside[:-1] & ~edge[1:]]
            start = np.flatnonzero(inside & ~before)
            end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge[1:])) + 1
            text = np.searchsorted(offsets, start, side="right") - 1
            piece = np.cumsum(ENDS[buf], dtype=np.int64)[start] + text if len(start) else text
            langs = t.column("lang").fill_null("und").dictionary_encode()
            names = langs.dictionary.to_pylist()
            keys = np.array([lang_hash(x) for x in names], U64) if names else np.zeros(0, U64)
            which = langs.indices.to_numpy(zero_copy_only=False)[text] if len(start) else text
            h = mix(hash_spans(buf, start, end) ^ keys[which]) | U64(1) if len(start) else np.zeros(0, U64)
            yield buf, start, end, h, which, piece, names, keys


def _joined(columns) -> np.ndarray:
    """Key of the words of each row. That of a pair gives its words back (see :func:`_pair_nodes`).
    Others are hashes of 40 bits, which shuffle narrower and only steer: two prefixes with one hash
    may pass a filter or be extended together; nodes are told apart by words."""
    if len(columns) == 2:
        a, b = columns
        return (a & ~U64(_LOW)) | (((b >> U64(1)) ^ (a >> U64(5))) & U64(_LOW))
    acc = np.zeros(len(columns[0]), U64)
    with np.errstate(over="ignore"):
        for m, c in zip(multipliers(DEPTH, 77), columns):
            acc += c * m
    return mix(acc) >> U64(24)


def _added(h, n):
    """Distinct hashes and the sums of their counts."""
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    a, _ = groups(h)
    return (h[a], np.add.reduceat(n, a)) if len(h) else (h, n)


class Held:
    """Hashes with counts, added up in a task before they are sent."""

    def __init__(self):
        self.h, self.n, self.size = [], [], 0

    def add(self, h):
        h, n = np.unique(h, return_counts=True)
        self.h.append(h)
        self.n.append(n.astype(np.int64))
        self.size += len(h)

    def taken(self, least: int = 0):
        """What is to be sent, in one piece and by ascending hash, if anything."""
        if self.size <= least:
            return
        h, n = _added(np.concatenate(self.h), np.concatenate(self.n))
        if len(h) * 2 <= self.size and least:       # equal ones were many: go on adding up
            self.h, self.n, self.size = [h], [n], len(h)
            return
        self.__init__()
        yield h, n

    def send(self, least: int = 0):
        for h, n in self.taken(least):
            yield from self._rows(h, n)

    @staticmethod
    def _rows(h, n):
        for a in range(0, len(h), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(h[a:a + (1 << 16)].view(np.int64)), pa.array(n[a:a + (1 << 16)])], names=["h", "n"])


def _bits(h):
    return np.concatenate([h, mix(h ^ U64(0x5DEECE66D))]) % U64(FILTER_BITS)


def _on(known: Filter, b: np.ndarray) -> np.ndarray:
    return (known.bits[(b >> U64(3)).astype(np.int64)] >> (b & U64(7)).astype(np.uint8)) & 1


def holds(known: Filter, h: np.ndarray) -> np.ndarray:
    """Which hashes a filter lets through."""
    return _on(known, _bits(h)).reshape(2, -1).all(axis=0)


def crowded(known: Filter, h: np.ndarray) -> np.ndarray:
    """Which hashes fall into a cell that reaches the least count."""
    return _on(known, h % U64(FILTER_BITS)) > 0


def _gathered(merged: DataFrame) -> Filter:
    """Filter of the merged segments. Their number and size are fixed, so they come in one job, whose
    tasks merge side by side; an iterator would run a job for each partition, one after another."""
    return Filter({row.segment: bytes(row.bits) for row in merged.collect()}, FILTER_BITS, SEGMENT_BITS)


def bloom(hashes: DataFrame) -> Filter:
    """Filter of the column ``h``: FILTER_BITS bits; segments are merged in Spark."""
    @tidy
    def send(batches):
        for b in batches:
            bits = np.unique(_bits(b.column("h").to_numpy(zero_copy_only=False).view(U64)))
            rows = list(pack((bits // U64(SEGMENT_BITS)).astype(np.int32), (bits % U64(SEGMENT_BITS)).astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                                             names=["segment", "bits"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(SEGMENT_BITS, bool)
        for b in batches:
            for x in b.column("bits"):
                out[np.frombuffer(x.as_py(), np.uint32)] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()),
                                          pa.array([packed_bits(out)], pa.binary())], names=["segment", "bits"])

    merged = hashes.select("h").mapInArrow(send, "segment int, bits binary").groupBy("segment").applyInArrow(merge, "segment int, bits binary")
    return _gathered(merged)


def _frequent(counts: DataFrame, min_count: int) -> DataFrame:
    return cut_lineage(counts.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))


def _word_counts(docs: DataFrame) -> DataFrame:
    """(h, n) rows of words, and of a language's mark with all its words."""
    @tidy
    def run(batches):
        held = Held()
        for *_, h, which, _, names, keys in scan(batches):
            marks = np.repeat(mix(keys ^ _MARK), np.bincount(which, minlength=len(keys))) if len(h) else h
            held.add(np.concatenate([h, marks]))
            yield from held.send(HELD)
        yield from held.send()

    return docs.mapInArrow(run, "h long, n long")


def _pairs_of(h, piece, bitmap):
    """At which words a pair of frequent words begins."""
    ok = holds(bitmap, h) if len(h) else np.zeros(0, bool)
    return np.flatnonzero(ok[:-1] & ok[1:] & (piece[:-1] == piece[1:])) if len(h) > 1 else np.zeros(0, np.int64)


def _pair_counts(docs: DataFrame, words) -> DataFrame:
    @tidy
    def run(batches):
        held = Held()
        for _, _, _, h, _, piece, _, _ in scan(batches):
            i = _pairs_of(h, piece, words.value)
            held.add(_joined([h[i], h[i + 1]]))
            yield from held.send(HELD)
        yield from held.send()

    return docs.mapInArrow(run, "h long, n long")


def _suffixes(h, piece, words, pairs, runs, depth: int) -> list[np.ndarray]:
    """Columns of the suffixes that begin with a frequent pair, cut before the first rare pair and,
    if ``runs`` is given, before the first run of three words and more in a cell below the count."""
    ok = np.zeros(len(h) + depth, bool)
    i = _pairs_of(h, piece, words)
    i = i[holds(pairs, _joined([h[i], h[i + 1]]))] if len(i) else i
    ok[i] = True
    longer = np.r_[h, np.zeros(depth, U64)]
    columns, live = [h[i]], np.ones(len(i), bool)
    for d in range(1, depth):
        live = live & ok[i + d - 1]
        if runs is not None and d >= 2:
            at = np.flatnonzero(live)
            live[at] = crowded(runs, _joined([*(c[at] for c in columns), longer[i[at] + d]]))
        columns.append(np.where(live, longer[i + d], U64(0)))
    return columns


def _crowded_cells(docs: DataFrame, words, pairs, min_count: int, depth: int) -> Filter:
    """The cells of runs of 3 to ``depth`` words that reach the least count: FILTER_BITS of them.
    Tasks send counts of the cells that they meet, a segment to a row; segments are added in Spark."""
    @tidy
    def run(batches):
        held = Held()

        def rows(least=0):
            for cell, n in held.taken(least):
                segment = cell // U64(SEGMENT_BITS)
                for a, b in zip(*groups(segment)):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(segment[a])], pa.int32()), pa.array([int(b - a)], pa.int32()),
                        pa.array([squeeze(np.diff(cell[a:b], prepend=segment[a] * U64(SEGMENT_BITS)).astype(np.uint32))], pa.binary()),
                        pa.array([squeeze(n[a:b].astype(np.uint32))], pa.binary())], names=["segment", "cells", "gaps", "counts"])

        for _, _, _, h, _, piece, _, _ in scan(batches):
            s = _suffixes(h, piece, words.value, pairs.value, None, depth)
            for d in range(3, depth + 1):
                s = [c[s[d - 1] != 0] for c in s]
                held.add(_joined(s[:d]) % U64(FILTER_BITS))
            yield from rows(HELD)
        yield from rows()

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SEGMENT_BITS, np.int64)
        for b in batches:
            for cells, gaps, counts in zip(*(b.column(c).to_pylist() for c in ("cells", "gaps", "counts"))):
                total[np.cumsum(unsqueeze(gaps, cells, np.uint32), dtype=np.int64)] += unsqueeze(counts, cells, np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()),
                                          pa.array([packed_bits(total >= min_count)], pa.binary())], names=["segment", "bits"])

    merged = docs.mapInArrow(run, "segment int, cells int, gaps binary, counts binary").groupBy("segment") \
        .applyInArrow(merge, "segment int, bits binary")
    return _gathered(merged)


def _pair_nodes(one: DataFrame, two: DataFrame) -> DataFrame:
    """(words, n) of frequent pairs from their keys: words that share the key's upper bits may be the
    first, and the right one leaves the bits of a frequent word."""
    first = one.select(F.col("h").alias("a"), F.shiftrightunsigned("h", FIRST).alias("upper"))
    second = one.select(F.col("h").alias("b"), F.shiftrightunsigned("h", 1).bitwiseAND(F.lit(_LOW)).alias("lower"))
    return two.withColumn("upper", F.shiftrightunsigned("h", FIRST)).join(first, "upper") \
        .withColumn("lower", F.col("h").bitwiseXOR(F.shiftrightunsigned("a", 5)).bitwiseAND(F.lit(_LOW))).join(second, "lower") \
        .select(F.array("a", "b").alias("words"), "n")


def _prefix_counts(docs: DataFrame, words, pairs, runs, heavy: list, depth: int) -> DataFrame:
    """(h, n) of the prefixes of ``depth + 1`` words below the heavy ones of ``depth`` words."""
    @tidy
    def run(batches):
        held = Held()
        for _, _, _, h, _, piece, _, _ in scan(batches):
            s = _suffixes(h, piece, words.value, pairs.value, runs.value, depth + 1)
            live = s[depth] != 0
            s = [c[live] for c in s]
            below = np.isin(_joined(s[:depth]), heavy[-1].value)
            held.add(_joined([c[below] for c in s]))
            yield from held.send(HELD)
        yield from held.send()

    return docs.mapInArrow(run, "h long, n long")


def _distinct(columns, n):
    """Sorted distinct rows with the sums of their counts."""
    order = np.lexsort(columns[::-1])
    columns, n = [c[order] for c in columns], n[order]
    new = np.zeros(len(n), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    a = np.flatnonzero(new)
    return [c[a] for c in columns], np.add.reduceat(n, a) if len(a) else n


def _sent(docs: DataFrame, words, pairs, runs, heavy: list, bins: int, depth: int) -> DataFrame:
    """Rows (bin, w1 to w``depth``, n) of suffixes of three words and more, equal ones of a task added up."""
    names = ["bin", *(f"w{d + 1}" for d in range(depth)), "n"]

    def added(parts):
        return _distinct([np.concatenate(c) for c in zip(*(p[0] for p in parts))], np.concatenate([p[1] for p in parts]))

    def send(s, n):
        prefix = _joined(s[:2])
        for d, known in enumerate(heavy):       # heavy prefixes of d + 2 words are extended by a word
            more = np.isin(prefix, known.value) & (s[d + 2] != 0) if d + 2 < depth else np.zeros(len(n), bool)
            prefix = np.where(more, _joined(s[:d + 3]), prefix)
        to = (mix(prefix) % U64(bins)).astype(np.int32)
        for a in range(0, len(n), 1 << 16):
            b = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(to[b]), *(pa.array(c[b].view(np.int64)) for c in s), pa.array(n[b])], names=names)

    @tidy
    def run(batches):
        parts, held = [], 0
        for _, _, _, h, _, piece, _, _ in scan(batches):
            s = _suffixes(h, piece, words.value, pairs.value, runs.value, depth)
            s = [c[s[2] != 0] for c in s]
            parts.append((s, np.ones(len(s[0]), np.int64)))
            held += len(s[0])
            if held >= HELD:
                s, n = added(parts)
                if 4 * len(n) <= 3 * held:          # equal ones were many: go on adding up
                    parts, held = [(s, n)], len(n)
                else:
                    yield from send(s, n)
                    parts, held = [], 0
        if held:
            yield from send(*added(parts))

    return docs.mapInArrow(run, "bin int, " + ", ".join(f"w{d + 1} long" for d in range(depth)) + ", n long")


def _subtrees(sent: DataFrame, heavy: list, min_count: int, depth: int) -> DataFrame:
    """(words, n) of the nodes of at least three words, from the leaves of each bin's subtree."""
    schema = pa.schema([("words", pa.list_(pa.int64())), ("n", pa.int64())])

    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, counts = [], []
        for b in batches:
            cols.append([b.column(f"w{d + 1}").to_numpy(zero_copy_only=False).view(U64) for d in range(depth)])
            counts.append(b.column("n").to_numpy(zero_copy_only=False))
        s, n = _distinct([np.concatenate(c) for c in zip(*cols)], np.concatenate(counts))
        new = np.zeros(len(n), bool)
        new[0] = True
        new[1:] = (s[0][1:] != s[0][:-1]) | (s[1][1:] != s[1][:-1])
        for d in range(3, depth + 1):
            new[1:] |= s[d - 1][1:] != s[d - 1][:-1]
            a = np.flatnonzero(new)
            total = np.add.reduceat(n, a)
            keep = s[d - 1][a] != 0
            if d - 2 < len(heavy):      # an extended prefix has leaves in several bins
                keep &= (total >= min_count) | np.isin(_joined([c[a] for c in s[:d]]), heavy[d - 2].value)
            else:
                keep &= total >= min_count
            a, total = a[keep], total[keep]
            for x in range(0, len(a), 1 << 14):
                at = a[x:x + (1 << 14)]
                rows = np.stack([c[at] for c in s[:d]], axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * d), pa.array(rows.ravel())),
                    pa.array(total[x:x + (1 << 14)])], schema=schema)

    nodes = sent.groupBy("bin").applyInArrow(build, "words array<long>, n long")
    return nodes.groupBy("words").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _names(docs: DataFrame, words) -> DataFrame:
    """(h, lang, word) of the words in the filter, and of each language's mark with an empty word."""
    @tidy
    def run(batches):
        seen: set[int] = set()
        for buf, start, end, h, which, _, names, keys in scan(batches):
            rows = [(int(x), names[i], "") for i, x in enumerate(mix(keys ^ _MARK)) if int(x) not in seen]
            u, first = np.unique(h, return_index=True)
            hit = holds(words.value, u) if len(u) else np.zeros(0, bool)
            rows += [(int(x), names[which[i]], buf[start[i]:end[i]].tobytes().decode()) for x, i in zip(u[hit], first[hit]) if int(x) not in seen]
            seen.update(r[0] for r in rows)
            if len(seen) > HELD:
                seen = set()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.array([r[0] for r in rows], U64).view(np.int64)),
                                                  pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], names=["h", "lang", "word"])

    return docs.mapInArrow(run, "h long, lang string, word string").dropDuplicates(["h"])


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, depth: int = DEPTH, group_suffixes: int = GROUP_SUFFIXES) -> tuple[DataFrame, DataFrame]:
    """(words as hashes, n) of all phrases of 1 to ``depth`` words that occur ``min_count`` times
    within pieces, and (h, lang, word) of the words of those of two and more; a language's mark
    counts its words."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    one = _frequent(_word_counts(docs), min_count)
    words = sc.broadcast(bloom(one))
    two = _frequent(_pair_counts(docs, words), min_count)
    pairs = sc.broadcast(bloom(two))
    runs = sc.broadcast(_crowded_cells(docs, words, pairs, min_count, depth))
    parts = n_partitions(docs.sparkSession)
    total = two.agg(F.sum("n")).first()[0] or 0
    budget = min(group_suffixes, max(256, total // (4 * parts)))
    heavy, level = [], two
    for d in range(2, depth):
        # at most total / budget of them: a fixed share of the suffixes, or a few for each task
        found = np.sort(np.array([r.h for r in level.filter(F.col("n") > budget).select("h").collect()], np.int64).view(U64))
        if not len(found):
            break
        heavy.append(sc.broadcast(found))
        if d + 1 < depth:
            level = _frequent(_prefix_counts(docs, words, pairs, runs, heavy, d), min_count)
    bins = max(2 * parts, 2 * total // budget, 1)
    nodes = one.select(F.array("h").alias("words"), "n").unionByName(_pair_nodes(one, two))
    if depth > 2:
        nodes = nodes.unionByName(_subtrees(_sent(docs, words, pairs, runs, heavy, bins, depth), heavy, min_count, depth))
    counted = cut_lineage(nodes)
    for sent in (words, pairs, runs, *heavy):     # their readers are written
        sent.destroy()
    # only words of a phrase need their strings
    used = counted.filter(F.size("words") >= 2).select(F.explode("words").alias("h")).distinct()
    phrased = sc.broadcast(bloom(used))
    names = cut_lineage(_names(docs, phrased))
    phrased.destroy()
    return counted, names


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, depth: int = DEPTH, top: int | None = TOP,
                 group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the phrases of two words and more; all of them if
    ``top`` is None."""
    counted, names = phrases(docs, min_count, depth, group_suffixes)
    long = counted.filter(F.size("words") >= 2)
    # inside a longer phrase that is as frequent: dropped
    inner = long.filter(F.size("words") >= 3).select(F.col("n").alias("outer"), "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("m")) \
        .select("outer", "words", "m", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)).alias("from")) \
        .select("outer", F.slice("words", F.col("from"), F.col("m")).alias("words")).groupBy("words").agg(F.max("outer").alias("outer"))
    kept = long.join(inner, "words", "left").filter(F.coalesce(F.col("outer"), F.lit(0)) < F.col("n")).select("words", F.col("n").alias("a"))
    cut = kept.select("words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")) \
        .select("words", "a", "k", F.expr("slice(words, 1, k)").alias("first"), F.expr("slice(words, k + 1, size(words) - k)").alias("rest"))
    count_of = lambda part, out: counted.select(F.col("words").alias(part), F.col("n").alias(out))
    cut = cut.join(count_of("first", "l"), "first").join(count_of("rest", "r"), "rest")
    # words of a phrase share their language: its total is under the language's mark
    w = names.filter("word <> ''").select(F.col("h").alias("w"), "lang", "word")
    total = names.filter("word = ''").join(counted.filter(F.size("words") == 1).select(F.col("words")[0].alias("h"), "n"), "h").select("lang", "n")
    text = kept.select("words", F.posexplode("words").alias("at", "w")).join(w, "w").groupBy("words").agg(
        F.first("lang").alias("lang"), F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x.word)).alias("phrase"))
    exact = F.expr("(cast(a as decimal(15,0)) * cast(1000 as decimal(4,0)) * cast(n as decimal(15,0))) div "
                   "(cast(l as decimal(19,0)) * cast(r as decimal(19,0)))").cast("long")
    best = cut.join(text.select("words", "lang"), "words").join(total, "lang").withColumn("score", exact) \
        .groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("s")) \
        .join(text.select("words", "phrase"), "words").select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is None:
        return best
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return best.withColumn("rank", rank).filter(F.col("rank") <= top) \
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws)) AS n FROM words GROUP BY lang),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: ws[i:i + m - 1])) AS p
  FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(ws) >= m),
f AS (SELECT lang, p, any_value(m) AS m, count(*) AS a FROM grams GROUP BY lang, p HAVING count(*) >= 100),
inner_ AS (SELECT lang, p[i:i + k - 1] AS p, max(a) AS outer_a FROM (
    SELECT lang, p, a, k, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM f WHERE m >= 3)) GROUP BY 1, 2),
kept AS (SELECT f.* FROM f LEFT JOIN inner_ o ON f.lang = o.lang AND f.p = o.p WHERE f.m >= 2 AND coalesce(o.outer_a, 0) < f.a),
cuts AS (SELECT c.lang, c.p, c.a, c.k, l.a AS l, r.a AS r, t.n,
    (CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM kept) c JOIN f l ON l.lang = c.lang AND l.p = c.p[1:c.k]
  JOIN f r ON r.lang = c.lang AND r.p = c.p[c.k + 1:] JOIN totals t ON t.lang = c.lang),
best AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000
"""
