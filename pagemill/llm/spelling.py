"""Operator 13: spelling variants by search schemes over FM-indexes of the delimited vocabulary.

Words that differ in one code point share the left or the right half of either: a search matches
one half exactly and then extends across the other half, allowing one inserted, deleted or replaced
code point. Extension works on suffix-rank intervals of an FM-index: one over the reversed words,
which extends to the right from the delimiter before a word, and one over the words as they are,
which extends to the left from the delimiter behind it. The vocabulary is ranked by word for the
one and by reversed word for the other and cut into blocks of ``BLOCK`` words, each with an index
of its own. A word is looked up in the blocks whose range holds its exact half, mostly one or two;
look-ups stream through a block's index, so a task holds one block, whatever its look-ups. Each
near word is found once: an edit in a run of equal letters counts at the end of the run, and what
shares the left half is left to the first search.

A block returns one row for a word: how many near words it has there and the best one.

Defined cases: a null text has no words, a null id counts as an empty one before the colon; repeated
rows count repeatedly; extra columns are ignored; an empty table gives an empty result. Ties of
counts go to the smallest word in code-point order.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.llm.common import cut_lineage, n_partitions, rows_to_batches, table, tidy
from pagemill.llm.words import LOWER, hash_spans, slices, text_bytes
from pagemill.operators.joins import rank_in_group

EDITED, MIN_LENGTH, MIN_COUNT, RATIO = 97, 5, 3, 2
BLOCK = 8192            # words of an index
DENSE = 1 << 23         # entries of a rank table (32 MB); a block of longer words ranks by search
LOOK_UPS = 2048         # words that a block looks up at once
HELD = 300_000          # words that a task adds up before it sends them


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def crc32_spans(buf, start, end, state) -> np.ndarray:
    """CRC-32 of each byte span after what ``state`` has already taken in."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    s, n, c = start[order], length[order], state[order] ^ np.uint32(0xFFFFFFFF)
    for p in range(min(64, int(n[0])) if len(n) else 0):
        live = int(np.searchsorted(-n, -p, side="left"))
        c[:live] = _CRC[(c[:live] ^ buf[s[:live] + p]) & np.uint32(255)] ^ (c[:live] >> np.uint32(8))
    out = np.empty_like(c)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > 64):
        out[i] = zlib.crc32(buf[start[i] + 64:end[i]].tobytes(), int(out[i]))
    return out


def runs(buf: np.ndarray, offsets: np.ndarray):
    """(start, end, code points) of the maximal runs of letters a-z and U+00C0 to U+00FF in
    lower-cased UTF-8 bytes."""
    lead = buf == 0xC3
    second = np.r_[False, lead[:-1]] & (buf >= 0x80) & (buf <= 0xBF)
    inside = np.r_[((buf >= ord("a")) & (buf <= ord("z"))) | lead | second, False]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & ~np.r_[False, inside[:-1] & ~edge[1:]])
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge[1:])) + 1
    seconds = np.r_[0, np.cumsum(second)]
    return start, end, end - start - (seconds[end] - seconds[start])


def word_counts(docs: DataFrame, min_count: int = MIN_COUNT, min_length: int = MIN_LENGTH, edited: int = EDITED) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text)."""
    @tidy
    def run(batches):
        held: dict[bytes, int] = {}

        def sent():
            words, n = list(held), np.fromiter(held.values(), np.int64, len(held))
            held.clear()
            for a in range(0, len(words), 1 << 15):
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words[a:a + (1 << 15)]]), pa.array(n[a:a + (1 << 15)])], names=["word", "n"])

        for b in batches:
            for t in slices(b, most=1 << 21):
                buf, offsets = text_bytes(t.column("text"))
                buf = LOWER[buf]
                start, end, chars = runs(buf, offsets)
                if not len(start):
                    continue
                first = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in t.column("doc_id").to_pylist()], np.uint32)
                h = crc32_spans(buf, start, end, first[np.searchsorted(offsets, start, side="right") - 1])
                hit = h % np.uint32(edited) == 0
                for i in np.flatnonzero(hit & (chars > min_length)):
                    w = buf[start[i]:end[i]].tobytes().decode()
                    at = int(h[i]) % len(w)
                    w = (w[:at] + w[at + 1:]).encode()
                    held[w] = held.get(w, 0) + 1
                keep = ~hit & (chars >= min_length)
                start, end = start[keep], end[keep]
                _, at, n = np.unique(hash_spans(buf, start, end), return_index=True, return_counts=True)
                whole = buf.tobytes()
                for a, z, k in zip(start[at].tolist(), end[at].tolist(), n.tolist()):
                    w = whole[a:z]
                    held[w] = held.get(w, 0) + k
                if len(held) > HELD:
                    yield from sent()
        yield from sent()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class Index:
    """FM-index of delimited words, read backwards: a search begins at the delimiter behind a word
    and each step extends the matched end of it by the code point before."""

    def __init__(self, words: list[str]):
        self.chars, text = np.unique(np.frombuffer(("\x00" + "\x00".join(words) + "\x00").encode("utf-32-le"), np.uint32), return_inverse=True)
        text = text.astype(np.int64)
        n = len(text)
        rank = text.copy()
        step = 1
        while True:     # prefix doubling; the end of the text is smaller than anything
            key = rank * (n + 1) + np.r_[rank[step:] + 1, np.zeros(min(step, n), np.int64)][:n]
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.r_[0, np.cumsum(key[1:] != key[:-1])]
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                break
            step *= 2
        self.n, self.at = n, order
        self.bwt = text[order - 1]
        count = np.bincount(text, minlength=len(self.chars))
        self.first = np.r_[0, np.cumsum(count)[:-1]]
        self.word = np.cumsum(text == 0) - 1        # of each place of the text, its delimiter included
        if len(self.chars) * (n + 1) <= DENSE:
            self.table = np.zeros((n + 1, len(self.chars)), np.int32)
            self.table[np.arange(1, n + 1), self.bwt] = 1
            np.cumsum(self.table, axis=0, out=self.table)
        else:
            self.table, self.keys = None, np.sort(self.bwt * (n + 1) + np.arange(n))
            self.starts = np.r_[0, np.cumsum(np.bincount(self.bwt, minlength=len(self.chars)))[:-1]]

    def _rank(self, c, row):
        if self.table is not None:
            return self.table[row, c]
        return np.searchsorted(self.keys, c * (self.n + 1) + row) - self.starts[c]

    def extend(self, c, lo, hi):
        """Suffix-rank intervals of what ``c`` and then the intervals' strings spell."""
        return self.first[c] + self._rank(c, lo), self.first[c] + self._rank(c, hi)

    def near(self, words: list[str], exact: np.ndarray):
        """(number of the given word, number of an indexed word) of all words that differ from a
        given one by one edit behind its first ``exact`` code points. Words are given in reading
        order of the search, that is reversed against the indexed ones."""
        size = np.array([len(w) for w in words], np.int64)
        width = int(size.max()) + 2
        codes = np.zeros((len(words), width), np.uint32)       # the delimiter ends each word
        for i, w in enumerate(words):
            codes[i, :len(w)] = np.frombuffer(w.encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.chars, codes)
        known = self.chars[np.minimum(at, len(self.chars) - 1)] == codes
        at = np.where(known, at, -1)
        who = np.arange(len(words))
        lo, hi = np.zeros(len(words), np.int64), np.full(len(words), self.first[1] if len(self.chars) > 1 else self.n)
        bad = [np.zeros(0, np.int64)] * 4      # states with an edit: word, next place, lo, hi
        found = []
        for p in range(width):
            # one edit at place p
            open_ = who[(p >= exact[who]) & (p <= size[who])]
            if len(open_):
                l, h, own = lo[open_], hi[open_], at[open_, p]
                w, c = self._followers(l, h)
                ok = (c != 0) & (c != own[w])
                w, c = w[ok], c[ok]
                nl, nh = self.extend(c, l[w], h[w])
                inside = p < size[open_][w]
                # replaced: go on behind p; inserted: go on at p; deleted: skip p, the last of a run of equal ones
                gone = (p < size[open_]) & (at[open_, np.minimum(p + 1, width - 1)] != own) | (p < size[open_]) & (own < 0) \
                    & (codes[open_, np.minimum(p + 1, width - 1)] != codes[open_, p])
                bad = [np.concatenate(x) for x in zip(
                    bad, (open_[w][inside], np.full(int(inside.sum()), p + 1), nl[inside], nh[inside]),
                    (open_[w], np.full(len(w), p), nl, nh),
                    (open_[gone], np.full(int(gone.sum()), p + 1), l[gone], h[gone]))]
            # states with an edit whose next place is p go on without
            now = bad[1] == p
            b, l, h = bad[0][now], bad[2][now], bad[3][now]
            done = p == size[b]
            c = at[b, p]
            fits = c >= 0
            b, c, done = b[fits], c[fits], done[fits]
            l, h = self.extend(c, l[fits], h[fits])
            alive = h > l
            end = alive & done
            found.append((b[end], l[end]))
            on = alive & ~done
            bad = [np.concatenate([x[~now], y]) for x, y in zip(bad, (b[on], np.full(int(on.sum()), p + 1), l[on], h[on]))]
            # exact states
            who = who[p < size[who]]
            c = at[who, p]
            who = who[c >= 0]
            lo[who], hi[who] = self.extend(at[who, p], lo[who], hi[who])
            who = who[hi[who] > lo[who]]
            if not len(who) and not len(bad[0]):
                break
        b, row = (np.concatenate(x) for x in zip(*found))
        # the row is the delimiter before the word: the text goes on with it
        return b, self.word[self.at[row]]

    def _followers(self, lo, hi):
        """(state, code point) of all that can extend the states: read from short intervals, and
        ranked for each code point in long ones."""
        short = hi - lo <= 2 * len(self.chars)
        s = np.flatnonzero(short)
        n = (hi - lo)[s]
        state = np.repeat(s, n)
        row = np.arange(len(state)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[s], n)
        pair = np.unique(state * len(self.chars) + self.bwt[row])
        w, c = pair // len(self.chars), pair % len(self.chars)
        wide = np.flatnonzero(~short)
        if len(wide):
            ww, cc = np.repeat(wide, len(self.chars)), np.tile(np.arange(len(self.chars)), len(wide))
            has = self._rank(cc, hi[ww]) > self._rank(cc, lo[ww])
            w, c = np.concatenate([w, ww[has]]), np.concatenate([c, cc[has]])
        return w, c


def _exact(size: int, reverse: bool) -> int:
    return size - size // 2 if reverse else size // 2


def _best(index: Index, words: list[str], counts: np.ndarray, members: list[str], n: np.ndarray, reverse: bool):
    """(word, near words, largest count, its smallest word) of looked-up words with a near one."""
    exact = np.array([_exact(len(w), reverse) for w in words], np.int64)
    q, x = index.near(words, exact)
    if reverse and len(q):      # what shares the left half is found by the other search
        half = [len(w) // 2 for w in words]
        keep = np.fromiter((not (len(members[j]) >= half[i] and members[j][len(members[j]) - half[i]:] == words[i][len(words[i]) - half[i]:])
                            for i, j in zip(q.tolist(), x.tolist())), bool, len(q))
        q, x = q[keep], x[keep]
    best: dict[int, list] = {}
    for i, j, k in zip(q.tolist(), x.tolist(), n[x].tolist()):
        w = members[j][::-1] if reverse else members[j]
        b = best.get(i)
        if b is None:
            best[i] = [1, k, w]
        else:
            b[0] += 1
            if k > b[1] or k == b[1] and w < b[2]:
                b[1:] = k, w
    for i, (near, k, w) in best.items():
        yield words[i][::-1] if reverse else words[i], near, k, w


def near_words(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of the words of ``vocabulary`` (word, n) with a near word."""
    spark = vocabulary.sparkSession
    both = vocabulary.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")) \
        .select("side", F.when(F.col("side") == 1, F.reverse("word")).otherwise(F.col("word")).alias("u"), "n")
    placed = cut_lineage(rank_in_group(both, ["side"], ["u"], "rank")
                         .select("side", "u", "n", F.floor((F.col("rank") - 1) / block).cast("int").alias("block")))
    # one row for each ``block`` words
    bounds = [[], []]
    for r in placed.groupBy("side", "block").agg(F.min("u").alias("u")).orderBy("side", "block").toLocalIterator():
        bounds[r.side].append(r.u)
    known = spark.sparkContext.broadcast(bounds)
    schema = pa.schema([("side", pa.int32()), ("block", pa.int32()), ("asked", pa.int32()), ("u", pa.string()), ("n", pa.int64())])

    @tidy
    def ask(batches):
        starts = known.value

        def rows():
            for b in batches:
                for side, u, n, own in zip(*(b.column(c).to_pylist() for c in ("side", "u", "n", "block"))):
                    yield side, own, 0, u, n
                    half = u[:_exact(len(u), side == 1)]
                    first = max(0, bisect_right(starts[side], half) - 1)
                    for k in range(first, max(first + 1, bisect_left(starts[side], half + "\U0010ffff"))):
                        yield side, k, 1, u, n

        yield from rows_to_batches(rows(), schema, 1 << 14)

    @tidy
    def search(batches):
        out = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

        def rows():
            place, members, n, index, asked = None, [], [], None, []
            for b in batches:
                for side, k, q, u, m in zip(*(b.column(c).to_pylist() for c in ("side", "block", "asked", "u", "n"))):
                    if (side, k) != place:
                        if asked:
                            yield from _best(index, [x for x, _ in asked], None, members, np.array(n), place[0] == 1)
                        place, members, n, index, asked = (side, k), [], [], None, []
                    if not q:
                        members.append(u)
                        n.append(m)
                        continue
                    if index is None:
                        index = Index([x[::-1] for x in members])
                    asked.append((u, m))
                    if len(asked) == LOOK_UPS:
                        yield from _best(index, [x for x, _ in asked], None, members, np.array(n), side == 1)
                        asked = []
            if asked:
                yield from _best(index, [x for x, _ in asked], None, members, np.array(n), place[0] == 1)

        yield from rows_to_batches(rows(), out, 1 << 13)

    found = placed.select("side", "u", "n", "block").mapInArrow(ask, "side int, block int, asked int, u string, n long") \
        .repartition(n_partitions(spark), "side", "block").sortWithinPartitions("side", "block", "asked") \
        .mapInArrow(search, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("b")) \
        .select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form), no form null: the last of each chain of forms, by
    pointer jumping; counts at least double along a chain, so some five rounds end the longest."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = cut_lineage(at.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if nxt.filter("moved").isEmpty():
            return nxt.select("word", "root")
        at = nxt.select("word", "root")


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of ``docs`` (doc_id, text)."""
    words = cut_lineage(word_counts(docs))
    found = cut_lineage(words.join(near_words(words), "word", "left")
                        .withColumn("form", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))))
    last = roots(found.filter(F.col("form").isNotNull()).select("word", "form"))
    return found.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


# CRC-32 by its rule; near words meet by what is left when one code point is taken out.
SQL = """
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, CAST(i AS BIGINT) AS v FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
found AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM found GROUP BY doc_id, run),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, CAST(length(x) AS BIGINT), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
    lambda c, b: xor(t[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8)), 4294967295) AS h FROM runs, crc),
words AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest, substr(word, i, 1) AS c
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.c <> b.c
  UNION SELECT DISTINCT a.word, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM v a JOIN cut b ON b.rest = a.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, encode(other))) AS best, max(n) AS best_n FROM near GROUP BY word),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form,
  CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n FROM v LEFT JOIN best ON v.word = best.word),
chain AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT chain.word, f.form FROM chain JOIN formed f ON f.word = chain.at WHERE f.form IS NOT NULL),
last AS (SELECT chain.word, chain.at AS root FROM chain JOIN formed f ON f.word = chain.at WHERE f.form IS NULL)
SELECT formed.word, form, root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM formed JOIN last ON formed.word = last.word
"""
