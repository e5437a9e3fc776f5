"""LM scoring: an interpolated modified Kneser-Ney bigram model over the words of the corpus.

Nothing of the model is held in one place, so it grows with the corpus:

1. Each map task sends, per model shard, its distinct bigrams with their training counts and the
   documents that hold them. Shards are chosen by the first word, so a shard has all of a context;
   the bigrams of heavy first words are spread over all shards by their second word.
2. A shard merges the counts and asks the home shards of its second words for their continuation
   and token counts, sending its own part of them along.
3. Home shards sum the parts up and answer in the order of the request. Global figures (counts of
   counts, token and type totals) are one aggregated row.
4. A shard writes its model - sorted hash arrays with log probabilities - to a file that it maps
   into memory, looks up every bigram of every document sent to it, and sends per document sums on.

Words are 48-bit hashes: two given words share one with probability 2**-48, two bigrams their
64-bit key with 2**-64. The end of a text is a token, and the context of the first one.

The order is two. With three the distinct n-grams are nearly as many as the tokens here, and their
shuffles for context and continuation counts pass four times the input.

Defined cases: null and empty texts hold the end alone; a null id counts as the empty text for the
split and trains; rows of one id are scored each by itself; without training texts every token
has probability 1 / (V + 1) with V = 0.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import U64, groups, i64, n_partitions, rows_to_batches, table, tidy, u64
from pagemill.llm.kneser_ney import count_of_counts, discounted, discounts, find, left_over
from pagemill.llm.words import mix, slices, split_words

HELD_OUT_OF, HELD_OUT = 7, 2
END = U64(0)            # the word number of a text's end; no word hash is 0
HEAVY = 1024            # at most so many heavy words, each with more than 1 / HEAVY of a task's tokens
TASK_TOKENS = 2_000_000     # tokens that a map task holds before it sends them on


def squeeze(a: np.ndarray) -> bytes:
    """Compressed integers: bytes of equal weight stand together, so zeros cost nothing."""
    a = np.ascontiguousarray(a)
    if not len(a):
        return b""
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return pa.compress(planes, "zstd", asbytes=True)


def unsqueeze(blob: bytes, n: int, kind=np.uint64) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    planes = pa.decompress(blob, decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).ravel()


def word_numbers(h: np.ndarray) -> np.ndarray:
    return np.maximum(h >> U64(16), U64(1))


def pair_keys(w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    return mix(mix(w1) + w2)


def home(w: np.ndarray, shards: int) -> np.ndarray:
    return (mix(w) >> U64(33)) % U64(shards)


def shard_of(w1: np.ndarray, w2: np.ndarray, heavy: np.ndarray, shards: int) -> np.ndarray:
    h = home(w1, shards)
    return np.where(find(heavy, w1)[1], (h + home(w2, shards)) % U64(shards), h).astype(np.int32)


def mapped(a: np.ndarray) -> np.ndarray:
    """The array in a file that is mapped into memory; the file goes with the mapping."""
    if not len(a):
        return a
    with tempfile.TemporaryFile() as f:
        f.write(np.ascontiguousarray(a).data)
        f.flush()
        return np.memmap(f, dtype=a.dtype, mode="r", shape=a.shape)


# ---- messages: one row layout for all steps, with the meaning of a to g by kind
ROW = "shard int, kind int, src int, n long, m long, a binary, b binary, c binary, d binary, e binary"
ROW_ARROW = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("src", pa.int32()), ("n", pa.int64()), ("m", pa.int64()),
                       *((x, pa.binary()) for x in "abcde")])
DOCS, PAIRS, ASK, CONTEXT, STATS, ANSWER, HEAVY_CONTEXT, SUMS = range(8)


def _tokens(b) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, context, token) of all tokens of a batch, and tokens per text."""
    w = split_words(b.column("text"), lower=True)
    n = w.counts + 1
    total = int(n.sum())
    token = np.zeros(total, U64)
    last = np.cumsum(n) - 1
    inner = np.ones(total, bool)
    inner[last] = False
    token[inner] = word_numbers(w.hash)
    context = np.zeros(total, U64)
    context[1:] = token[:-1]
    return np.repeat(np.arange(len(n)), n), context, token, n


def heavy_words(src: DataFrame) -> np.ndarray:
    """Words that would crowd a shard, at most HEAVY: only the balance depends on them."""
    def run(batches):
        for batch in batches:
            for b in slices(batch, most=4 << 20):
                _, context, _, _ = _tokens(b)
                w, n = np.unique(context, return_counts=True)
                big = n > max(16, len(context) // HEAVY)
                yield pa.RecordBatch.from_arrays([pa.array(w[big].view(np.int64)), pa.array(n[big])], names=["w", "n"])

    top = (src.select("text").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "w").limit(HEAVY).collect())
    return np.unique(np.array([r.w for r in top] + [0], np.int64).view(U64))


def _send(part: int, shards: int, heavy: np.ndarray):
    """Map side: DOCS rows (ids, flags, token counts) and PAIRS rows (bigrams, counts, texts)."""
    def settle(held, base):
        doc, context, token, train = (np.concatenate(x) for x in zip(*held))
        doc = doc - base
        shard = shard_of(context, token, heavy, shards)
        order = np.lexsort((doc, token, context, shard))
        doc, context, token, train, shard = (x[order] for x in (doc, context, token, train, shard))
        del order
        for s, e in zip(*groups(shard)):
            w1, w2 = context[s:e], token[s:e]
            new = np.flatnonzero(np.r_[True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
            counts = np.add.reduceat(train[s:e].astype(np.uint32), new).astype(np.uint32)
            times = np.diff(np.r_[new, e - s]).astype(np.uint32)
            w1, w2 = w1[new], w2[new]
            yield (int(shard[s]), PAIRS, part, len(new), e - s, squeeze(np.diff(w1, prepend=U64(0))), squeeze(w2),
                   squeeze(counts), squeeze(times), np.uint32(base).tobytes() + squeeze(doc[s:e].astype(np.uint32)))

    def run(batches):
        ids, flags, sizes = [], [], []
        held, tokens, seen, base = [], 0, 0, 0
        for b in (x for batch in batches for x in slices(batch)):
            doc, context, token, n = _tokens(b)
            out = b.column("held_out").to_numpy(zero_copy_only=False)
            ids.append(b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            flags.append(out.astype(np.uint8) | b.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.uint8) << 1)
            sizes.append(n)
            held.append(((doc + seen).astype(np.int32), context, token, ~out[doc]))
            seen += len(n)
            tokens += len(doc)
            if tokens >= TASK_TOKENS:
                yield from settle(held, base)
                held, tokens, base = [], 0, seen
        if held:
            yield from settle(held, base)
        if seen:
            yield (part % shards, DOCS, part, seen, 0, np.concatenate(ids).tobytes(), np.concatenate(flags).tobytes(),
                   np.concatenate(sizes).astype(np.int64).tobytes(), None, None)

    return run


def _rows(t: pa.Table, kind: int):
    """Rows of a kind, in a fixed order whatever order they arrived in."""
    found = [r for r in t.to_pylist() if r["kind"] == kind]
    return sorted(found, key=lambda r: (r["src"], r["e"] or b""))


class Shard:
    """A shard's merged bigrams: sorted keys with words and training counts."""

    def __init__(self, rows: list[dict]):
        parts = []
        for r in rows:
            w1 = np.cumsum(unsqueeze(r["a"], r["n"]), dtype=U64)
            parts.append((w1, unsqueeze(r["b"], r["n"]), unsqueeze(r["c"], r["n"], np.uint32)))
        if not parts:
            parts = [(np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.uint32))]
        w1, w2, c = (np.concatenate(x) for x in zip(*parts))
        del parts
        key = pair_keys(w1, w2)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.key = key[first]
        self.w1, self.w2 = w1[order[first]], w2[order[first]]
        self.c = np.add.reduceat(c[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)

    def contexts(self):
        """(first words, their index per bigram, counts, bigrams seen once, twice, more often)."""
        w, at = np.unique(self.w1, return_inverse=True)
        total = np.bincount(at, weights=self.c, minlength=len(w)).astype(np.int64)
        seen = [np.bincount(at[self.c == 1], minlength=len(w)), np.bincount(at[self.c == 2], minlength=len(w)),
                np.bincount(at[self.c >= 3], minlength=len(w))]
        return w, at, total, seen


def _count(shards: int, heavy: np.ndarray):
    """Step 2: ask for second words, tell of contexts and of counts of counts."""
    def run(key, t):
        own = key[0].as_py()
        rows = _rows(t, PAIRS)
        if not rows:
            return pa.Table.from_batches([], ROW_ARROW)
        s = Shard(rows)
        out = [(own, STATS, own, 0, 0, np.r_[count_of_counts(s.c[s.c > 0]), np.zeros(7, np.int64)].astype(np.int64).tobytes(), None, None, None, None)]
        w2, at = np.unique(s.w2, return_inverse=True)
        before = np.bincount(at[s.c > 0], minlength=len(w2)).astype(np.uint32)
        for to, idx in _by_home(w2, shards):
            out.append((to, ASK, own, len(idx), 0, squeeze(np.diff(w2[idx], prepend=U64(0))), squeeze(before[idx]), None, None, None))
        w1, _, total, seen = s.contexts()
        for to, idx in _by_home(w1, shards):
            big = idx[find(heavy, w1[idx])[1]]
            out.append((to, CONTEXT, own, len(idx), len(big), squeeze(np.diff(w1[idx], prepend=U64(0))), squeeze(total[idx].astype(np.uint64)),
                        w1[big].tobytes(), np.stack([x[big] for x in seen]).astype(np.int64).tobytes(), None))
        return pa.Table.from_batches(rows_to_batches(out, ROW_ARROW, 256), ROW_ARROW)

    return run


def _by_home(w: np.ndarray, shards: int):
    """(home, ascending indexes) of sorted words."""
    h = home(w, shards)
    order = np.argsort(h, kind="stable")
    for s, e in zip(*groups(h[order])):
        yield int(h[order[s]]), order[s:e]


def _answer(shards: int, heavy: np.ndarray):
    """Step 3: continuation and token counts in the order asked, and totals."""
    def run(key, t):
        own = key[0].as_py()
        asks, tells = _rows(t, ASK), _rows(t, CONTEXT)
        asked = [np.cumsum(unsqueeze(r["a"], r["n"]), dtype=U64) for r in asks]
        told = [np.cumsum(unsqueeze(r["a"], r["n"]), dtype=U64) for r in tells]
        words = np.unique(np.concatenate([*asked, *told, np.zeros(0, U64)]))
        before, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for r, w in zip(asks, asked):
            before[np.searchsorted(words, w)] += unsqueeze(r["b"], r["n"], np.uint32)
        for r, w in zip(tells, told):
            count[np.searchsorted(words, w)] += unsqueeze(r["b"], r["n"]).astype(np.int64)
        out = [(own, STATS, own, 0, 0, r["a"], None, None, None, None) for r in _rows(t, STATS)]
        n = before[before > 0]
        totals = [count.sum(), (count > 0).sum(), n.sum(), *count_of_counts(n)]
        out.append((own, STATS, own, 0, 0, np.r_[np.zeros(4, np.int64), np.array(totals, np.int64)].tobytes(), None, None, None, None))
        for r, w in zip(asks, asked):
            at = np.searchsorted(words, w)
            out.append((r["src"], ANSWER, own, len(w), 0, r["a"], squeeze(before[at].astype(np.uint64)), squeeze(count[at].astype(np.uint64)), None, None))
        # contexts of heavy words are summed up here and told to all shards
        big = heavy[home(heavy, shards) == own] if len(heavy) else heavy
        if len(big) and len(tells):
            seen = np.zeros((3, len(big)), np.int64)
            for r in tells:
                if r["m"]:
                    seen[:, np.searchsorted(big, u64(r["c"]))] += i64(r["d"]).reshape(3, r["m"])
            at, hit = find(words, big)
            total = np.where(hit, count[at], 0)
            for to in range(shards):
                out.append((to, HEAVY_CONTEXT, own, len(big), 0, big.tobytes(), total.tobytes(), seen.tobytes(), None, None))
        return pa.Table.from_batches(rows_to_batches(out, ROW_ARROW, 256), ROW_ARROW)

    return run


def _stats(batches):
    for t in batches:
        for kind, a in zip(t.column("kind").to_pylist(), t.column("a")):
            if kind == STATS:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in i64(a.as_py()).tolist()], names=[f"t{i}" for i in range(11)])


def _score(shards: int):
    """Step 4: sums per document of the shard's bigrams."""
    def run(key, t, answers):
        out = [tuple(r[f.name] for f in ROW_ARROW) for r in _rows(t, DOCS)]
        rows = _rows(t, PAIRS)
        if rows:
            out += _sums(rows, answers, shards)
        return pa.Table.from_batches(rows_to_batches(out, ROW_ARROW, 256), ROW_ARROW)

    return run


def _sums(rows: list[dict], answers: pa.Table, shards: int):
    t = [int(answers.column(f"t{i}")[0].as_py()) for i in range(11)]
    pair_d, n, v, pairs, below_d = discounts(t[:4]), t[4], t[5], t[6], discounts(t[7:])
    s = Shard(rows)
    asked = np.unique(s.w2)
    before, count = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
    for r in _rows(answers, ANSWER):
        at = np.searchsorted(asked, np.cumsum(unsqueeze(r["a"], r["n"]), dtype=U64))
        before[at] = unsqueeze(r["b"], r["n"]).astype(np.int64)
        count[at] = unsqueeze(r["c"], r["n"]).astype(np.int64)
    w1, context, total, seen = s.contexts()
    for r in _rows(answers, HEAVY_CONTEXT):
        at, hit = find(w1, u64(r["a"]))
        total[at[hit]] = i64(r["b"])[hit]
        for one, all_ in zip(seen, i64(r["c"]).reshape(3, r["n"])):
            one[at[hit]] = all_[hit]
    # p(word) from continuation counts, then p(word | context)
    spare = below_weight(t)
    low = (discounted(before, below_d) + spare / (v + 1)) / max(pairs, 1) if pairs else np.full(len(asked), 1 / (v + 1))
    weight = sum(d * x for d, x in zip(pair_d[1:], seen))
    of_word = np.searchsorted(asked, s.w2)
    known = total[context] > 0
    p = np.where(known, (discounted(s.c, pair_d) + weight[context] * low[of_word]) / np.maximum(total[context], 1), low[of_word])
    base = np.log10((count + 1) / (n + v + 1))
    # the shard's model: sorted hash arrays, mapped into memory
    keys, score, plain, is_known = mapped(s.key), mapped(np.log10(p)), mapped(base[of_word]), mapped((count > 0)[of_word])
    del s, p, of_word, context, asked, before, count
    for r in rows:
        at, hit = find(keys, pair_keys(np.cumsum(unsqueeze(r["a"], r["n"]), dtype=U64), unsqueeze(r["b"], r["n"])))
        assert hit.all()
        first = int(np.frombuffer(r["e"][:4], np.uint32)[0])
        doc = unsqueeze(r["e"][4:], r["m"], np.uint32)
        at = np.repeat(at, unsqueeze(r["d"], r["n"], np.uint32))
        size = int(doc.max()) + 1
        there = np.flatnonzero(np.bincount(doc, minlength=size))
        yield (r["src"] % shards, SUMS, r["src"], len(there), n, squeeze((there + first).astype(np.uint32)),
               np.bincount(doc, weights=score[at], minlength=size)[there].tobytes(), np.bincount(doc, weights=plain[at], minlength=size)[there].tobytes(),
               squeeze(np.bincount(doc, weights=is_known[at], minlength=size)[there].astype(np.uint32)), None)


def below_weight(t: list[int]) -> float:
    """Mass that the discounts take from all continuation counts, in pairs."""
    types, n = t[5], t[7:]
    d = discounts(n)
    more = max(0, types - n[0] - n[1])
    return d[1] * n[0] + d[2] * n[1] + d[3] * more


def _finish(key, t):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    sums: dict[int, list] = {}
    for r in _rows(t, SUMS):
        sums.setdefault(r["src"], []).append(r)
    out = []
    for r in _rows(t, DOCS):
        ids, flags, sizes = i64(r["a"]), np.frombuffer(r["b"], np.uint8), i64(r["c"])
        score, base, known, train = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64), 0
        for x in sums.get(r["src"], []):
            at, train = unsqueeze(x["a"], x["n"], np.uint32), x["m"]
            score[at] += np.frombuffer(x["b"])
            base[at] += np.frombuffer(x["c"])
            known[at] += unsqueeze(x["d"], x["n"], np.uint32)
        out.append(pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=(flags & 2) > 0), pa.array((flags & 1) > 0), pa.array(sizes), pa.array(known), pa.array(np.full(len(ids), train)), pa.array(base), pa.array(score)], schema=schema))
    return pa.Table.from_batches(out, schema)


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    shards = n_partitions(docs.sparkSession)
    did = F.col(id_col).cast("long")
    held = F.crc32(F.coalesce(did.cast("string"), F.lit(""))) % HELD_OUT_OF == HELD_OUT
    src = docs.select(did.alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out"))
    heavy = heavy_words(src)

    @tidy
    def send(batches):
        yield from rows_to_batches(_send(TaskContext.get().partitionId(), shards, heavy)(batches), ROW_ARROW, 64)

    sent = src.mapInArrow(send, ROW)
    counted = sent.groupBy("shard").applyInArrow(_count(shards, heavy), ROW)
    answered = counted.groupBy("shard").applyInArrow(_answer(shards, heavy), ROW).repartition(shards, "shard")
    stats = (answered.mapInArrow(_stats, ", ".join(f"t{i} long" for i in range(11)))
             .agg(*[F.coalesce(F.sum(f"t{i}"), F.lit(0)).alias(f"t{i}") for i in range(11)]))
    # one aggregated row, attached to every answer
    told = answered.join(F.broadcast(stats))
    sums = sent.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_score(shards), ROW)
    return sums.groupBy("shard").applyInArrow(
        _finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """Contract rows of :func:`score_corpus` over all documents."""
    return score_corpus(table(spark, sf_dir, "documents"))
