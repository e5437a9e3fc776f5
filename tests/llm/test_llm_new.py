"""Order MinHash, phrase mining and spelling variants against plain Python."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from pagemill.llm import order_minhash, phrase_mining, spelling

DOCS = [
    (9, "One two three, four five six; seven eight nine ten. One two three four"), (8, ""), (7, None), (6, "   \n\t"),
    (5, "One two three, four five six; seven eight nine tan. One two three four"), (4, "漢字仮名交じり文の文書 and latin" * 3), (3, "x" * 100),
    (2, "Thenea " * 50), (1, "y 😀 z " * 7), (None, "no id one two three"), (None, "no id one two three"), (None, None),
    (5, "One two three, four five six; seven eight nine tan. One two three four"), (2, "another text of id two"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, 1, 2) for i, t in DOCS],
                                 "doc_id long, text string, lang string, `h` int, `pos` int")


# ------------------------------------------------------------------ Order MinHash

def _x64(seed: int, *values) -> int:
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def _u(x: int) -> int:
    return x % (1 << 64)


def brute_signature(text: str) -> list[int]:
    symbol = "(?:[^\\x20\\x09-\\x0D⺀-￿]{1,16}|[⺀-￿])"
    k_mers = re.findall(f"(?=({symbol}(?:[\\x20\\x09-\\x0D]*{symbol}){{0,2}})){symbol}", text)
    seen, least = Counter(), {}
    for pos, k in enumerate(k_mers):
        h = _x64(42, k)
        seen[h] += 1
        g = _x64(_u(_x64(42, h)), (seen[h],))
        order = ((_u(g) << 29) % (1 << 63)) | pos
        slot = (_u(g) >> 40) % 64
        least[slot] = min(least.get(slot, order), order)
    out = []
    for t in range(32):
        held = sorted((least[s] % (1 << 29), least[s] >> 29) for s in (2 * t, 2 * t + 1) if s in least)
        if held:
            out.append(t << 58 | _u(_x64(42, *[g for _, g in held])) >> 6)
    return out


def _alike(a, b):
    either = {x >> 58 for x in a} | {x >> 58 for x in b}
    return len(set(a) & set(b)) / len(either) if either else 1.0


def test_order_minhash_brute(docs):
    rows = order_minhash.fingerprints(docs).collect()
    assert len(rows) == len(DOCS)
    texts = {(i, t or "") for i, t in DOCS}
    hash_of = lambda i, t: _x64(_u(_x64(42, i)) if i is not None else 42, t)
    order = sorted(texts, key=lambda x: (x[0] is None, -(x[0] or 0), -hash_of(*x)))
    want = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[:len(t) - len(t) // 3] + after[:len(t) // 3]
        a, b, c = brute_signature(t), brute_signature(edited), brute_signature(after)
        want[i, hashlib.sha256(edited.encode()).hexdigest(), len(t)] = (
            "".join(f"{x:016x}" for x in a), "".join(f"{x:016x}" for x in b), _alike(a, b), _alike(a, c))
    for r in rows:
        assert want[r.doc_id, r.edited_sha256, r.n_chars] == (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)


def test_order_minhash_sees_order(spark):
    words = [f"w{i}" for i in range(400)]
    moved = words[200:] + words[:200]
    d = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(moved)), (3, " ".join(words[:399] + ["other"]))], "id int, text string")
    s = {r.id: r.tuples for r in order_minhash.signatures(d, ["id"]).collect()}
    assert _alike(s[1], s[3]) > 0.9
    assert 0.3 < _alike(s[1], s[2]) < 0.75      # equal k-mers, half of the pairs stand the other way round


def test_order_minhash_empty(spark):
    assert order_minhash.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    r = order_minhash.fingerprints(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).first()
    assert r.near_next == 1.0 and r.n_chars == 11


# ------------------------------------------------------------------ phrases

def brute_phrases(rows, least):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    cands = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = {(p[0], *p[i:i + m]) for p, a in cands.items() for m in range(2, len(p) - 1)
              for i in range(1, len(p) - m + 1) if cands.get((p[0], *p[i:i + m])) == a}
    out = defaultdict(list)
    for p, a in cands.items():
        if p not in inside:
            lang, w = p[0], p[1:]
            s, k, l, r = min((1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
            out[lang].append((-s, -a, " ".join(w).encode(), l, r, n[lang]))
    return {(lang, k + 1, p.decode(), -a, l, r, n, -s) for lang, v in out.items() for k, (s, a, p, l, r, n) in enumerate(sorted(v))}


PHRASES = [("en", "A b c d e f. " * 9 + "a b x; c d e f, b b b b b b b"), (None, "a b c d\ta b c d" * 4), ("de", "ä ö ü Ä ö ü " * 30), ("en", None), ("en", ""),
           ("und", "a b c d"), ("en", "the " * 300), ("en", " ".join(f"q{i % 7} r{i % 3} s" for i in range(500))), ("en", "A b c d e f. " * 9)]


@pytest.mark.parametrize("suffixes", [1 << 20, 64])
def test_phrases_brute(spark, suffixes):
    d = spark.createDataFrame([(k, *x, 5) for k, x in enumerate(PHRASES)], "doc_id long, lang string, text string, n int")
    got = {tuple(r) for r in phrase_mining.collocations(d, min_count=3, group_suffixes=suffixes).collect()}
    assert got == brute_phrases(PHRASES, 3)
    assert {len(p[2].split()) for p in got} == {2, 3, 4, 5}


def test_phrases_extend_heavy_prefixes(spark):
    """With a small budget, prefixes are extended and their counts come from several groups."""
    d = spark.createDataFrame([("en", "a b " + f"c{i % 40} d{i % 9}") for i in range(4000)], "lang string, text string")
    rows = [("en", "a b " + f"c{i % 40} d{i % 9}") for i in range(4000)]
    got = {tuple(r) for r in phrase_mining.collocations(d, min_count=5, group_suffixes=300, top=None).select(
        "lang", "phrase", "a", "l", "r", "n", "score").collect()}
    assert got == {x[:1] + x[2:] for x in brute_phrases(rows, 5)}


def test_phrases_send_only_runs_that_may_be_frequent(spark, monkeypatch):
    """Pairs occur often enough and longer runs do not: their suffixes are cut, and pairs counted before."""
    rng = np.random.default_rng(5)
    rows = [("en", " ".join("abcdef"[i] for i in rng.integers(0, 6, 500))) for _ in range(40)]
    sent = []
    monkeypatch.setattr(phrase_mining, "_subtrees", lambda s, *more, old=phrase_mining._subtrees: sent.append(s.count()) or old(s, *more))
    d = spark.createDataFrame(rows, "lang string, text string")
    got = {tuple(r) for r in phrase_mining.collocations(d, min_count=300).collect()}
    assert got == brute_phrases(rows, 300) and len(got) == 36 and sent == [0]


def test_pair_keys_give_words_back(spark):
    """Also of words that share the bits which a key holds of its first word."""
    words = np.array([(7 << 48) | 12345, (7 << 48) | 999, (9 << 60) | 12345, (15 << 60) | 1], np.uint64)
    pairs = [(i, j) for i in range(4) for j in range(4)]
    keys = phrase_mining._joined([words[[i for i, _ in pairs]], words[[j for _, j in pairs]]]).view(np.int64).tolist()
    one = spark.createDataFrame([(w, 1) for w in words.view(np.int64).tolist()], "h long, n long")
    two = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "h long, n long")
    own = words.view(np.int64).tolist()
    assert sorted((r.n, *r.words) for r in phrase_mining._pair_nodes(one, two).collect()) == [(n, own[i], own[j]) for n, (i, j) in enumerate(pairs)]


def test_phrases_jobs_do_not_grow_with_partitions(spark):
    """Filters and heavy prefixes come to the driver in a job each, not in one for each partition."""
    rows = [("en", "a b " + f"c{i % 40} d{i % 9}") for i in range(4000)]
    settings_ = {"spark.sql.shuffle.partitions": "150", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings_}
    sc = spark.sparkContext
    try:
        for k, v in settings_.items():
            spark.conf.set(k, v)
        sc.setJobGroup("phrases of many partitions", "")
        counted, _ = phrase_mining.phrases(spark.createDataFrame(rows, "lang string, text string"), min_count=5, group_suffixes=300)
        jobs = len(sc.statusTracker().getJobIdsForGroup("phrases of many partitions"))
        assert 0 < jobs < 150
        f = Counter(" ".join(t.split()[i:i + m]) for _, t in rows for m in range(1, 5) for i in range(5 - m))
        assert Counter(r.n for r in counted.collect()) == Counter([n for n in f.values() if n >= 5] + [16000])
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
        for k, v in before.items():
            spark.conf.set(k, v)


def test_phrases_of_two_words_at_most(spark):
    rows = [("en", "a b a b c")] * 5
    got = {tuple(r) for r in phrase_mining.collocations(spark.createDataFrame(rows, "lang string, text string"), min_count=5, depth=2).collect()}
    assert {(r[2], r[3]) for r in got} == {("a b", 10), ("b a", 5), ("b c", 5)}


def test_phrases_empty(spark):
    assert phrase_mining.collocations(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0
    assert phrase_mining.collocations(spark.createDataFrame([(1, None, None)], "doc_id long, lang string, text string")).count() == 0


# ------------------------------------------------------------------ spelling

def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


words_ = st.lists(st.text("abé", min_size=5, max_size=9), min_size=1, max_size=60, unique=True)


@settings(max_examples=150, deadline=None)
@given(words_)
def test_index_finds_each_near_word_once(words):
    for dense in (spelling.DENSE, 0):
        spelling.DENSE, kept = dense, spelling.DENSE
        try:
            for reverse in (False, True):
                u = [w[::-1] if reverse else w for w in words]
                index = spelling.Index([x[::-1] for x in u])
                exact = [spelling._exact(len(w), reverse) for w in u]
                q, x = index.near(u, spelling.np.array(exact))
                got = sorted(zip(q.tolist(), x.tolist()))
                assert got == [(i, j) for i in range(len(u)) for j in range(len(u)) if one_edit(u[i], u[j]) and u[j][:exact[i]] == u[i][:exact[i]]]
        finally:
            spelling.DENSE = kept


def test_crc_of_spans():
    texts = [b"", b"a", "é".encode() * 50, b"abc" * 100]
    buf = spelling.np.frombuffer(b"".join(texts), spelling.np.uint8)
    end = spelling.np.cumsum([len(t) for t in texts])
    start = end - [len(t) for t in texts]
    first = spelling.np.array([zlib.crc32(b"17:")] * 4, spelling.np.uint32)
    assert spelling.crc32_spans(buf, start, end, first).tolist() == [zlib.crc32(b"17:" + t) for t in texts]


def brute_variants(rows):
    n = Counter()
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for w in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[:h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w] += 1
    v = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [x for x in v if one_edit(w, x)] for w in v}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-v[x], x), default=None)
        form[w] = best if best is not None and v[best] >= 2 * v[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), v[w], len(near[w]), v[form[w]] if form[w] else None) for w in v}


def test_spelling_brute(spark, monkeypatch):
    import random
    rng = random.Random(5)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["z" * 5000, "z" * 4999, "z" * 4998 + "a"]
    rows = [(i if i % 9 else None, " ".join(rng.choice(base[:rng.randint(5, 63)]).title() for _ in range(60)) + " ÀÉ×÷ßÿ x1y2") for i in range(120)]
    rows += [(3, None), (3, ""), (None, "aaaaaa " * 50 + "aaaaa " * 20 + "aaaa " * 9), (8, "aaaaaaa " * 3)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    assert {tuple(r) for r in spelling.variants(d).collect()} == brute_variants(rows)
    monkeypatch.setattr(spelling, "HELD", 10)
    near = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(spelling.word_counts(d), block=7).collect()}
    whole = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(spelling.word_counts(d)).collect()}
    assert near == whole and len(near) > 10


def test_spelling_chains_and_empty(spark):
    f = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(13)], "word string, form string")
    assert {r.root for r in spelling.roots(f).collect()} == {"w13"}
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_filters_pass_the_driver_unopened(spark, monkeypatch):
    """The driver hands segments on as tasks packed them, and lets go of what is broadcast."""
    from pagemill.llm import common, line_dedup, phrase_mining
    opened, freed = [], []
    monkeypatch.setattr(common.Filter, "bits", property(lambda f, get=common.Filter.bits.fget: opened.append(1) or get(f)))
    sent = type(spark.sparkContext).broadcast

    def broadcast(sc, value):
        b = sent(sc, value)
        gone = b.destroy
        b.destroy = lambda *a, **k: freed.append(b) or gone(*a, **k)
        return b

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    line = "the same long line in every document"
    docs = spark.createDataFrame([(i, f"{line}\nrow {i}", "en") for i in range(4)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {0: "row 0", 1: "row 1", 2: "row 2", 3: f"{line}\nrow 3"} and len(freed) == 1
    assert phrase_mining.collocations(docs, min_count=4).filter("phrase = 'the same long line in'").first().a == 4
    assert not opened and len(freed) >= 4
    f = common.Filter({1: common.packed_bits(np.arange(16) == 3)}, 32, 16)
    assert f.bits.tolist() == [0, 0, 8, 0]
