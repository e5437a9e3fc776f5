"""Plain Python versions of the operators, to hold their results against."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STRIP = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def line_dedup(rows, min_chars=20, min_docs=3):
    """rows: (id or None, text). Per row: (id, n_lines, n_dropped, kept text)."""
    def key(line):
        k = line.strip(STRIP).translate(LOWER)
        return k if len(k) >= min_chars else None

    holders = defaultdict(list)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")} - {None}:
            holders[k].append(i)
    last = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def base_quality(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(STRIP):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit),
            len(w) < 50 or 100 * len(hit) > 50 * len(w))


def substring_dedup(rows, n=13):
    """rows: (id, text) with ids. Per row: (id, n_words, n_removed, kept text)."""
    first = {}
    for i, text in rows:
        w = words(text)
        for p in range(len(w) - n + 1):
            k = tuple(w[p:p + n])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = set()
        for p in range(len(w) - n + 1):
            if first[tuple(w[p:p + n])] < i:
                gone |= set(range(p, p + n))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def shingles(text):
    w = words(text, lower=True)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_dup(rows):
    """rows: (id, text) with ids. {id: (n_shingles, component)}"""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        near = {j for s in sets[i] for j in holders[s]}
        for j in near:
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(s), top(i)) for i, s in sets.items()}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def masked(text, spans, mark="[SECRET]"):
    """Each span is a mark; a span that begins within an earlier one is part of its hole."""
    out, at = "", 0
    for s, _, e in sorted(spans):
        if s >= at:
            out += text[at:s] + mark
        at = max(at, e)
    return out + text[at:]


def discounts(counts):
    n = [sum(c == i for c in counts) for i in (1, 2, 3, 4)]
    if min(n[:2]) <= 0:
        return [0, 0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
    return [0, *(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))]


def lm_scores(rows):
    """rows: (id or None, text). Per row: (id, held out, tokens, known, N, base, score)."""
    def held(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2

    texts = [(i, words(t, lower=True) + ["\n"]) for i, t in rows]
    one, two = Counter(), Counter()
    for i, w in texts:
        if not held(i):
            one.update(w)
            two.update(zip(["\n"] + w[:-1], w))
    n, v = sum(one.values()), len(one)
    before = Counter(b for _, b in two)
    d2, d1 = discounts(two.values()), discounts(before.values())
    spare = sum(d1[min(c, 3)] for c in before.values())
    total, taken = Counter(), Counter()
    for (a, _), c in two.items():
        total[a] += c
        taken[a] += d2[min(c, 3)]
    out = []
    for i, w in texts:
        base = score = 0.0
        for a, b in zip(["\n"] + w[:-1], w):
            p = (max(before[b] - d1[min(before[b], 3)], 0) + spare / (v + 1)) / len(two) if two else 1 / (v + 1)
            if total[a]:
                c = two[a, b]
                p = (max(c - d2[min(c, 3)], 0) + taken[a] * p) / total[a]
            score += math.log10(p)
            base += math.log10((one[b] + 1) / (n + v + 1))
        out.append((i, held(i), len(w), sum(one[b] > 0 for b in w), n, base, score))
    return out
