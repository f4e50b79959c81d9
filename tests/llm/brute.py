"""Plain versions of the training-data operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def groups(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def covered(seqs, width):
    """For each sequence the mask of places that a repeated run of ``width`` covers."""
    seen = Counter(tuple(s[j : j + width]) if not isinstance(s, bytes) else s[j : j + width] for s in seqs for j in range(len(s) - width + 1))
    out = []
    for s in seqs:
        mask = [False] * len(s)
        for j in range(len(s) - width + 1):
            key = s[j : j + width] if isinstance(s, bytes) else tuple(s[j : j + width])
            if seen[key] > 1:
                mask[j : j + width] = [True] * width
        out.append(mask)
    return out


def spans(mask):
    return sum(1 for i, m in enumerate(mask) if m and (i == 0 or not mask[i - 1]))


def substring(docs, width):
    """(id, n_words, n_removed, kept sha256) rows."""
    seqs = [words(t) for _, t in docs]
    return [(i, len(s), sum(m), hashlib.sha256(b" ".join(w for w, x in zip(s, m) if not x)).hexdigest()) for (i, _), s, m in zip(docs, seqs, covered(seqs, width))]


def suffix(docs, width):
    seqs = [(t or "").encode() for _, t in docs]
    return [(i, len(s), sum(m), spans(m), hashlib.sha256(bytes(c for c, x in zip(s, m) if not x)).hexdigest()) for (i, _), s, m in zip(docs, seqs, covered(seqs, width))]


def shingles(text, width=5):
    w = words((text or "").encode().lower().decode())
    return set() if not w else {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


def near(docs, percent=75, width=5):
    """{id: (n_shingles, component)}"""
    sets = {i: shingles(t, width) for i, t in docs}
    at = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            at[g].append(i)
    common = Counter((a, b) for held in at.values() for k, a in enumerate(held) for b in held[k + 1 :])
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    comp = groups(sets, links)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def held_out(i, folds=10, fold=0):
    return i is not None and zlib.crc32(str(i).encode()) % folds == fold


def bigram_scores(docs, prior):
    """{id: (n_tokens, n_known, N, base, score)} of the interpolated bigram model."""
    end, start = b"</s> ", b"<s> "
    toks = [(i, [*words((t or "").encode().lower().decode()), end]) for i, t in docs]
    one, two, firsts = Counter(), Counter(), 0
    for i, w in toks:
        if not held_out(i):
            one.update(w)
            two.update(zip([start, *w], w))
            firsts += 1
    n, v = sum(one.values()), len(one)
    out = {}
    for i, w in toks:
        base = score = 0.0
        for a, b in zip([start, *w], w):
            p = (one[b] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            score += math.log10((two[a, b] + prior * p) / ((firsts if a == start else one[a]) + prior))
        out[i] = (len(w), sum(one[x] > 0 for x in w), n, base, score)
    return out


_SHAPES = [(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a + b <= 4] + [(1, 1, 1), (2, 1, 1), (1, 2, 1), (1, 1, 2)]


def subsequences(word, decay):
    """(bytes, weight) of the subsequences of three or four bytes that span at most five, each skipped byte costing
    ``decay``; the weights have norm 1."""
    data, out = word.encode(), []
    for steps in _SHAPES:
        for i in range(len(data) - sum(steps)):
            at = [i]
            for s in steps:
                at.append(at[-1] + s)
            out.append((bytes(data[k] for k in at), decay ** (sum(steps) - len(steps))))
    size = sum(w * w for _, w in out) ** 0.5
    return [(k, w / size) for k, w in out]


def kernel(x, y, decay):
    return sum(a * b for k, a in subsequences(x, decay) for m, b in subsequences(y, decay) if k == m)


def margin(word, table, bias, decay):
    total = 0.0
    for key, weight in subsequences(word, decay):
        code = len(key) - 1
        for byte in key:
            code = ((code ^ byte) * 0x9E3779B1) & 0xFFFFFFFF
            code ^= code >> 15
        total += weight * float(table[((code * 0x85EBCA6B) & 0xFFFFFFFF) >> 14])
    return total + bias


def content(text):
    """The first 18 features of the content view."""
    w = text.split() or [""]  # an empty text is one empty word
    n, size, counts = len(w), max(1, len(w)), Counter(w)
    again = sum(a == b for a, b in zip(w, w[1:]))
    data = text.encode()
    total = max(1, len(data))
    upper, lower = sum(65 <= c < 91 for c in data), sum(97 <= c < 123 or c > 127 for c in data)
    is_mark = lambda c: 33 <= c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 127
    lines = data.count(10) + 1
    return [
        len(counts) / size, math.log1p(size) * (1 - len(counts) / size) / 8, max(counts.values(), default=0) / size, (again / size) ** 0.5, sum(min(len(x), 30) for x in w) / size / 10,
        sum(len(x) > 20 for x in w) / size, min(n, 20) / 20, math.log1p(n) / 10, upper / total / max((upper + lower) / total, 1e-9), sum(48 <= c < 58 for c in data) / total,
        sum(c in b"\t\x0b\x0c\r " for c in data) / total, sum(map(is_mark, data)) / total, (sum(is_mark(a) and is_mark(b) for a, b in zip(data, data[1:])) / total) ** 0.5,
        (sum(chr(c) in "#$%&*+<=>@[]^_`{|}~\\!" for c in data) / total) ** 0.5, math.log1p(lines) / 5, math.log1p(total / lines) / 10, math.log1p(total) / 10, float(total < 40),
    ]
