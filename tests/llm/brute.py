"""The contracts of the training-data operators in plain Python, one document after another."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def fold(doc_id, parts):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


def near(docs, percent=85):
    """{doc_id: (n_shingles, component)} of (doc_id, text) with distinct ids."""
    sets = {}
    for i, text in docs:
        w = WORD.findall(lower(text))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def removed(docs, words):
    """{doc_id: (units, removed, spans, kept)}."""
    span = 20 if words else 50
    first = {}
    cut = {i: WORD.findall((t or "").encode()) if words else (t or "").encode() for i, t in docs}
    for i in sorted(cut):
        for j in range(len(cut[i]) - span + 1):
            first.setdefault(tuple(cut[i][j : j + span]) if words else cut[i][j : j + span], (i, j))
    out = {}
    for i, u in cut.items():
        gone = [False] * len(u)
        for j in range(len(u) - span + 1):
            at = first[tuple(u[j : j + span]) if words else u[j : j + span]]
            if at < (i, j) if words else at[0] < i:
                gone[j : j + span] = [True] * span
        kept = [x for x, g in zip(u, gone) if not g]
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out[i] = (len(u), sum(gone), spans, b" ".join(kept) if words else bytes(kept))
    return out


def contaminated(docs, items, least=2):
    """{doc_id: (n_words, n_hit, items)}."""
    windows = {}
    for i, text in items:
        w = ALNUM.findall(lower(text))
        n = min(8, len(w))
        for j in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    out = {}
    for i, text in docs:
        w = ALNUM.findall(lower(text))
        hit, met = set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if found := windows.get(tuple(w[j : j + n])):
                    hit |= set(range(j, j + n))
                    met |= found
        out[i] = (len(w), len(hit), sorted(met))
    return out


def base_scores(docs, parts=10, held=0):
    """{doc_id: (tokens, known, N, base)}."""
    cut = {i: [*WORD.findall(lower(t)), None] for i, t in docs}
    counts = Counter(w for i, ws in cut.items() if fold(i, parts) != held for w in ws)
    n, v = sum(counts.values()), len(counts)
    z = n + 0.1 * (v + 1)
    return {i: (len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.1) / z) for w in ws)) for i, ws in cut.items()}


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target} by raising the level step by step."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, budget = {}, sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in fixed]
        left = budget - sum(fixed.values())
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in open_}
        fixed |= {s: most * sizes[s] for s in over}
