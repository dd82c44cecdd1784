"""Plain in-memory versions of the operators, for small tables."""

import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text, size=5):
    words = SPACED.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def near(rows, percent=75):
    """rows: (id, text) with distinct ids → id: (n, component)."""
    sets = {i: shingles(t) for i, t in rows}
    index = defaultdict(set)
    links = []
    for i, s in sets.items():
        seen = set()
        for g in s:
            seen |= index[g]
            index[g].add(i)
        links += [(i, j) for j in seen if 100 * len(s & sets[j]) >= percent * len(s | sets[j])]
    where = components(sets, links)
    return {i: (len(s), where[i]) for i, s in sets.items()}


def contaminated(docs, items, window=10):
    """docs, items: (id, text) → id: (n_words, n_hit, sorted item ids)."""
    words = lambda t: ALNUM.findall((t or "").translate(LOWER))
    where = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            where[tuple(w[k:k + n])].add(str(i))
    lengths = {len(k) for k in where}
    out = {}
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                names = where.get(tuple(w[k:k + n]))
                if names:
                    hit.update(range(k, k + n))
                    found |= names
        out[d] = (len(w), len(hit), ",".join(sorted(found)))
    return out


def backoff(rows, order=3, back=0.4, unseen=0.5):
    """rows: (id, text) → id: (n_words, words at full order, score); a document is scored by all others."""
    import math
    words = {i: SPACED.findall((t or "").translate(LOWER)) for i, t in rows}

    def counts(w):
        out = defaultdict(int)
        for n in range(1, order + 1):
            for k in range(len(w) - n + 1):
                out[tuple(w[k:k + n])] += 1
        return out

    own = {i: counts(w) for i, w in words.items()}
    whole = defaultdict(int)
    for table in own.values():
        for g, c in table.items():
            whole[g] += c
    total = sum(map(len, words.values()))
    out = {}
    for i, w in words.items():
        score, full = 0.0, 0
        others = max(1, total - len(w))
        left = lambda g: whole[g] - own[i].get(g, 0)
        for k in range(len(w)):
            top = min(order, k + 1)
            for n in range(top, 0, -1):
                g = tuple(w[k - n + 1:k + 1])
                if left(g):
                    score += math.log(left(g) / (left(g[:-1]) if n > 1 else others)) + (top - n) * math.log(back)
                    full += n == order
                    break
            else:
                score += math.log(unseen / others) + (top - 1) * math.log(back)
        out[i] = (len(w), full, score)
    return out
