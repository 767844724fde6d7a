"""Plain versions of the operators, one text at a time."""

from __future__ import annotations

import re
import zlib

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, k):
    w = words(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def components(docs, k, percent):
    """{id: smallest reachable id} of (id, text) rows, by all pairs that share a shingle."""
    sets = [(i, shingles(t, k)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for n, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(n)
    pairs = {(a, b) for h in holders.values() for j, a in enumerate(h) for b in h[j + 1:]}
    for a, b in pairs:
        (i, x), (j, y) = sets[a], sets[b]
        common = len(x & y)
        if 100 * common >= percent * (len(x) + len(y) - common):
            p, q = find(i), find(j)
            parent[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in sets}


def remainder(key, modulus):
    return zlib.crc32(str(key).encode()) % modulus


def contained(docs, items, k=5, percent=80):
    """{(doc id, item id): (shared, size)}."""
    out = {}
    for i, t in docs:
        have = {}
        for item, text in items:
            w = words(text)
            if not w:
                continue
            n = min(k, len(w))
            if n not in have:
                own = words(t)
                have[n] = {tuple(own[j:j + n]) for j in range(len(own) - n + 1)}
            want = shingles(text, k)
            shared = len(want & have[n])
            if 100 * shared >= percent * len(want):
                out[i, item] = (shared, len(want))
    return out
