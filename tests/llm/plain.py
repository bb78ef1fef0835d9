"""The contracts once more in plain Python, one document at a time and without shortcuts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

SPACE = " \t\n\x0b\x0c\r"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def decontaminated(docs, items, window=10):
    """docs, items: (id, text) pairs."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    find = lambda t: word.findall(ascii_lower(t or ""))
    owners = {}
    for i, t in items:
        w = find(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            owners.setdefault(tuple(w[k : k + window]), set()).add(i)
    sizes = {len(x) for x in owners}
    out = {}
    for d, t in docs:
        w = find(t)
        hit, seen = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (ids := owners.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    seen |= ids
        ids = sorted(str(i) for i in seen if i is not None)
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    return out


def fingerprint(text):
    import xxhash

    w = split_words(ascii_lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, radius=4):
    """fps: id to fingerprint. Smallest id reachable, by comparing all pairs."""
    ids = sorted(fps)
    values = np.array([fps[i] for i in ids], np.uint64)
    root = list(range(len(ids)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= radius):
            a, b = sorted((top(i), top(int(j))))
            root[b] = a
    return {d: ids[top(i)] for i, d in enumerate(ids)}


def figures(text):
    text = text or ""
    w = split_words(text)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    often = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if split_words(x)]
    n_dup = sum(x in lines[:k] for k, x in enumerate(lines))
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), n_dup, len(covered), failed


def removed_places(docs, size=50):
    """docs: (id, bytes) pairs. For every byte whether a string of ``size`` bytes covers it
    that also starts in a smaller id."""
    seen, out = set(), {}
    for d, data in sorted(docs):
        own = [data[k : k + size] for k in range(len(data) - size + 1)]
        out[d] = [False] * len(data)
        for k, x in enumerate(own):
            if x in seen:
                out[d][k : k + size] = [True] * size
        seen.update(own)
    return out


def substrings_removed(docs, size=50):
    places, out = removed_places(docs, size), {}
    for d, data in docs:
        gone = places[d]
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[d] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def shingles(text, n=5):
    w = split_words(ascii_lower(text or ""))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def near_copies(texts, least=(4, 5)):
    """texts: key to text. Smallest key reachable over pairs with a similarity of 0.8 or more."""
    keys = sorted(texts)
    sets, root = [shingles(texts[k]) for k in keys], list(range(len(keys)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) * least[1] >= least[0] * len(x | y):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {k: keys[top(i)] for i, k in enumerate(keys)}
