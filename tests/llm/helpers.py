"""Brute-force versions and small documents for the corpus operators."""

from __future__ import annotations

import re
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingles(text, k):
    w = [x.translate(LOWER) for x in space_words(text)]
    if len(w) >= k:
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w else set()


def components(rows, k, percent=80):
    """doc_id -> (set size, smallest doc_id reachable), by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeated_bytes(texts, length):
    """Per text a list of flags: byte lies in a string of that length that also starts elsewhere."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[s:s + length] for b in data for s in range(len(b) - length + 1))
    out = []
    for b in data:
        flags = [False] * len(b)
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                flags[s:s + length] = [True] * length
        out.append(flags)
    return data, out


def overlap(text, items, size=13):
    """(words, hit words, item ids) of a text."""
    w, hit, found = alnum_words(text), set(), set()
    for i, t in items:
        b = alnum_words(t)
        m = min(size, len(b))
        for s in range(len(b) - m + 1) if m else ():
            for p in range(len(w) - m + 1):
                if w[p:p + m] == b[s:s + m]:
                    hit.update(range(p, p + m))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def repeat_words(words, k=8):
    n = Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    return len({i + j for i in range(len(words) - k + 1) if n[tuple(words[i:i + k])] > 1 for j in range(k)})
