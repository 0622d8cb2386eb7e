"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

FOLD = {i: i + 32 for i in range(65, 91)}
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def substrings(rows, depth=35):
    words = [PLAIN.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + depth]) for w in words for i in range(len(w) - depth + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - depth + 1):
            if seen[tuple(w[i:i + depth])] > 1:
                gone.update(range(i, i + depth))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def overlaps(rows, items, window=10):
    by_first: dict = {}
    for item, t in items:
        w = ALNUM.findall((t or "").translate(FOLD))
        k = min(window, len(w))
        for i in range(len(w) - k + 1) if w else ():
            by_first.setdefault(w[i], set()).add((item, tuple(w[i:i + k])))
    out = []
    for d, t in rows:
        w = ALNUM.findall((t or "").translate(FOLD))
        hit, who = set(), set()
        for i, x in enumerate(w):
            for item, s in by_first.get(x, ()):
                if tuple(w[i:i + len(s)]) == s:
                    hit.update(range(i, i + len(s)))
                    if item is not None:
                        who.add(item)
        out.append((d, len(w), len(hit), len(who), sha(",".join(sorted(map(str, who)))), bool(hit)))
    return out


def shingles(t, k=5):
    w = PLAIN.findall((t or "").translate(FOLD))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_duplicates(rows, percent=85, k=5):
    sets = {d: shingles(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    holders: dict = {}
    for d in ids:
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    for d in ids:
        common = Counter(o for s in sets[d] for o in holders[s] if o > d)
        for o, n in common.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[o]) - n):
                a, b = find(d), find(o)
                root[max(a, b)] = min(a, b)
    return [(d, len(sets[d]), find(d), find(d) == d) for d in ids]
