"""Plain single-process versions that the operators must agree with."""

import re
from collections import defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def removed_words(rows, window=13):
    """Words and removed places of each ``(doc_id, text)``."""
    first = {}
    words = [SPACED.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, w, gone))
    return out


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def groups(rows, percent=80, size=5):
    """``(doc_id, shingles, component)`` of each ``(doc_id, text)``."""
    sets = []
    for _, t in rows:
        w = SPACED.findall(lower(t))
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    holders = defaultdict(list)
    for x, ((i, _), s) in enumerate(zip(rows, sets, strict=True)):
        for token in s if i is not None else ():
            holders[token].append(x)
    common = defaultdict(int)
    for held in holders.values():
        for k, y in enumerate(held):
            for x in held[:k]:
                common[x, y] += 1
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (x, y), n in common.items():
        if 100 * n >= percent * (len(sets[x]) + len(sets[y]) - n):
            parent[root(x)] = root(y)
    smallest = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            smallest[root(x)] = min(smallest.get(root(x), i), i)
    return [(i, len(s), None if i is None else smallest[root(x)]) for x, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]
