"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict


def words(data: bytes) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", data)


def repeats(docs, length=200):
    seen = Counter(t[i:i + length] for _, t in docs for i in range(len(t) - length + 1))
    out = []
    for doc_id, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        kept = bytes(c for c, x in zip(t, gone, strict=True) if not x)
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def earlier(docs, length=50):
    cut = [(doc_id, words(t)) for doc_id, t in docs]
    order = lambda d: float("inf") if d is None else d
    first = {}
    for doc_id, w in cut:
        for i in range(len(w) - length + 1):
            key = tuple(w[i:i + length])
            first[key] = min(first.get(key, float("inf")), order(doc_id))
    out = []
    for doc_id, w in cut:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i:i + length])] < order(doc_id):
                gone[i:i + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(data: bytes, k: int) -> frozenset:
    w = words(bytes(c + 32 if 65 <= c <= 90 else c for c in data))
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def groups(docs, k, percent=80):
    """doc_id, set size and smallest id reachable, over all pairs that share a shingle."""
    sets = {d: shingles(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    shared = Counter((a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1:])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [(d, len(s), find(d)) for d, s in sets.items()]


def quality_counts(text: str) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)
