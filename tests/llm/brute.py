"""Brute-force versions of the operators over small lists of documents."""

import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def earlier_bytes(docs, length):
    """docs: (id, text); per id: bytes, removed, spans, digest."""
    data = sorted(((i, (t or "").encode()) for i, t in docs), key=lambda d: (d[0] is None, d[0] or 0, d[1]))
    seen, out = set(), []
    for i, b in data:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            w = b[k:k + length]
            if w in seen:
                gone[k:k + length] = [True] * length
            seen.add(w)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def shared_words(docs, window):
    data = [(i, WORD.findall((t or "").encode())) for i, t in docs]
    count = {}
    for _, w in data:
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            count[key] = count.get(key, 0) + 1
    out = []
    for i, w in data:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def repeated_lines(docs, run):
    """docs: (id, text) with distinct ids; per id: (text left, counted lines, removed lines)."""
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for k in range(len(at) - run + 1):
            key = tuple(lines[j] for j in at[k:k + run])
            if key in seen:
                gone.update(at[k:k + run])
            seen.add(key)
        left = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out[i] = (left, len(at), len(gone))
    return out


def near(docs, size, percent):
    """docs: (id, text); per row: (id, set size, component id)."""
    sets = []
    for _, t in docs:
        w = [x.lower() for x in WORD.findall((t or "").encode())]
        sets.append({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(docs):
        r = root(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return [(i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(docs)]
