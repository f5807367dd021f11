"""Plain versions of the operators, one document after the other."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def substring_dedup(docs, length=20):
    seen, out = set(), []
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if key in seen:
                gone[i : i + length] = [True] * length
            seen.add(key)
        out.append((doc_id, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out)


def suffix_dedup(docs, length=400):
    places = defaultdict(int)
    texts = [(d, (t or "").encode()) for d, t in docs]
    for _, b in texts:
        for i in range(len(b) - length + 1):
            places[b[i : i + length]] += 1
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if places[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out)


def line_dedup(docs, longest=10):
    """Flags of removed lines: windows of 2 to `longest` lines, two of them spoken, that occur earlier."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        lines = text.split("\n")
        gone = [False] * len(lines)
        for i in range(len(lines)):
            for j in range(i + 2, min(i + longest, len(lines)) + 1):
                w = tuple(lines[i:j])
                if sum(1 for x in w if x.strip()) > 1:
                    if w in seen:
                        gone[i:j] = [True] * (j - i)
                    seen.add(w)
        out[doc_id] = gone
    return out


def shingles(text: str | None, k: int) -> frozenset:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near_groups(docs, k=3, num=90, den=100):
    sets = {d: shingles(t, k) for d, t in docs}
    ids = sorted(sets)
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by_token = defaultdict(list)
    for d in ids:
        s = sets[d]
        found = defaultdict(int)
        for t in s:
            for e in by_token[t]:
                found[e] += 1
            by_token[t].append(d)
        for e, i in found.items():
            if den * i >= num * (len(s) + len(sets[e]) - i):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return sorted((d, len(sets[d]), find(d)) for d in ids)
