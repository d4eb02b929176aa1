"""Plain versions of the operators, one text at a time."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, block string, kept string, rule string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, texts, ids=None):
    """Documents whose further columns are named like columns that operators use or add."""
    ids = range(1, len(texts) + 1) if ids is None else ids
    rows = [(i, t, None if n % 5 == 0 else "en", f"s{n % 2}", n, 1, "x", "y", "z") for n, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def remove_bytes(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = {j for i in range(len(b) - length + 1) if seen[b[i : i + length]] > 1 for j in range(i, i + length)}
        spans = sum(j - 1 not in gone for j in gone)
        out.append((len(b), len(gone), spans, sha(bytes(c for i, c in enumerate(b) if i not in gone))))
    return out


def remove_words(rows, length):
    """rows: (id, text); a NULL id is smaller than all others."""
    rank = [(i is not None, i or 0) for i, _ in rows]
    split = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for r, w in zip(rank, split):
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            first[key] = min(first.get(key, r), r)
    out = []
    for r, w in zip(rank, split):
        gone = {j for i in range(len(w) - length + 1) if first[tuple(w[i : i + length])] < r for j in range(i, i + length)}
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode())))
    return out


def shingles(text, width=4):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def classes(texts, percent=85):
    """Index of the first text of each text's component."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def contamination(text, items, width=13):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = pattern.findall(lower(text))
    hit, found = set(), set()
    for item, body in items:
        own = pattern.findall(lower(body))
        n = min(width, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def best_fit(lengths, size):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, c in enumerate(free) if c >= n]
        if fits:
            free[min(fits, key=free.__getitem__)] -= n
        else:
            free.append(size - n)
    return len(free)


def reach(edges):
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    out = {}
    for node in sorted(near):
        todo = [] if node in out else [node]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = node
                todo += near[x]
    return out
