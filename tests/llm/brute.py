"""Brute-force versions of the operators, over small tables held in memory."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def words(text):
    return WORD.findall((text or "").encode())


def suffix(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), runs, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return out


def substring(rows, length):
    rows = [(i, words(t)) for i, t in rows]
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, w in rows:
        for k in range(len(w) - length + 1):
            x = tuple(w[k : k + length])
            first[x] = min(first.get(x, float("inf")), key(i))
    out = []
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < key(i):
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def shingles(text):
    w = [x.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for x in words(text)]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_duplicates(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    at = list(range(len(sets)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    by = defaultdict(list)
    for x, (_, s) in enumerate(sets):
        for item in s:
            by[item].append(x)
    for y, (_, b) in enumerate(sets):
        for x, shared in Counter(x for item in b for x in by[item] if x < y).items():
            if 100 * shared >= 75 * (len(sets[x][1]) + len(b) - shared):
                at[max(find(x), find(y))] = min(find(x), find(y))
    least = {}
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(least.get(find(x), float("inf")), float("inf") if i is None else i)
    out = []
    for x, (i, s) in enumerate(sets):
        c = least[find(x)]
        out.append((i, len(s), None if c == float("inf") else c))
    return out


def lines(rows, min_docs, min_tokens=4, depth=3, part=0.5, share=0.1, short=False):
    """(number of lines, numbers of those dropped) for each row; ids must differ."""
    split = [(i, (t or "").split("\n") if t else []) for i, t in rows]
    every = []
    for i, ls in split:
        for k, x in enumerate(ls):
            w = tuple(words(x))
            if len(w) >= min_tokens:
                w = tuple(b"\0" if re.search(rb"[0-9]", y) else y for y in w)
                every.append((i, k, (len(w), *w[:depth]), w))
            elif w and short:
                every.append((i, k, (len(w), *w), w))
    leaf = defaultdict(set)
    for i, _, f, _ in every:
        leaf[f].add(i)
    every = [x for x in every if len(leaf[x[2]]) >= min_docs]
    docs = defaultdict(set)
    for i, _, f, w in every:
        docs[f, w].add(i)
    tokens = Counter()
    for (f, w), ids in docs.items():
        for p, t in enumerate(w):
            if t != b"\0" and p >= depth:
                tokens[f, p, t] += len(ids)
    of, seen = [], defaultdict(set)
    for i, k, f, w in every:
        found = []
        if len(docs[f, w]) >= min_docs and (len(w) < min_tokens or sum(t != b"\0" for t in w) >= part * len(w)):
            found.append(("line", f, w))
        constant = tuple((p, t) for p, t in enumerate(w) if t != b"\0" and p >= depth and tokens[f, p, t] >= max(min_docs, share * len(leaf[f])))
        if constant and len(constant) >= part * (len(w) - depth):
            found.append(("template", f, constant))
        for t in found:
            of.append((i, k, t))
            seen[t].add(i)
    gone = defaultdict(set)
    for i, k, t in of:
        if len(seen[t]) >= min_docs and i > min(seen[t]):
            gone[i].add(k)
    return {i: (len(ls), gone[i], "\n".join(x for k, x in enumerate(ls) if k not in gone[i])) for i, ls in split}


def one_edit(a, b):
    """Whether one inserted, deleted or replaced code point makes `a` into `b`."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]
