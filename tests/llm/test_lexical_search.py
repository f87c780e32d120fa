import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from panelrd.llm import lexical_search as L

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def plain(docs, items, k=20):
    """The contract by loops."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if no else i, -s) for r, (s, no, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(60)] + ["\u00e9t\u00e9", "a_b", "x.y", "\u00c9T"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choices(words, weights, k=n))
    docs = [(i, text(rng.choice([1, 3, 10, 40, 300]))) for i in range(n)]
    return docs + [(i, docs[i][1]) for i in range(0, 40)] + [(None, docs[5][1]), (900, None), (901, ""), (902, "., !")], [(i, text(rng.randint(1, 25))) for i in range(25)]


@pytest.mark.parametrize("seed,docs_in_block,at_once,k", [(1, 4096, 4096, 20), (2, 8, 4096, 3), (3, 16, 10, 5), (4, 8, 4096, 1)])
def test_against_brute_force(spark, frame, monkeypatch, seed, docs_in_block, at_once, k):
    docs, items = corpus(seed)
    items += [items[0], (items[1][0], "W3 W3 W50"), (None, "W1"), (77, None), (78, "nowhere to be found"), (79, "")]
    monkeypatch.setattr(L, "BLOCK_DOCS", docs_in_block)
    got = L.search(frame(docs), spark.createDataFrame(items, "item_id long, text string"), k, at_once)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, items, k)


def test_pair_bounds_skip_more_than_single_ones():
    """Two terms that never stand together: their joint bound keeps documents of the one from being looked at."""
    n = 400
    terms_, tfs = np.tile([0, 1], n // 2), np.ones(n, np.int64)
    terms_ = np.append(terms_, [0, 2] * 10)
    count = np.append(np.ones(n, np.int64), np.full(10, 2))
    tfs = np.append(tfs, np.ones(20, np.int64))
    q = L.Queries.of([(np.array([0, 1, 2]), np.array([1, 1, 1]))], np.array([90, 100, 150]))
    assert q.first.tolist() == [2, 0] and q.second.tolist() == [1, -1]
    q = L.Queries(np.array([0, 0]), np.array([0, 2]), np.array([1, -1]), np.array([90, 150]), np.array([100, 0]), np.array([0, 2]))
    single = L.Queries(np.array([0, 0, 0]), np.array([0, 1, 2]), np.array([-1, -1, -1]), np.array([90, 100, 150]), np.zeros(3, np.int64), np.array([0, 3]))
    scored = []
    for queries in (q, single):
        block = L._index_block(np.arange(len(count)), count, count, terms_, tfs, queries, (len(count), int(count.sum())))
        search = L.BlockSearch(queries, np.array([140 * int(block[4][0])]), 10)
        search.add(*block[:7])
        scored.append((search.scored, [b.tolist() for b in search.best[0]]))
    assert scored[0][1] == scored[1][1] and scored[0][0] <= scored[1][0] and len(scored[0][1][0]) == 10


def test_long_texts_and_empty_tables(spark, frame, monkeypatch):
    docs = [(1, "one two " * 400_000), (2, "one"), (3, "x" * 3_000_000 + " two")]
    items = [(1, "one two"), (2, "x" * 3_000_000)]
    given = spark.createDataFrame(items, "item_id long, text string")
    got = L.search(frame(docs), given).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(docs, items)
    assert L.search(frame(docs).limit(0), given).count() == 0 and L.search(frame(docs), given.limit(0)).count() == 0
