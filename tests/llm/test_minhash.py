import random

import brute
import numpy as np
from pyspark.sql import functions as F

from panelrd.llm import components, minhash


def families(seed):
    """Groups of near copies around the threshold, chains, exact copies, and odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    rows, i = [], 10
    for _ in range(25):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                base = copy  # a chain
            rows.append((i, " ".join(copy)))
            i += 1
    rows += [(1, "One  two\tTHREE"), (2, "one two three"), (3, None), (4, ""), (5, " \n"), (6, "one two"), (None, rows[0][1]), (None, "alone here"), rows[2]]
    return rows


def test_components_match_brute_force(frame):
    for seed in (1, 2):
        rows = families(seed)
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(rows)).collect()), key=str)
        assert got == sorted(brute.near_duplicates(rows), key=str)


def test_keep_one(frame):
    rows = families(3)
    table = frame(rows)
    kept = minhash.keep_one(table)
    assert kept.columns == table.columns
    found = brute.near_duplicates(rows)
    words = {c for _, n, c in found if n and c is not None}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == sorted(words | {3, 4, 5})
    assert got.count(None) == 1  # "alone here"; the other null id has a copy with an id


def test_links_between_members_that_never_were_hubs(frame, monkeypatch):
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, rows = words(60), []
    for k in range(40):  # texts of much boilerplate, all in one bucket; ten have a near one
        own = words(50)
        rows.append((k, " ".join(shared + own)))
        if k % 4 == 0:
            rows.append((100 + k, " ".join(shared + own[:-1] + words(1))))
    hashed = minhash.hashed_documents
    monkeypatch.setattr(minhash, "hashed_documents", lambda docs: hashed(docs).withColumn("buckets", F.expr("IF(n > 0, array(1L, 2L), NULL)")))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(rows)).collect())
    assert got == sorted(brute.near_duplicates(rows))
    assert sum(i != c for i, _, c in got) == 10


def test_empty_table_and_no_links(frame):
    assert minhash.op3_minhash_dedup(frame([(1, "a")]).filter("doc_id < 0")).count() == 0
    assert [(r.component_id, r.kept) for r in minhash.op3_minhash_dedup(frame([(1, None), (2, "a b")])).orderBy("doc_id").collect()] == [(1, True), (2, True)]


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(4)
    for part in (0.5, 0.75, 0.9):
        agree = []
        for _ in range(60):
            both = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
            k = int(400 * part)
            a, b = np.sort(both[: k + (400 - k) // 2]), np.sort(np.append(both[:k], both[k + (400 - k) // 2 :]))
            s = minhash.signatures([a, b])
            agree.append((s[0] == s[1]).mean())
        assert abs(np.mean(agree) - part) < 0.03


def test_components_of_chains(spark, frame):
    links = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (200, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long"), "t").collect()}
    assert got == {**{k: 0 for k in range(41)}, 90: 90, 95: 90, 100: 90}


def test_rounds_end_when_they_confirm_few_of_their_edges(frame, monkeypatch):
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, rows = words(60), []
    for k in range(130):  # texts of much boilerplate in one bucket, each with one near text: a hub finds one link
        own = words(50)
        rows += [(2 * k, " ".join(shared + own)), (2 * k + 1, " ".join(shared + own[:-1] + words(1)))]
    hashed, confirm, calls = minhash.hashed_documents, minhash.confirmed, []
    monkeypatch.setattr(minhash, "hashed_documents", lambda docs: hashed(docs).withColumn("buckets", F.expr("IF(n > 0, array(1L, 2L), NULL)")))
    monkeypatch.setattr(minhash, "confirmed", lambda *a: calls.append(1) or confirm(*a))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(rows)).collect())
    assert got == sorted(brute.near_duplicates(rows))
    assert sum(i != c for i, _, c in got) == 130
    assert len(calls) == 3  # the first hubs, one round, the exact join
