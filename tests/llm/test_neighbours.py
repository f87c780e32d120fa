import numpy as np

from panelrd.llm import neighbours
from panelrd.llm.common import table, written


def exact(ids, v, q, k):
    s = (v * v[ids == q][0]).sum(axis=1)
    s[ids == q] = -np.inf
    return ids[np.lexsort((ids, -s))[:k]]


def search(spark, ids, v, k=5, **options):
    df = spark.createDataFrame([(int(i), x.tolist(), "extra", 1.0) for i, x in zip(ids, v)], "id long, v array<double>, key string, score double")
    found = neighbours.search(df, df.filter("id % 10 = 0"), "id", "v", k, **options).collect()
    return {q: [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in found}}, found


def test_recall_on_the_table(spark, sf_small):
    rows = table(spark, sf_small, "embeddings").orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    found = neighbours.op9_nearest_neighbours(table(spark, sf_small, "embeddings")).collect()
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append(r)
    hits = [len(set(exact(ids, v, q, 20)) & {r.vec_id for r in rs}) for q, rs in by.items()]
    assert len(by) == (ids % 20 == 0).sum() and np.mean(hits) / 20 >= 0.9
    r = by[0][0]
    assert r.score == (v[ids == r.vec_id][0] * v[ids == 0][0]).sum()


def test_lengths_differ_and_many_buckets(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    v = centres[rng.integers(0, 40, 3000)] + 0.2 * rng.normal(size=(3000, 16))
    v *= rng.uniform(0.2, 3, (3000, 1))
    ids = np.arange(3000)
    found, _ = search(spark, ids, v, k=10, bucket=20)
    recall = np.mean([len(set(found[q]) & set(exact(ids, v, q, 10))) / 10 for q in range(0, 3000, 10)])
    assert recall >= 0.9


def recall(found, ids, v, k):
    return np.mean([len(set(found[q]) & set(exact(ids, v, q, k))) / k for q in found])


def test_lengths_over_decades_and_one_very_long_vector(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(2000, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.arange(2000)
    spread, long = v * rng.lognormal(0, 0.5, (2000, 1)), v.copy()
    long[7] *= 1000
    decades = v * 10.0 ** rng.uniform(-3, 3, (2000, 1))
    for x in (spread, long, decades):
        found, rows = search(spark, ids, x, k=20, bucket=32)
        assert len(found) == 200 and all(len(f) == 20 for f in found.values())
        assert recall(found, ids, x, 20) >= 0.9


def test_keys_of_two_hashes(spark):
    """So many keys that a second hash comes in: tables and probes grow until enough is found."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(3000, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert len(neighbours.CrossPolytope.sized(13, 3000, 4, 4).axes) == 2
    found, _ = search(spark, np.arange(3000), v, k=10, bucket=4)
    assert recall(found, np.arange(3000), v, 10) >= 0.9


def test_without_a_good_choice_all_rows_are_searched(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(1500, 16))
    found, _ = search(spark, np.arange(1500), v, k=10, bucket=4, tables=(1,), probes=(1,))
    assert recall(found, np.arange(1500), v, 10) == 1.0


def test_short_results_are_filled(spark, monkeypatch):
    """With hardly any probes some queries find less than k rows; these are searched against all."""
    monkeypatch.setattr(neighbours, "LEAST", 0.0)
    rng = np.random.default_rng(10)
    v = rng.normal(size=(1000, 16))
    found, _ = search(spark, np.arange(1000), v, k=20, bucket=8, tables=(1,), probes=(1,))
    assert len(found) == 100 and all(len(f) == 20 for f in found.values())


def test_ties_go_to_smaller_ids_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    v = np.ones((200, 8))
    v[150:] = np.random.default_rng(1).normal(size=(50, 8)) * 0.1
    found, rows = search(spark, np.arange(200), v)
    assert found[0] == [1, 2, 3, 4, 5] and found[100] == [0, 1, 2, 3, 4]
    assert all([r.rank for r in rows if r.query_id == q] is not None for q in found)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (10, [0.0, 2.0]), (10, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, df.filter("vec_id % 10 = 0"), "vec_id", "embedding").collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 0.5), (0, 2, 10, 0.0), (10, 1, 1, 1.0), (10, 2, 0, 0.0)]
    assert neighbours.op9_nearest_neighbours(df.filter("vec_id > 99")).count() == 0


def test_choice_counts_the_rows_of_vectors_in_every_table():
    """Found by 4 tables and 16 probes, or by 8 and 4: another table costs a row for each vector, another probe one for each query."""

    class Planned:
        whole, index = False, property(lambda self: self)

        def lifted(self, v, asks):
            return v

        def probes(self, v, n):
            keys = np.full((len(v), 64, n), 0 if n == 1 else -1)
            if n > 1:
                keys[:, 0, 15] = keys[:, 4, 3] = 0
            return keys

    given = [{"query_id": 0, "c": 0, "v": [1.0]}], np.array([0]), np.array([[1.0]]), {0: Planned()}, neighbours.TABLES, neighbours.PROBES
    assert neighbours.measured_choice(*given) == (8, 4, 1.0)
    assert neighbours.measured_choice(*given, 20.0) == (4, 16, 1.0)


def made_by_blocks(spark, monkeypatch, ids, v, **options):
    """Rows that blocks give back for a query, and the search's rows."""
    made, plain = [], neighbours._blockwise

    def counted(*a):
        out = written(plain(*a), "counted")
        made.append(out.count())
        return out

    with monkeypatch.context() as patched:
        patched.setattr(neighbours, "_blockwise", counted)
        _, rows = search(spark, ids, v, **options)
    return sum(made) / (ids % 10 == 0).sum(), {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in rows}


def test_more_probes_make_few_more_rows(spark, monkeypatch):
    """Each bucket gave its k best to each query that probes it: 8 * 32 of them here, 8 times as many as 4 * 8."""
    monkeypatch.setattr(neighbours, "LEAST", 0.0)
    rng = np.random.default_rng(11)
    v = rng.normal(size=(3000, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.arange(3000)
    few, _ = made_by_blocks(spark, monkeypatch, ids, v, k=10, bucket=32, tables=(4,), probes=(8,))
    many, found = made_by_blocks(spark, monkeypatch, ids, v, k=10, bucket=32, tables=(8,), probes=(32,))
    assert many < 2.5 * few and many < 10 * 8 * 32 / 5
    assert np.mean([found[q, r][0] in exact(ids, v, q, 10) for q, r in found]) >= 0.9


def test_rounds_lose_no_row_that_their_buckets_hold(spark, monkeypatch):
    """The result of probing everything at once, copies and ties included, whatever the rounds' bounds leave out."""
    rng = np.random.default_rng(12)
    v = np.round(rng.normal(size=(1200, 8)), 1) * 10.0 ** rng.integers(-2, 3, (1200, 1))
    v[300:340] = v[300]
    ids = np.arange(1200)
    options = dict(k=5, bucket=16, tables=(6,), probes=(8,))
    monkeypatch.setattr(neighbours, "LEAST", 0.0)
    _, rows = search(spark, ids, v, **options)
    monkeypatch.setattr(neighbours, "probe_rounds", lambda tables, probes: [(0, tables, 0, probes)])
    _, whole = search(spark, ids, v, **options)
    key = lambda r: (r.query_id, r["rank"], r.vec_id, r.score)
    assert sorted(map(key, rows)) == sorted(map(key, whole)) and len(rows) == 600


def test_blocks_of_all_rows_make_few_rows(spark, monkeypatch):
    """Searched against all rows: 47 blocks, of which each gave its k best to each query."""
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    rng = np.random.default_rng(13)
    v, ids = rng.normal(size=(1500, 16)), np.arange(1500)
    made, found = made_by_blocks(spark, monkeypatch, ids, v, k=10, bucket=4, tables=(1,), probes=(1,))
    assert made < 10 * 47 / 3
    assert all(found[q, r][0] == exact(ids, v, q, 10)[r - 1] for q, r in found)


def test_unit_vectors_are_one_class(spark, monkeypatch):
    """Lengths that rounding puts on either side of 1 fell into two classes, and every query probed both."""
    seen, plain = [], neighbours.length_classes
    monkeypatch.setattr(neighbours, "length_classes", lambda *a: seen.append(plain(*a)) or seen[-1])
    v = np.random.default_rng(14).normal(size=(500, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    search(spark, np.arange(500), v.astype(float), bucket=16)
    assert len(seen[0]) == 1
