import random

import numpy as np

from panelrd.llm import toxicity
from panelrd.llm.common import table


def test_held_out_precision_and_recall(spark):
    sf = "/root/testdata/sf0.1"
    found = toxicity.op7_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in found)
    assert hit / sum(r.predicted for r in found) > 0.85 and hit / sum(r.toxic for r in found) > 0.85
    assert all(0 <= r.score <= 1 for r in found)


def test_pairs_are_learned():
    """A text is toxic only if it holds both terms: no sum of weights separates that from noise as well."""
    rng = np.random.default_rng(3)
    rows, y = [], []
    for _ in range(1500):
        insult, group = (rng.random(2) < 0.5).tolist()
        rows.append(np.unique(np.concatenate([[1] * insult, [2] * group, rng.integers(10, 200, 6)]).astype(np.int64)))
        y.append(float(insult and group))
    model = toxicity.fit_machine(rows, np.array(y), np.ones(len(y)))
    margin = lambda terms: model.margins(1, *model.known(np.zeros(len(terms), np.int64), np.array(terms, np.int64)))[0][0]
    assert margin([1, 2]) > 0 > max(margin([1]), margin([2]))
    at = np.searchsorted(model.terms, [1, 2])
    assert model.factors[at[0]] @ model.factors[at[1]] > 0.1


def test_terms_neutral_by_themselves_are_kept_for_their_pair():
    """Toxic exactly if both or neither word occurs: each says nothing alone."""
    rng = np.random.default_rng(5)
    rows, y = [], []
    for _ in range(2000):
        a, b = (rng.random(2) < 0.5).tolist()
        rows.append(np.unique(np.concatenate([[1] * a, [2] * b, rng.integers(10, 400, 8)]).astype(np.int64)))
        y.append(float(a == b))
    model = toxicity.fit_machine(rows, np.array(y), np.ones(len(y)))
    assert {1, 2} <= set(model.terms.tolist()) and len(model.terms) < 20
    margin = lambda terms: model.margins(1, *model.known(np.zeros(len(terms), np.int64), np.array(terms, np.int64)))[0][0]
    assert min(margin([1, 2]), margin([])) > 0 > max(margin([1]), margin([2]))


def test_margins_equal_an_explicit_sum_over_pairs():
    rng = np.random.default_rng(6)
    model = toxicity.FactorizationMachine(np.arange(30), 0.3, rng.normal(size=30), rng.normal(size=(30, 4)))
    texts = [np.unique(rng.integers(0, 40, rng.integers(0, 12))) for _ in range(50)]
    row, term = np.repeat(np.arange(50), [len(t) for t in texts]), np.concatenate(texts)
    got, _ = model.margins(50, *model.known(row, term))
    for t, m in zip(texts, got):
        t = [x for x in t.tolist() if x < 30]
        want = 0.3 + sum(model.weights[i] for i in t) + sum(float(model.factors[i] @ model.factors[j]) for i in t for j in t if i < j)
        assert abs(m - want) < 1e-9


def test_own_column_names_do_not_clash(frame):
    from pyspark.sql import functions as F

    table = frame([(1, "a b")]).withColumn("_toxicity", F.lit("x"))
    found = toxicity.score(table, toxicity.fit_machine([], np.zeros(0), np.zeros(0)))
    assert found.columns.count("_toxicity") == 1 and found.first()._toxicity < 0.1


def test_odd_rows(frame, spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["fine", "good", "day", "sun"]) for _ in range(8)) + (" moron scum" if i % 3 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] + [(1, 0), (None, 1), (2, None), (9999, 1)], "doc_id long, toxic int")
    rows += [(1000, None), (1001, ""), (None, "you moron"), (1002, "x" * 9000 + " scum, moron"), rows[0]]
    got = toxicity.op7_toxicity(frame(rows), labels).collect()
    assert len(got) == len(rows)
    flagged = {r.doc_id for r in got if r.predicted}
    assert flagged == {i for i in range(0, 300, 3)} | {None, 1002}
    assert toxicity.op7_toxicity(frame(rows).filter("doc_id < 0"), labels).count() == 0
    assert not any(r.predicted for r in toxicity.op7_toxicity(frame(rows), labels.filter("doc_id < 0")).collect())
