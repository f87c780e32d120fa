"""Joins on NULL keys, models over their own rows, sparse bins, differenced plot bins, duplicates in pivots."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelrd.operators import bins, density, ols, panel, reshape, summary
from panelrd.operators.attach import attach


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("null_safe", [True, False])
@pytest.mark.parametrize("bound", [100, 0])
def test_joins_with_null_keys_equal_plain_loops(spark, how, null_safe, bound, monkeypatch):
    monkeypatch.setattr(panel._null_keys, "__defaults__", (bound, 3))
    a = [(None, 1, "a"), (None, 1, "b"), (None, None, "c"), (1, None, "d"), (1, 1, "e"), (2, 2, "f"), (9, None, "g"), (None, 7, "h")]
    b = [(None, 1, "A"), (None, None, "B"), (None, None, "C"), (1, 1, "D"), (1, 1, "E"), (3, 3, "F"), (1, None, "G"), (None, 8, "H")]
    got = rows(panel.join_on(spark.createDataFrame(a, "k int, m int, v string"), spark.createDataFrame(b, "k2 int, m2 int, v string").withColumnRenamed("v", "w"), [("k", "k2"), ("m", "m2")], how, null_safe))
    meets = lambda x, y: all(p == q and (null_safe or p is not None) for p, q in zip(x[:2], y[:2]))
    want = [(*x, y[2]) for x in a for y in b if meets(x, y)]
    want += [(*x, None) for x in a if not any(meets(x, y) for y in b)] if how in ("left", "full") else []
    want += [(*y[:2], None, y[2]) for y in b if not any(meets(x, y) for x in a)] if how in ("right", "full") else []
    assert got == sorted(want, key=str)


def test_hot_null_keys_stay_where_they_are(spark):
    """A third of the rows have no key: they are not shuffled to one task."""
    a = spark.range(30_000).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("k"), F.col("id").alias("v")).repartition(8)
    b = spark.range(0, 30_000, 5).select(F.col("id").alias("k2"), (F.col("id") * 2).alias("w"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = panel.join_on(a, b.unionByName(spark.createDataFrame([(None, 5)], "k2 long, w long")), [("k", "k2")], "left")
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 30_000 and out.filter("k IS NULL AND w = 5").count() == 10_000
    assert max(sizes) <= 2 * np.median(sizes) + 500


def test_attach_refuses_joins_that_keep_the_repeated_side(spark):
    with pytest.raises(ValueError):
        attach(spark.range(3), spark.range(2), ["id"], how="right")


def test_models_have_their_own_rows_in_one_scan(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(5, 2, (400, 3))
    y = 1 + X @ [0.5, -1, 2] + rng.normal(0, 1, 400)
    X[rng.random((400, 3)) < 0.2] = np.nan
    y[rng.random(400) < 0.1] = np.nan
    null = lambda v: None if math.isnan(v) else float(v)
    df = spark.createDataFrame([(null(p), *map(null, q)) for p, q in zip(y, X)], "y double, a double, b double, c double")
    models = {"m1": ["a"], "m2": ["a", "b"], "m3": ["c", "b", "a"]}
    got = {(r["model"], r["term"]): r for r in ols.ols_models(df, "y", models, complete_on_all=False).collect()}
    for name, xs in models.items():
        M = X[:, ["abc".index(c) for c in xs]]
        ok = ~np.isnan(M).any(axis=1) & ~np.isnan(y)
        A = np.column_stack([np.ones(ok.sum()), M[ok]])
        beta, rss, *_ = np.linalg.lstsq(A, y[ok], rcond=None)
        se = np.sqrt(np.diag(rss[0] / (ok.sum() - len(xs) - 1) * np.linalg.inv(A.T @ A)))
        for i, term in enumerate(["(Intercept)", *xs]):
            r = got[name, term]
            assert r["n"] == ok.sum() and r["estimate"] == pytest.approx(beta[i], rel=1e-9) and r["std_error"] == pytest.approx(se[i], rel=1e-9)


def test_density_test_with_very_narrow_bins(spark):
    x = np.random.default_rng(2).normal(1, 5, 3000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    r = density.density_test(df, "x", 0.0, (x.max() - x.min()) * 1e-9, 4.0).first()
    wide = density.density_test(df, "x", 0.0, 0.01, 4.0).first()
    assert r["theta"] == pytest.approx(wide["theta"], abs=0.02) and r["std_error"] == pytest.approx(wide["std_error"], rel=0.05)
    grid = density.density_binned(df, "x", 0.0, 0.5, 4.0)
    f = {}
    for side in ("left", "right"):
        p = grid.filter((F.col("side") == side) & (F.col("weight") > 0)).toPandas()
        A = np.column_stack([np.ones(len(p)), p.mid])
        f[side] = np.linalg.solve((A * p.weight.values[:, None]).T @ A, (A * p.weight.values[:, None]).T @ p.height)[0]
    t = density.density_test(df, "x", 0.0, 0.5, 4.0).first()
    assert (t["f_left"], t["f_right"]) == pytest.approx((f["left"], f["right"]), rel=1e-9)


@pytest.mark.parametrize("values", [[], [1.0], [2.0, 2.0, 2.0], [None, float("nan")]])
def test_density_without_width_on_too_little(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    r = density.density_test(df, "x").first()
    assert r["theta"] is None and r["n"] == sum(v is not None and v == v for v in values)
    assert density.density_binned(df, "x").count() == 0 and density.density_curve(df, "x").count() == 0


@pytest.mark.parametrize("spaced", ["even", "quantile"])
@pytest.mark.parametrize("per_bucket", [200_000, 7])
def test_plot_bins_from_differences(spark, spaced, per_bucket):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(0, 3, 600), 1)
    y = 2 + 0.5 * x + (x >= 0) + rng.normal(0, 0.7, 600)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (1.0, None), (float("nan"), 2.0)], "x double, y double")
    got = bins.rd_plot_data(df, "x", "y", p=2, spaced=spaced, per_bucket=per_bucket).collect()
    for side in (0, 1):
        m = (x >= 0) == bool(side)
        v, d = np.unique(x[m], return_counts=True)
        mean = np.array([y[m][x[m] == a].mean() for a in v])
        dy2, dx = 2 * np.diff(mean) ** 2 / (1 / d[1:] + 1 / d[:-1]), np.diff(v)
        n = m.sum()
        lo, hi = (v[0], 0.0) if side == 0 else (0.0, v[-1])
        V = n / 4 * (dx ** 2 * dy2).sum() / (hi - lo) ** 2 if spaced == "even" else dy2.mean() / 2
        J = math.ceil(np.var(y[m], ddof=1) / V * n / math.log(n) ** 2)
        if spaced == "even":
            b = np.clip(np.floor((x[m] - lo) / ((hi - lo) / J)), 0, J - 1)
        else:
            first = np.cumsum(d) - d
            b = np.floor(first[np.searchsorted(v, x[m])] * J / n)
        coef = np.polyfit(x[m], y[m], 2)
        want = sorted((int(k), int((b == k).sum()), J, x[m][b == k].mean(), y[m][b == k].mean(), np.polyval(coef, x[m][b == k].mean())) for k in np.unique(b))
        mine = sorted(tuple(r)[1:] for r in got if r["side"] == side)
        assert [w[:3] for w in want] == [g[:3] for g in mine]
        np.testing.assert_allclose([w[3:] for w in want], [g[3:] for g in mine], rtol=1e-7, atol=1e-9)


def test_plot_bins_on_too_little(spark):
    empty = spark.createDataFrame([], "x double, y double")
    assert bins.rd_plot_data(empty, "x", "y").count() == 0
    one = bins.rd_plot_data(spark.createDataFrame([(1.0, 2.0), (-1.0, 3.0), (-1.0, 5.0)], "x double, y double"), "x", "y").collect()
    assert sorted((r["side"], r["n"], r["J"], r["y_mean"], r["y_fit"]) for r in one) == [(0, 2, 1, 4.0, None), (1, 1, 1, 2.0, None)]


def test_histogram_returns_empty_bins(spark):
    df = spark.createDataFrame([(0.5, "a"), (3.5, "b"), (None, "c")], "x double, g string")
    assert [r["n"] for r in bins.histogram(df, "x", 4, 0.0, 4.0).orderBy("bin").collect()] == [1, 0, 0, 1]
    assert rows(bins.histogram(df, "x", 2, 0.0, 4.0, by=["g"]).select("g", "bin", "n")) == [("a", 0, 1), ("a", 1, 0), ("b", 0, 0), ("b", 1, 1), ("c", 0, 0), ("c", 1, 0)]


def test_duplicates_in_a_pivot_are_an_error_or_aggregated(spark):
    df = spark.createDataFrame([(1, "A", "x"), (1, "A", "y"), (2, "R", "z")], "id int, type string, span string")
    with pytest.raises(Exception, match="more than one span"):
        reshape.pivot_first(df, ["id"], "type", "span", ["A", "R"]).collect()
    assert rows(reshape.pivot_first(df, ["id"], "type", "span", ["A", "R"], duplicates=F.max)) == [(1, "y", None), (2, None, "z")]


def test_bubble_table_is_one_plan(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 2.0, 4.0), ("c", 3.0, 6.0)], "g string, x double, y double")
    assert [r["y_fit"] for r in summary.bubble_table(df, "g", "x", "y").orderBy("g").collect()] == pytest.approx([2.0, 4.0, 6.0])
    assert summary.bubble_table(df.limit(0), "g", "x", "y").count() == 0
    assert summary.bubble_table(df.limit(1), "g", "x", "y").first()["y_fit"] is None
