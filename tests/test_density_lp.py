"""Local-polynomial density: dense formulas over all pairs, selected bandwidths, pointwise curve."""

import numpy as np
import pytest

from panelrd.operators import density_lp as D


def sample(seed=1, n=900, ties=True):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 4, n), rng.uniform(0, 3, n // 6)])
    return np.round(x, 2) if ties else x


def frame(spark, x, parts=3):
    return spark.createDataFrame([(float(v),) for v in x], "x double").repartition(parts)


def dense(x, h, orders):
    """f̂ and the jackknife by the full matrix of pairs."""
    n, out = len(x), {}
    F = (x[None, :] <= x[:, None]).sum(axis=1) / n
    for o in orders:
        fs, proj = [], []
        for side in (0, 1):
            w = (x >= 0) == bool(side)
            z = np.where(w, x / h[side], 2.0)
            k = np.where(np.abs(z) <= 1, 1 - np.abs(z), 0.0) / h[side]
            R = np.vander(np.where(k > 0, z, 0), o + 1, increasing=True)
            G = (R * k[:, None]).T @ R
            beta = np.linalg.solve(G, (R * k[:, None]).T @ F)
            l = (np.linalg.inv(G)[1] @ (R * k[:, None]).T) / h[side]
            U = l[:, None] * ((x[None, :] <= x[:, None]) - (R @ beta)[:, None])
            np.fill_diagonal(U, 0)
            fs.append(beta[1] / h[side])
            proj.append((U.sum(axis=1) + U.sum(axis=0)) / (n - 1))
        out[o] = (*fs, np.sqrt(((proj[1] - proj[0]) ** 2).sum()))
    return out


@pytest.mark.parametrize("ties,per_bucket", [(True, 200_000), (False, 200_000), (True, 13)])
def test_jackknife_equals_all_pairs(spark, ties, per_bucket):
    x, h = sample(ties=ties), (3.0, 2.5)
    ref = dense(x, h, (2, 3))
    for r in D.density_lp_auto(frame(spark, x), "x", h=h, per_bucket=per_bucket).collect():
        np.testing.assert_allclose([r["f_left"], r["f_right"], r["std_error"]], ref[r["p"]], rtol=1e-8)
        assert 0.5 < r["std_error"] / r["std_error_plugin"] < 2


def test_constants_by_numerical_integration():
    u = (np.arange(4000) + 0.5) / 4000
    K = 1 - u
    for order in (1, 2, 3, 4):
        R = np.vander(u, order + 1, increasing=True)
        G = (R * K[:, None]).T @ R / len(u)
        S = np.einsum("ia,ij,jb->ab", R * K[:, None], np.minimum.outer(u, u), R * K[:, None]) / len(u) ** 2
        inverse, bias, spread = D.fit_constants(order, "triangular")
        np.testing.assert_allclose(bias, np.linalg.inv(G) @ (R * (K * u ** (order + 1))[:, None]).sum(axis=0) / len(u), rtol=1e-3)
        np.testing.assert_allclose(spread[1, 1], (np.linalg.inv(G) @ S @ np.linalg.inv(G))[1, 1], rtol=1e-2)
    t = np.linspace(-12, 12, 20001)
    third = (3 * t - t ** 3) * np.exp(-t * t / 2) / np.sqrt(2 * np.pi)
    assert abs(D.reference(3) - np.sqrt((third ** 2).sum() * (t[1] - t[0]))) < 1e-9


def test_selected_bandwidths_shrink_with_rows_and_keep_size(spark):
    small, large = (D.density_lp_auto(frame(spark, np.random.default_rng(5).normal(0.5, 1, n)), "x").collect() for n in (500, 8000))
    for a, b in zip(small, large):
        assert a["h_left"] > b["h_left"] > 0.1 and a["h_right"] > b["h_right"] > 0.1
        assert b["p_value"] > 0.01 and abs(b["f_right"] - 0.352) < 0.05
    jump = np.abs(np.random.default_rng(6).normal(0, 1, 4000)) * np.where(np.random.default_rng(7).random(4000) < 0.7, 1, -1)
    assert all(r["p_value"] < 1e-3 and r["difference"] > 0 for r in D.density_lp_auto(frame(spark, jump), "x").collect())


@pytest.mark.parametrize("rule", ["each", "diff", "sum", "comb"])
def test_rules(spark, rule):
    h = D.select_density_bandwidths(D.Ecdf(frame(spark, sample()), "x", 0.0), rule=rule)
    assert min(h) > 0 and (h[0] == pytest.approx(h[1])) == (rule in ("diff", "sum"))


def test_curve_equals_pointwise_fits(spark):
    x, h = sample(3), (2.0003, 1.5007)
    F = np.searchsorted(np.sort(x), x, side="right") / len(x)
    got = D.density_lp_curve(frame(spark, x), "x", h=h, points=9, per_bucket=50).collect()
    assert len(got) == 18
    for r in got:
        side = int(r["side"] == "right")
        z = (x - r["x"]) / h[side]
        m = (np.abs(z) < 1) & ((x >= 0) == bool(side))
        R = np.vander(z[m], 3, increasing=True)
        w = 1 - np.abs(z[m])
        f = np.linalg.solve((R * w[:, None]).T @ R, (R * w[:, None]).T @ F[m])[1] / h[side]
        assert r["density"] == pytest.approx(f, rel=1e-7) and r["n_h"] == m.sum()


def test_too_few_values(spark):
    for rows in ([], [1.0], [1.0, 2.0, 3.0, -1.0], [0.0] * 50):
        got = D.density_lp_auto(spark.createDataFrame([(v,) for v in rows], "x double"), "x").collect()
        assert len(got) == 2 and all(r["statistic"] is None and r["n"] == len(rows) for r in got)
        assert D.density_lp_curve(spark.createDataFrame([(v,) for v in rows], "x double"), "x").count() == 0
