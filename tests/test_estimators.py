"""RD, OLS and density estimators: dense cross-checks and known truths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paths import SF_MID
from panelrd.operators import density as DEN
from panelrd.operators import ols as OLS
from panelrd.operators.rd import RDSpec, rd_bandwidth, rd_grid
from panelrd.plans import roles
from rd_dense import rd_dense


@pytest.fixture(scope="module")
def fixture(spark):
    df = roles.rd_fixture(spark, SF_MID).cache()
    return df, df.toPandas()


def _get(res, method):
    r = [x for x in res.collect() if x["method"] == method][0]
    return r["estimate"], r["std_error"]


@pytest.mark.parametrize("fuzzy,group", [(False, False), (True, False), (True, True), (False, True)])
def test_rd_matches_dense(spark, fixture, fuzzy, group):
    df, pdf = fixture
    res = rd_grid(df, "x", [RDSpec("s", "y", 0.0, 15.0, 15.0, 25.0, 25.0, fuzzy=fuzzy)], treat="t" if fuzzy else None,
                  group="grp" if group else None, vce="hc1")
    ref = rd_dense(pdf.x.values, pdf.y.values, 0.0, 15.0, 25.0, t=pdf.t.values if fuzzy else None,
                   groups=pdf.grp.values if group else None)
    cl, se_cl = _get(res, "conventional")
    bc, _ = _get(res, "bias_corrected")
    rb, se_rb = _get(res, "robust")
    np.testing.assert_allclose([cl, bc, se_cl, se_rb], ref, rtol=1e-8)


def test_planted_effect_recovered(spark, fixture):
    df, _ = fixture
    res = rd_grid(df, "x", [RDSpec("f", "y", 0.0, 15.0, 15.0, 25.0, 25.0, fuzzy=True)], treat="t")
    est, se = _get(res, "robust")
    assert abs(est - 0.2) < 3 * se + 0.01
    sharp = rd_grid(df, "x", [RDSpec("s", "y", 0.0, 15.0, 15.0, 25.0, 25.0)])
    est, se = _get(sharp, "conventional")
    assert abs(est - 0.14) < 3 * se + 0.01


def test_perfect_compliance_fuzzy_equals_sharp(spark, fixture):
    df, _ = fixture
    d = df.withColumn("tp", F.when(F.col("x") >= 0, 1.0).otherwise(0.0))
    f = rd_grid(d, "x", [RDSpec("f", "y", 0.0, 15.0, 15.0, 25.0, 25.0, fuzzy=True)], treat="tp")
    s = rd_grid(d, "x", [RDSpec("s", "y", 0.0, 15.0, 15.0, 25.0, 25.0)])
    for m in ("conventional", "bias_corrected", "robust"):
        np.testing.assert_allclose(_get(f, m), _get(s, m), rtol=1e-9)


def test_shift_scale_and_partition_invariance(spark, fixture):
    df, _ = fixture
    spec = [RDSpec("s", "y", 0.0, 15.0, 12.0, 25.0, 20.0)]
    base = _get(rd_grid(df, "x", spec), "robust")
    shifted = _get(rd_grid(df.withColumn("x", F.col("x") + 5), "x", [RDSpec("s", "y", 5.0, 15.0, 12.0, 25.0, 20.0)]), "robust")
    scaled = _get(rd_grid(df.withColumn("y", F.col("y") * 3), "x", spec), "robust")
    repart = _get(rd_grid(df.repartition(3), "x", spec), "robust")
    np.testing.assert_allclose(shifted, base, rtol=1e-6)
    np.testing.assert_allclose(scaled, (base[0] * 3, base[1] * 3), rtol=1e-9)
    np.testing.assert_allclose(repart, base, rtol=1e-9)


def test_bias_corrected_equals_order_q_fit_when_b_equals_h(spark, fixture):
    df, _ = fixture
    bc = _get(rd_grid(df, "x", [RDSpec("s", "y", 0.0, 15.0, 15.0, 15.0, 15.0)], p=1, q=2), "bias_corrected")[0]
    q2 = _get(rd_grid(df, "x", [RDSpec("s", "y", 0.0, 15.0, 15.0, 15.0, 15.0)], p=2, q=3), "conventional")[0]
    assert abs(bc - q2) < 1e-9


def test_grid_equals_single_fits(spark, fixture):
    df, _ = fixture
    specs = [RDSpec("a", "y", 0.0, 10.0, 10.0, 20.0, 20.0, fuzzy=True), RDSpec("b", "e", 5.0, 12.0, 8.0, 12.0, 8.0)]
    grid = {(r["spec"], r["method"]): r["estimate"] for r in rd_grid(df, "x", specs, treat="t").collect()}
    for s in specs:
        one = {(r["spec"], r["method"]): r["estimate"] for r in rd_grid(df, "x", [s], treat="t").collect()}
        for k, v in one.items():
            assert abs(grid[k] - v) < 1e-12


def test_bandwidths_positive_and_cer_smaller(spark, fixture):
    df, _ = fixture
    mse, cer = rd_bandwidth(df, "x", "y", treat="t", rule=["msetwo", "certwo"], as_dict=True)
    for k in ("h_left", "h_right", "b_left", "b_right"):
        assert mse[k] > 0
    assert cer["h_left"] < mse["h_left"] and cer["b_left"] == mse["b_left"]
    assert mse["h_left"] <= 95 + 1e-6                      # restricted to the side's range


def test_ols_matches_numpy(spark, fixture):
    df, pdf = fixture
    res = {(r["model"], r["term"]): r for r in OLS.ols_models(df, "y", {"m2": ["x", "t"]}).collect()}
    X = np.column_stack([np.ones(len(pdf)), pdf.x.values, pdf.t.values])
    beta, rss, *_ = np.linalg.lstsq(X, pdf.y.values, rcond=None)
    s2 = rss[0] / (len(pdf) - 3)
    se = np.sqrt(np.diag(s2 * np.linalg.inv(X.T @ X)))
    got = [res[("m2", t)] for t in ("(Intercept)", "x", "t")]
    np.testing.assert_allclose([g["estimate"] for g in got], beta, rtol=1e-8)
    np.testing.assert_allclose([g["std_error"] for g in got], se, rtol=1e-6)


def test_t_pvalue():
    from panelrd.operators.stats import norm_sf2, t_sf2

    assert abs(t_sf2(2.0, 10) - 0.07338803477074) < 1e-10
    assert abs(norm_sf2(1.959963984540054) - 0.05) < 1e-12


def test_density_detects_bunching(spark, fixture):
    df, _ = fixture
    smooth = DEN.density_test(df, "x", 0.0, 1.0, 20.0).first()
    cut = df.filter(~((F.col("x") >= -3) & (F.col("x") < 0) & F.col("grp").isin("1-URGENT", "2-HIGH", "3-MEDIUM")))
    bunched = DEN.density_test(cut, "x", 0.0, 1.0, 20.0).first()
    assert bunched["theta"] > smooth["theta"]
    assert bunched["p_value"] < 0.05


@pytest.mark.parametrize("fuzzy,per_bucket", [(False, 200_000), (True, 200_000), (False, 40), (True, 40)])
def test_nn_variance_matches_dense_with_ties(spark, fixture, fuzzy, per_bucket, monkeypatch):
    import panelrd.operators.rd.nn as NN
    from rd_dense import rd_dense_nn

    monkeypatch.setattr(NN, "PER_BUCKET", per_bucket)          # small buckets exercise the cross-bucket halo
    df, _ = fixture
    d = df.withColumn("x", F.round(F.col("x") * 20) / 20)        # ties in the running variable
    pdf = d.select("x", "y", "t").toPandas()
    res = rd_grid(d, "x", [RDSpec("s", "y", 0.0, 15.0, 15.0, 25.0, 25.0, fuzzy=fuzzy)], treat="t" if fuzzy else None, vce="nn")
    got = [_get(res, "conventional")[0], _get(res, "bias_corrected")[0], _get(res, "conventional")[1], _get(res, "robust")[1]]
    ref = rd_dense_nn(pdf.x.values, pdf.y.values, 0.0, 15.0, 25.0, t=pdf.t.values if fuzzy else None)
    np.testing.assert_allclose(got, ref, rtol=1e-9)


def test_auto_bandwidth_fuzzy_recovers_effect(spark, fixture):
    from panelrd.operators.rd import rd

    df, _ = fixture
    res = rd(df, "x", "y", c=0.0, treat="t")
    est, se = _get(res, "robust")
    assert abs(est - 0.2) < 4 * se + 0.01


@pytest.mark.parametrize("vce,fuzzy,group", [("hc1", False, False), ("nn", True, True)])
def test_bandwidth_matches_dense_plugin(spark, fixture, vce, fuzzy, group):
    from rd_dense import bw_dense

    df, pdf = fixture
    r = rd_bandwidth(df, "x", "y", treat="t" if fuzzy else None, group="grp" if group else None, vce=vce, as_dict=True)
    ref = bw_dense(pdf.x.values, pdf.y.values, 0.0, t=pdf.t.values if fuzzy else None,
                   groups=pdf.grp.values if group else None, vce=vce, c_bw=r["pilot"])
    np.testing.assert_allclose([r["h_left"], r["h_right"], r["b_left"], r["b_right"]], ref, rtol=1e-8)


@pytest.mark.parametrize("vce", ["hc1", "nn"])
def test_rd_undefined_sides_give_null_rows(spark, vce):
    rows = [(float(i), float(i % 3)) for i in range(-20, 20)]
    df = spark.createDataFrame(rows, "x double, y double")
    for spec in (RDSpec("empty", "y", 100.0, 5.0, 5.0), RDSpec("tiny", "y", 0.0, 2.5, 2.5)):
        out = rd_grid(df, "x", [spec], vce=vce).collect()
        assert len(out) == 3 and all(r["estimate"] is None and r["std_error"] is None for r in out)


def test_no_jump_outcome_interval_covers_zero(spark, fixture):
    df, _ = fixture
    res = rd_grid(df, "x", [RDSpec("bal", "e", 0.0, 15.0, 15.0, 25.0, 25.0)])
    r = [x for x in res.collect() if x["method"] == "robust"][0]
    assert r["conf_low"] < 0 < r["conf_high"]


def test_study_main_matches_dense_pipeline(spark):
    """The whole main analysis (collapse, joins, cutoffs, fuzzy RD with group controls,
    per-side MSE bandwidths, NN variance) against the dense formulas on the same table."""
    from panelrd.operators.rd import rd
    from panelrd.plans import catalog
    from rd_dense import bw_dense, rd_dense_nn

    t = catalog.study_table(spark, SF_MID)
    res = {r["method"]: r for r in rd(t, "x_treat_b", "persist_1", c=0.0, treat="treat_b", group="n_name").collect()}
    pilot = rd_bandwidth(t, "x_treat_b", "persist_1", treat="treat_b", group="n_name", as_dict=True)["pilot"]
    pdf = t.toPandas().dropna(subset=["x_treat_b", "persist_1", "treat_b", "n_name"])
    x, y, tt, g = pdf.x_treat_b.values, pdf.persist_1.values, pdf.treat_b.values, pdf.n_name.values
    bw = bw_dense(x, y, 0.0, t=tt, groups=g, vce="nn", c_bw=pilot)
    r = res["conventional"]
    np.testing.assert_allclose([r["h_left"], r["h_right"], r["b_left"], r["b_right"]], bw, rtol=1e-5)
    ref = rd_dense_nn(x, y, 0.0, r["h_left"], r["b_left"], t=tt, groups=g, hr=r["h_right"], br=r["b_right"])
    got = [res["conventional"]["estimate"], res["robust"]["estimate"], res["conventional"]["std_error"], res["robust"]["std_error"]]
    np.testing.assert_allclose(got, ref, rtol=1e-5, atol=1e-6)


def test_lp_density_matches_dense_ecdf_regression_and_detects_bunching(spark, fixture):
    from panelrd.operators import density as D2

    df, pdf = fixture
    H = 10.0
    x = np.sort(pdf.x.values)
    n = len(x)
    Fh = np.searchsorted(x, x, side="right") / n
    ref = []
    for m in ((x < 0) & (x >= -H), (x >= 0) & (x <= H)):
        z = x[m] / H
        w = np.maximum(0, 1 - np.abs(z)) / H
        R = np.vander(z, 3, increasing=True)
        ref.append(np.linalg.solve((R * w[:, None]).T @ R, (R * w[:, None]).T @ Fh[m])[1] / H)
    r = D2.density_lp(df, "x", 0.0, H, 2).first()
    np.testing.assert_allclose([r["f_left"], r["f_right"]], ref, rtol=1e-9)
    assert r["p_value"] > 0.01
    cut = df.filter(~((F.col("x") >= -3) & (F.col("x") < 0) & F.col("grp").isin("1-URGENT", "2-HIGH", "3-MEDIUM")))
    b = D2.density_lp(cut, "x", 0.0, H, 2).first()
    assert b["difference"] > 0 and b["p_value"] < 0.05


def test_lp_density_constant_closed_form():
    from panelrd.operators.density import lp_density_constant

    # p = 1, uniform kernel on [0, 1]: Γ = [[1, 1/2], [1/2, 1/3]], Σ from min(u, v) moments
    Gi = np.linalg.inv(np.array([[1, 1 / 2], [1 / 2, 1 / 3]]))
    S = np.array([[1 / 3, 5 / 24], [5 / 24, 2 / 15]])
    assert abs(lp_density_constant(1, "uniform") - (Gi @ S @ Gi)[1, 1]) < 1e-12


def test_lp_density_bucketed_ecdf_equals_single_bucket(spark, fixture, monkeypatch):
    from panelrd.operators import density as D2

    df, _ = fixture
    one = D2.density_lp(df, "x", 0.0, 10.0, 2).first()
    monkeypatch.setattr(D2, "ECDF_PER_BUCKET", 100)      # dozens of buckets: offsets + running sums per bucket
    many = D2.density_lp(df, "x", 0.0, 10.0, 2).first()
    np.testing.assert_allclose([many["f_left"], many["f_right"]], [one["f_left"], one["f_right"]], rtol=1e-12)


def test_rd_materialize_modes_agree(spark, fixture):
    df, _ = fixture
    spec = [RDSpec("s", "y", 0.0, 15.0, 15.0, 25.0, 25.0, fuzzy=True)]
    got = {m: [(r["method"], r["estimate"], r["std_error"]) for r in rd_grid(df, "x", spec, treat="t", materialize_mode=m).collect()]
           for m in ("persist", "checkpoint", "none")}
    assert got["persist"] == got["checkpoint"] == got["none"]


@pytest.mark.parametrize("step", [0.5, 4.0])
def test_mass_points_match_dense_plugin(spark, fixture, step):
    """Few distinct values: the pilot counts them, and windows hold ten of them at least."""
    from rd_dense import bw_dense

    df, pdf = fixture
    r = rd_bandwidth(df.withColumn("x", F.floor(F.col("x") / step) * step), "x", "y", treat="t", masspoints="adjust", as_dict=True)
    x = np.floor(pdf.x.values / step) * step
    values = np.unique(x)
    spread = min(np.std(x, ddof=1), np.subtract(*np.quantile(x, [0.75, 0.25])) / 1.349)
    floors = [np.sort(np.abs(v))[:10].max() for v in (values[values < 0], values[values >= 0])]
    pilot = max(min(2.576 * spread * len(values) ** -0.2, max(abs(x.min()), x.max())), *floors)
    assert r["pilot"] == pytest.approx(pilot, rel=1e-12)
    ref = bw_dense(x, pdf.y.values, 0.0, t=pdf.t.values, c_bw=pilot, floors=floors)
    np.testing.assert_allclose([r["h_left"], r["h_right"], r["b_left"], r["b_right"]], ref, rtol=1e-7)
    plain = rd_bandwidth(df, "x", "y", treat="t", masspoints="adjust", as_dict=True)
    assert plain == pytest.approx(rd_bandwidth(df, "x", "y", treat="t", as_dict=True))
