"""Density discontinuity (manipulation) test at the cutoff, binned version
(McCrary 2008): a histogram with bins that never straddle the cutoff, then a
kernel-weighted local-linear fit of the normalised bin heights on each side.

The histogram is one `groupBy(bin)` (map-side combined); the bin grid, which
includes empty bins, has one row per bin between the data extremes and is made
on the executors; the two side fits need only the bins with rows, as the weights
of all bins are sums of powers.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrd.operators.stats import norm_sf2

TEST_SCHEMA = ("theta double, std_error double, statistic double, p_value double, f_left double, f_right double, "
               "n long, bin_width double, bandwidth double")
BIN_SCHEMA = "bin long, mid double, n long, height double, side string, weight double"


def _defaults(df, x, c, bin_width, bandwidth):
    st = df.agg(F.count(F.col(x)).alias("n"), F.stddev_samp(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    n = int(st["n"])
    if n == 0 or not st["sd"] and (bin_width is None or bandwidth is None):
        return n, bin_width, bandwidth, st["lo"], st["hi"]  # nothing to choose a width by
    b = bin_width if bin_width is not None else 2.0 * st["sd"] * n ** -0.5
    h = bandwidth if bandwidth is not None else 2.576 * st["sd"] * n ** -0.2
    return n, float(b), float(h), st["lo"], st["hi"]


def density_binned(df: DataFrame, x: str, c: float = 0.0, bin_width: float | None = None, bandwidth: float | None = None) -> DataFrame:
    """Bin table: (bin, mid, n, height = n / (N·width), side, in_band, weight)."""
    d = df.select(F.col(x).cast("double").alias("x")).dropna().filter(~F.isnan("x"))
    return _bin_table(d, c, *_defaults(d, "x", c, bin_width, bandwidth))


def _bin_table(d: DataFrame, c: float, n: int, b: float, h: float, lo: float, hi: float) -> DataFrame:
    if lo is None or not b or not h:
        return d.sparkSession.createDataFrame([], BIN_SCHEMA)
    jlo, jhi = math.floor((lo - c) / b), math.floor((hi - c) / b)
    counts = d.groupBy(F.floor((F.col("x") - F.lit(c)) / F.lit(b)).alias("bin")).agg(F.count(F.lit(1)).cast("long").alias("n"))
    grid = d.sparkSession.range(jlo, jhi + 1).withColumnRenamed("id", "bin")
    t = grid.join(counts, on="bin", how="left").fillna(0, subset=["n"])
    mid = F.lit(c) + (F.col("bin") + F.lit(0.5)) * F.lit(b)
    r = F.abs(mid - F.lit(c)) / F.lit(h)
    return t.select(
        F.col("bin"), mid.alias("mid"), F.col("n"), (F.col("n") / F.lit(float(n) * b)).alias("height"),
        F.when(F.col("bin") >= 0, F.lit("right")).otherwise(F.lit("left")).alias("side"),
        F.when(r <= 1.0, 1.0 - r).otherwise(F.lit(0.0)).alias("weight"),
    )


def _band_sums(bins: int, b: float, h: float) -> tuple[float, float, float]:
    """Σ w uᵐ, m = 0, 1, 2, over the `bins` bins next to the cutoff, u = (j + ½) b and w = 1 − u / h, by exact sums of powers."""
    m = max(bins, 0)
    odd = [Fraction(m), Fraction(m * m, 2), Fraction(m * (4 * m * m - 1), 12), Fraction(m * m * (2 * m * m - 1), 8)]  # Σ (j + ½)ᵏ, j < m
    p = [float(v) * b ** k for k, v in enumerate(odd)]
    return p[0] - p[1] / h, p[1] - p[2] / h, p[2] - p[3] / h


def density_test(df: DataFrame, x: str, c: float = 0.0, bin_width: float | None = None, bandwidth: float | None = None) -> DataFrame:
    """θ = ln f₊ − ln f₋ with se = √((1/(N h))·(24/5)·(1/f₊ + 1/f₋)); one-row result."""
    d = df.select(F.col(x).cast("double").alias("x")).dropna().filter(~F.isnan("x"))
    n, b, h, lo, hi = _defaults(d, "x", c, bin_width, bandwidth)
    if n == 0 or not b or not h:
        return d.sparkSession.createDataFrame([(*[None] * 6, n, b, h)], TEST_SCHEMA)
    # only bins with rows are counted; the weights of all bins, empty ones too, are sums of powers in closed form
    bin_ = F.floor((F.col("x") - F.lit(c)) / F.lit(b))
    counts = d.filter((F.col("x") >= c - h - b) & (F.col("x") <= c + h + b)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    u = (F.col("bin") + F.lit(0.5)) * F.lit(b)
    w = F.greatest(F.lit(0.0), 1.0 - F.abs(u) / F.lit(h))
    height = F.col("n") / F.lit(float(n) * b)
    got = {r["right"]: r for r in counts.groupBy((F.col("bin") >= 0).alias("right")).agg(F.sum(w * height).alias("t0"), F.sum(w * u * height).alias("t1")).collect()}
    f = {}
    for side, right, reach in (("left", False, -math.floor((lo - c) / b)), ("right", True, math.floor((hi - c) / b) + 1)):
        if right not in got:
            continue
        s0, s1, s2 = _band_sums(min(reach, math.floor(h / b + 0.5)), b, h)
        s1 = s1 if right else -s1
        det = s0 * s2 - s1 ** 2
        f[side] = (s2 * got[right]["t0"] - s1 * got[right]["t1"]) / det if det else float("nan")
    fl, fr = f.get("left"), f.get("right")
    if fl and fr and fl > 0 and fr > 0:
        theta = math.log(fr) - math.log(fl)
        se = math.sqrt((1.0 / (n * h)) * (24.0 / 5.0) * (1.0 / fr + 1.0 / fl))
        z = theta / se
        row = (theta, se, z, norm_sf2(z), fl, fr, n, float(b), float(h))
    else:
        row = (None, None, None, None, fl, fr, n, float(b), float(h))
    return d.sparkSession.createDataFrame([row], TEST_SCHEMA)


def density_curve(df: DataFrame, x: str, c: float = 0.0, bin_width: float | None = None, bandwidth: float | None = None) -> DataFrame:
    """Smoothed density at every bin midpoint: a triangular-kernel local-linear fit of
    the normalised heights of the bins on the same side within the bandwidth.

    Bins sit on a regular grid, so each bin is sent only to the evaluation points
    within `bandwidth` (2·h/width + 1 offsets, a bounded band), never to all bins.
    """
    d = df.select(F.col(x).cast("double").alias("x")).dropna().filter(~F.isnan("x"))
    n, b, h, lo, hi = _defaults(d, "x", c, bin_width, bandwidth)
    bins = _bin_table(d, c, n, b, h, lo, hi)
    H = int(math.floor(h / b)) if b and h else 0
    e = bins.select("bin", "height", "side", F.explode(F.sequence(F.lit(-H), F.lit(H))).alias("o"))
    e = e.select((F.col("bin") + F.col("o")).alias("at"), "side", "height", (-F.col("o") * F.lit(b or 0.0)).alias("dx"))
    e = e.withColumn("w", F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("dx")) / F.lit(h or 1.0))).filter(F.col("w") > 0)
    w, dx, ht = F.col("w"), F.col("dx"), F.col("height")
    fit = e.groupBy("at", "side").agg(F.sum(w).alias("s0"), F.sum(w * dx).alias("s1"), F.sum(w * dx * dx).alias("s2"),
                                      F.sum(w * ht).alias("t0"), F.sum(w * dx * ht).alias("t1"))
    fit = fit.select(F.col("at").alias("bin"), "side",
                     F.try_divide(F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1"),
                                  F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")).alias("density"))
    return bins.select("bin", "mid", "side", "n", "height").join(fit, on=["bin", "side"], how="left")


# ---------------------------------------------------------------- local-polynomial density (ECDF regression)

#: Distinct values that one task sorts.
ECDF_PER_BUCKET = 200_000
LP_SCHEMA = ("f_left double, f_right double, difference double, std_error double, statistic double, p_value double, "
             "n long, n_left_h long, n_right_h long, bandwidth double, p int")


def _kernel_poly(kernel: str):
    from numpy.polynomial import Polynomial as Poly

    return {"triangular": Poly([1.0, -1.0]), "uniform": Poly([1.0]), "epanechnikov": Poly([1.0, 0.0, -1.0])}[kernel]


def lp_density_constant(p: int = 2, kernel: str = "triangular") -> float:
    """e₁ᵀ Γ⁻¹ Σ Γ⁻¹ e₁ for the one-sided ECDF regression, exact polynomial integrals:
    Γ = ∫₀¹ K r rᵀ, Σ = ∫₀¹∫₀¹ K(u)K(v) r(u) r(v)ᵀ min(u, v)."""
    import numpy as np
    from numpy.polynomial import Polynomial as Poly

    K = _kernel_poly(kernel)
    r = [Poly([0.0] * j + [1.0]) for j in range(p + 1)]
    G = np.array([[float((K * r[j] * r[k]).integ()(1.0)) for k in range(p + 1)] for j in range(p + 1)])
    S = np.zeros((p + 1, p + 1))
    u = Poly([0.0, 1.0])
    for j in range(p + 1):
        for k in range(p + 1):
            f, g = K * r[j], K * r[k]
            # ∫₀¹ g(v) ∫₀ᵛ f(u) u du dv + ∫₀¹ f(u) ∫₀ᵘ g(v) v dv du
            S[j, k] = float(((f * u).integ() * g).integ()(1.0) + ((g * u).integ() * f).integ()(1.0))
    Gi = np.linalg.inv(G)
    return float((Gi @ S @ Gi)[1, 1])


def _ecdf_window(d: DataFrame, c: float, h: float, per_bucket: int | None = None):
    """Distinct values within [c − h, c + h] with their count and ECDF value F̂ = #{x_j ≤ x}/n,
    less its value before c (the fits need slopes only, and small numbers add up more exactly).

    Two-level prefix sum: the count below the window (one aggregate), running totals
    over buckets of distinct values (a window over one row per bucket), and a running
    sum inside each bucket.
    """
    from pyspark.sql import Window

    from panelrd.operators.ranges import range_buckets

    st = d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") < F.lit(c - h)).alias("below"), F.count_if(F.col("x") < F.lit(c)).alias("left")).first()
    n, below, left = int(st["n"]), int(st["below"]), int(st["left"])
    dv = d.filter((F.col("x") >= c - h) & (F.col("x") <= c + h)).groupBy("x").agg(F.count(F.lit(1)).alias("d"))
    dv = range_buckets(dv, [], "x", per_bucket or ECDF_PER_BUCKET)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = dv.groupBy("_b").agg(F.sum("d").alias("t")).select("_b", (F.lit(below) + F.coalesce(F.sum("t").over(before), F.lit(0))).alias("off"))
    w = Window.partitionBy("_b").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dv.withColumn("run", F.sum("d").over(w)).join(offs, on="_b")
    return out.withColumn("F", (F.col("off") + F.col("run") - F.lit(left)) / F.lit(float(n))), n


def density_lp(df: DataFrame, x: str, c: float = 0.0, h: float = 1.0, p: int = 2, kernel: str = "triangular",
               per_bucket: int | None = None) -> DataFrame:
    """Density on each side of c from a local polynomial of order p fitted to the ECDF
    (Cattaneo, Jansson and Ma 2020, unrestricted fit), with the plug-in variance
    f·e₁ᵀΓ⁻¹ΣΓ⁻¹e₁/(n h); test of equal densities.  One-row result."""
    import numpy as np

    from panelrd.operators.rd.cells import kernel_weight

    d = df.select(F.col(x).cast("double").alias("x")).dropna().filter(~F.isnan("x"))
    ec, n = _ecdf_window(d, c, h, per_bucket)
    u = F.col("x") - F.lit(c)
    z = u / F.lit(h)
    wgt = F.col("d") * kernel_weight(u, h, kernel)
    side = F.when(F.col("x") >= c, F.lit(1)).otherwise(F.lit(0))
    aggs = [F.sum(F.when(kernel_weight(u, h, kernel) > 0, F.col("d")).otherwise(0)).alias("nh")]
    aggs += [F.sum(wgt * z ** m).alias(f"S{m}") for m in range(2 * p + 1)]
    aggs += [F.sum(wgt * z ** m * F.col("F")).alias(f"T{m}") for m in range(p + 1)]
    mom = {r["side"]: r.asDict() for r in ec.groupBy(side.alias("side")).agg(*aggs).collect()}
    const = lp_density_constant(p, kernel)
    f, nh = {}, {}
    for s in (0, 1):
        m = mom.get(s)
        nh[s] = int(m["nh"]) if m else 0
        if not m or nh[s] < p + 1:
            f[s] = None
            continue
        G = np.array([[m[f"S{a + b}"] for b in range(p + 1)] for a in range(p + 1)])
        T = np.array([m[f"T{a}"] for a in range(p + 1)])
        f[s] = float(np.linalg.solve(G, T)[1] / h)
    if f[0] is not None and f[1] is not None and f[0] > 0 and f[1] > 0:
        diff = f[1] - f[0]
        se = math.sqrt((f[0] + f[1]) * const / (n * h))
        zst = diff / se
        row = (f[0], f[1], diff, se, zst, norm_sf2(zst), n, nh[0], nh[1], float(h), p)
    else:
        row = (f[0], f[1], None, None, None, None, n, nh[0], nh[1], float(h), p)
    return d.sparkSession.createDataFrame([row], LP_SCHEMA)
