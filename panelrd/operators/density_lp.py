"""Density on both sides of a cutoff by local polynomials of the distribution function, as it is called: without a bandwidth.

Cattaneo, Jansson and Ma (2020): a polynomial of order p is fitted to F̂ on each side with kernel weights; its slope is the
density.  Everything is computed from one written table of distinct values with their counts and cumulative counts:

* bandwidths: mean-squared-error plug-ins of each side, of the difference and of the sum, with derivatives from a fit of order
  p + 2 whose own bandwidth comes from a normal reference;
* variance: the jackknife of the second-order U-statistic.  f̂ = Σ l_i F̂_i with weights l of the fit, so the pairs
  U_ij = l_i (1(x_j ≤ x_i) − fit_i) are summed over j by a cumulative count and over i by a suffix sum of l: no pairs are made;
* test: the difference of the densities at order p, and at order p + 1 with the same bandwidths (robust to the bias of order p);
* curve: pointwise fits on a grid.  The triangular kernel is linear on either side of a grid point, so its moments come from
  sums of powers of x, and of F̂ times them, up to three borders of each point; rows are summed between borders once.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
from numpy.polynomial import Polynomial as Poly
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrd.operators.ranges import range_buckets
from panelrd.operators.rd.cells import kernel_weight, powers
from panelrd.operators.stats import norm_sf2
from panelrd.session import drop_shared, jit_friendly, save_shared

#: Distinct values that one task sorts.
PER_BUCKET = 200_000
#: Distinct values that a window must hold besides the fit's coefficients.
LEAST_VALUES = 20
_KERNELS = {"triangular": Poly([1.0, -1.0]), "uniform": Poly([0.5]), "epanechnikov": Poly([0.75, 0.0, -0.75])}
AUTO_SCHEMA = ("method string, f_left double, f_right double, difference double, std_error double, std_error_plugin double, statistic double, p_value double, "
               "n long, n_left_h long, n_right_h long, h_left double, h_right double, p int")
CURVE_SCHEMA = "side string, point int, x double, density double, n_h long"


def fit_constants(order: int, kernel: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the one-sided fit on [0, 1], exact: Γ⁻¹, Γ⁻¹ ∫ K r u^(order+1), and Γ⁻¹ Σ Γ⁻¹ with Σ = ∫∫ K K r rᵀ min(u, v)."""
    K, u = _KERNELS[kernel], Poly([0.0, 1.0])
    r = [u ** j for j in range(order + 1)]
    inverse = np.linalg.inv([[(K * a * b).integ()(1.0) for b in r] for a in r])
    bias = inverse @ [(K * a * u ** (order + 1)).integ()(1.0) for a in r]
    spread = [[((K * a * u).integ() * K * b).integ()(1.0) + ((K * b * u).integ() * K * a).integ()(1.0) for b in r] for a in r]
    return inverse, bias, inverse @ np.array(spread) @ inverse


def reference(k: int) -> float:
    """Root of the mean square of the k-th derivative of the standard normal density, ∫ (φ⁽ᵏ⁾)²."""
    return math.sqrt(math.factorial(2 * k) / (2 ** (2 * k + 1) * math.factorial(k) * math.sqrt(math.pi)))


class Ecdf:
    """Distinct values `x` of a column with `d`, their rows, and `cum`, the rows up to them, written once.  NULL and NaN are left out."""

    def __init__(self, df: DataFrame, x: str, c: float, per_bucket: int | None = None):
        per_bucket = per_bucket or PER_BUCKET
        self.spark, self.c = df.sparkSession, float(c)
        value = df.select(F.col(x).cast("double").alias("x")).dropna().filter(~F.isnan("x"))
        counts = save_shared(value.groupBy("x").agg(F.count(F.lit(1)).alias("d")), "ecdf-counts")
        left = F.col("x") < self.c
        s = counts.agg(F.count(F.lit(1)).alias("values"), F.sum("d").alias("n"), F.sum(F.when(left, F.col("d"))).alias("left"), F.min("x").alias("lo"), F.max("x").alias("hi"),
                       F.count_if(left).alias("vl"), F.sum(F.col("d") * F.col("x")).alias("sum")).first()
        self.n, self.left, self.values = int(s["n"] or 0), int(s["left"] or 0), (int(s["vl"]), int(s["values"] - s["vl"]))
        self.lo, self.hi, self.sum = s["lo"], s["hi"], s["sum"]
        cut = range_buckets(counts, [], "x", per_bucket) if s["values"] > per_bucket else counts.withColumn("_b", F.array(F.lit(0).cast("long")))
        before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        starts = cut.groupBy("_b").agg(F.sum("d").alias("t")).select("_b", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("start"))  # a row for each bucket
        inside = Window.partitionBy("_b").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self.table = save_shared(cut.withColumn("run", F.sum("d").over(inside)).join(starts, "_b").select("x", "d", (F.col("start") + F.col("run")).alias("cum"), "_b"), "ecdf")
        drop_shared(counts)

    def drop(self) -> None:
        drop_shared(self.table)

    def spread(self) -> float:
        gap = F.col("x") - F.lit(self.sum / self.n)
        return math.sqrt(self.table.agg(F.sum(F.col("d") * gap * gap)).first()[0] / (self.n - 1))

    def reach(self) -> tuple[float, float]:
        """The range of each side."""
        return self.c - self.lo, self.hi - self.c

    def nearest(self, k: int) -> tuple[float, float]:
        """How far the k-th distinct value of each side is from c; the farthest where there are fewer."""
        left = [r["x"] for r in self.table.filter(F.col("x") < self.c).orderBy(F.desc("x")).limit(k).select("x").collect()]
        right = [r["x"] for r in self.table.filter(F.col("x") >= self.c).orderBy("x").limit(k).select("x").collect()]
        return self.c - left[-1], right[-1] - self.c

    def moments(self, fits: Sequence[tuple[int, float, int]], kernel: str) -> list[dict]:
        """(side, h, order) → nh, the sums G of k z^(i+j) and T of k z^i (F̂ − F̂(c−)); one job for all fits."""
        most = max(o for _, _, o in fits)
        given = F.from_json(F.lit(json.dumps([dict(w=i, right=bool(s), h=float(h)) for i, (s, h, _) in enumerate(fits)])), "array<struct<w:int,right:boolean,h:double>>")
        u = F.col("x") - F.lit(self.c)
        far = max(h for _, h, _ in fits)
        e = self.table.filter((F.col("x") >= self.c - far) & (F.col("x") <= self.c + far))
        e = e.select("x", "d", ((F.col("cum") - F.lit(self.left)) / F.lit(float(self.n))).alias("F"), F.explode(F.filter(given, lambda f: (F.abs(u) <= f["h"]) & (f["right"] == (u >= 0)))).alias("fit"))
        e = e.select("fit.w", "d", "F", (u / F.col("fit.h")).alias("z"), kernel_weight(u, F.col("fit.h"), kernel).alias("k"))
        z, k = powers(F.col("z"), 2 * most), F.col("k") * F.col("d")
        sums = [F.sum(F.when(F.col("k") > 0, F.col("d")).otherwise(0)).alias("nh")] + [F.sum(k * z[m]).alias(f"S{m}") for m in range(2 * most + 1)] + [F.sum(k * z[m] * F.col("F")).alias(f"T{m}") for m in range(most + 1)]
        with jit_friendly(self.spark):
            got = {r["w"]: r for r in e.groupBy("w").agg(*sums).collect()}
        out = []
        for i, (_, h, o) in enumerate(fits):
            r = got.get(i)
            if r is None or r["nh"] <= o + 1:
                out.append(dict(nh=int(r["nh"]) if r else 0, beta=None))
                continue
            G = np.array([[r[f"S{a + b}"] for b in range(o + 1)] for a in range(o + 1)])
            beta = np.linalg.solve(G, np.array([r[f"T{a}"] for a in range(o + 1)]))
            out.append(dict(nh=int(r["nh"]), beta=beta, slope=np.linalg.inv(G)[1] / h))
        return out


def select_density_bandwidths(ecdf: Ecdf, p: int = 2, kernel: str = "triangular", rule: str = "comb") -> tuple[float, float] | None:
    """(h_left, h_right): "each" side's plug-in, that of the "diff"erence or the "sum", or their median, "comb"."""
    if min(ecdf.values) <= p + 3:
        return None
    n, reach, sd = ecdf.n, ecdf.reach(), ecdf.spread()
    v, o = p + 1, p + 2
    _, bias, spread = fit_constants(o, kernel)
    # normal reference for the (p + 1)-th derivative of F from a fit of order p + 2
    B = math.factorial(v) * bias[v] * reference(o) / sd ** (o + 1) / math.factorial(o + 1)
    V = math.factorial(v) ** 2 * spread[v, v] * reference(0) ** 2 / sd
    pilot = ((2 * v - 1) * V / (4 * n * B * B)) ** (1 / (2 * v + 3))
    near = ecdf.nearest(LEAST_VALUES + o + 1)
    b = [min(max(pilot, near[s]), reach[s]) * (1 + 1e-9) for s in (0, 1)]
    fits = ecdf.moments([(s, b[s], o) for s in (0, 1)], kernel)
    if any(f["beta"] is None for f in fits):
        return None
    _, bias, spread = fit_constants(p, kernel)
    floor = reference(0) ** 2 / sd
    f = [x if x > 0 else floor for x in (fits[s]["beta"][1] / b[s] for s in (0, 1))]
    # the slope changes its sign with u, and u^(p + 1) its by p + 1
    B = [(-1.0) ** (p * (1 - s)) * bias[1] * fits[s]["beta"][v] / b[s] ** v for s in (0, 1)]

    def width(variance: float, b_: float) -> float:
        return (spread[1, 1] * variance / (2 * p * n * b_ * b_)) ** (1 / (2 * p + 1)) if b_ else math.inf

    each, diff, total = [width(f[s], B[s]) for s in (0, 1)], width(f[0] + f[1], B[1] - B[0]), width(f[0] + f[1], B[0] + B[1])
    chosen = {"each": each, "diff": [diff, diff], "sum": [total, total], "comb": [sorted((each[s], diff, total))[1] for s in (0, 1)]}[rule]
    near = ecdf.nearest(LEAST_VALUES + p + 1)
    return tuple(float(min(max(chosen[s], near[s]), reach[s])) for s in (0, 1))


def _jackknife(ecdf: Ecdf, h: tuple[float, float], fits: dict, kernel: str) -> dict:
    """For each order: variances of the left and right density and their covariance, from `fits` (side, order)."""
    orders = sorted({o for _, o in fits})
    u = F.col("x") - F.lit(ecdf.c)
    right = u >= 0
    hs = F.when(right, F.lit(h[1])).otherwise(F.lit(h[0]))
    e = ecdf.table.filter((F.col("x") >= ecdf.c - h[0]) & (F.col("x") <= ecdf.c + h[1]))
    e = e.withColumns({"side": right.cast("int"), "z": u / hs, "k": kernel_weight(u, hs, kernel)}).filter(F.col("k") > 0)
    z = powers(F.col("z"), max(orders) + 1)
    poly = lambda a, b: F.when(F.col("side") == 1, sum((F.lit(float(v)) * z[m] for m, v in enumerate(b)), F.lit(0.0))).otherwise(sum((F.lit(float(v)) * z[m] for m, v in enumerate(a)), F.lit(0.0)))
    start = ecdf.left / ecdf.n
    for o in orders:
        e = e.withColumns({f"l{o}": F.col("k") * poly(fits[0, o]["slope"], fits[1, o]["slope"]), f"fit{o}": F.lit(start) + poly(fits[0, o]["beta"], fits[1, o]["beta"])})
    after = Window.partitionBy("side").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    rest = e.groupBy("side", "_b").agg(*(F.sum(F.col("d") * F.col(f"l{o}")).alias(f"t{o}") for o in orders)).select("side", "_b", *(F.coalesce(F.sum(f"t{o}").over(after), F.lit(0.0)).alias(f"after{o}") for o in orders))
    down = Window.partitionBy("side", "_b").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.select("*", *(F.sum(F.col("d") * F.col(f"l{o}")).over(down).alias(f"g{o}") for o in orders)).join(rest, ["side", "_b"])
    sums, n = [F.sum("d").alias("rows")], ecdf.n
    for o in orders:
        l, fit = F.col(f"l{o}"), F.col(f"fit{o}")
        T = F.when(F.col("side") == 1, F.lit(float(fits[1, o]["f"]))).otherwise(F.lit(float(fits[0, o]["f"])))
        phi = l * ((F.col("cum") - 1) - (n - 1) * fit) + (F.col(f"after{o}") + F.col(f"g{o}") - l) - (T - l * fit)
        sums += [F.sum(F.col("d") * phi).alias(f"a{o}"), F.sum(F.col("d") * phi * phi).alias(f"q{o}")]
    with jit_friendly(ecdf.spark):
        got = {r["side"]: r for r in e.groupBy("side").agg(*sums).collect()}
    out = {}
    for o in orders:
        T, rows = [fits[s, o]["f"] for s in (0, 1)], [got[s]["rows"] for s in (0, 1)]
        var = [(got[s][f"q{o}"] + (n - rows[s]) * T[s] ** 2) / (n - 1) ** 2 for s in (0, 1)]
        both = (-T[0] * got[1][f"a{o}"] - T[1] * got[0][f"a{o}"] + (n - rows[0] - rows[1]) * T[0] * T[1]) / (n - 1) ** 2
        out[o] = (var[0], var[1], both)
    return out


def density_lp_auto(df: DataFrame, x: str, c: float = 0.0, p: int = 2, kernel: str = "triangular", h: tuple[float, float] | None = None, rule: str = "comb",
                    per_bucket: int | None = None) -> DataFrame:
    """Test of equal densities on both sides of c: a row "conventional" (order p) and a row "robust" (order p + 1), AUTO_SCHEMA.

    Bandwidths are selected unless `h` gives them.  Standard errors are the jackknife's; the plug-in f V / (n h) stands beside them.
    Too few distinct values on a side give rows of NULLs.
    """
    ecdf = Ecdf(df, x, c, per_bucket)
    try:
        h = h or select_density_bandwidths(ecdf, p, kernel, rule)
        rows = []
        orders = (p, p + 1)
        keys = [(s, o) for o in orders for s in (0, 1)]
        got = dict(zip(keys, ecdf.moments([(s, h[s], o) for s, o in keys], kernel))) if h else {}
        if not h or any(f["beta"] is None for f in got.values()):
            rows = [(m, *[None] * 7, ecdf.n, *(got[s, p]["nh"] if got else 0 for s in (0, 1)), *(h or (None, None)), o) for m, o in zip(("conventional", "robust"), orders)]
            return ecdf.spark.createDataFrame(rows, AUTO_SCHEMA)
        for (s, _), f in got.items():
            f["f"] = float(f["beta"][1] / h[s])
        var = _jackknife(ecdf, h, got, kernel)
        for m, o in zip(("conventional", "robust"), orders):
            fl, fr = got[0, o]["f"], got[1, o]["f"]
            constant = fit_constants(o, kernel)[2][1, 1]
            plug = fl / (ecdf.n * h[0]) + fr / (ecdf.n * h[1])
            v = var[o][0] + var[o][1] - 2 * var[o][2]
            se = math.sqrt(v) if v > 0 else None
            z = (fr - fl) / se if se else None
            rows.append((m, fl, fr, fr - fl, se, math.sqrt(plug * constant) if plug > 0 else None, z, norm_sf2(z), ecdf.n, got[0, o]["nh"], got[1, o]["nh"], float(h[0]), float(h[1]), o))
        return ecdf.spark.createDataFrame(rows, AUTO_SCHEMA)
    finally:
        ecdf.drop()


def density_lp_curve(df: DataFrame, x: str, c: float = 0.0, h: tuple[float, float] | None = None, p: int = 2, points: int = 20, reach: float = 3.0, rule: str = "comb",
                     per_bucket: int | None = None) -> DataFrame:
    """Density at `points` evenly spaced points on each side up to `reach` bandwidths from c, triangular kernel: CURVE_SCHEMA.

    Point 0 lies at c; a point uses rows of its own side within h only.  One pass sums the rows between the borders of all points,
    at most three for each; a point whose window holds too few rows, or that lies beyond all values, has a NULL density.
    """
    ecdf = Ecdf(df, x, c, per_bucket)
    try:
        h = h or select_density_bandwidths(ecdf, p, "triangular", rule)
        if not h:
            return ecdf.spark.createDataFrame([], CURVE_SCHEMA)
        step = [reach * h[s] / max(points - 1, 1) for s in (0, 1)]
        u = F.col("x") - F.lit(ecdf.c)
        right = u >= 0
        own = lambda f: F.when(right, f(1)).otherwise(f(0))
        far = F.abs(u)  # distance from c on the row's side
        wide = own(lambda s: F.lit((reach + 1) * h[s]))
        cell = lambda shift: (far - own(lambda s: F.lit(shift * h[s]))) / own(lambda s: F.lit(step[s]))
        z = powers(far / own(lambda s: F.lit(h[s])), 2 * p + 1)
        Fc = (F.col("cum") - F.lit(ecdf.left)) / F.lit(float(ecdf.n))
        e = ecdf.table.filter(F.col("x").between(ecdf.c - (reach + 1) * h[0], ecdf.c + (reach + 1) * h[1])).filter(far <= wide)
        # distances at which no point's window begins, turns or ends between two rows go into one sum
        e = e.groupBy(right.cast("int").alias("side"), (F.ceil(cell(-1.0)) - 1).alias("ends"), F.floor(cell(0.0)).alias("at"), F.floor(cell(1.0)).alias("begins")).agg(
            F.sum("d").alias("n"), *(F.sum(F.col("d") * z[m]).alias(f"S{m}") for m in range(2 * p + 2)), *(F.sum(F.col("d") * z[m] * Fc).alias(f"T{m}") for m in range(p + 2)))
        with jit_friendly(ecdf.spark):
            cells = e.collect()  # at most three borders for each point
        out = []
        for s in (0, 1):
            mine = [r for r in cells if r["side"] == s]
            for k in range(points):
                # rows farther than the point minus h and up to it, and from it up to h more
                below = [r for r in mine if r["ends"] >= k and r["at"] < k]
                above = [r for r in mine if r["at"] >= k and r["begins"] < k]
                at = ecdf.c + (1 if s else -1) * k * step[s]
                density, n = _point(below, above, k * step[s] / h[s], p, h[s], s)
                out.append(("right" if s else "left", k, at, density if ecdf.lo <= at <= ecdf.hi else None, n))
        return ecdf.spark.createDataFrame(out, CURVE_SCHEMA)
    finally:
        ecdf.drop()


def _point(below: list, above: list, g: float, p: int, h: float, side: int) -> tuple[float | None, int]:
    """Slope at distance g (in bandwidths) from sums of powers of the distance over the rows on either side of the point."""
    n = sum(r["n"] for r in below + above)
    if n <= p + 1:
        return None, int(n)

    def shifted(rows: list, name: str, most: int) -> np.ndarray:
        raw = [sum(r[f"{name}{m}"] for r in rows) for m in range(most + 1)]
        return np.array([sum(math.comb(m, i) * raw[i] * (-g) ** (m - i) for i in range(m + 1)) for m in range(most + 1)])

    def weighted(name: str, most: int) -> np.ndarray:
        lo, hi = shifted(below, name, most + 1), shifted(above, name, most + 1)
        return lo[:-1] + lo[1:] + hi[:-1] - hi[1:]  # K = 1 + v below the point, 1 − v above it

    S, T = weighted("S", 2 * p), weighted("T", p)
    G = np.array([[S[a + b] for b in range(p + 1)] for a in range(p + 1)])
    try:
        slope = float(np.linalg.solve(G, T)[1]) / h
    except np.linalg.LinAlgError:
        return None, int(n)
    return (slope if side else -slope), int(n)
