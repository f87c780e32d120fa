"""Binned statistics around a threshold: equal-width bin means, centred
right-closed bands, histograms, data-driven RD-plot bins and fitted lines.

Bins are computed by arithmetic on the running variable (no sort, no window),
and each summary is one map-side-combined `groupBy(bin)`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrd.functions.na import within
from panelrd.operators.attach import attach
from panelrd.operators.ranges import running_total
from panelrd.operators.rd import nn
from panelrd.operators.rd.cells import known, powers
from panelrd.session import drop_shared, save_shared


def equal_bin(x, lo: float, hi: float, bins: int):
    """0-based bin of `x` among `bins` equal bins over [lo, hi] (top edge in the last bin)."""
    w = (hi - lo) / bins
    return F.least(F.floor((x - F.lit(lo)) / F.lit(w)), F.lit(bins - 1)).cast("int")


def bin_means(df: DataFrame, x: str, y: str, bins: int, lo: float | None = None, hi: float | None = None,
              by: Sequence[str] = ()) -> DataFrame:
    """Mean and standard error of `y` in `bins` equal-width bins of `x` over [lo, hi].

    A missing `lo`/`hi` is taken from the data (one small min/max aggregate)."""
    if lo is None or hi is None:
        mm = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
        lo = float(mm["lo"]) if lo is None else lo
        hi = float(mm["hi"]) if hi is None else hi
    w = (hi - lo) / bins
    xc = F.col(x)
    d = within(df, x, lo, hi).filter(F.col(y).isNotNull()).withColumn("bin", equal_bin(xc, lo, hi, bins))
    out = d.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.avg(F.col(y)).alias("mean_y"), F.stddev_samp(F.col(y)).alias("sd_y")
    )
    return out.withColumns({
        "bin_lo": F.lit(lo) + F.col("bin") * F.lit(w),
        "bin_mid": F.lit(lo) + (F.col("bin") + F.lit(0.5)) * F.lit(w),
        "se_y": F.col("sd_y") / F.sqrt(F.col("n").cast("double")),
    })


def bin_bands(df: DataFrame, x: str, y: str, width: float, center: float, z: float = 1.96, by: Sequence[str] = ()) -> DataFrame:
    """Centred fixed-width bins, right-closed `(a, b]`, lowest edge of each group included.

    Per bin: n, mean, se = sd/√n (once), mean ± z·se, and the bin centre as label.
    The group minimum (for the included lowest edge) is a small aggregate joined back.
    """
    boundary = center - width / 2.0
    xc = F.col(x)
    d = df.filter(xc.isNotNull())
    k_raw = (F.ceil((xc - F.lit(boundary)) / F.lit(width)) - 1).cast("long")
    if by:
        mins = d.groupBy(*by).agg(F.min(xc).alias("_min"))
        d = attach(d, mins, by, how="inner")
    else:
        # one number: the global minimum, computed by a partial aggregate
        d = d.withColumn("_min", F.lit(d.agg(F.min(xc)).first()[0]).cast("double"))
    lowest = F.floor((F.col("_min") - F.lit(boundary)) / F.lit(width)).cast("long")
    d = d.withColumn("bin", F.greatest(k_raw, lowest))
    out = d.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.avg(F.col(y)).alias("mean"), F.stddev_samp(F.col(y)).alias("sd")
    )
    se = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    return out.withColumns({
        "bin_lo": F.lit(boundary) + F.col("bin") * F.lit(width),
        "bin_hi": F.lit(boundary) + (F.col("bin") + 1) * F.lit(width),
        "bin_mid": F.lit(boundary) + (F.col("bin") + F.lit(0.5)) * F.lit(width),
        "se": se,
    }).withColumns({"upper": F.col("mean") + F.lit(z) * F.col("se"), "lower": F.col("mean") - F.lit(z) * F.col("se")}).drop("sd")


def histogram(df: DataFrame, x: str, bins: int, lo: float, hi: float, shift: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """Counts of `x + shift` in `bins` equal bins over [lo, hi], empty bins with 0; values outside are dropped.

    With `by`, every group of `df` has all bins.
    """
    v = F.col(x) + F.lit(shift)
    w = (hi - lo) / bins
    d = df.select(*by, v.alias("_v")).filter((F.col("_v") >= lo) & (F.col("_v") <= hi))
    counts = d.groupBy(*by, equal_bin(F.col("_v"), lo, hi, bins).alias("bin")).agg(F.count(F.lit(1)).cast("long").alias("n"))
    every = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    grid = df.select(*by).distinct().select(*by, every) if by else df.sparkSession.range(1).select(every)
    zero = grid.withColumn("n", F.lit(0).cast("long"))
    out = counts.unionByName(zero).groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    return out.withColumns({"bin_lo": F.lit(lo) + F.col("bin") * F.lit(w), "bin_hi": F.lit(lo) + (F.col("bin") + 1) * F.lit(w)})


PLOT_SCHEMA = "side int, bin int, n long, J int, x_mean double, y_mean double, y_fit double"


def rd_plot_data(df: DataFrame, x: str, y: str, c: float = 0.0, p: int = 1, scale: float = 1.0, spaced: str = "even", per_bucket: int | None = None) -> DataFrame:
    """Data-driven RD plot bins whose means vary as the outcome does (Calonico, Cattaneo and Titiunik 2015).

    Per side J = ceil(scale · var(y) / V · n / log(n)²).  V comes from first differences of y in x order, so no fit enters it:
    for evenly spaced bins n / 4 Σ (Δx)² (Δy)² over the squared length of the side, for `spaced` "quantile" the mean of
    (Δy)² / 2.  Rows of equal x are one value; the difference of two values' means is scaled to the variance of single
    rows, (Δy)² = 2 (Δȳ)² / (1/d₁ + 1/d₂).  Returns bin means of x and y and the order-`p` fit of the side at the mean of x.

    Rows are summed once to distinct values, cut into buckets of ordered x with one neighbour handed on at each border.
    Rows with NULL or NaN in x or y are left out; quantile bins may share an edge value, which goes to the first of them.
    """
    if spaced not in ("even", "quantile"):
        raise ValueError("spaced must be 'even' or 'quantile'")
    spark, per_bucket = df.sparkSession, per_bucket or nn.PER_BUCKET
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.select(xc.alias("x"), yc.alias("y")).filter(known(F.col("x")) & known(F.col("y"))).withColumn("side", F.when(F.col("x") >= c, F.lit(1)).otherwise(F.lit(0)))
    values = save_shared(rows.groupBy("side", "x").agg(F.count(F.lit(1)).alias("d"), F.sum("y").alias("S"), F.sum(F.col("y") * F.col("y")).alias("Q")), "plot-values")
    tables = [values]
    try:
        far = F.abs(F.col("x") - F.lit(c))
        st = {r["side"]: r for r in values.groupBy("side").agg(F.count(F.lit(1)).alias("values"), F.sum("d").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.max(far).alias("reach"), F.sum("S").alias("S")).collect()}
        if not st:
            return spark.createDataFrame([], PLOT_SCHEMA)
        if max(r["values"] for r in st.values()) > per_bucket:
            tables.append(save_shared(nn.with_halo(values, ["side"], "x", 1, per_bucket), "plot-buckets"))
            cut = tables[-1]
        else:
            cut = values.withColumns({"_b": F.array(F.lit(0).cast("long")), "_halo": F.lit(False)})
        of = lambda f: F.element_at(F.create_map(*(v for s, r in st.items() for v in (F.lit(s), F.lit(f(s, r))))), F.col("side"))
        order = Window.partitionBy("side", "_b").orderBy("x")
        gaps = cut.select("*", *(F.lag(k).over(order).alias(f"_{k}") for k in ("x", "d", "S"))).filter(~F.col("_halo"))
        dx, dy2 = F.col("x") - F.col("_x"), 2 * F.pow(F.col("S") / F.col("d") - F.col("_S") / F.col("_d"), 2) / (1 / F.col("d") + 1 / F.col("_d"))
        z = powers((F.col("x") - F.lit(c)) / of(lambda s, r: float(r["reach"]) or 1.0), 2 * p)
        off = F.col("S") / F.col("d") - of(lambda s, r: r["S"] / r["n"])  # squares about the mean of the side
        sums = gaps.groupBy("side").agg(F.sum(dx * dx * dy2).alias("even"), F.sum(dy2).alias("dy2"), F.count("_x").alias("gaps"), F.sum(F.col("Q") - F.col("S") * F.col("S") / F.col("d") + F.col("d") * off * off).alias("yy"),
                                        *(F.sum(F.col("d") * z[m]).alias(f"G{m}") for m in range(2 * p + 1)), *(F.sum(F.col("S") * z[m]).alias(f"T{m}") for m in range(p + 1)))
        fits, J, edges = {}, {}, {}
        for r in sums.collect():
            s, n = r["side"], st[r["side"]]["n"]
            lo, hi = (st[s]["lo"], float(c)) if s == 0 else (float(c), st[s]["hi"])
            V = (n / 4 * r["even"] / (hi - lo) ** 2 if spaced == "even" else r["dy2"] / (2 * r["gaps"])) if r["gaps"] and hi > lo else 0.0
            J[s] = max(1, math.ceil(scale * r["yy"] / (n - 1) / V * n / math.log(n) ** 2)) if V else 1
            edges[s] = (lo, hi)
            G = np.array([[r[f"G{a + b}"] for b in range(p + 1)] for a in range(p + 1)])
            enough = st[s]["values"] > p
            fits[s] = np.linalg.solve(G, np.array([r[f"T{a}"] for a in range(p + 1)])) if enough else None
        own = cut.filter(~F.col("_halo"))
        jc = of(lambda s, r: J[s])
        if spaced == "even":
            part = (F.col("x") - of(lambda s, r: edges[s][0])) / of(lambda s, r: (edges[s][1] - edges[s][0]) / J[s] or 1.0)
            own = own.withColumn("bin", F.least(F.greatest(F.floor(part), F.lit(0)), jc - 1).cast("int"))
        else:
            own = running_total(own, ["side"], "x", "d", "cum")
            own = own.withColumn("bin", F.floor((F.col("cum") - F.col("d")) * jc / of(lambda s, r: float(r["n"]))).cast("int"))
        at = own.groupBy("side", "bin").agg(F.sum("d").alias("n"), (F.sum(F.col("x") * F.col("d")) / F.sum("d")).alias("x_mean"), (F.sum("S") / F.sum("d")).alias("y_mean")).withColumn("J", jc.cast("int"))
        zm = powers((F.col("x_mean") - F.lit(c)) / of(lambda s, r: float(r["reach"]) or 1.0), max(p, 1))
        fit = sum((of(lambda s, r: None if fits[s] is None else float(fits[s][m])) * zm[m] for m in range(p + 1)), F.lit(0.0))
        # written: the number of bins grows with the rows
        return save_shared(at.select("side", "bin", "n", "J", "x_mean", "y_mean", fit.cast("double").alias("y_fit")), "plot-bins")
    finally:
        for t in tables:
            drop_shared(t)


def fitted_lines(df: DataFrame, x: str, side_coefs: DataFrame, c: float = 0.0, h_left: float | None = None, h_right: float | None = None) -> DataFrame:
    """Fitted RD lines `a + b·(x − c)` at every observed `x` within the bandwidths, both sides.

    `side_coefs` has columns (spec, side, role, power, coef) from the RD result;
    its few rows are pivoted to one row per (spec, side, role) and broadcast
    (size bounded by the number of specifications).
    """
    coefs = side_coefs.groupBy("spec", "side", "role").agg(
        F.max(F.when(F.col("power") == 0, F.col("coef"))).alias("a"),
        F.max(F.when(F.col("power") == 1, F.col("coef"))).alias("b"),
    )
    xc = F.col(x)
    cond = F.lit(True)
    if h_left is not None:
        cond = cond & (xc >= c - h_left)
    if h_right is not None:
        cond = cond & (xc <= c + h_right)
    pts = df.filter(xc.isNotNull() & cond).select(xc.alias("x"), F.when(xc >= c, F.lit("right")).otherwise(F.lit("left")).alias("side"))
    j = pts.join(F.broadcast(coefs), on="side", how="inner")
    return j.select("spec", "side", "role", "x", (F.col("a") + F.col("b") * (F.col("x") - F.lit(c))).alias("fitted"))
