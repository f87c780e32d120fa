"""Distributed least squares from Gram matrices.

One pass, a single aggregation combined map-side: rows, means and centred
cross-products of all regressors and the response for each pattern of missing
columns.  These merge exactly on the driver to the sample of every model, so
a list of models costs one scan, whether they share their rows or not.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrd.operators.stats import t_sf2

#: Part of a regressor's variance that the ones before it must leave.
ALIASED = 1e-10
OLS_SCHEMA = ("model string, term string, estimate double, std_error double, statistic double, p_value double, "
              "n long, r2 double")


def ols_models(df: DataFrame, y: str, models: Mapping[str, Sequence[str]], complete_on_all: bool = True) -> DataFrame:
    """`lm(y ~ x1 + … )` for several regressor lists; one row per (model, term).

    Rows with a NULL in the response or any regressor used by any model are
    dropped first (`complete_on_all`), so nested models share their sample;
    otherwise each model has its own complete rows.

    A regressor that is a linear combination of those before it is aliased: its
    estimates are NULL and it takes no degree of freedom.  Without rows, or
    with as many terms as rows, what is undefined is NULL.
    """
    xs = list(dict.fromkeys(c for m in models.values() for c in m))
    cols = list(dict.fromkeys([y] + xs))
    place = {c: i for i, c in enumerate(cols)}
    d = df.select(*[F.col(c).cast("double").alias(f"c{i}") for c, i in place.items()])
    has = [F.col(f"c{i}").isNotNull() & ~F.isnan(f"c{i}") for i in place.values()]
    d = d.withColumn("mask", F.concat(*(F.when(h, F.lit("1")).otherwise(F.lit("0")) for h in has)))
    d = d.filter(F.col("mask") == "1" * len(cols)) if complete_on_all else d
    # per pattern of missing columns: rows, means and centred products, which merge exactly
    sums = [F.count(F.lit(1)).alias("n"), *(F.avg(f"c{i}").alias(f"m{i}") for i in place.values()), *(F.covar_pop(f"c{i}", f"c{j}").alias(f"v{i}_{j}") for i in place.values() for j in range(i, len(cols)))]
    masks = d.groupBy("mask").agg(*sums).collect()  # a row for each pattern that occurs

    def merged(used: Sequence[str]) -> tuple[int, dict, dict]:
        """n, means and centred products of `used` over all rows that have them."""
        mine = [r for r in masks if all(r["mask"][place[c]] == "1" for c in used)]
        n = sum(r["n"] for r in mine)
        mu = {c: sum(r["n"] * r[f"m{place[c]}"] for r in mine) / n if n else None for c in used}
        S = {}
        for a in used:
            for b in used:
                i, j = sorted((place[a], place[b]))
                S[a, b] = sum(r["n"] * (r[f"v{i}_{j}"] + (r[f"m{place[a]}"] - mu[a]) * (r[f"m{place[b]}"] - mu[b])) for r in mine)
        return n, mu, S

    rows = []
    for name, mx in models.items():
        mx = list(mx)
        n, mu, S = merged(cols if complete_on_all else list(dict.fromkeys([y, *mx])))
        used = _independent(mx, S) if n else []
        k = len(used) + 1
        Sxx = np.array([[S[(a, b)] for b in used] for a in used]).reshape(len(used), len(used))
        Sxy = np.array([S[(a, y)] for a in used])
        syy = S[(y, y)]
        inv = np.linalg.inv(Sxx) if used else np.zeros((0, 0))
        beta = inv @ Sxy
        rss = syy - float(beta @ Sxy)
        dof = n - k
        s2 = rss / dof if dof > 0 else float("nan")
        r2 = 1 - rss / syy if syy > 0 else float("nan")
        fit = {}
        if n:
            xbar = np.array([mu[a] for a in used])
            fit["(Intercept)"] = (mu[y] - float(beta @ xbar), s2 * (1.0 / n + float(xbar @ inv @ xbar)))
            fit.update({a: (float(beta[i]), s2 * float(inv[i, i])) for i, a in enumerate(used)})
        for term in ["(Intercept)", *mx]:
            est, var = fit.get(term, (float("nan"), float("nan")))
            se = math.sqrt(var) if var >= 0 else float("nan")
            t = est / se if se > 0 else float("nan")
            rows.append((name, term, *(_or_null(v) for v in (est, se, t, t_sf2(t, dof) if dof > 0 else float("nan"))), n, _or_null(r2)))
    return df.sparkSession.createDataFrame(rows, OLS_SCHEMA)


def _or_null(v):
    return None if v is None or math.isnan(v) else float(v)


def _independent(xs: Sequence[str], S: Mapping[tuple, float]) -> list[str]:
    """The regressors that are no linear combination of those before them."""
    kept: list[str] = []
    for c in xs:
        left = S[(c, c)]
        if kept:
            A = np.array([[S[(a, b)] for b in kept] for a in kept])
            v = np.array([S[(a, c)] for a in kept])
            left -= float(v @ np.linalg.solve(A, v))
        if left > ALIASED * S[(c, c)]:
            kept.append(c)
    return kept


def ols(df: DataFrame, y: str, xs: Sequence[str], name: str = "model") -> DataFrame:
    """One linear model with intercept: estimate, se, t, p (Student t, n − k df)."""
    return ols_models(df, y, {name: list(xs)})
