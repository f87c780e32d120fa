"""Nearest-neighbour residuals over distinct values, without a global sort.

For each observation the residual is w_i minus the mean of its J nearest neighbours in the running variable, ties taken as
whole groups (the matching rule of Calonico, Cattaneo and Titiunik 2014), scaled by √(J_i/(J_i+1)).  Neighbours are defined
on distinct values, so the work is done on the table of distinct values (count d, Σw, Σw²):

1. distinct values are cut into buckets by range arithmetic (operators/ranges.py); each bucket is given copies of the J
   values before and after it, its halo, so that every later pass needs one window over buckets alone;
2. left and right groups are taken in order of distance (ties together), so a group is used exactly when the own
   ties plus all strictly closer groups are still short of min(J, n − 1): no loop;
3. Σ_{i∈v} res_i² = α²Σw² − 2αβΣw + dβ² per distinct value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrd.operators.ranges import range_buckets

#: Distinct values that one task sorts.
PER_BUCKET = 200_000


def with_halo(values: DataFrame, keys: Sequence[str], x: str, J: int, per_bucket: int) -> DataFrame:
    """`values` with `_b`, its bucket within the keys, and `_halo`: true for copies of the J distinct values on either side of a bucket."""
    keys = list(keys)
    cut = range_buckets(values, keys, x, per_bucket)
    up, down = (Window.partitionBy(*keys, "_b").orderBy(o) for o in (F.asc(x), F.desc(x)))
    ends = cut.withColumns({"_first": F.dense_rank().over(up), "_last": F.dense_rank().over(down)}).filter((F.col("_first") <= J) | (F.col("_last") <= J))
    # every bucket holds a value, so J neighbours come from J buckets at most
    over = Window.partitionBy(*keys).orderBy("_b")
    near = lambda f: F.array_compact(F.array(*(f("_b", j).over(over) for j in range(1, J + 1))))
    buckets = cut.select(*keys, "_b").distinct().select(*keys, "_b", near(F.lag).alias("_before"), near(F.lead).alias("_after"))
    ends = ends.join(buckets, [*keys, "_b"])
    halo = F.explode(F.concat(F.when(F.col("_first") <= J, F.col("_before")).otherwise(F.array().cast("array<array<bigint>>")), F.when(F.col("_last") <= J, F.col("_after")).otherwise(F.array().cast("array<array<bigint>>"))))
    copies = ends.select(*values.columns, halo.alias("_b"), F.lit(True).alias("_halo"))
    return cut.select(*values.columns, "_b", F.lit(False).alias("_halo")).unionByName(copies)


def squared_residuals(t: DataFrame, part: Sequence[str], x: str, J: int) -> DataFrame:
    """`t`, rows of distinct `x` within `part` with _d, _S, _Q and _n, with _E: the sum of squared residuals at each value."""
    win = Window.partitionBy(*part).orderBy(x)
    near = [f(c, j).over(win).alias(f"_{side}{j}{name}") for j in range(1, J + 1) for side, f in (("l", F.lag), ("r", F.lead)) for c, name in ((x, "x"), ("_d", "d"), ("_S", "s"))]
    t = t.select("*", *near)
    t = t.selectExpr("*", *(f"abs(`{x}` - _{side}{j}x) AS _g{side}{j}" for j in range(1, J + 1) for side in "lr"))
    names = [(f"_g{side}{j}", f"_{side}{j}d", f"_{side}{j}s") for j in range(1, J + 1) for side in "lr"]
    used = []
    for gap, _, _ in names:
        before = " + ".join(["(_d - 1)"] + [f"CASE WHEN {other} < {gap} THEN {d} ELSE 0 END" for other, d, _ in names if other != gap])
        used.append(f"coalesce({gap} IS NOT NULL AND ({before}) < least({J}, _n - 1), false) AS _u{gap}")
    t = t.selectExpr("*", *used)
    k = " + ".join(["(_d - 1)"] + [f"CASE WHEN _u{gap} THEN {d} ELSE 0 END" for gap, d, _ in names])
    a = " + ".join(["0.0D"] + [f"CASE WHEN _u{gap} THEN {s} ELSE 0.0D END" for gap, _, s in names])
    t = t.selectExpr("*", f"CAST({k} AS DOUBLE) AS _k", f"{a} AS _A")
    # res_i = α w_i − β, α = c(1 + 1/J_i), β = c(S + A)/J_i, c = √(J_i/(J_i+1))
    t = t.selectExpr("*", "CASE WHEN _k > 0 THEN sqrt(_k / (_k + 1.0D)) * (1.0D + 1.0D / _k) END AS _al",
                     "CASE WHEN _k > 0 THEN sqrt(_k / (_k + 1.0D)) * (_S + _A) / _k END AS _be")
    return t.selectExpr("*", "_al * _al * _Q - 2.0D * _al * _be * _S + _d * _be * _be AS _E")
