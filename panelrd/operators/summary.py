"""Grouped summaries: counts/means/shares, two-group descriptions, frequency
tables, payment roll-ups, bubble tables and side-by-side model tables.

All are one `groupBy` each (map-side combined); long outputs come from
`unpivot` of the small aggregated row, never from per-variable jobs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrd.functions.na import strict, n_unique


@dataclass(frozen=True)
class Stat:
    """One summary column: `fn` in n, mean, sum, sd, min, max, n_valid."""

    col: str | None
    fn: str
    name: str
    scale: float = 1.0
    skip_null: bool = False


def _stat_expr(s: Stat):
    if s.fn == "n":
        return F.count(F.lit(1)).cast("long").alias(s.name)
    c = F.col(s.col)
    if s.fn == "n_valid":
        return F.count(c).cast("long").alias(s.name)
    fns = {"mean": F.avg, "sum": F.sum, "sd": F.stddev_samp, "min": F.min, "max": F.max}
    f = fns[s.fn]
    if s.skip_null:
        e = F.coalesce(F.sum(c), F.lit(0.0)) if s.fn == "sum" else f(c)
    else:
        e = strict(f, c)
    if s.scale != 1.0:
        e = e * F.lit(float(s.scale))
    return e.cast("double").alias(s.name)


def group_stats(df: DataFrame, keys: Sequence[str], stats: Sequence[Stat]) -> DataFrame:
    """`group_by(keys) %>% summarise(...)`; `keys=()` gives whole-table figures."""
    exprs = [_stat_expr(s) for s in stats]
    return df.groupBy(*keys).agg(*exprs) if keys else df.agg(*exprs)


def describe_by(df: DataFrame, group: str, cols: Sequence[str], stats: Sequence[str] = ("mean", "sd", "n")) -> DataFrame:
    """Long description table: one row per (group, variable) with mean, sd, n non-null."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__sd"), F.count(x).cast("double").alias(f"{c}__n")]
    wide = df.groupBy(group).agg(*aggs)
    stack = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__sd").alias("sd"),
                 F.col(f"{c}__n").cast("long").alias("n"))
        for c in cols
    ])).alias("_v")
    out = wide.select(F.col(group), stack).select(group, "_v.variable", "_v.mean", "_v.sd", "_v.n")
    return out.select(group, "variable", *[s for s in ("mean", "sd", "n") if s in stats])


def freq(df: DataFrame, col: str) -> DataFrame:
    """Frequency table that keeps the NULL value as its own row."""
    return df.groupBy(col).agg(F.count(F.lit(1)).cast("long").alias("n"))


def payment_rollup(df: DataFrame, keys: Sequence[str], amount: str, period: str) -> DataFrame:
    """Per key: total amount (NULLs skipped), number of distinct periods (NULL
    counts as a value) and the `min-max` period span (`NA-NA` if any period is NULL)."""
    p = F.col(period)
    span = F.concat_ws(
        "-",
        F.coalesce(strict(F.min, p).cast("string"), F.lit("NA")),
        F.coalesce(strict(F.max, p).cast("string"), F.lit("NA")),
    )
    return df.groupBy(*keys).agg(
        F.coalesce(F.sum(F.col(amount)), F.lit(0.0)).cast("double").alias("total"),
        n_unique(p).cast("long").alias("parcels"),
        span.alias("span"),
    )


def bubble_table(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Per group: size, mean x, mean y, and the across-group OLS line at mean x.

    The line's two numbers (slope, intercept) are a scalar subquery over the grouped table: one plan, which groups once
    and runs no job before its own.
    """
    g = df.groupBy(group).agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.avg(F.col(x)).alias("x_mean"), F.avg(F.col(y)).alias("y_mean")
    )
    line = g.agg(F.struct(F.regr_slope("y_mean", "x_mean").alias("b"), F.regr_intercept("y_mean", "x_mean").alias("a"))).scalar()
    return g.withColumn("_line", line).withColumn("y_fit", F.col("_line.a") + F.col("_line.b") * F.col("x_mean")).drop("_line")


def stars(p, cuts: Sequence[float] = (0.1, 0.05, 0.01)):
    """Significance marks: one `*` per cut the p-value is below."""
    cuts = sorted(cuts, reverse=True)
    expr = F.lit("")
    for i, c in enumerate(cuts):
        expr = F.when(p < c, F.lit("*" * (i + 1))).otherwise(expr)
    return expr


def model_table(results: DataFrame, model_col: str = "spec", term_col: str = "method", models: Sequence[str] | None = None,
                cuts: Sequence[float] = (0.1, 0.05, 0.01), digits: int = 3) -> DataFrame:
    """Side-by-side table: rows (term, estimate / std_error), one text column per model."""
    if models is None:
        raise ValueError("pass the model names (pivot values) so the schema is fixed")
    fmt = lambda c: F.format_string(f"%.{digits}f", F.col(c))
    est = results.select(model_col, term_col, F.lit("estimate").alias("row"),
                         F.concat(fmt("estimate"), stars(F.col("p_value"), cuts)).alias("cell"))
    se = results.select(model_col, term_col, F.lit("std_error").alias("row"),
                        F.concat(F.lit("("), fmt("std_error"), F.lit(")")).alias("cell"))
    long = est.unionByName(se)
    wide = long.groupBy(term_col, "row").pivot(model_col, list(models)).agg(F.min("cell"))
    return wide.select(term_col, "row", *[F.col(f"`{m}`").alias(m) for m in models])
