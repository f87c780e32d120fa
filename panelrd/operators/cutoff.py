"""Implied award cutoffs and the normalised running variable.

All cohorts and all treatments are inferred in one `groupBy(cohort)` (one
conditional `min` per treatment, combined map-side), replacing one scan per
cohort × treatment.  The result has one row per cohort; its rows are counted and
broadcast to the unit rows, which are not shuffled by cohort (operators/attach.py).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrd.operators.attach import attach


def cutoff_table(df: DataFrame, score: str, cohort: str, treatments: Mapping[str, float], empty_cutoff: str = "null") -> DataFrame:
    """Wide cutoffs: `cohort`, `cutoff_<t>` = min score among treated (`t == 1`) with score > floor.

    A cohort with no treated unit above the floor gets NULL (`empty_cutoff="null"`)
    or +inf (`"inf"`, R's `min()` of an empty set, which makes every normalised
    score −inf).
    """
    s = F.col(score)
    aggs = [F.min(F.when((F.col(t) == 1) & (s > floor), s)).alias(f"cutoff_{t}") for t, floor in treatments.items()]
    out = df.groupBy(cohort).agg(*aggs)
    if empty_cutoff == "inf":
        out = out.withColumns({f"cutoff_{t}": F.coalesce(F.col(f"cutoff_{t}"), F.lit(float("inf"))) for t in treatments})
    elif empty_cutoff != "null":
        raise ValueError("empty_cutoff must be 'null' or 'inf'")
    return out


def infer_cutoff(df: DataFrame, score: str, cohort: str, treatments: Mapping[str, float], empty_cutoff: str = "null") -> DataFrame:
    """Long cutoffs: (`cohort`, `treatment`, `floor`, `cutoff`, `n_treated_above`)."""
    s = F.col(score)
    aggs = []
    for t, floor in treatments.items():
        cond = (F.col(t) == 1) & (s > floor)
        aggs.append(F.struct(F.lit(t).alias("treatment"), F.lit(float(floor)).alias("floor"),
                             F.min(F.when(cond, s)).alias("cutoff"),
                             F.count_if(cond).cast("long").alias("n_treated_above")))
    wide = df.groupBy(cohort).agg(F.array(*aggs).alias("_c"))
    out = wide.select(cohort, F.explode("_c").alias("_v")).select(cohort, "_v.*")
    if empty_cutoff == "inf":
        out = out.withColumn("cutoff", F.coalesce(F.col("cutoff"), F.lit(float("inf"))))
    return out


def normalise(df: DataFrame, cutoffs: DataFrame, score: str, cohort: str, treatments, inclusive: bool = False) -> DataFrame:
    """Attach `cutoff_<t>` and add `x_<t> = score − cutoff_<t>` and `above_<t>`.

    `above` uses `x > 0` (`inclusive=False`, as the eligibility flag was built) or
    `x >= 0` (the side convention of the RD estimator).  NULL cutoff → NULL x,
    above = 0.
    """
    out = attach(df, cutoffs, [cohort])
    new = {}
    for t in treatments:
        x = F.col(score) - F.col(f"cutoff_{t}")
        new[f"x_{t}"] = x
        cond = (x >= 0) if inclusive else (x > 0)
        new[f"above_{t}"] = F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))
    return out.withColumns(new)
