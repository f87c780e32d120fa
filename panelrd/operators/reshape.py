"""Long → wide reshapes and the two-period composition change.

Pivots always receive their value list, so Spark plans a single aggregation
(no extra distinct job) and the output schema does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrd.functions.na import fill_and_cast


def one_hot(df: DataFrame, keys: Sequence[str], type_col: str, values: Sequence[str]) -> DataFrame:
    """One row per key with a 0/1 integer column per type (bare type names).

    Equivalent to distinct (type, key) → pivot → fill 0; the pivot's `max` is
    combined map-side, so duplicate (type, key) rows never travel.
    """
    out = df.groupBy(*keys).pivot(type_col, list(values)).agg(F.max(F.lit(1)))
    return fill_and_cast(out.select(*keys, *[F.col(f"`{v}`").alias(v) for v in values]), values, 0, "int")


def pivot_first(df: DataFrame, keys: Sequence[str], name: str, value: str, values: Sequence[str], duplicates=None) -> DataFrame:
    """Long → wide of one (text) value; every other column in `keys` stays a row key.

    A (keys, name) pair must be unique, as in a tidy long table: a second row of one is an error, unless `duplicates`, an
    aggregate function such as `F.min`, `F.max` or `F.collect_list`, says what becomes of them.
    """
    if duplicates is None:
        many = F.raise_error(F.concat(F.lit(f"more than one {value} for a key and {name} "), F.first(F.col(name).cast("string"))))
        one = F.when(F.count(F.lit(1)) > 1, many.cast(df.schema[value].dataType)).otherwise(F.min(F.col(value)))
    else:
        one = duplicates(F.col(value))
    out = df.groupBy(*keys).pivot(name, list(values)).agg(one)
    return out.select(*keys, *[F.col(f"`{v}`").alias(v) for v in values])


def panel_change(
    df: DataFrame,
    unit: str,
    period: str,
    y0: int,
    y1: int,
    measures: Sequence[str],
    annualise: Sequence[str] = (),
    base_means: Sequence[str] = (),
    rate_scale: float = 100.0,
) -> DataFrame:
    """Change of unit-level means between two periods, in one conditional aggregation.

    Per unit: `students` = rows in `y0`; `<m>_<y0>`, `<m>_<y1>` = means (NULL-skipping)
    in each period; `diff_<m>` = level change; for `annualise`, `rate_<m>` =
    `((m_y1 / m_y0) ** (1 / (y1 - y0)) - 1) * rate_scale`; `base_means` are extra
    means over the `y0` rows (`mean_<c>`).  Units missing either period or a mean
    are dropped (complete cases), as the two-halves self-join did.
    """
    p = F.col(period)
    k = float(y1 - y0)
    aggs = [F.count_if(p == y0).cast("long").alias("students"), F.count_if(p == y1).cast("long").alias("_n1")]
    aggs += [F.avg(F.when(p == y0, F.col(c))).alias(f"mean_{c}") for c in base_means]
    for m in measures:
        aggs.append(F.avg(F.when(p == y0, F.col(m))).alias(f"{m}_{y0}"))
        aggs.append(F.avg(F.when(p == y1, F.col(m))).alias(f"{m}_{y1}"))
    out = df.filter(p.isin(y0, y1)).groupBy(unit).agg(*aggs)
    out = out.filter((F.col("students") > 0) & (F.col("_n1") > 0)).drop("_n1")
    out = out.dropna(subset=[f"mean_{c}" for c in base_means] + [f"{m}_{y}" for m in measures for y in (y0, y1)])
    new = {f"diff_{m}": F.col(f"{m}_{y1}") - F.col(f"{m}_{y0}") for m in measures}
    for m in annualise:
        new[f"rate_{m}"] = (F.pow(F.try_divide(F.col(f"{m}_{y1}"), F.col(f"{m}_{y0}")), F.lit(1.0 / k)) - 1.0) * rate_scale
    return out.withColumns(new)
