"""NA-exact helpers.

R and Spark differ on missing values in a few places that silently change
results (membership tests, strict aggregates, distinct counts).  These helpers
give the R meaning with built-in expressions only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_set(col, values: Iterable, null_is_member: bool | None = None) -> Column:
    """`x %in% values`: always TRUE/FALSE, never NULL.

    A `None` inside `values` makes NULL a member (as `NA` in an R set does);
    `null_is_member` overrides that.
    """
    c = _col(col)
    vals = list(values)
    non_null = [v for v in vals if v is not None]
    has_null = (None in vals) if null_is_member is None else null_is_member
    hit = F.coalesce(c.isin(non_null), F.lit(False)) if non_null else F.lit(False)
    return (hit | c.isNull()) if has_null else hit


def strict(agg, col) -> Column:
    """Aggregate that is NULL when any input is NULL (R's default `na.rm = FALSE`)."""
    c = _col(col)
    return F.when(F.count_if(c.isNull()) == 0, agg(c))


def skip_mean(col) -> Column:
    """Mean skipping NULLs (R `na.rm = TRUE`); NULL for an all-NULL group."""
    return F.avg(_col(col))


def n_unique(col) -> Column:
    """`length(unique(x))`: distinct count where NULL counts as one value."""
    c = _col(col)
    return F.count_distinct(c) + F.max(c.isNull().cast("int"))


def to_number(col, decimal: str = ",") -> Column:
    """Locale number text (spaces, comma decimals) to double; bad text → NULL."""
    c = F.regexp_replace(_col(col), r"\s", "")
    if decimal != ".":
        c = F.translate(c, decimal, ".")
    return c.try_cast("double")


def fill_and_cast(df, cols, value=0, dtype: str | None = None):
    """`mutate(across(cols, ~ifelse(is.na(.), value, .)))` plus an optional cast, in one projection."""
    cols = set(cols)
    out = []
    for c in df.columns:
        if c in cols:
            e = F.coalesce(F.col(f"`{c}`"), F.lit(value))
            out.append((e.cast(dtype) if dtype else e).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def within(df, x: str, lo: float, hi: float, closed: str = "both"):
    """Rows with `lo ≤ x ≤ hi` (`closed` = both / left / right / neither); pushed to the scan when x is a column."""
    c = F.col(x)
    left = (c >= lo) if closed in ("both", "left") else (c > lo)
    right = (c <= hi) if closed in ("both", "right") else (c < hi)
    return df.filter(left & right)
