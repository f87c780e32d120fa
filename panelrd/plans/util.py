"""Presentation step shared by the catalogue: round reals for stable comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column to `digits` places (the last step of a query).

    The double goes through DECIMAL(38,9) first, so a value whose decimal form
    ends in 5 rounds up in every engine instead of depending on its binary tail.
    What does not fit (NaN, ±Inf, 1e29 and more) stays as it is.
    """
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            v = F.col(f"`{f.name}`").cast("double")
            cols.append(F.coalesce(F.round(v.try_cast("decimal(38,9)"), digits).cast("double"), v).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)
