"""Attach a small aggregate to a large table without shuffling the large side by a few key values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side table that may be broadcast; a larger one is joined with salted keys.
BROADCAST_ROWS = 10_000
SALTS = 32


def attach(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left", bound: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """`df` joined with the aggregate `small` on `on`.

    At most `bound` + 1 rows of `small` are fetched.  If that is all of it, they are broadcast: its size is then known
    from the rows themselves, not from an estimate, and `df` is not shuffled.  Otherwise `small` is repeated once for
    each salt and `df` is dealt by its key and a hash of the row, so that a hot key is spread over `salts` tasks.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left': a repeated side cannot keep its unmatched rows")
    rows = small.limit(bound + 1).collect()
    if len(rows) <= bound:
        return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, small.schema)), on=list(on), how=how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")).join(salted, on=[*on, "_salt"], how=how).drop("_salt")
