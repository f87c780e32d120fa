"""Cut a table of distinct values per key into ordered buckets of bounded size, without a sort and without a maximum.

A key's range is cut into equal cells, about one for `per_bucket` values; cells that still hold more than twice that are
cut again over their own range, until none does.  A bucket is the list of cell numbers, which orders as the values do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrd.operators.attach import attach

#: Rows of the table of heavy cells that may be broadcast: enough for 4e10 distinct values of a key at the default size.
HEAVY_ROWS = 100_000


def range_buckets(values: DataFrame, keys: Sequence[str], x: str, per_bucket: int) -> DataFrame:
    """`values` (rows differ in (keys, x)) with `_b`: array of cell numbers.  Scanned once for each level of cells."""
    keys = list(keys)
    sizes = [F.count(F.lit(1)).alias("_cn"), F.min(x).alias("_clo"), F.max(x).alias("_chi")]

    def cell(out: DataFrame):
        parts = F.ceil(F.col("_cn") / F.lit(per_bucket))
        # values of one cell differ, so the smallest and the largest of them part at each level
        part = F.try_divide(F.col(x) - F.col("_clo"), F.col("_chi") - F.col("_clo"))
        return F.array(F.coalesce(F.least(F.floor(part * parts), parts - 1), F.lit(0)).cast("long"))

    whole = values.groupBy(*keys).agg(*sizes)
    if keys:
        out = attach(values, whole, keys)
    else:
        row = whole.first()
        out = values.withColumns({c: F.lit(row[c]) for c in ("_cn", "_clo", "_chi")})
    out = out.withColumn("_b", cell(out)).drop("_cn", "_clo", "_chi")
    while True:
        cells = out.groupBy(*keys, "_b").agg(*sizes)
        heavy = cells.filter((F.col("_cn") > 2 * per_bucket) & (F.col("_chi") > F.col("_clo")))
        if heavy.isEmpty():
            return out
        out = attach(out, heavy, [*keys, "_b"], bound=HEAVY_ROWS)
        out = out.withColumn("_b", F.concat("_b", cell(out))).drop("_cn", "_clo", "_chi")


def running_total(cut: DataFrame, keys: Sequence[str], x: str, d: str, name: str) -> DataFrame:
    """`cut` (with buckets `_b`) with `name`: the sum of `d` up to each row in x order within the keys, over buckets first."""
    keys = list(keys)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*keys, "_b").agg(F.sum(d).alias("_t")).select(*keys, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))  # a row for each bucket
    inside = Window.partitionBy(*keys, "_b").orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.withColumn("_run", F.sum(d).over(inside)).join(starts, [*keys, "_b"]).withColumn(name, F.col("_start") + F.col("_run")).drop("_start", "_run")
