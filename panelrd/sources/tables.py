"""Named-table load, header promotion and table export.

The original work reads spreadsheet sheets; here a sheet is any Spark-readable
table (Parquet by default) with an optional explicit schema, so no schema
inference job runs at 100 TB.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def load_table(spark: SparkSession, path: str, schema: StructType | str | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """Read one table.  Filters and projections applied later reach the scan."""
    r = spark.read.format(fmt).options(**options)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def save_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Write a table (overwrite by default); optional partition columns."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def promote_header(df: DataFrame, order_col: str, drop_positions: Sequence[int] = ()) -> DataFrame:
    """Make the first record (lowest `order_col`, ties by the other columns) the column names.

    Only that single record reaches the driver.  The header record itself is
    removed and every data column stays text (as a sheet read without types);
    columns at `drop_positions` (0-based, after promotion, order column
    excluded) are dropped.  Blank or repeated header cells get positional names.
    """
    data_cols = [c for c in df.columns if c != order_col]
    order = [F.col(order_col).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in data_cols]]
    first = df.orderBy(*order).select(order_col, *data_cols).limit(1).collect()
    if not first:
        return df.drop(order_col)
    is_head = F.lit(True)
    for c, v in zip([order_col, *data_cols], first[0]):
        is_head = is_head & F.col(c).eqNullSafe(F.lit(v))
    names, seen = [], set()
    for i, v in enumerate(first[0][1:]):
        n = str(v) if v is not None and str(v).strip() != "" else f"col_{i + 1}"
        while n in seen:
            n = f"{n}_{i + 1}"
        seen.add(n)
        names.append(n)
    body = df.filter(~is_head)
    again = df.filter(is_head).count() - 1
    if again:  # rows equal to the header in every column: all but one are data
        body = body.unionByName(df.sparkSession.range(again).select(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip([order_col, *data_cols], first[0])]))
    out = body.select(*[F.col(c).cast("string").alias(n) for c, n in zip(data_cols, names)])
    drop = [names[i] for i in drop_positions]
    return out.drop(*drop) if drop else out
