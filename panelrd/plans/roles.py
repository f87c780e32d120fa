"""Table roles: the study's entities expressed on the driver's tables.

Each role is a projection/filter/join of the given tables, written so that the
oracle SQL can use identical arithmetic (see `oracle.py`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrd.functions.recode import flag
from panelrd.session import table_path
from panelrd.sources import load_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_table(spark, table_path(sf_dir, name))


def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicant × cohort with a score and two treatment flags (`orders`)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.year("o_orderdate").alias("cohort"),
        (F.col("o_totalprice") / 4000).alias("score"),
        flag(F.col("o_orderstatus") == "F").alias("treat_a"),
        flag(F.col("o_orderstatus") == "P").alias("treat_b"),
        F.col("o_custkey"),
        F.col("o_orderpriority"),
    )


def rd_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted RD data: x = price/4000 − 95, fuzzy take-up t, outcome with a 0.2 effect."""
    o = table(spark, sf_dir, "orders")
    x = F.col("o_totalprice") / 4000 - 95
    k10 = F.col("o_orderkey") % 10
    t = F.when(((x >= 0) & (k10 < 8)) | ((x < 0) & (k10 < 1)), F.lit(1.0)).otherwise(F.lit(0.0))
    e = ((F.col("o_orderkey") * 7919) % 1000) / 1000 - 0.5
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.year("o_orderdate").alias("cohort"),
        x.alias("x"), t.alias("t"), e.alias("e"),
        F.col("o_orderpriority").alias("grp"),
    ).withColumn("y", F.lit(0.3) + F.lit(0.01) * F.col("x") + F.lit(0.2) * F.col("t") + F.lit(0.1) * F.col("e"))
