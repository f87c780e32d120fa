"""Plan-shape checks over every registered query, including the plans of the
actions the estimators run internally (captured at `collect`):

* no Cartesian product and no nested-loop join (no pairs are ever emitted);
* nothing is moved to a single partition except the partial results of an
  aggregate or a top-k (one small record per task), so no window or sort ever
  gathers the data in one task;
* Parquet scans read only the needed columns of the wide fact table.
"""

import re

import pytest

from paths import SF_SMALL


def _plans_of(spark, fn):
    from pyspark.sql.classic.dataframe import DataFrame as CDF

    plans = []
    orig = CDF.collect

    def collect(self):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return orig(self)

    CDF.collect = collect
    try:
        df = fn(spark, SF_SMALL)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    finally:
        CDF.collect = orig
    return plans


def _names():
    from panelrd.plans import catalog

    return sorted(k[2:] for k in vars(catalog) if k.startswith("q_"))


def check_shape(spark, name, fn):
    for plan in _plans_of(spark, fn):
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                child = lines[i + 1] if i + 1 < len(lines) else ""
                assert re.search(r"Aggregate|TakeOrderedAndProject|Limit", child), f"{name}: single-partition exchange above {child.strip()[:120]}"
            m = re.search(r"FileScan parquet .*?lineitem.*?ReadSchema: struct<([^>]*)>", line)
            if m and name != "first_per_key":
                assert len(m.group(1).split(",")) < 11, f"{name}: lineitem scan reads every column"


@pytest.mark.parametrize("name", _names())
def test_plan_shape(spark, name):
    import __spark_entry__ as E

    check_shape(spark, name, E.queries()[name])


def test_plan_check_catches_single_partition_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    bad = df.select(F.row_number().over(Window.orderBy("l_orderkey")).alias("r"))._jdf.queryExecution().executedPlan().toString()
    lines = bad.splitlines()
    hits = [lines[i + 1] for i, l in enumerate(lines) if "Exchange SinglePartition" in l]
    assert hits and not any(re.search(r"Aggregate|TakeOrderedAndProject|Limit", h) for h in hits)


def test_hot_key_operators_combine_map_side(spark):
    """One key holds a third of all rows: the per-key operators must pre-aggregate in
    every task (partial aggregates under each shuffle) and stay exact."""
    from pyspark.sql import functions as F

    from panelrd.operators import panel as P
    from panelrd.operators import reshape as V
    from panelrd.operators import summary as S

    n = 30_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),     # key 0: a third of the rows
        F.lit(2018).alias("cohort"), (F.col("id") % 5).cast("double").alias("dur"),
        (F.col("id") % 2).cast("double").alias("done"), F.lit(0.0).alias("dropf"),
        (F.col("id") % 7 + 1).cast("int").alias("month"), F.col("id").cast("double").alias("amt"),
        F.concat(F.lit("t"), (F.col("id") % 4).cast("string")).alias("type")).repartition(8)
    ops = {
        "collapse": P.collapse_spells(df, ["k", "cohort"], "dropf", "done", "dur", order_by=["amt"], keep=["amt"]),
        "first": P.first_per_key(df.select("k", "amt", "dur"), ["k"], ["amt"]),
        "rollup": S.payment_rollup(df, ["k", "type"], "amt", "month"),
        "pivot": V.one_hot(df, ["k"], "type", ["t0", "t1", "t2", "t3"]),
    }
    for name, out in ops.items():
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "partial_" in plan, name
    hot = ops["collapse"].filter(F.col("k") == 0).first()
    assert hot["n_spells"] == n // 3 and hot["amt"] == 0.0 and hot["years"] == 4.0
    assert ops["first"].filter(F.col("k") == 0).first()["amt"] == 0.0
    r = ops["rollup"].filter((F.col("k") == 0) & (F.col("type") == "t0")).first()
    assert r["parcels"] == 7 and r["span"] == "1-7"
    assert ops["pivot"].filter(F.col("k") == 0).first()["t3"] == 1
