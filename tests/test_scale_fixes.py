"""Rows and plans of the operators that must not depend on the number of rows, levels or buckets."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelrd.functions import deflate
from panelrd.operators import bins, cutoff
from panelrd.operators.attach import attach
from panelrd.operators.density import density_lp
from panelrd.operators.ols import ols_models
from panelrd.operators.panel import group_flags
from panelrd.operators.ranges import range_buckets
from panelrd.operators.rd import RDSpec, rd, rd_bandwidth, rd_grid
from panelrd.operators.rd.bandwidth import exact_quantiles
from panelrd.plans.util import rounded
from panelrd.sources import promote_header


def sample(spark, n=2000, levels=5, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 10, n), 1)
    t = ((x >= 0) ^ (rng.random(n) < 0.1)).astype(float)
    g = rng.integers(0, levels, n)
    y = 0.5 * t + 0.02 * x + 0.1 * (g % 7) + rng.normal(0, 1, n)
    return spark.createDataFrame([(float(a), float(b), float(c), f"g{d:06d}") for a, b, c, d in zip(x, y, t, g)], "x double, y double, t double, grp string")


SPEC = [RDSpec("s", "y", 0.0, 12.0, 12.0, 20.0, 20.0)]


def by_method(df):
    return {r["method"]: (r["estimate"], r["std_error"], r["n_left"], r["n_right"]) for r in df.collect()}


def test_nan_rows_are_left_out(spark):
    df = sample(spark)
    nan = float("nan")
    more = df.unionByName(spark.createDataFrame([(1.0, nan, 1.0, "g"), (nan, 1.0, 1.0, "g"), (2.0, 1.0, nan, "g")], df.schema))
    for treat, specs in ((None, SPEC), ("t", [RDSpec("s", "y", 0.0, 12.0, 12.0, 20.0, 20.0, fuzzy=True)])):
        a, b = by_method(rd_grid(df, "x", specs, treat=treat)), by_method(rd_grid(more if treat else more.filter(~F.isnan("t")), "x", specs, treat=treat))
        assert all(a[k] == pytest.approx(b[k]) for k in a)


def test_results_do_not_depend_on_the_bucket_size(spark):
    df = sample(spark).withColumn("x", F.when(F.col("x") > 25, F.col("x") * 1e6).otherwise(F.col("x")))
    whole = by_method(rd_grid(df, "x", SPEC))
    for size in (1, 3, 40):
        got = by_method(rd_grid(df, "x", SPEC, nn_bucket=size))
        assert all(got[k] == pytest.approx(whole[k], rel=1e-9) for k in whole)
    a, b = (density_lp(df, "x", 0.0, 8.0, per_bucket=k).first() for k in (None, 5))
    assert tuple(a) == pytest.approx(tuple(b))


def test_buckets_are_bounded_and_ordered(spark):
    values = [0.0, *(10.0 ** k for k in range(-12, 13)), *(1.0 + 1e-9 * k for k in range(300))]
    rows = range_buckets(spark.createDataFrame([(v,) for v in set(values)], "x double"), [], "x", 10).collect()
    sizes = {}
    for r in rows:
        sizes[tuple(r["_b"])] = sizes.get(tuple(r["_b"]), 0) + 1
    assert max(sizes.values()) <= 20 and len(sizes) > 15
    assert [r["x"] for r in sorted(rows, key=lambda r: r["_b"])] == sorted(set(values)) or all(
        a["x"] <= b["x"] for a, b in zip(*(lambda s: (s, s[1:]))(sorted(rows, key=lambda r: (r["_b"], r["x"])))))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    for x in (rng.normal(size=1001), np.repeat([1.0, 2.0, 3.0], 50), np.exp(rng.normal(0, 6, 500)), np.ones(12)):
        df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(4)
        got = exact_quantiles(df, "x", len(x), float(x.min()), float(x.max()), (0.25, 0.75))
        assert got == pytest.approx(np.quantile(x, [0.25, 0.75]).tolist(), rel=1e-12)


def test_many_group_levels(spark):
    """20,000 levels are solved through a small system; few levels give what dummies give."""
    many = sample(spark, 60000, 20000)
    got = by_method(rd_grid(many, "x", SPEC, group="grp", vce="hc0"))
    assert all(math.isfinite(v) for v in got["robust"][:2])
    few = sample(spark, 3000, 3)
    pdf = few.toPandas()
    h = 12.0
    w = np.maximum(0, 1 - np.abs(pdf.x) / h) / h
    right = (pdf.x >= 0).astype(float)
    X = np.column_stack([np.ones(len(pdf)), right, pdf.x, right * pdf.x, *((pdf.grp == f"g{k:06d}").astype(float) for k in (1, 2))])
    beta = np.linalg.lstsq(X * np.sqrt(w.to_numpy())[:, None], pdf.y * np.sqrt(w), rcond=None)[0]
    assert by_method(rd_grid(few, "x", SPEC, group="grp", vce="hc0"))["conventional"][0] == pytest.approx(beta[1], rel=1e-8)


def test_too_few_rows_give_null(spark):
    df = sample(spark, 8)
    assert [tuple(r)[1:6] for r in rd_bandwidth(df, "x", "y").collect()] == [(None,) * 5]
    assert all(r["estimate"] is None for r in rd(df, "x", "y").collect())


def test_ols_aliasing_own_rows_and_empty_input(spark):
    rows = [(float(i), float(i % 3), 2.0 * i, 1.0 + 3 * i + (i % 3) + 0.1 * (i % 2)) for i in range(30)] + [(None, 1.0, 0.0, 9.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    got = {(r.model, r.term): r for r in ols_models(df, "y", {"m": ["a", "c", "b"], "n": ["b"]}, complete_on_all=False).collect()}
    assert got["m", "c"].estimate is None and got["m", "a"].estimate is not None and got["m", "b"].std_error > 0
    assert got["m", "a"].n == 30 and got["n", "b"].n == 31
    assert {r.n for r in ols_models(df, "y", {"m": ["a", "b"], "n": ["b"]}).collect()} == {30}
    assert all(r.estimate is None and r.n == 0 for r in ols_models(df.filter("a < -1"), "y", {"m": ["a"]}).collect())


def test_header_ties(spark):
    schema = "ord int, a string, b string"
    rows = [(0, "x", "y"), (0, "z", "y"), (1, "1", "2"), (0, "x", "y")]
    got = promote_header(spark.createDataFrame(rows, schema), "ord")
    assert got.columns == ["x", "y"] and sorted(tuple(r) for r in got.collect()) == [("1", "2"), ("x", "y"), ("z", "y")]


def test_rounded_keeps_what_is_no_decimal(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e30,), (0.1234567,), (None,)], "v double")
    got = [r.v for r in rounded(df).collect()]
    assert math.isnan(got[0]) and got[1:] == [float("inf"), 1e30, 0.123457, None]


def test_deflate(spark):
    df = spark.createDataFrame([(10.0, 2001), (10.0, 1999), (None, 2001)], "v double, y int")
    assert [r.r for r in df.select(deflate(F.col("v"), F.col("y"), {2001: 1.5}).alias("r")).collect()] == [15.0, None, None]


@pytest.fixture
def static_plans(spark):
    """Plans as for tables that are too large to broadcast by their estimated size."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_fact_is_not_shuffled_by_few_keys(spark, static_plans):
    fact = spark.range(1000).select((F.col("id") % 7).alias("cohort"), (F.col("id") % 2).alias("side"), F.col("id").cast("double").alias("score"), F.lit(1).alias("t"))
    cuts = cutoff.cutoff_table(fact, "score", "cohort", {"t": 3.0})
    plan = cutoff.normalise(fact, cuts, "score", "cohort", {"t": 3.0})._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    plan = bins.bin_bands(fact, "score", "score", 10.0, 5.0, by=["side"])._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("partial_"):]  # under the map-side part of the bands' aggregate
    assert "BroadcastHashJoin" in below and "hashpartitioning" not in below


def test_attach_beyond_the_bound_is_salted(spark):
    fact = spark.range(500).select((F.col("id") % 20).alias("k"), F.col("id"))
    small = fact.groupBy("k").agg(F.max("id").alias("m"))
    a, b = attach(fact, small, ["k"]), attach(fact, small, ["k"], bound=5, salts=4)
    assert sorted(a.collect()) == sorted(b.collect()) and "_salt" in b._jdf.queryExecution().toString()


def test_hot_unit_is_split(spark, static_plans):
    """One unit holds a third of the spells: the join with the written flags splits its partition."""
    keys = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        spells = spark.range(0, 300000, 1, 8).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("u"), (F.col("id") % 2).cast("double").alias("d"), F.xxhash64("id").alias("pad"))
        units = spells.select("u").distinct().withColumn("entry", F.lit(2000))
        out = group_flags(spells, ["u"], "d", "d", units)
        assert out.count() == 300000
        out = group_flags(spells, ["u"], "d", "d", units)
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_million_group_levels(spark):
    """Group controls are solved from sums over levels: nothing of a level reaches the driver."""
    n = 2_000_000
    df = spark.range(n).select(
        (F.pmod(F.xxhash64("id"), F.lit(20_001)) / 1000.0 - 10).alias("x"), (F.col("id") % 1_000_000).cast("string").alias("grp"), F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1000)).alias("e"))
    df = df.withColumn("t", F.when(F.col("x") >= 0, 1.0).otherwise(0.0)).withColumn("y", 0.5 * F.col("t") + 0.02 * F.col("x") + F.col("e") / 1000 + F.pmod(F.xxhash64("grp"), F.lit(100)) / 10)
    got = by_method(rd_grid(df, "x", SPEC[:1], group="grp", vce="hc1"))
    plain = by_method(rd_grid(df, "x", SPEC[:1], vce="hc1"))
    assert abs(got["conventional"][0] - 0.5) < 4 * got["conventional"][1] and got["conventional"][1] < 0.2 * plain["conventional"][1]


def test_many_levels_take_the_path_of_few(spark, monkeypatch):
    from panelrd.operators.rd import cells

    df = sample(spark, levels=40)
    few = by_method(rd_grid(df, "x", SPEC, group="grp")), rd_bandwidth(df, "x", "y", group="grp", as_dict=True)
    monkeypatch.setattr(cells, "BROADCAST_ROWS", 5)
    many = by_method(rd_grid(df, "x", SPEC, group="grp")), rd_bandwidth(df, "x", "y", group="grp", as_dict=True)
    assert all(many[0][k] == pytest.approx(few[0][k], rel=1e-9) for k in few[0])
    assert all(many[1][k] == pytest.approx(few[1][k], rel=1e-7) for k in ("h_left", "h_right", "b_left", "b_right"))


def test_same_period_joins_on_years_taken_before(spark, tmp_path):
    import re

    import duckdb

    from panelrd.plans import catalog
    from panelrd.plans.oracle import SQL

    days = ["1996-12-31 23:59:59", "1997-01-01 00:00:00", "0800-05-05 00:00:00", None]
    li = [(k, n, days[(k + n) % 4]) for k in range(8) for n in range(4)] + [(None, 9, days[0]), (99, 1, days[0]), (1, 1, days[2])]
    o = [(k, days[k % 4]) for k in range(8)] + [(1, days[0]), (1, days[1]), (None, days[0])]  # one key repeats, one is null
    spark.createDataFrame(li, "l_orderkey long, l_linenumber int, t string").selectExpr("l_orderkey", "l_linenumber", "cast(t as timestamp_ntz) l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(o, "o_orderkey long, t string").selectExpr("o_orderkey", "cast(t as timestamp_ntz) o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.q_same_period_filter(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"(?:Join|Sort|hashpartitioning|HashedRelation).*", plan)
    assert keys and not [k for k in keys if "substring" in k or "year(" in k]
    with duckdb.connect() as c:
        for t in ("lineitem", "orders"):
            c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        want = c.sql(SQL["same_period_filter"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 6
