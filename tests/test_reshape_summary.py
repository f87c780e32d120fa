"""Reshape and summary semantics on hand-written rows."""

import math

from pyspark.sql import functions as F

from panelrd.operators import reshape as V
from panelrd.operators import summary as S


def test_payment_rollup_na_span_and_null_distinct(spark):
    df = spark.createDataFrame([(1, "a", 10.0, 3), (1, "a", None, 5), (1, "a", 2.0, 5), (2, "b", 1.0, None), (2, "b", 4.0, 7)],
                               "id int, type string, amount double, month int")
    out = {r["id"]: r for r in S.payment_rollup(df, ["id", "type"], "amount", "month").collect()}
    assert out[1]["total"] == 12.0 and out[1]["parcels"] == 2 and out[1]["span"] == "3-5"
    assert out[2]["parcels"] == 2 and out[2]["span"] == "NA-NA"        # a NULL month: R's min/max are NA


def test_one_hot_fills_zero_and_dedups(spark):
    df = spark.createDataFrame([(1, 2018, "x"), (1, 2018, "x"), (1, 2018, "y"), (2, 2019, "y")], "id int, yr int, t string")
    out = {(r["id"], r["yr"]): (r["x"], r["y"], r["z"]) for r in V.one_hot(df, ["id", "yr"], "t", ["x", "y", "z"]).collect()}
    assert out == {(1, 2018): (1, 1, 0), (2, 2019): (0, 1, 0)}


def test_pivot_first_keeps_other_columns_as_keys(spark):
    df = spark.createDataFrame([(2015, 1, "A", "1-3"), (2015, 1, "R", "2-2"), (2016, 1, "A", "4-9")], "yr int, id int, type string, span string")
    out = sorted(tuple(r) for r in V.pivot_first(df, ["yr", "id"], "type", "span", ["A", "R"]).collect())
    assert out == [(2015, 1, "1-3", "2-2"), (2016, 1, "4-9", None)]


def test_panel_change_complete_cases_and_rate(spark):
    rows = [("m1", 2011, 100.0), ("m1", 2011, 300.0), ("m1", 2015, 400.0),   # mean 200 → 400 over 4 years
            ("m2", 2011, 50.0),                                               # no 2015 rows: dropped
            ("m3", 2011, None), ("m3", 2015, 10.0)]                           # no 2011 mean: dropped
    df = spark.createDataFrame(rows, "major string, yr int, inc double")
    out = V.panel_change(df, "major", "yr", 2011, 2015, ["inc"], annualise=["inc"]).collect()
    assert [r["major"] for r in out] == ["m1"]
    r = out[0]
    assert r["students"] == 2 and r["diff_inc"] == 200.0
    assert math.isclose(r["rate_inc"], (2.0 ** 0.25 - 1) * 100, rel_tol=1e-12)


def test_group_stats_strict_vs_skip(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "g string, v double")
    out = {r["g"]: r for r in S.group_stats(df, ["g"], [S.Stat("v", "mean", "strict"), S.Stat("v", "mean", "skip", skip_null=True),
                                                         S.Stat("v", "sum", "total", skip_null=True), S.Stat(None, "n", "n")]).collect()}
    assert out["a"]["strict"] is None and out["a"]["skip"] == 1.0 and out["a"]["total"] == 1.0 and out["a"]["n"] == 2
    assert out["b"]["strict"] == 2.0


def test_describe_by_long_table(spark):
    df = spark.createDataFrame([("E", 1.0, 0.0), ("E", 3.0, None), ("N", 5.0, 1.0)], "cut string, a double, b double")
    out = {(r["cut"], r["variable"]): r for r in S.describe_by(df, "cut", ["a", "b"]).collect()}
    assert out[("E", "a")]["mean"] == 2.0 and out[("E", "b")]["n"] == 1 and out[("N", "a")]["sd"] is None


def test_model_table_stars(spark):
    res = spark.createDataFrame([("m", "robust", 0.5, 0.1, 0.004), ("n", "robust", -0.02, 0.1, 0.8)],
                                "spec string, method string, estimate double, std_error double, p_value double")
    out = {(r["method"], r["row"]): (r["m"], r["n"]) for r in S.model_table(res, models=["m", "n"]).collect()}
    assert out[("robust", "estimate")] == ("0.500***", "-0.020") and out[("robust", "std_error")] == ("(0.100)", "(0.100)")
