"""Spell collapse, first row per key, cutoffs and bin edges (FIXTURES §3)."""

import math

from pyspark.sql import functions as F

from panelrd.operators import bins as B
from panelrd.operators import cutoff as C
from panelrd.operators import panel as P


def test_censored_spell_duration(spark):
    df = spark.createDataFrame([(None, 2018), ("2020/2", 2018), ("2021/1", 2019)], "end string, entry int")
    got = [r[0] for r in df.select(P.spell_duration(F.col("end"), F.col("entry"), 2023.5)).collect()]
    assert got == [5.5, 3.0, 2.5]


def test_conditional_duration_finished_vs_unfinished(spark):
    df = spark.createDataFrame([(1, 2018, 0.0, 0.0, 6.0), (1, 2018, 0.0, 1.0, 4.0), (2, 2018, 1.0, 0.0, 3.0), (2, 2018, 1.0, 0.0, -1.0)],
                               "id int, cohort int, dropf double, done double, dur double")
    out = {r["id"]: r for r in P.collapse_spells(df, ["id", "cohort"], "dropf", "done", "dur", keep=[]).collect()}
    assert out[1]["years"] == 4.0 and out[1]["finished"] == 1.0 and out[1]["dropped"] == 0.0
    assert out[2]["years"] == 3.0 and out[2]["dropped"] == 1.0


def test_negative_duration_product_semantics(spark):
    # finished spell with a negative duration: max(dur * flag) keeps the 0 of the unfinished spell
    df = spark.createDataFrame([(1, 2018, 0.0, 1.0, -2.0), (1, 2018, 0.0, 0.0, 5.0)], "id int, cohort int, dropf double, done double, dur double")
    r = P.collapse_spells(df, ["id", "cohort"], "dropf", "done", "dur", keep=[]).first()
    assert r["years"] == 0.0


def test_null_flag_makes_group_flag_zero(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, None, 1.0)], "id int, dropf double, done double")
    r = P.collapse_spells(df.withColumn("dur", F.lit(1.0)), ["id"], "dropf", "done", "dur", keep=[]).first()
    assert r["dropped"] == 0.0 and r["finished"] == 1.0


def test_first_per_key_total_order_and_partition_invariance(spark):
    rows = [(1, 3, "c"), (1, 1, "b"), (1, 1, "a"), (2, 5, "z")]
    df = spark.createDataFrame(rows, "k int, o int, v string")
    for n in (1, 3, 7):
        out = sorted(tuple(r) for r in P.first_per_key(df.repartition(n), ["k"], ["o", "v"]).collect())
        assert out == [(1, 1, "a"), (2, 5, "z")]


def test_cutoff_missing_and_inclusive(spark):
    df = spark.createDataFrame([(2018, 95.0, 1.0), (2018, 91.0, 1.0), (2018, 85.0, 1.0), (2019, 85.0, 1.0), (2019, 99.0, 0.0)],
                               "cohort int, score double, t double")
    cut = {r["cohort"]: r["cutoff"] for r in C.infer_cutoff(df, "score", "cohort", {"t": 90.0}).collect()}
    assert cut == {2018: 91.0, 2019: None}
    inf = {r["cohort"]: r["cutoff"] for r in C.infer_cutoff(df, "score", "cohort", {"t": 90.0}, empty_cutoff="inf").collect()}
    assert math.isinf(inf[2019])
    wide = C.cutoff_table(df, "score", "cohort", {"t": 90.0})
    strict_ = {(r["cohort"], r["score"]): r["above_t"] for r in C.normalise(df, wide, "score", "cohort", ["t"]).collect()}
    incl = {(r["cohort"], r["score"]): r["above_t"] for r in C.normalise(df, wide, "score", "cohort", ["t"], inclusive=True).collect()}
    assert strict_[(2018, 91.0)] == 0.0 and incl[(2018, 91.0)] == 1.0
    assert strict_[(2019, 85.0)] == 0.0


def test_bin_edges_right_closed_lowest_included(spark):
    df = spark.createDataFrame([(-30.0, 1.0), (-20.0, 2.0), (0.0, 3.0)], "x double, y double")
    out = {r["bin"]: r for r in B.bin_bands(df, "x", "y", width=10.0, center=5.0).collect()}
    lowest = min(out)
    rel = sorted((b - lowest + 1, r["n"]) for b, r in out.items())
    assert rel == [(1, 2), (3, 1)]                 # R's cut_width numbering: bins 1, 1, 3
    assert out[lowest + 2]["se"] is None           # one-row bin: se NULL


def test_equal_bins_top_edge(spark):
    df = spark.createDataFrame([(-30.0, 1.0), (30.0, 3.0), (29.9, 5.0)], "x double, y double")
    out = {r["bin"]: r["n"] for r in B.bin_means(df, "x", "y", bins=6, lo=-30.0, hi=30.0).collect()}
    assert out == {0: 1, 5: 2}


def test_collapse_terms_equals_collapse_spells(spark):
    rows = [(1, "2020/2", 1.0, 0.0), (1, "2019/1", 0.0, 1.0),           # finished + unfinished
            (2, "2017/1", 0.0, 1.0), (2, "2016/2", 0.0, 1.0),           # only finished, ends before entry (negative)
            (3, None, 1.0, 0.0), (3, "2021/1", 1.0, 0.0),               # censored, all dropped out
            (4, "20x9/1", 0.0, 1.0), (4, "2020/1", 0.0, 0.0)]           # malformed end term → NULL years
    sp = spark.createDataFrame(rows, "id int, end string, dropf double, done double")
    units = spark.createDataFrame([(1, 2018), (2, 2018), (3, 2019), (4, 2018)], "id int, entry int")
    fast = {r["id"]: tuple(r) for r in P.collapse_terms(sp, ["id"], "dropf", "done", "end", units, "entry", 2023.5).collect()}
    full = sp.join(units, "id").withColumn("dur", P.spell_duration(F.col("end"), F.col("entry"), 2023.5))
    ref = {r["id"]: tuple(r) for r in P.collapse_spells(full, ["id", "entry"], "dropf", "done", "dur", keep=[]).collect()}
    assert fast == ref
    assert fast[2][4] == -0.5 and fast[3][4] == 4.5 and fast[4][4] is None


def test_join_on_null_safe_keys_and_right_keys(spark):
    a = spark.createDataFrame([(1, 2018, "x"), (None, 2019, "y")], "id int, yr int, va string")
    b = spark.createDataFrame([(1, 2018, 10.0), (None, 2019, 20.0), (3, 2020, 30.0)], "k int, year int, vb double")
    right = sorted((tuple(r) for r in P.join_on(a, b, [("id", "k"), ("yr", "year")], how="right").collect()), key=str)
    assert right == sorted([(None, 2019, "y", 20.0), (1, 2018, "x", 10.0), (3, 2020, None, 30.0)], key=str)
    strict_ = P.join_on(a, b, [("id", "k"), ("yr", "year")], how="left", null_safe=False).collect()
    assert {r["va"]: r["vb"] for r in strict_} == {"x": 10.0, "y": None}     # NULL keys do not match without null_safe


def test_join_fill(spark):
    a = spark.createDataFrame([("m1", 10), ("m2", 5)], "major string, students int")
    b = spark.createDataFrame([("m1", 3)], "major string, applicants int")
    out = {r["major"]: r["applicants"] for r in P.join_fill(a, b, ["major"], {"applicants": 0}).collect()}
    assert out == {"m1": 3, "m2": 0}
