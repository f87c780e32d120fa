"""NA semantics (N1–N12) and recoding rules, on hand-written edge rows."""

from pyspark.sql import functions as F

from panelrd.functions import Rule, backfill, bracket, in_set, lookup, n_unique, recode, refine, strict, to_number


def test_in_set_with_null_member(spark):
    df = spark.createDataFrame([("A",), (None,), ("B",)], "x string")
    got = [r[0] for r in df.select(in_set("x", ["A", None]).cast("int")).collect()]
    assert got == [1, 1, 0]
    got = [r[0] for r in df.select(in_set("x", ["A"]).cast("int")).collect()]
    assert got == [1, 0, 0]  # never NULL


def test_unknown_class_is_null_and_filtered(spark):
    df = spark.createDataFrame([("R",), ("N",), ("A",), (None,), ("Z",)], "c string")
    rules = [Rule(("R",), 1), Rule(("N",), 2), Rule(("A", None), 0)]
    out = df.select("c", recode("c", rules).alias("k"))
    got = {r["c"]: r["k"] for r in out.collect()}
    assert got == {"R": 1, "N": 2, "A": 0, None: 0, "Z": None}
    kept = [r["c"] for r in out.filter(F.col("k") != 2).collect()]
    assert sorted(kept, key=str) == ["A", "None", "R"] or sorted(map(str, kept)) == ["A", "None", "R"]


def test_strict_and_skip_mean(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    r = df.agg(strict(F.avg, "x").alias("s"), F.avg("x").alias("k")).first()
    assert r["s"] is None and r["k"] == 1.0


def test_n_unique_counts_null(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "x int")
    assert df.agg(n_unique("x")).first()[0] == 2


def test_to_number_locale(spark):
    df = spark.createDataFrame([(" 1 234,5",), ("12,25",), ("abc",), (None,)], "t string")
    got = [r[0] for r in df.select(to_number("t")).collect()]
    assert got == [1234.5, 12.25, None, None]


def test_bracket_regex_vs_literal(spark):
    df = spark.createDataFrame([("above 20 to 30",), ("R$ 1 to 2",), (None,)], "t string")
    rules = [Rule("above 20", 20.0), Rule("above 20 to 30", 25.0), Rule("R$ 1", 1.5)]
    rg = [r[0] for r in df.select(bracket("t", rules, match="regex")).collect()]
    lt = [r[0] for r in df.select(bracket("t", rules, match="literal")).collect()]
    assert rg == [20.0, None, None]          # '$' is an end anchor: no match
    assert lt == [20.0, 1.5, None]           # first listed rule wins
    lt2 = [r[0] for r in df.select(bracket("t", [rules[1], rules[0], rules[2]])).collect()]
    assert lt2[0] == 25.0                    # order is the caller's


def test_lookup_backfill_refine(spark):
    df = spark.createDataFrame([("one", None, 1, "X", "X1"), ("two", 0.0, 1, "Y", "Y1"), ("zz", None, 0, "X", "X2")],
                               "w string, a double, cond int, coarse string, fine string")
    out = df.select(lookup("w", {"one": 1.0, "two": 2.0}).alias("n"), backfill("a", F.col("cond") == 1, 1.0).alias("b"),
                    refine("coarse", "fine", ["X"]).alias("r")).collect()
    assert [r["n"] for r in out] == [1.0, 2.0, None]
    assert [r["b"] for r in out] == [1.0, 0.0, None]
    assert [r["r"] for r in out] == ["X1", "Y", "X2"]
