"""Spark side of the query catalogue: one function per operator exercise.

Each function takes (spark, sf_dir) and returns a DataFrame over the whole
driver tables; the matching SQL is in `oracle.py` under the same name.  The
final step of every query rounds reals to 6 places for a stable comparison.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrd.functions import Rule, any_of, backfill, bracket, deflate, flag, in_set, lookup, recode, refine, to_number, tri_state
from panelrd.operators import bins as B
from panelrd.operators import cutoff as C
from panelrd.operators import panel as P
from panelrd.operators import reshape as V
from panelrd.operators import summary as S
from panelrd.plans import roles
from panelrd.plans.util import rounded
from panelrd.sources import promote_header

TREATMENTS = {"treat_a": 90.0, "treat_b": 80.0}
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
FLAGS = ["A", "N", "R"]
CENSOR = 2002.5

# Fixed values of the stand-in rules (chosen for the driver tables).
# Closure classes: R = dropped out (1), N = excluded (2), A or missing = finished/open (0).
CLOSURE_RULES = [Rule(("R",), 1), Rule(("N",), 2), Rule(("A", None), 0)]
# Ordered bracket rules over part names; overlapping on purpose (first match wins).
BRACKET_LITERAL = [Rule("small r", 5.0), Rule("small", 10.0), Rule("red", 20.0), Rule("ring", 25.0),
                   Rule("o$ld", 40.0), Rule("old", 30.0)]
BRACKET_REGEX = [Rule("small r", 5.0), Rule("sm.ll", 10.0), Rule("red", 20.0), Rule("ring$", 25.0),
                 Rule("o$ld", 40.0), Rule("^old", 30.0)]
PRIORITY_WORDS = {"1-URGENT": 5.0, "2-HIGH": 4.0, "3-MEDIUM": 3.0, "5-LOW": 1.0}
DEFLATOR = {1995: 1.35, 1996: 1.3, 1997: 1.24, 1998: 1.19, 1999: 1.12, 2000: 1.06}


def _t(spark, d, name):
    return roles.table(spark, d, name)


# ---------------------------------------------------------------- 2.A-2.D

def q_select_rename(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    o = o.drop("o_orderdate").withColumnsRenamed({"o_orderkey": "id", "o_custkey": "customer", "o_totalprice": "price", "o_orderstatus": "status"})
    return rounded(o)


def q_flags(spark, d):
    o = _t(spark, d, "orders")
    primary = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    out = o.select(
        F.col("o_orderkey").alias("id"),
        flag(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        tri_state(F.col("o_orderstatus"), ("F",), ("O",)).alias("finished_known"),
        flag(any_of(in_set(primary, ["1-URGENT", "2-HIGH"]), in_set(F.col("o_orderstatus"), ["F"]))).alias("high_or_done"),
    )
    return rounded(out)


def q_recode_set(spark, d):
    li = _t(spark, d, "lineitem")
    closure = F.when(F.col("l_linenumber") != 1, F.col("l_returnflag"))
    out = li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        recode(closure, CLOSURE_RULES).alias("cls"),
        recode(F.col("l_linestatus"), [Rule(("F",), "closed"), Rule(("O",), "open")]).alias("label"),
    ).filter(F.col("cls") != 2)
    out = out.withColumn("is_closed", flag(F.col("label") == "closed"))
    return rounded(out)


def q_bracket_midpoint(spark, d):
    p = _t(spark, d, "part")
    out = p.select("p_partkey", "p_name",
                   bracket(F.col("p_name"), BRACKET_LITERAL, match="literal").alias("mid_literal"),
                   bracket(F.col("p_name"), BRACKET_REGEX, match="regex").alias("mid_regex"))
    return rounded(out)


def q_word_number(spark, d):
    o = _t(spark, d, "orders")
    return rounded(o.select(F.col("o_orderkey").alias("id"), lookup(F.col("o_orderpriority"), PRIORITY_WORDS).alias("priority_num")))


def q_backfill(spark, d):
    o = _t(spark, d, "orders")
    a = F.when(F.col("o_orderstatus") != "O", flag(F.col("o_orderpriority") == "1-URGENT"))
    out = o.select(F.col("o_orderkey").alias("id"), a.alias("urgent"), (F.col("o_totalprice") > 200000).alias("big"))
    out = out.withColumn("urgent_filled", backfill("urgent", F.col("big"), 1.0)).drop("big")
    return rounded(out)


def q_refine_category(spark, d):
    c = _t(spark, d, "customer")
    n = _t(spark, d, "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left")
    fine = F.concat(F.col("c_mktsegment"), F.lit("/"), F.col("n_name"))
    return j.select("c_custkey", refine(F.col("c_mktsegment"), fine, ["BUILDING", "MACHINERY"]).alias("category"))


def q_regex_exclude(spark, d):
    p = _t(spark, d, "part")
    name = F.when(F.col("p_size") != 1, F.col("p_name"))
    return p.select("p_partkey", name.alias("name")).filter(~F.col("name").rlike("^(red|blue) "))


def q_complete_cases(spark, d):
    o = _t(spark, d, "orders")
    out = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("status"),
                   F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"), "o_totalprice")
    return rounded(out.dropna(how="any", subset=["status", "priority"]))


def q_freq_with_null(spark, d):
    o = _t(spark, d, "orders")
    v = o.select(F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority")).alias("priority"))
    return S.freq(v, "priority")


def _cents_text(price):
    cents = F.round(price * 100).cast("long")
    return F.concat(F.lit(" "), F.floor(cents / 100).cast("long").cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))


def q_parse_locale_number(spark, d):
    o = _t(spark, d, "orders")
    text = F.when(F.col("o_orderstatus") == "P", F.concat(_cents_text(F.col("o_totalprice")), F.lit("x"))).otherwise(_cents_text(F.col("o_totalprice")))
    out = o.select(F.col("o_orderkey").alias("id"), text.alias("text")).withColumn("value", to_number("text"))
    return rounded(out)


def q_deflate(spark, d):
    li = _t(spark, d, "lineitem")
    x = li.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", F.year("l_shipdate").alias("year"))
    real = deflate(F.col("l_extendedprice"), F.col("year"), DEFLATOR)
    out = x.select("l_orderkey", "l_linenumber", "year", real.alias("real"), F.try_divide(real, F.col("l_quantity") - 1).alias("real_per_unit"))
    return rounded(out)


def q_same_period_filter(spark, d):
    """Rows whose date prefix (text) and order's year (number) agree, and whose years do.

    Years are columns before the join: as expressions over both sides they would become its keys, ahead of the order's, and be
    worked out again, text and all, in every comparison of its sorts.  Where the years agree, the prefix can be held against
    the row's own.  Both tables grow alike, so neither is broadcast.
    """
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", F.year("l_shipdate").alias("year"))
    li = li.filter(F.substring(F.col("l_shipdate").cast("string"), 1, 4) == F.col("year").cast("string")).drop("l_shipdate")
    o = _t(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("cohort"))
    j = li.join(o.hint("merge"), (li.l_orderkey == o.o_orderkey) & (li.year == o.cohort))
    return j.select("l_orderkey", "l_linenumber", "cohort")


def q_distinct_rows(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus").distinct()


def q_header_promote(spark, d):
    r = _t(spark, d, "region")
    head = spark.createDataFrame([(0, "region_key", "region_name", "note")], "ord int, c1 string, c2 string, c3 string")
    body = r.select((F.col("r_regionkey") + 1).alias("ord"), F.col("r_regionkey").cast("string").alias("c1"),
                    F.col("r_name").alias("c2"), F.lit("-").alias("c3"))
    return promote_header(head.unionByName(body), "ord", drop_positions=[2])


# ---------------------------------------------------------------- cutoffs and bins

def _normalised(spark, d):
    s = roles.score(spark, d)
    cuts = C.cutoff_table(s, "score", "cohort", TREATMENTS)
    return C.normalise(s, cuts, "score", "cohort", TREATMENTS)


def q_cutoff_infer(spark, d):
    return rounded(C.infer_cutoff(roles.score(spark, d), "score", "cohort", TREATMENTS))


def q_cutoff_normalise(spark, d):
    n = _normalised(spark, d).filter(F.col("x_treat_a") < 0)
    return rounded(n.select("id", "cohort", "score", "x_treat_a", "x_treat_b", "above_treat_b", "treat_b"))


def q_bin_means(spark, d):
    n = _normalised(spark, d).filter(F.col("x_treat_a") < 0).withColumn("y", F.col("treat_b") * 100)
    out = B.bin_means(n, "x_treat_b", "y", bins=6, lo=-30.0, hi=30.0, by=["cohort"])
    return rounded(out.select("cohort", "bin", "bin_lo", "bin_mid", "n", "mean_y", "se_y"))


# ---------------------------------------------------------------- 2.E-2.H: spells, joins, reshape

def _students(spark, d):
    """One row per (order, cohort) from its line-item spells; duration from `l_quantity`.

    Nothing here depends on the cohort, so the spells are collapsed per unit first
    (combined map-side: a unit holding a third of all line items becomes one record
    per task before any shuffle) and the cohort is attached afterwards by a 1:1 join.
    """
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("closure"),
                                         (F.col("l_quantity") / 10).alias("dur"))
    sp = li.withColumn("cls", recode(F.col("closure"), CLOSURE_RULES)).filter(F.col("cls") != 2)
    sp = sp.withColumns({"drop": flag(F.col("cls") == 1), "done": flag(F.col("closure") == "A")})
    st = P.collapse_spells(sp, ["id"], "drop", "done", "dur", keep=[])
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("cohort"))
    return st.join(o, on="id", how="inner").select("id", "cohort", "dropped", "finished", "years", "n_spells")


def q_spell_flags(spark, d):
    """Unit flags and cohort attached to every spell: flags and cohort meet first (one row per
    unit, written and read back), and the spells are joined once and last."""
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
                                         F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("closure"))
    sp = li.withColumn("cls", recode(F.col("closure"), CLOSURE_RULES)).filter(F.col("cls") != 2)
    sp = sp.withColumns({"drop": flag(F.col("cls") == 1), "done": flag(F.col("closure") == "A")})
    units = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("cohort"))
    out = P.group_flags(sp, ["id"], "drop", "done", units)
    return rounded(out.select("id", "cohort", "line", "part", "drop", "done", "dropped", "finished"))


def q_spell_duration(spark, d):
    """Duration = end term − entry year: spells are pre-aggregated per unit on the line
    items, the entry year (order year) is joined 1:1 afterwards."""
    li = _t(spark, d, "lineitem")
    half = F.when(F.month("l_shipdate") <= 6, F.lit("1")).otherwise(F.lit("2"))
    end_term = F.when(F.col("l_linenumber") == 7, F.lit(None).cast("string")).otherwise(
        F.concat(F.year("l_shipdate").cast("string"), F.lit("/"), half))
    sp = li.select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("closure"), end_term.alias("end_term"))
    sp = sp.withColumn("cls", recode(F.col("closure"), CLOSURE_RULES)).filter(F.col("cls") != 2)
    sp = sp.withColumns({"drop": flag(F.col("cls") == 1), "done": flag(F.col("closure") == "A")})
    units = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("cohort"))
    return rounded(P.collapse_terms(sp, ["id"], "drop", "done", "end_term", units, "cohort", CENSOR))


def q_first_per_key(spark, d):
    li = _t(spark, d, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus", "l_shipdate"]
    return rounded(P.first_per_key(li, ["l_orderkey"], order_by=order))


def q_persistence_ladder(spark, d):
    from panelrd.functions import persistence

    st = _students(spark, d)
    return rounded(st.select("id", "cohort", "years", *persistence(F.col("years"), [1, 2, 3, 4], prefix="persist_")))


def _awards(o):
    return o.select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("cohort"), F.col("o_orderpriority").alias("type"))


def q_pivot_awards(spark, d):
    return V.one_hot(_awards(_t(spark, d, "orders")), ["id", "cohort"], "type", PRIORITIES)


def _payments(spark, d):
    li = _t(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("id"), F.year("l_shipdate").alias("pay_year"),
                     F.when(F.month("l_shipdate") != 2, F.month("l_shipdate")).alias("pay_month"),
                     F.col("l_returnflag").alias("type"), F.col("l_extendedprice").alias("amount"))


def q_payment_rollup(spark, d):
    return rounded(S.payment_rollup(_payments(spark, d), ["pay_year", "id", "type"], "amount", "pay_month"))


def q_pivot_text(spark, d):
    roll = S.payment_rollup(_payments(spark, d), ["pay_year", "id", "type"], "amount", "pay_month")
    return V.pivot_first(roll, ["pay_year", "id"], "type", "span", FLAGS)


def q_join_right_two_key(spark, d):
    o = _t(spark, d, "orders")
    awards = V.one_hot(_awards(o.filter(F.col("o_orderstatus") == "F")), ["id", "cohort"], "type", PRIORITIES)
    scores = o.groupBy(F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("yr")).agg(
        F.count(F.lit(1)).cast("long").alias("n_orders"), F.sum("o_totalprice").alias("price_sum"))
    return rounded(P.join_on(awards, scores, [("id", "cust"), ("cohort", "yr")], how="right"))


def q_join_left_two_key(spark, d):
    s = roles.score(spark, d).select("id", "cohort", "score")
    st = _students(spark, d).withColumnsRenamed({"id": "sid", "cohort": "entry"}).drop("n_spells")
    return rounded(P.join_on(s, st, [("id", "sid"), ("cohort", "entry")], how="left"))


def _majors(spark, d):
    """Score role with the unit's major (customer nation) attached."""
    s = roles.score(spark, d)
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = _t(spark, d, "nation").select("n_nationkey", "n_name")
    return s.join(c, s.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left") \
        .withColumn("price", F.col("score") * 4000)


def q_join_agg_fill(spark, d):
    m = _majors(spark, d)
    students = S.group_stats(m, ["n_name"], [S.Stat(None, "n", "students"), S.Stat("treat_a", "mean", "porc_a", scale=100.0)])
    appl = m.filter((F.col("treat_a") == 1) & (F.col("o_orderpriority") == "1-URGENT") & (F.col("score") > 112.5))
    applicants = appl.groupBy("n_name").agg(F.count(F.lit(1)).cast("long").alias("applicants"), F.sum("treat_a").alias("stipends"))
    out = P.join_fill(students, applicants, ["n_name"], {"applicants": 0, "stipends": 0.0})
    out = out.withColumns({
        "porc_apply": F.when(F.col("applicants") == 0, F.lit(0.0)).otherwise(100 * F.col("applicants") / F.col("students")),
        "porc_stipend": F.when(F.col("stipends") == 0, F.lit(0.0)).otherwise(100 * F.col("stipends") / F.col("students")),
    })
    return rounded(out)


# ---------------------------------------------------------------- 2.F summaries

def q_group_shares(spark, d):
    m = _majors(spark, d)
    out = S.group_stats(m, ["cohort", "n_name"], [
        S.Stat(None, "n", "n"),
        S.Stat("treat_a", "mean", "pct_a", scale=100.0),
        S.Stat("treat_b", "sum", "n_b", skip_null=True),
        S.Stat("score", "mean", "mean_score", skip_null=True),
        S.Stat("score", "mean", "scaled_score", scale=1.1648, skip_null=True),
    ])
    return rounded(out)


def q_table_means(spark, d):
    s = roles.score(spark, d)
    return rounded(S.group_stats(s, [], [S.Stat("treat_a", "mean", "pct_a", scale=100.0), S.Stat("treat_b", "mean", "pct_b", scale=100.0),
                                         S.Stat("score", "mean", "mean_score")]))


def q_describe_by_group(spark, d):
    n = _normalised(spark, d).withColumns({
        "cut": F.when(F.col("above_treat_b") == 1, F.lit("Eligible")).otherwise(F.lit("Not Eligible")),
        "pct_a": F.col("treat_a") * 100, "pct_b": F.col("treat_b") * 100})
    return rounded(S.describe_by(n, "cut", ["score", "pct_a", "pct_b"]))


def q_cohort_series(spark, d):
    s = roles.score(spark, d)
    return rounded(S.group_stats(s, ["cohort"], [S.Stat(None, "n", "n"), S.Stat("treat_b", "mean", "pct_b", scale=100.0),
                                                 S.Stat("score", "mean", "mean_score", skip_null=True)]))


def q_panel_change(spark, d):
    m = _majors(spark, d).withColumn("pct_a", F.col("treat_a") * 100)
    out = V.panel_change(m, "n_name", "cohort", 1995, 1999, ["price", "pct_a"], annualise=["price"], base_means=["score"])
    return rounded(out)


def q_bubble_table(spark, d):
    m = _majors(spark, d).withColumn("pct_a", F.col("treat_a") * 100)
    return rounded(S.bubble_table(m, "n_name", "score", "pct_a"))


# ---------------------------------------------------------------- 2.J bins, 2.K estimators

from panelrd.operators import density as DEN  # noqa: E402
from panelrd.operators import ols as OLS  # noqa: E402
from panelrd.operators.density_lp import density_lp_auto, density_lp_curve  # noqa: E402
from panelrd.operators.rd import rd_bandwidth, rd_grid, rd_robustness  # noqa: E402
from panelrd.plans import estimates as EST  # noqa: E402


def q_histogram(spark, d):
    n = _normalised(spark, d)
    return rounded(B.histogram(n, "x_treat_b", EST.HIST_BINS, EST.HIST_LO, EST.HIST_HI, shift=EST.HIST_SHIFT))


def q_bin_bands(spark, d):
    n = _normalised(spark, d).filter((F.col("x_treat_a") < 0) & (F.col("x_treat_b") >= -30) & (F.col("x_treat_b") < 30))
    n = n.withColumns({"side": F.when(F.col("x_treat_b") >= 0, F.lit(1)).otherwise(F.lit(0)), "y": F.col("treat_b") * 100})
    return rounded(B.bin_bands(n, "x_treat_b", "y", width=10.0, center=5.0, by=["side"]))


def q_rdplot_bins(spark, d):
    return rounded(B.rd_plot_data(roles.rd_fixture(spark, d), "x", "y", c=0.0))


def q_rdplot_bins_quantile(spark, d):
    """The same with quantile-spaced bins."""
    return rounded(B.rd_plot_data(roles.rd_fixture(spark, d), "x", "y", c=0.0, spaced="quantile"))


def q_rd_sharp(spark, d):
    return rounded(rd_grid(roles.rd_fixture(spark, d), "x", EST.SHARP_SPECS, vce="hc1"))


def q_rd_fuzzy(spark, d):
    return rounded(rd_grid(roles.rd_fixture(spark, d), "x", EST.FUZZY_SPECS, treat="t", vce="nn"))


def q_rd_fuzzy_buckets(spark, d):
    """`rd_fuzzy` with buckets of 20 values: neighbours across dozens of bucket borders."""
    return rounded(rd_grid(roles.rd_fixture(spark, d), "x", EST.FUZZY_SPECS, treat="t", vce="nn", nn_bucket=20))


def q_rd_fuzzy_groups(spark, d):
    return rounded(rd_grid(roles.rd_fixture(spark, d), "x", EST.FUZZY_SPECS, treat="t", group="grp"))


def q_rd_spec_grid(spark, d):
    return rounded(rd_grid(roles.rd_fixture(spark, d), "x", EST.GRID_SPECS, treat="t", vce="hc1"))


def q_rd_fuzzy_auto(spark, d):
    """The main analysis call: fuzzy RD, per-side MSE-optimal bandwidths, nearest-neighbour variance."""
    from panelrd.operators.rd import rd

    return rounded(rd(roles.rd_fixture(spark, d), "x", "y", c=0.0, treat="t", bwselect="msetwo", name="fuzzy_auto"), EST.AUTO_DIGITS)


def q_rd_sharp_auto(spark, d):
    """Sharp estimates of an outcome and of a covariate with selected bandwidths."""
    return rounded(rd_robustness(roles.rd_fixture(spark, d), "x", EST.SHARP_AUTO_SPECS), EST.AUTO_DIGITS)


def q_rd_mass_points(spark, d):
    """Selected bandwidths on a running variable of few distinct values."""
    fx = roles.rd_fixture(spark, d).withColumn("x", F.floor(F.col("x") * 2) / 2)
    return rounded(rd_robustness(fx, "x", EST.MASS_SPECS, treat="t", masspoints="adjust"), EST.AUTO_DIGITS)


def q_rd_robustness_grid(spark, d):
    """The robustness study with group controls: rules, multiples of the selected bandwidths, placebo cutoffs, a covariate."""
    return rounded(rd_robustness(roles.rd_fixture(spark, d), "x", EST.ROBUST_SPECS, treat="t", group="grp"), EST.AUTO_DIGITS)


def q_rd_bandwidth(spark, d):
    fx = roles.rd_fixture(spark, d)
    return rounded(rd_bandwidth(fx, "x", "y", treat="t", rule=["msetwo", "certwo"]), EST.AUTO_DIGITS)


def q_fitted_lines(spark, d):
    fx = roles.rd_fixture(spark, d)
    _, sides = rd_grid(fx, "x", EST.FUZZY_SPECS, treat="t", return_sides=True, variance=False)
    return rounded(B.fitted_lines(fx, "x", sides, c=0.0, h_left=EST.RD_H, h_right=EST.RD_H))


def q_model_table(spark, d):
    res = rd_grid(roles.rd_fixture(spark, d), "x", EST.TABLE_SPECS, vce="hc1")
    return S.model_table(res, models=[s.name for s in EST.TABLE_SPECS])


def q_ols_simple(spark, d):
    return rounded(OLS.ols(roles.rd_fixture(spark, d), "y", ["x"], name="simple"))


def q_ols_multi(spark, d):
    return rounded(OLS.ols_models(roles.rd_fixture(spark, d), "y", {"m1": ["x"], "m2": ["x", "t"]}))


def q_ols_masks(spark, d):
    """Models over their own complete rows, of a table with holes, in one scan."""
    fx = roles.rd_fixture(spark, d)
    hole = lambda c, k: F.when(F.col("id") % k != 0, F.col(c)).alias(c)
    return rounded(OLS.ols_models(fx.select(hole("y", 7), hole("x", 11), hole("t", 13)), "y", {"m1": ["x"], "m2": ["x", "t"]}, complete_on_all=False))


def q_export_round_trip(spark, d):
    """Export to a partitioned table and read it again."""
    from panelrd.session import checkpoint_dir
    from panelrd.sources import load_table, save_table

    path = f"{checkpoint_dir(spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("cohort"), F.col("o_orderpriority").alias("type"), F.col("o_totalprice").alias("price"))
    save_table(o, path, partition_by=["cohort"])
    return rounded(load_table(spark, path).select("id", F.col("cohort").cast("int").alias("cohort"), "type", "price"))


def q_density_binned(spark, d):
    return rounded(DEN.density_binned(roles.rd_fixture(spark, d), "x", 0.0, EST.DENSITY_BIN, EST.DENSITY_H))


def q_density_curve(spark, d):
    return rounded(DEN.density_curve(roles.rd_fixture(spark, d), "x", 0.0, EST.DENSITY_BIN, EST.DENSITY_H))


def q_density_lp(spark, d, per_bucket=None):
    fx = roles.rd_fixture(spark, d)
    bunched = fx.filter(~((F.col("x") >= -3) & (F.col("x") < 0) & F.col("grp").isin("1-URGENT", "2-HIGH")))
    a, b = (DEN.density_lp(s, "x", 0.0, EST.DENSITY_LP_H, EST.DENSITY_LP_P, per_bucket=per_bucket) for s in (fx, bunched))
    return rounded(a.withColumn("sample", F.lit("full")).unionByName(b.withColumn("sample", F.lit("bunched"))))


def _bunched(fx):
    """The fixture with a gap left of the cutoff."""
    return fx.filter(~((F.col("x") >= -3) & (F.col("x") < 0) & F.col("grp").isin("1-URGENT", "2-HIGH")))


def q_density_lp_auto(spark, d):
    """The density test as it is called, without a bandwidth: selected bandwidths, jackknife errors, robust order."""
    fx = roles.rd_fixture(spark, d)
    a, b = (density_lp_auto(s, "x", 0.0, EST.DENSITY_LP_P) for s in (fx, _bunched(fx)))
    return rounded(a.withColumn("sample", F.lit("full")).unionByName(b.withColumn("sample", F.lit("bunched"))), EST.DENSITY_DIGITS)


def q_density_lp_curve(spark, d):
    return rounded(density_lp_curve(roles.rd_fixture(spark, d), "x", 0.0, None, EST.DENSITY_LP_P, EST.CURVE_POINTS, EST.CURVE_REACH), EST.DENSITY_DIGITS)


def q_density_lp_buckets(spark, d):
    """`density_lp` with buckets of 20 values: running sums across dozens of buckets."""
    return q_density_lp(spark, d, per_bucket=20)


def q_density_test(spark, d):
    fx = roles.rd_fixture(spark, d)
    bunched = fx.filter(~((F.col("x") >= -3) & (F.col("x") < 0) & F.col("grp").isin("1-URGENT", "2-HIGH")))
    a = DEN.density_test(fx, "x", 0.0, EST.DENSITY_BIN, EST.DENSITY_H).withColumn("sample", F.lit("full"))
    b = DEN.density_test(bunched, "x", 0.0, EST.DENSITY_BIN, EST.DENSITY_H).withColumn("sample", F.lit("bunched"))
    return rounded(a.unionByName(b))



# ---------------------------------------------------------------- the main analysis, end to end (lifecycle L1)

def study_table(spark, d):
    """One row per unit: normalised score, treatment, persistence outcome and group.

    units (orders) ⟕ collapsed spells (line items) on (unit, cohort); group = the
    customer's nation; cutoffs inferred per cohort for both treatments; sample
    restricted to units below the other treatment's cutoff.
    """
    from panelrd.functions import persistence

    s = roles.score(spark, d)
    st = _students(spark, d).select(F.col("id").alias("sid"), F.col("cohort").alias("entry"), "years")
    st = st.select("*", *persistence(F.col("years"), [2], prefix="persist_"))
    u = P.join_on(s, st, [("id", "sid"), ("cohort", "entry")], how="left")
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = _t(spark, d, "nation").select("n_nationkey", "n_name")
    u = u.join(c, u.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    cuts = C.cutoff_table(s, "score", "cohort", TREATMENTS)  # the joins keep every unit, so its cutoffs are those of `s`
    u = C.normalise(u, cuts, "score", "cohort", TREATMENTS)
    return u.filter(F.col("x_treat_a") < 0).select("id", "cohort", "x_treat_b", "treat_b", "persist_1", "n_name")


def q_study_main(spark, d):
    """Fuzzy RD of persistence on the normalised score, treatment take-up as the
    endogenous variable, group controls, per-side MSE bandwidths, NN variance."""
    from panelrd.operators.rd import rd

    t = study_table(spark, d)
    return rounded(rd(t, "x_treat_b", "persist_1", c=0.0, treat="treat_b", group="n_name", bwselect="msetwo",
                      name="persistence_2y"), EST.AUTO_DIGITS)
