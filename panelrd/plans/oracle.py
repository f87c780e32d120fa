"""DuckDB oracle SQL for the query catalogue (same arithmetic as `catalog.py`).

Tables are the pre-registered views of the driver.  Every real output is
rounded to 6 places, as on the Spark side.
"""

from __future__ import annotations

SCORE = """score AS (
  SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS cohort, o_totalprice / 4000 AS score,
         CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS treat_a,
         CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END AS treat_b,
         o_custkey, o_orderpriority
  FROM orders)"""

CUTS = """cuts AS (
  SELECT cohort,
         min(CASE WHEN treat_a = 1 AND score > 90.0 THEN score END) AS cutoff_treat_a,
         min(CASE WHEN treat_b = 1 AND score > 80.0 THEN score END) AS cutoff_treat_b
  FROM score GROUP BY cohort),
norm AS (
  SELECT s.*, c.cutoff_treat_a, c.cutoff_treat_b,
         s.score - c.cutoff_treat_a AS x_treat_a, s.score - c.cutoff_treat_b AS x_treat_b,
         CASE WHEN s.score - c.cutoff_treat_a > 0 THEN 1.0 ELSE 0.0 END AS above_treat_a,
         CASE WHEN s.score - c.cutoff_treat_b > 0 THEN 1.0 ELSE 0.0 END AS above_treat_b
  FROM score s LEFT JOIN cuts c USING (cohort))"""

SPELLS = """spells AS (
  SELECT l_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS cohort, l_linenumber AS line, l_partkey AS part,
         l_returnflag AS closure,
         CASE WHEN l_linenumber = 7 THEN NULL
              ELSE CAST(year(l_shipdate) AS VARCHAR) || '/' || CASE WHEN month(l_shipdate) <= 6 THEN '1' ELSE '2' END END AS end_term,
         l_quantity / 10 AS dur, l_extendedprice AS price, l_shipdate AS shipdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

RD = """rd AS (
  SELECT id, cohort, x, t, e, grp, 0.3 + 0.01 * x + 0.2 * t + 0.1 * e AS y
  FROM (SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS cohort, o_totalprice / 4000 - 95 AS x,
               CASE WHEN (o_totalprice / 4000 - 95 >= 0 AND o_orderkey % 10 < 8)
                      OR (o_totalprice / 4000 - 95 < 0 AND o_orderkey % 10 < 1) THEN 1.0 ELSE 0.0 END AS t,
               ((o_orderkey * 7919) % 1000) / 1000 - 0.5 AS e, o_orderpriority AS grp
        FROM orders))"""


def _r(x: str, d: int = 6) -> str:
    return f"round({x}, {d})"


SQL: dict[str, str] = {}

SQL["export_round_trip"] = "SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS cohort, o_orderpriority AS type, round(o_totalprice, 6) AS price FROM orders"

SQL["select_rename"] = "SELECT o_orderkey AS id, o_custkey AS customer, round(o_totalprice, 6) AS price, o_orderstatus AS status FROM orders"

SQL["flags"] = """
SELECT o_orderkey AS id,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END AS urgent,
       CASE WHEN o_orderstatus = 'F' THEN 1.0 WHEN o_orderstatus = 'O' THEN 0.0 END AS finished_known,
       CASE WHEN coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END IN ('1-URGENT', '2-HIGH'), false)
              OR coalesce(o_orderstatus IN ('F'), false) THEN 1.0 ELSE 0.0 END AS high_or_done
FROM orders"""

SQL["recode_set"] = """
SELECT * , CASE WHEN label = 'closed' THEN 1.0 ELSE 0.0 END AS is_closed FROM (
  SELECT l_orderkey, l_linenumber, l_partkey,
         CASE WHEN cl IN ('R') THEN 1 WHEN cl IN ('N') THEN 2 WHEN cl IN ('A') OR cl IS NULL THEN 0 END AS cls,
         CASE WHEN l_linestatus = 'F' THEN 'closed' WHEN l_linestatus = 'O' THEN 'open' END AS label
  FROM (SELECT *, CASE WHEN l_linenumber <> 1 THEN l_returnflag END AS cl FROM lineitem))
WHERE cls <> 2"""

SQL["bracket_midpoint"] = """
SELECT p_partkey, p_name,
  CASE WHEN contains(p_name, 'small r') THEN 5.0 WHEN contains(p_name, 'small') THEN 10.0
       WHEN contains(p_name, 'red') THEN 20.0 WHEN contains(p_name, 'ring') THEN 25.0
       WHEN contains(p_name, 'o$ld') THEN 40.0 WHEN contains(p_name, 'old') THEN 30.0 END AS mid_literal,
  CASE WHEN regexp_matches(p_name, 'small r') THEN 5.0 WHEN regexp_matches(p_name, 'sm.ll') THEN 10.0
       WHEN regexp_matches(p_name, 'red') THEN 20.0 WHEN regexp_matches(p_name, 'ring$') THEN 25.0
       WHEN regexp_matches(p_name, 'o$ld') THEN 40.0 WHEN regexp_matches(p_name, '^old') THEN 30.0 END AS mid_regex
FROM part"""

SQL["word_number"] = """
SELECT o_orderkey AS id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 5.0 WHEN '2-HIGH' THEN 4.0 WHEN '3-MEDIUM' THEN 3.0 WHEN '5-LOW' THEN 1.0 END AS priority_num
FROM orders"""

SQL["backfill"] = """
SELECT id, urgent, CASE WHEN urgent IS NULL AND big THEN 1.0 ELSE urgent END AS urgent_filled FROM (
  SELECT o_orderkey AS id,
         CASE WHEN o_orderstatus <> 'O' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END END AS urgent,
         o_totalprice > 200000 AS big
  FROM orders)"""

SQL["refine_category"] = """
SELECT c_custkey, CASE WHEN coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY'), false) THEN c_mktsegment || '/' || n_name ELSE c_mktsegment END AS category
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""

SQL["regex_exclude"] = """
SELECT p_partkey, name FROM (SELECT p_partkey, CASE WHEN p_size <> 1 THEN p_name END AS name FROM part)
WHERE NOT regexp_matches(name, '^(red|blue) ')"""

SQL["complete_cases"] = """
SELECT * FROM (
  SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS status,
         CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority, round(o_totalprice, 6) AS o_totalprice
  FROM orders)
WHERE status IS NOT NULL AND priority IS NOT NULL"""

SQL["freq_with_null"] = """
SELECT priority, count(*) AS n FROM (SELECT CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderpriority END AS priority FROM orders)
GROUP BY priority"""

_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_TEXT = f"' ' || CAST({_CENTS} // 100 AS VARCHAR) || ',' || lpad(CAST({_CENTS} % 100 AS VARCHAR), 2, '0')"
SQL["parse_locale_number"] = f"""
SELECT id, text, round(TRY_CAST(replace(regexp_replace(text, '\\s', '', 'g'), ',', '.') AS DOUBLE), 6) AS value FROM (
  SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN {_TEXT} || 'x' ELSE {_TEXT} END AS text FROM orders)"""

SQL["deflate"] = """
WITH f(year, factor) AS (VALUES (1995, 1.35), (1996, 1.3), (1997, 1.24), (1998, 1.19), (1999, 1.12), (2000, 1.06)),
x AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem)
SELECT l_orderkey, l_linenumber, x.year,
       round(l_extendedprice * CAST(factor AS DOUBLE), 6) AS real,
       round(CASE WHEN l_quantity - 1 = 0 THEN NULL ELSE l_extendedprice * CAST(factor AS DOUBLE) / (l_quantity - 1) END, 6) AS real_per_unit
FROM x LEFT JOIN f ON x.year = f.year"""

SQL["same_period_filter"] = """
SELECT l_orderkey, l_linenumber, CAST(year(o_orderdate) AS INTEGER) AS cohort
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE substring(CAST(l_shipdate AS VARCHAR), 1, 4) = CAST(year(o_orderdate) AS VARCHAR) AND year(l_shipdate) = year(o_orderdate)"""

SQL["distinct_rows"] = "SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem"

SQL["header_promote"] = "SELECT CAST(r_regionkey AS VARCHAR) AS region_key, r_name AS region_name FROM region"

SQL["cutoff_infer"] = f"""
WITH {SCORE}
SELECT cohort, treatment, floor, round(cutoff, 6) AS cutoff, n_treated_above FROM (
  SELECT cohort, 'treat_a' AS treatment, 90.0::DOUBLE AS floor, min(CASE WHEN treat_a = 1 AND score > 90.0 THEN score END) AS cutoff,
         CAST(count(CASE WHEN treat_a = 1 AND score > 90.0 THEN 1 END) AS BIGINT) AS n_treated_above FROM score GROUP BY cohort
  UNION ALL
  SELECT cohort, 'treat_b', 80.0::DOUBLE, min(CASE WHEN treat_b = 1 AND score > 80.0 THEN score END),
         CAST(count(CASE WHEN treat_b = 1 AND score > 80.0 THEN 1 END) AS BIGINT) FROM score GROUP BY cohort)"""

SQL["cutoff_normalise"] = f"""
WITH {SCORE}, {CUTS}
SELECT id, cohort, round(score, 6) AS score, round(x_treat_a, 6) AS x_treat_a, round(x_treat_b, 6) AS x_treat_b, above_treat_b, treat_b
FROM norm WHERE x_treat_a < 0"""

SQL["bin_means"] = f"""
WITH {SCORE}, {CUTS},
b AS (SELECT cohort, CAST(least(floor((x_treat_b - -30.0) / 10.0), 5) AS INTEGER) AS bin, treat_b * 100 AS y
      FROM norm WHERE x_treat_a < 0 AND x_treat_b >= -30.0 AND x_treat_b <= 30.0)
SELECT cohort, bin, round(CAST(-30.0 AS DOUBLE) + bin * CAST(10.0 AS DOUBLE), 6) AS bin_lo, round(CAST(-30.0 AS DOUBLE) + (bin + 0.5) * CAST(10.0 AS DOUBLE), 6) AS bin_mid,
       count(*) AS n, round(avg(y), 6) AS mean_y, round(stddev_samp(y) / sqrt(count(*)), 6) AS se_y
FROM b GROUP BY cohort, bin"""


def _rewrite_rounds(sql: str) -> str:
    """`round(X, d)` → decimal-then-round, matching Spark's HALF_UP rounding of
    the shortest decimal form of a double (DuckDB would round the binary value)."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + len(key):k - 1]
        depth, cut = 0, -1
        for m, ch in enumerate(inner):
            depth += {"(": 1, ")": -1}.get(ch, 0)
            if ch == "," and depth == 0:
                cut = m
        out.append(sql[i:j])
        if cut < 0:
            out.append(f"round({_rewrite_rounds(inner)})")
        else:
            arg, digits = _rewrite_rounds(inner[:cut]), inner[cut + 1:].strip()
            out.append(f"CAST(round(CAST({arg} AS DECIMAL(38,9)), {digits}) AS DOUBLE)")
        i = k


def _doubles(sql: str) -> str:
    """Decimal literals in CASE arms → DOUBLE (Spark's literal type)."""
    import re

    return re.sub(r"\b(THEN|ELSE)\s+(-?\d+\.\d+)\b(?!::)", r"\1 \2::DOUBLE", sql)


SPELLROWS = """sr AS (
  SELECT *, CASE WHEN cls = 1 THEN 1.0 ELSE 0.0 END AS dropf, CASE WHEN closure = 'A' THEN 1.0 ELSE 0.0 END AS done
  FROM (SELECT *, CASE WHEN closure IN ('R') THEN 1 WHEN closure IN ('N') THEN 2
                       WHEN closure IN ('A') OR closure IS NULL THEN 0 END AS cls FROM spells)
  WHERE cls <> 2)"""


def _collapse(dur: str) -> str:
    strict_sum = "(CASE WHEN count(done) = count(*) THEN sum(done) END)"
    return f"""SELECT id, cohort,
    CASE WHEN count(dropf) = count(*) AND min(dropf) = 1 THEN 1.0 ELSE 0.0 END AS dropped,
    CASE WHEN count(done) = count(*) AND max(done) = 1 THEN 1.0 ELSE 0.0 END AS finished,
    CASE WHEN {strict_sum} >= 1 THEN (CASE WHEN count({dur} * done) = count(*) THEN max({dur} * done) END)
         WHEN {strict_sum} = 0 THEN (CASE WHEN count({dur}) = count(*) THEN max({dur}) END) END AS years,
    count(*) AS n_spells
  FROM sr GROUP BY id, cohort"""


STUDENTS = f"st AS ({_collapse('dur')})"

MAJORS = """maj AS (
  SELECT s.*, n_name, score * 4000 AS price FROM score s
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""

PAYMENTS = """pay AS (
  SELECT l_suppkey AS id, CAST(year(l_shipdate) AS INTEGER) AS pay_year,
         CASE WHEN month(l_shipdate) <> 2 THEN CAST(month(l_shipdate) AS INTEGER) END AS pay_month,
         l_returnflag AS type, l_extendedprice AS amount FROM lineitem),
roll AS (
  SELECT pay_year, id, type, coalesce(sum(amount), 0.0) AS total,
         count(DISTINCT pay_month) + max(CASE WHEN pay_month IS NULL THEN 1 ELSE 0 END) AS parcels,
         coalesce(CASE WHEN count(pay_month) = count(*) THEN CAST(min(pay_month) AS VARCHAR) END, 'NA') || '-' ||
         coalesce(CASE WHEN count(pay_month) = count(*) THEN CAST(max(pay_month) AS VARCHAR) END, 'NA') AS span
  FROM pay GROUP BY pay_year, id, type)"""

_PRI = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
ONEHOT = ", ".join(f"""CAST(coalesce(max(CASE WHEN o_orderpriority = '{v}' THEN 1 END), 0) AS INTEGER) AS "{v}\"""" for v in _PRI)

SQL["spell_flags"] = f"""
WITH {SPELLS}, {SPELLROWS},
g AS (SELECT id, cohort,
        CASE WHEN count(dropf) = count(*) AND min(dropf) = 1 THEN 1.0 ELSE 0.0 END AS dropped,
        CASE WHEN count(done) = count(*) AND max(done) = 1 THEN 1.0 ELSE 0.0 END AS finished
      FROM sr GROUP BY id, cohort)
SELECT id, cohort, line, part, dropf AS "drop", done, dropped, finished FROM sr JOIN g USING (id, cohort)"""

SQL["spell_duration"] = f"""
WITH {SPELLS}, sr0 AS (SELECT * FROM ({SPELLROWS.replace("sr AS (", "(", 1)})),
sr AS (SELECT *, CASE WHEN end_term IS NULL THEN 2002.5::DOUBLE
                      ELSE TRY_CAST(substring(end_term, 1, 4) AS DOUBLE) + TRY_CAST(substring(end_term, 6, 1) AS DOUBLE) * 0.5 END
                 - CAST(cohort AS DOUBLE) AS years_code FROM sr0)
SELECT id, cohort, dropped, finished, round(years, 6) AS years, n_spells FROM ({_collapse('years_code')})"""

SQL["first_per_key"] = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice,
       round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax, l_returnflag, l_linestatus, l_shipdate
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                                   l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem)
WHERE rn = 1"""

SQL["persistence_ladder"] = f"""
WITH {SPELLS}, {SPELLROWS}, {STUDENTS}
SELECT id, cohort, round(years, 6) AS years,
       CASE WHEN years > 1 THEN 1.0 ELSE 0.0 END AS persist_1, CASE WHEN years > 2 THEN 1.0 ELSE 0.0 END AS persist_2,
       CASE WHEN years > 3 THEN 1.0 ELSE 0.0 END AS persist_3, CASE WHEN years > 4 THEN 1.0 ELSE 0.0 END AS persist_4
FROM st"""

SQL["pivot_awards"] = f"""
SELECT o_custkey AS id, CAST(year(o_orderdate) AS INTEGER) AS cohort, {ONEHOT} FROM orders GROUP BY 1, 2"""

SQL["payment_rollup"] = f"""
WITH {PAYMENTS}
SELECT pay_year, id, type, round(total, 6) AS total, parcels, span FROM roll"""

SQL["pivot_text"] = f"""
WITH {PAYMENTS}
SELECT pay_year, id, min(CASE WHEN type = 'A' THEN span END) AS "A", min(CASE WHEN type = 'N' THEN span END) AS "N",
       min(CASE WHEN type = 'R' THEN span END) AS "R"
FROM roll GROUP BY pay_year, id"""

SQL["join_right_two_key"] = f"""
WITH aw AS (SELECT o_custkey AS id, CAST(year(o_orderdate) AS INTEGER) AS cohort, {ONEHOT} FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
sc AS (SELECT o_custkey AS cust, CAST(year(o_orderdate) AS INTEGER) AS yr, count(*) AS n_orders, sum(o_totalprice) AS price_sum
       FROM orders GROUP BY 1, 2)
SELECT sc.cust AS id, sc.yr AS cohort, {", ".join(f'aw."{v}"' for v in _PRI)}, n_orders, round(price_sum, 6) AS price_sum
FROM aw RIGHT JOIN sc ON aw.id IS NOT DISTINCT FROM sc.cust AND aw.cohort IS NOT DISTINCT FROM sc.yr"""

SQL["join_left_two_key"] = f"""
WITH {SCORE}, {SPELLS}, {SPELLROWS}, {STUDENTS}
SELECT s.id, s.cohort, round(s.score, 6) AS score, st.dropped, st.finished, round(st.years, 6) AS years
FROM score s LEFT JOIN st ON s.id IS NOT DISTINCT FROM st.id AND s.cohort IS NOT DISTINCT FROM st.cohort"""

SQL["join_agg_fill"] = f"""
WITH {SCORE}, {MAJORS},
stu AS (SELECT n_name, count(*) AS students, CASE WHEN count(treat_a) = count(*) THEN avg(treat_a) END * 100.0 AS porc_a FROM maj GROUP BY n_name),
app AS (SELECT n_name, count(*) AS applicants, sum(treat_a) AS stipends FROM maj
        WHERE treat_a = 1 AND o_orderpriority = '1-URGENT' AND score > 112.5 GROUP BY n_name)
SELECT stu.n_name, students, round(porc_a, 6) AS porc_a, coalesce(applicants, 0) AS applicants,
       round(coalesce(stipends, 0.0), 6) AS stipends,
       round(CASE WHEN coalesce(applicants, 0) = 0 THEN 0.0 ELSE 100 * coalesce(applicants, 0) / students END, 6) AS porc_apply,
       round(CASE WHEN coalesce(stipends, 0.0) = 0 THEN 0.0 ELSE 100 * coalesce(stipends, 0.0) / students END, 6) AS porc_stipend
FROM stu LEFT JOIN app USING (n_name)"""

SQL["group_shares"] = f"""
WITH {SCORE}, {MAJORS}
SELECT cohort, n_name, count(*) AS n, round(CASE WHEN count(treat_a) = count(*) THEN avg(treat_a) END * 100.0, 6) AS pct_a,
       round(coalesce(sum(treat_b), 0.0), 6) AS n_b, round(avg(score), 6) AS mean_score, round(avg(score) * 1.1648, 6) AS scaled_score
FROM maj GROUP BY cohort, n_name"""

SQL["table_means"] = f"""
WITH {SCORE}
SELECT round(CASE WHEN count(treat_a) = count(*) THEN avg(treat_a) END * 100.0, 6) AS pct_a,
       round(CASE WHEN count(treat_b) = count(*) THEN avg(treat_b) END * 100.0, 6) AS pct_b,
       round(CASE WHEN count(score) = count(*) THEN avg(score) END, 6) AS mean_score
FROM score"""

SQL["describe_by_group"] = f"""
WITH {SCORE}, {CUTS},
n2 AS (SELECT CASE WHEN above_treat_b = 1 THEN 'Eligible' ELSE 'Not Eligible' END AS cut, score, treat_a * 100 AS pct_a, treat_b * 100 AS pct_b FROM norm)
SELECT cut, 'score' AS variable, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, count(score) AS n FROM n2 GROUP BY cut
UNION ALL SELECT cut, 'pct_a', round(avg(pct_a), 6), round(stddev_samp(pct_a), 6), count(pct_a) FROM n2 GROUP BY cut
UNION ALL SELECT cut, 'pct_b', round(avg(pct_b), 6), round(stddev_samp(pct_b), 6), count(pct_b) FROM n2 GROUP BY cut"""

SQL["cohort_series"] = f"""
WITH {SCORE}
SELECT cohort, count(*) AS n, round(CASE WHEN count(treat_b) = count(*) THEN avg(treat_b) END * 100.0, 6) AS pct_b,
       round(avg(score), 6) AS mean_score
FROM score GROUP BY cohort"""

SQL["panel_change"] = f"""
WITH {SCORE}, {MAJORS},
pc AS (SELECT n_name, count(CASE WHEN cohort = 1995 THEN 1 END) AS students, count(CASE WHEN cohort = 1999 THEN 1 END) AS n1,
              avg(CASE WHEN cohort = 1995 THEN score END) AS mean_score,
              avg(CASE WHEN cohort = 1995 THEN price END) AS price_1995, avg(CASE WHEN cohort = 1999 THEN price END) AS price_1999,
              avg(CASE WHEN cohort = 1995 THEN pct_a END) AS pct_a_1995, avg(CASE WHEN cohort = 1999 THEN pct_a END) AS pct_a_1999
       FROM (SELECT *, treat_a * 100 AS pct_a FROM maj) WHERE cohort IN (1995, 1999) GROUP BY n_name)
SELECT n_name, students, round(mean_score, 6) AS mean_score, round(price_1995, 6) AS price_1995, round(price_1999, 6) AS price_1999,
       round(pct_a_1995, 6) AS pct_a_1995, round(pct_a_1999, 6) AS pct_a_1999,
       round(price_1999 - price_1995, 6) AS diff_price, round(pct_a_1999 - pct_a_1995, 6) AS diff_pct_a,
       round((pow(CASE WHEN price_1995 = 0 THEN NULL ELSE price_1999 / price_1995 END, 0.25) - 1) * 100.0, 6) AS rate_price
FROM pc
WHERE students > 0 AND n1 > 0 AND mean_score IS NOT NULL AND price_1995 IS NOT NULL AND price_1999 IS NOT NULL
  AND pct_a_1995 IS NOT NULL AND pct_a_1999 IS NOT NULL"""

SQL["bubble_table"] = f"""
WITH {SCORE}, {MAJORS},
g AS (SELECT n_name, count(*) AS n, avg(score) AS x_mean, avg(treat_a * 100) AS y_mean FROM maj GROUP BY n_name),
c AS (SELECT regr_slope(y_mean, x_mean) AS b, regr_intercept(y_mean, x_mean) AS a FROM g)
SELECT n_name, n, round(x_mean, 6) AS x_mean, round(y_mean, 6) AS y_mean, round(a + b * x_mean, 6) AS y_fit FROM g, c"""


from panelrd.plans import estimates as _EST, oracle_auto as _auto, oracle_density as _density  # noqa: E402
from panelrd.plans.oracle_estimators import all_sql as _est_sql  # noqa: E402

SQL.update(_est_sql(RD))

_ROWS = RD + ", b0 AS MATERIALIZED (SELECT 0 AS o, x, y, t, '' AS g FROM rd{more})"
_GROUPED = RD + ", b0 AS MATERIALIZED (SELECT 0 AS o, x, y, t, grp AS g FROM rd{more})"
_STUDY = f"""{SCORE}, {CUTS}, {SPELLS}, {SPELLROWS}, {STUDENTS},
b0 AS MATERIALIZED (SELECT * FROM (
  SELECT 0 AS o, n.x_treat_b AS x, CASE WHEN st.id IS NULL THEN NULL WHEN st.years > 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, n.treat_b AS t, nation.n_name AS g
  FROM norm n LEFT JOIN st ON st.id = n.id AND st.cohort = n.cohort LEFT JOIN customer ON n.o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  WHERE n.x_treat_a < 0) WHERE x IS NOT NULL AND y IS NOT NULL AND t IS NOT NULL AND g IS NOT NULL)"""
SQL["rd_bandwidth"] = _auto.bandwidth_sql(_ROWS.format(more=""), [(0, 0.0, True)], ["msetwo", "certwo"], _EST.AUTO_DIGITS)
SQL["rd_fuzzy_auto"] = _auto.estimates_sql(_ROWS.format(more=""), ["y"], _EST.MAIN_SPECS, _EST.AUTO_DIGITS)
SQL["rd_sharp_auto"] = _auto.estimates_sql(_ROWS.format(more=" UNION ALL SELECT 1, x, e, t, '' FROM rd"), ["y", "e"], _EST.SHARP_AUTO_SPECS, _EST.AUTO_DIGITS)
SQL["rd_mass_points"] = _auto.estimates_sql(RD + ", b0 AS MATERIALIZED (SELECT 0 AS o, floor(x * 2) / 2 AS x, y, t, '' AS g FROM rd)", ["y"], _EST.MASS_SPECS, _EST.AUTO_DIGITS, mass=True)
SQL["rd_fuzzy_groups"] = _auto.estimates_sql(_GROUPED.format(more=""), ["y"], [s.filled() for s in _EST.FUZZY_SPECS], 6, fixed=True)
SQL["rd_robustness_grid"] = _auto.estimates_sql(_GROUPED.format(more=" UNION ALL SELECT 1, x, e, t, grp FROM rd"), ["y", "e"], _EST.ROBUST_SPECS, _EST.AUTO_DIGITS)
_BUNCHED = "(SELECT * FROM rd WHERE NOT (x >= -3 AND x < 0 AND grp IN ('1-URGENT', '2-HIGH')))"
SQL["density_lp_auto"] = f"WITH {RD} SELECT * FROM " + " UNION ALL SELECT * FROM ".join(_density.auto_sql(src, label, _EST.DENSITY_LP_P, _EST.DENSITY_DIGITS) for src, label in (("rd", "full"), (_BUNCHED, "bunched")))
SQL["density_lp_curve"] = _density.curve_sql(RD, _EST.DENSITY_LP_P, _EST.CURVE_POINTS, _EST.CURVE_REACH, _EST.DENSITY_DIGITS)
SQL["study_main"] = _auto.estimates_sql(_STUDY, ["persist_1"], _EST.STUDY_SPECS, _EST.AUTO_DIGITS)

_HW = repr((_EST.HIST_HI - _EST.HIST_LO) / _EST.HIST_BINS)
SQL["histogram"] = f"""
WITH {SCORE}, {CUTS},
v AS (SELECT x_treat_b + 95.0 AS v FROM norm WHERE x_treat_b + 95.0 >= 0.0 AND x_treat_b + 95.0 <= 130.0),
b AS (SELECT CAST(least(floor((v - 0.0) / CAST('{_HW}' AS DOUBLE)), 29) AS INTEGER) AS bin FROM v)
SELECT CAST(g.bin AS INTEGER) AS bin, count(b.bin) AS n, round(0.0 + g.bin * CAST('{_HW}' AS DOUBLE), 6) AS bin_lo, round(0.0 + (g.bin + 1) * CAST('{_HW}' AS DOUBLE), 6) AS bin_hi
FROM range(0, 30) g(bin) LEFT JOIN b ON b.bin = g.bin GROUP BY g.bin"""

SQL["bin_bands"] = f"""
WITH {SCORE}, {CUTS},
w AS (SELECT CASE WHEN x_treat_b >= 0 THEN 1 ELSE 0 END AS side, x_treat_b AS x, treat_b * 100 AS y FROM norm
      WHERE x_treat_a < 0 AND x_treat_b >= -30 AND x_treat_b < 30),
mn AS (SELECT side, min(x) AS mn FROM w GROUP BY side),
k AS (SELECT w.side, y, greatest(CAST(ceil((x - 0.0) / 10.0) - 1 AS BIGINT), CAST(floor((mn - 0.0) / 10.0) AS BIGINT)) AS bin
      FROM w JOIN mn USING (side)),
g AS (SELECT side, bin, count(*) AS n, avg(y) AS mean, stddev_samp(y) / sqrt(count(*)) AS se FROM k GROUP BY side, bin)
SELECT side, bin, n, round(mean, 6) AS mean, round(CAST(0.0 AS DOUBLE) + bin * CAST(10.0 AS DOUBLE), 6) AS bin_lo,
       round(CAST(0.0 AS DOUBLE) + (bin + 1) * CAST(10.0 AS DOUBLE), 6) AS bin_hi, round(CAST(0.0 AS DOUBLE) + (bin + 0.5) * CAST(10.0 AS DOUBLE), 6) AS bin_mid,
       round(se, 6) AS se, round(mean + 1.96 * se, 6) AS upper, round(mean - 1.96 * se, 6) AS lower
FROM g"""

def _rdplot(spaced: str) -> str:
    V = "n / 4.0 * es / ((hi_e - lo_e) * (hi_e - lo_e))" if spaced == "even" else "qs / (2 * gaps)"
    bin_ = ("least(greatest(floor((v.x - j.lo_e) / ((j.hi_e - j.lo_e) / j.J)), 0), j.J - 1)" if spaced == "even" else "floor((v.cum - v.d) * j.J / CAST(j.n AS DOUBLE))")
    return f"""
WITH {RD},
r0 AS (SELECT x, y, CASE WHEN x >= 0.0 THEN 1 ELSE 0 END AS side FROM rd WHERE x IS NOT NULL AND y IS NOT NULL),
v AS MATERIALIZED (SELECT side, x, count(*) AS d, sum(y) AS s, sum(count(*)) OVER (PARTITION BY side ORDER BY x) AS cum FROM r0 GROUP BY side, x),
g AS (SELECT side, x - lag(x) OVER w AS dx, 2 * pow(s / d - lag(s / d) OVER w, 2) / (1.0 / d + 1.0 / lag(d) OVER w) AS dy2 FROM v WINDOW w AS (PARTITION BY side ORDER BY x)),
gs AS (SELECT side, sum(dx * dx * dy2) AS es, sum(dy2) AS qs, count(dx) AS gaps FROM g GROUP BY side),
m AS (SELECT side, count(*) AS n, min(x) AS lo, max(x) AS hi, var_samp(y) AS vy, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM r0 GROUP BY side),
l AS (SELECT m.*, gs.es, gs.qs, gs.gaps, CASE WHEN side = 0 THEN lo ELSE 0.0 END AS lo_e, CASE WHEN side = 0 THEN 0.0 ELSE hi END AS hi_e FROM m JOIN gs USING (side)),
j AS (SELECT *, CAST(greatest(1, ceil(vy / ({V}) * n / (ln(n) * ln(n)))) AS INTEGER) AS J FROM l),
jb AS (SELECT v.*, j.J, j.a, j.b, CAST({bin_} AS INTEGER) AS bin FROM v JOIN j USING (side))
SELECT side, bin, CAST(sum(d) AS BIGINT) AS n, max(J) AS J, round(sum(x * d) / sum(d), 6) AS x_mean, round(sum(s) / sum(d), 6) AS y_mean,
       round(max(a) + max(b) * (sum(x * d) / sum(d)), 6) AS y_fit FROM jb GROUP BY side, bin"""


SQL["rdplot_bins"], SQL["rdplot_bins_quantile"] = _rdplot("even"), _rdplot("quantile")


SQL = {k: _rewrite_rounds(_doubles(v)) for k, v in SQL.items()}
