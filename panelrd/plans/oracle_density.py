"""Oracle SQL of the local-polynomial density: selected bandwidths, jackknife test, curve (triangular kernel)."""

from __future__ import annotations

import math

from panelrd.operators.density_lp import LEAST_VALUES, fit_constants, reference
from panelrd.plans.oracle_auto import IDENTITY, _solve
from panelrd.plans.oracle_estimators import _dbl, pnorm2


def _fits(p: str, windows: str) -> str:
    """Fits of `windows` (fit, side, c, h, o, lo, hi): {p}r rows, {p}b solutions."""
    return f"""{p}r AS MATERIALIZED (SELECT w.fit, w.side, e.x, e.d, e.cum, e.Fc, (e.x - w.c) / w.h AS z, (1 - abs(e.x - w.c) / w.h) / w.h AS k
  FROM ec e JOIN {windows} w ON abs(e.x - w.c) <= w.h AND (e.x >= 0.0) = (w.side = 1)),
{p}s AS MATERIALIZED (SELECT fit, m, sum(d * k * pow(z, m)) AS s, sum(d * k * pow(z, m) * Fc) AS t FROM {p}r, range(0, 10) q(m) GROUP BY fit, m),
{p}m AS MATERIALIZED (SELECT w.fit, w.o + 1 AS n, i, j, s.s AS v FROM {windows} w, range(0, 5) a(i), range(0, 5) b(j), {p}s s WHERE i <= w.o AND j <= w.o AND s.fit = w.fit AND s.m = i + j
  UNION ALL SELECT w.fit, w.o + 1, m, w.o + 1, t FROM {windows} w JOIN {p}s s ON s.fit = w.fit AND s.m <= w.o
  UNION ALL SELECT w.fit, w.o + 1, i, w.o + 1 + {IDENTITY} + j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM {windows} w, range(0, 5) a(i), range(0, 5) b(j) WHERE i <= w.o AND j <= w.o),
{_solve(p + 'b', p + 'm')}"""


def _selected(src: str, p: int) -> str:
    """CTEs to `hh` (side, h): the median of the plug-ins."""
    v, o = p + 1, p + 2
    _, bias, spread = fit_constants(o, "triangular")
    _, bias_p, spread_p = fit_constants(p, "triangular")
    c0 = math.factorial(v) * bias[v] * reference(o) / math.factorial(o + 1)
    v0 = math.factorial(v) ** 2 * spread[v, v] * reference(0) ** 2
    near = lambda k: f"(SELECT max(g) FROM nr WHERE nr.side = s.side AND nr.r <= {k})"
    return f"""d0 AS MATERIALIZED (SELECT x FROM {src} WHERE x IS NOT NULL),
st AS MATERIALIZED (SELECT count(*) AS n, count(CASE WHEN x < 0.0 THEN 1 END) AS nleft, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi FROM d0),
ec AS MATERIALIZED (SELECT x, d, cum, (cum - nleft) / CAST(n AS DOUBLE) AS Fc FROM (SELECT x, count(*) AS d, sum(count(*)) OVER (ORDER BY x) AS cum FROM d0 GROUP BY x), st),
nr AS MATERIALIZED (SELECT CASE WHEN x >= 0.0 THEN 1 ELSE 0 END AS side, abs(x) AS g, row_number() OVER (PARTITION BY x >= 0.0 ORDER BY abs(x)) AS r FROM ec),
sides AS (SELECT side, CASE WHEN side = 1 THEN hi ELSE -lo END AS reach, st.* FROM st, range(0, 2) r(side)),
pl AS MATERIALIZED (SELECT side AS fit, side, 0.0::DOUBLE AS c, reach, n, sd, {o} AS o,
    least(greatest(pow({2 * v - 1} * {_dbl(v0)} / sd / (4 * n * pow({_dbl(c0)} / pow(sd, {o + 1}), 2)), 1.0 / {2 * v + 3}), {near(LEAST_VALUES + o + 1)}), reach) * (1 + 1e-9) AS h FROM sides s),
{_fits('pf_', 'pl')},
pd AS MATERIALIZED (SELECT w.side, w.reach, w.n, w.sd, CASE WHEN a.v > 0 THEN a.v / w.h ELSE {_dbl(reference(0) ** 2)} / w.sd END AS f,
    CASE WHEN w.side = 0 THEN {(-1) ** p} ELSE 1 END * {_dbl(bias_p[1])} * b.v / pow(w.h, {v}) AS bb
  FROM pl w JOIN pf_b a ON a.fit = w.fit AND a.i = 1 AND a.col = 0 JOIN pf_b b ON b.fit = w.fit AND b.i = {v} AND b.col = 0),
dd AS MATERIALIZED (SELECT l.f + r.f AS f, r.bb - l.bb AS df, r.bb + l.bb AS sm FROM pd l, pd r WHERE l.side = 0 AND r.side = 1),
cand AS (SELECT s.side, s.reach, pow({_dbl(spread_p[1, 1])} * s.f / ({2 * p} * s.n * s.bb * s.bb), 1.0 / {2 * p + 1}) AS a, pow({_dbl(spread_p[1, 1])} * dd.f / ({2 * p} * s.n * dd.df * dd.df), 1.0 / {2 * p + 1}) AS b,
    pow({_dbl(spread_p[1, 1])} * dd.f / ({2 * p} * s.n * dd.sm * dd.sm), 1.0 / {2 * p + 1}) AS c FROM pd s, dd),
hh AS MATERIALIZED (SELECT s.side, least(greatest(a + b + c - greatest(a, b, c) - least(a, b, c), {near(LEAST_VALUES + p + 1)}), reach) AS h FROM cand s)"""


def auto_sql(src: str, label: str, p: int, digits: int) -> str:
    r = lambda c: f"round({c}, {digits})"
    constant = " ".join(f"WHEN {o} THEN {_dbl(fit_constants(o, 'triangular')[2][1, 1])}" for o in (p, p + 1))
    return f"""(WITH RECURSIVE {_selected(src, p)},
fw AS MATERIALIZED (SELECT o * 10 + side AS fit, side, 0.0::DOUBLE AS c, h, o FROM hh, range({p}, {p + 2}) r(o)),
{_fits('f_', 'fw')},
ff AS MATERIALIZED (SELECT w.*, b.v / w.h AS f FROM fw w JOIN f_b b ON b.fit = w.fit AND b.i = 1 AND b.col = 0),
lw AS MATERIALIZED (SELECT r.fit, r.x, r.d, r.cum, r.k * (SELECT sum(b.v * pow(r.z, b.col - {IDENTITY})) FROM f_b b WHERE b.fit = r.fit AND b.i = 1 AND b.col >= {IDENTITY}) / w.h AS l,
    (SELECT nleft / CAST(n AS DOUBLE) FROM st) + (SELECT sum(b.v * pow(r.z, b.i)) FROM f_b b WHERE b.fit = r.fit AND b.col = 0) AS fit_ FROM f_r r JOIN fw w ON w.fit = r.fit WHERE r.k > 0),
lg AS (SELECT *, sum(d * l) OVER (PARTITION BY fit ORDER BY x DESC) AS g FROM lw),
ph AS (SELECT lg.*, l * ((cum - 1) - (st.n - 1) * fit_) + (g - l) - (f.f - l * fit_) AS phi FROM lg JOIN ff f ON f.fit = lg.fit, st),
sm AS MATERIALIZED (SELECT fit, sum(d) AS rows, sum(d * phi) AS a, sum(d * phi * phi) AS q FROM ph GROUP BY fit),
res AS MATERIALIZED (SELECT l.o, l.f AS fl, r.f AS fr, st.n, a.rows AS nl, b.rows AS nr, l.h AS hl, r.h AS hr,
    sqrt((a.q + (st.n - a.rows) * l.f * l.f + b.q + (st.n - b.rows) * r.f * r.f - 2 * (-l.f * b.a - r.f * a.a + (st.n - a.rows - b.rows) * l.f * r.f)) / (CAST(st.n - 1 AS DOUBLE) * (st.n - 1))) AS se,
    sqrt((l.f / (st.n * l.h) + r.f / (st.n * r.h)) * CASE l.o {constant} END) AS sp
  FROM ff l JOIN ff r ON l.o = r.o AND l.side = 0 AND r.side = 1 JOIN sm a ON a.fit = l.fit JOIN sm b ON b.fit = r.fit, st)
SELECT CASE WHEN o = {p} THEN 'conventional' ELSE 'robust' END AS method, {r('fl')} AS f_left, {r('fr')} AS f_right, {r('fr - fl')} AS difference, {r('se')} AS std_error, {r('sp')} AS std_error_plugin,
       {r('(fr - fl) / se')} AS statistic, {r(pnorm2('(fr - fl) / se'))} AS p_value, n, CAST(nl AS BIGINT) AS n_left_h, CAST(nr AS BIGINT) AS n_right_h, {r('hl')} AS h_left, {r('hr')} AS h_right, CAST(o AS INTEGER) AS p, '{label}' AS sample FROM res)"""


def curve_sql(base: str, p: int, points: int, reach: float, digits: int) -> str:
    r = lambda c: f"round({c}, {digits})"
    return f"""WITH RECURSIVE {base}, {_selected('rd', p)},
gw AS MATERIALIZED (SELECT side * 1000 + q AS fit, side, q, CASE WHEN side = 1 THEN 1 ELSE -1 END * q * ({_dbl(reach)} * h / {points - 1}) AS c, h, {p} AS o FROM hh, range(0, {points}) r(q)),
{_fits('g_', 'gw')},
nn AS (SELECT fit, sum(d) AS n FROM g_r WHERE k > 0 GROUP BY fit)
SELECT CASE WHEN side = 1 THEN 'right' ELSE 'left' END AS side, CAST(q AS INTEGER) AS point, {r('c')} AS x, CASE WHEN nn.n > {p + 1} AND w.c BETWEEN (SELECT lo FROM st) AND (SELECT hi FROM st) THEN {r('b.v / h')} END AS density, coalesce(CAST(nn.n AS BIGINT), 0) AS n_h
FROM gw w LEFT JOIN g_b b ON b.fit = w.fit AND b.i = 1 AND b.col = 0 LEFT JOIN nn ON nn.fit = w.fit"""
