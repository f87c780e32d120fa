"""Oracle SQL of the RD estimates with selected bandwidths, group controls and neighbour variance (p = 1, q = 2, triangular).

Linear systems of any size are solved in SQL: a matrix is a table (fit, i, j, v) with right-hand sides in further columns, and a
recursive query eliminates one pivot at a time.  `b0` (o, x, y, t, g) holds the complete rows of each outcome.
"""

from __future__ import annotations

from collections.abc import Sequence

from panelrd.plans.oracle_estimators import Z975, _dbl, pnorm2

#: Columns of right-hand sides: 0 the outcome, 1 the treatment, 2 and more the groups but the first, IDENTITY + i the unit vectors.
IDENTITY = 1000


def _solve(name: str, matrix: str) -> str:
    """`name` (fit, i, col, v): the solutions of `matrix` (fit, n, i, j, v), where j < n is the system and j − n a right-hand side."""
    return f"""{name}_el AS (SELECT fit, n, 0 AS k, i, j, v FROM {matrix}
  UNION ALL SELECT fit, n, k + 1, i, j, CASE WHEN i = k THEN v / pv ELSE v - ci * rj / pv END
  FROM (SELECT *, max(CASE WHEN i = k AND j = k THEN v END) OVER (PARTITION BY fit) AS pv, max(CASE WHEN i = k THEN v END) OVER (PARTITION BY fit, j) AS rj,
               max(CASE WHEN j = k THEN v END) OVER (PARTITION BY fit, i) AS ci FROM {name}_el) WHERE k < n),
{name} AS MATERIALIZED (SELECT fit, i, j - n AS col, v FROM {name}_el WHERE k = n AND j >= n)"""


def _fits(p: str, windows: str) -> str:
    """Fits of `windows` (fit, sel, side, c, h, scale, o): {p}row, {p}s, {p}d (moments), {p}b (solutions), {p}gm (sums by group)."""
    return f"""{p}row AS MATERIALIZED (SELECT w.fit, b.x, b.y, b.t, b.g, (b.x - w.c) / w.scale AS z, (1 - abs(b.x - w.c) / w.h) / w.h AS k
  FROM b0 b JOIN sel s ON s.o = b.o JOIN {windows} w ON w.sel = s.sel WHERE abs(b.x - w.c) <= w.h AND (b.x >= w.c) = (w.side = 1)),
{p}s AS MATERIALIZED (SELECT fit, m, sum(k * pow(z, m)) AS v FROM {p}row, range(0, 9) r(m) GROUP BY fit, m),
{p}d AS MATERIALIZED (SELECT fit, m, 0 AS col, sum(k * pow(z, m) * y) AS v FROM {p}row, range(0, 5) r(m) GROUP BY fit, m
  UNION ALL SELECT fit, m, 1, sum(k * pow(z, m) * t) FROM {p}row, range(0, 5) r(m) GROUP BY fit, m
  UNION ALL SELECT w.fit, r.m, gi.col, coalesce(q.v, 0) FROM {windows} w, range(0, 5) r(m), gi LEFT JOIN (SELECT fit, m, gi.col, sum(k * pow(z, m)) AS v
    FROM {p}row JOIN gi USING (g), range(0, 5) r(m) GROUP BY fit, m, gi.col) q ON q.fit = w.fit AND q.m = r.m AND q.col = gi.col),
{p}m AS MATERIALIZED (SELECT w.fit, w.o + 1 AS n, a.i, c.j, s.v FROM {windows} w, range(0, 5) a(i), range(0, 5) c(j), {p}s s
    WHERE a.i <= w.o AND c.j <= w.o AND s.fit = w.fit AND s.m = a.i + c.j
  UNION ALL SELECT w.fit, w.o + 1, d.m, w.o + 1 + d.col, d.v FROM {windows} w JOIN {p}d d ON d.fit = w.fit AND d.m <= w.o
  UNION ALL SELECT w.fit, w.o + 1, a.i, w.o + 1 + {IDENTITY} + c.j, CASE WHEN a.i = c.j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM {windows} w, range(0, 5) a(i), range(0, 5) c(j) WHERE a.i <= w.o AND c.j <= w.o),
{_solve(p + 'b', p + 'm')},
{p}zy AS MATERIALIZED (SELECT fit, gi.col, sum(k) AS d, sum(k * y) AS zy, sum(k * t) AS zt FROM {p}row JOIN gi USING (g) GROUP BY fit, gi.col),
{p}gm AS MATERIALIZED (SELECT a.fit, a.col AS gi, b.col AS gj, -sum(a.v * b.v) AS v FROM {p}d a JOIN {p}b b ON a.fit = b.fit AND a.m = b.i
    WHERE a.col >= 2 AND b.col < {IDENTITY} GROUP BY a.fit, a.col, b.col)"""


def _gammas(p: str, fits: str, key: str) -> str:
    """{p}gam (fit, col, gy, gt): group coefficients of the systems summed over the fits (fit, o) of `fits` with equal `key`."""
    return f"""{p}gn AS MATERIALIZED (SELECT f.{key} AS fit, z.col, row_number() OVER (PARTITION BY f.{key} ORDER BY z.col) - 1 AS r
  FROM {p}zy z JOIN {fits} f ON f.fit = z.fit GROUP BY f.{key}, z.col),
{p}gs AS MATERIALIZED (SELECT f.{key} AS fit, g.gi, g.gj, sum(g.v) AS v FROM (SELECT * FROM {p}gm UNION ALL SELECT fit, col, col, d FROM {p}zy
    UNION ALL SELECT fit, col, 0, zy FROM {p}zy UNION ALL SELECT fit, col, 1, zt FROM {p}zy) g JOIN {fits} f ON f.fit = g.fit GROUP BY f.{key}, g.gi, g.gj),
{p}gmat AS MATERIALIZED (SELECT s.fit, (SELECT count(*) FROM {p}gn q WHERE q.fit = s.fit) AS n, a.r AS i,
    CASE WHEN s.gj < 2 THEN (SELECT count(*) FROM {p}gn q WHERE q.fit = s.fit) + s.gj ELSE b.r END AS j, s.v
  FROM {p}gs s JOIN {p}gn a ON a.fit = s.fit AND a.col = s.gi LEFT JOIN {p}gn b ON b.fit = s.fit AND b.col = s.gj WHERE s.gj < 2 OR b.r IS NOT NULL),
{_solve(p + 'ge', p + 'gmat')},
{p}gam AS MATERIALIZED (SELECT n.fit, n.col, y.v AS gy, t.v AS gt FROM {p}gn n JOIN {p}ge y ON y.fit = n.fit AND y.i = n.r AND y.col = 0 JOIN {p}ge t ON t.fit = n.fit AND t.i = n.r AND t.col = 1)"""


def _neighbours(p: str, rows: str, sums: str, J: int = 3) -> str:
    """{p}mt: `sums` over the distinct values of `rows` (fit, x, v, z, k, kb) with E, the squared neighbour residuals."""
    lags = ", ".join(f"{f}({c}, {j}) OVER w AS {s}{c}{j}" for j in range(1, J + 1) for s, f in (("l", "lag"), ("r", "lead")) for c in ("x", "d", "S"))
    steps = [f"{p}s0 AS (SELECT *, d - 1 AS k_, 0.0::DOUBLE AS A, 0 AS li, 0 AS ri FROM {p}lg)"]
    for i in range(J):
        pick = lambda s, c: f"CASE {s}i " + " ".join(f"WHEN {j - 1} THEN {s}{c}{j}" for j in range(1, J + 1)) + " END"
        steps.append(f"""{p}t{i} AS (SELECT *, coalesce(k_ < least({J}, n - 1) AND nlx IS NOT NULL AND (nrx IS NULL OR x - nlx <= nrx - x), false) AS tl,
    coalesce(k_ < least({J}, n - 1) AND nrx IS NOT NULL AND (nlx IS NULL OR x - nlx >= nrx - x), false) AS tr
  FROM (SELECT *, {pick('l', 'x')} AS nlx, {pick('l', 'd')} AS nld, {pick('l', 'S')} AS nls, {pick('r', 'x')} AS nrx, {pick('r', 'd')} AS nrd, {pick('r', 'S')} AS nrs FROM {p}s{i})),
{p}s{i + 1} AS (SELECT * EXCLUDE (k_, A, li, ri, nlx, nld, nls, nrx, nrd, nrs, tl, tr), k_ + CASE WHEN tl THEN nld ELSE 0 END + CASE WHEN tr THEN nrd ELSE 0 END AS k_,
    A + CASE WHEN tl THEN nls ELSE 0.0 END + CASE WHEN tr THEN nrs ELSE 0.0 END AS A, li + CASE WHEN tl THEN 1 ELSE 0 END AS li, ri + CASE WHEN tr THEN 1 ELSE 0 END AS ri FROM {p}t{i})""")
    return f"""{p}dv AS MATERIALIZED (SELECT fit, x, count(*) AS d, sum(v) AS S, sum(v * v) AS Q, first(z) AS z, first(k) AS k, first(kb) AS kb FROM {rows} GROUP BY fit, x),
{p}nn AS MATERIALIZED (SELECT fit, sum(d) AS n FROM {p}dv GROUP BY fit),
{p}lg AS (SELECT a.*, c.n, {lags} FROM {p}dv a JOIN {p}nn c USING (fit) WINDOW w AS (PARTITION BY fit ORDER BY x)),
{', '.join(steps)},
{p}e AS MATERIALIZED (SELECT fit, z, k, kb, pow(sqrt(k_ / (k_ + 1.0)) * (1 + 1.0 / k_), 2) * Q - 2 * sqrt(k_ / (k_ + 1.0)) * (1 + 1.0 / k_) * (sqrt(k_ / (k_ + 1.0)) * (S + A) / k_) * S
    + d * pow(sqrt(k_ / (k_ + 1.0)) * (S + A) / k_, 2) AS E FROM {p}s{J}),
{p}mt AS MATERIALIZED (SELECT fit, m, {sums} FROM {p}e, range(0, 9) r(m) GROUP BY fit, m)"""


def _combined(p: str, s: str, fit: str = "s.fit") -> str:
    """{p}vr: rows of {p}row with v, the combination of outcome and treatment less the groups' shares, by the constants {s}s and {s}gam of `fit`."""
    return f"""{p}vr AS MATERIALIZED (SELECT r.fit, r.x, r.z, r.k, r.k AS kb, s.sy * (r.y - coalesce(m.gy, 0)) + s.st * (r.t - coalesce(m.gt, 0)) AS v
  FROM {p}row r JOIN {p}of q ON q.fit = r.fit JOIN {s}s s ON {fit} = q.base LEFT JOIN gi ON gi.g = r.g LEFT JOIN {s}gam m ON m.fit = s.fit AND m.col = gi.col)"""


def _variance(p: str, at: str) -> str:
    """Element (at, at) of the sandwich of each fit of {p}w, as {p}vv."""
    return f"""{p}vv AS MATERIALIZED (SELECT w.fit, sum(a.v * c.v * m.hh) AS v FROM {p}w w JOIN {p}b a ON a.fit = w.fit AND a.i = {at} AND a.col >= {IDENTITY}
  JOIN {p}b c ON c.fit = w.fit AND c.i = {at} AND c.col >= {IDENTITY} JOIN {p}mt m ON m.fit = w.fit AND m.m = (a.col - {IDENTITY}) + (c.col - {IDENTITY}) GROUP BY w.fit)"""


def _selection(mass: bool = False) -> str:
    """CTEs from `sel` (sel, o, c, fz) and `b0` to `bw` (sel, side, h, b, pilot, range, n)."""
    out = ["""smp AS MATERIALIZED (SELECT s.sel, count(*) AS n, stddev_samp(b.x) AS sd, quantile_cont(b.x, 0.25) AS q1, quantile_cont(b.x, 0.75) AS q3,
    abs(min(b.x) - any_value(s.c)) AS rl, abs(max(b.x) - any_value(s.c)) AS rr FROM sel s JOIN b0 b ON b.o = s.o GROUP BY s.sel),
mass AS MATERIALIZED (SELECT sel, max(share) AS share, sum(m) AS m, max(CASE WHEN side = 0 THEN fl END) AS fl, max(CASE WHEN side = 1 THEN fl END) AS fr
    FROM (SELECT sel, side, 1 - count(*) / CAST(sum(d) AS DOUBLE) AS share, count(*) AS m, max(CASE WHEN r <= 10 THEN g END) AS fl
      FROM (SELECT s.sel, CASE WHEN b.x >= s.c THEN 1 ELSE 0 END AS side, abs(b.x - any_value(s.c)) AS g, count(*) AS d, row_number() OVER (PARTITION BY s.sel, b.x >= any_value(s.c) ORDER BY abs(b.x - any_value(s.c))) AS r
        FROM sel s JOIN b0 b ON b.o = s.o GROUP BY s.sel, CASE WHEN b.x >= s.c THEN 1 ELSE 0 END, b.x) GROUP BY sel, side) GROUP BY sel),
pil AS MATERIALIZED (SELECT s.sel, s.c, s.fz, side, greatest(least(2.576 * CASE WHEN q3 > q1 THEN least(sd, (q3 - q1) / 1.349) ELSE sd END * pow(CASE WHEN {massed} THEN m ELSE n END, -0.2), greatest(rl, rr)),
      CASE WHEN {massed} THEN greatest(fl, fr) ELSE 0 END) AS pilot, CASE WHEN {massed} THEN CASE WHEN side = 1 THEN fr ELSE fl END ELSE 0 END AS floor_,
    CASE WHEN side = 1 THEN rr ELSE rl END AS rng, n FROM sel s JOIN smp USING (sel) JOIN mass USING (sel), range(0, 2) r(side))""".replace("{massed}", "share >= 0.2" if mass else "false"),
           "vv_w AS MATERIALIZED (SELECT sel * 100 + side * 10 + o AS fit, sel, side, c, pilot AS h, pilot AS scale, o, CASE o WHEN 3 THEN 3 WHEN 2 THEN 2 ELSE 0 END AS nu, fz FROM pil, range(1, 4) r(o))",
           _fits("vv_", "vv_w"), _gammas("vv_", "vv_w", "fit"),
           """vv_tt AS (SELECT w.fit, w.fz, CASE w.nu WHEN 3 THEN 6 WHEN 2 THEN 2 ELSE 1 END * y.v / pow(w.h, w.nu) AS ty, CASE w.nu WHEN 3 THEN 6 WHEN 2 THEN 2 ELSE 1 END * t.v / pow(w.h, w.nu) AS tt
  FROM vv_w w JOIN vv_b y ON y.fit = w.fit AND y.i = w.nu AND y.col = 0 JOIN vv_b t ON t.fit = w.fit AND t.i = w.nu AND t.col = 1),
vv_s_ AS MATERIALIZED (SELECT fit, CASE WHEN fz = 1 THEN 1 / tt ELSE 1.0 END AS sy, CASE WHEN fz = 1 THEN -ty / (tt * tt) ELSE 0.0 END AS st FROM vv_tt),
vv_of AS (SELECT fit, fit AS base FROM vv_w)""",
           _combined("vv_", "vv_").replace("JOIN vv_s s", "JOIN vv_s_ s"),
           _neighbours("vv_", "vv_vr", "sum(k * k * pow(z, m) * E) AS hh"), _variance("vv_", "w.nu"),
           f"""vv_bc AS MATERIALIZED (SELECT w.fit, sum(a.v * s.v) AS bc FROM vv_w w JOIN vv_b a ON a.fit = w.fit AND a.i = w.nu AND a.col >= {IDENTITY} JOIN vv_s s ON s.fit = w.fit AND s.m = (a.col - {IDENTITY}) + w.o + 1 GROUP BY w.fit),
vv_all AS MATERIALIZED (SELECT w.*, s.sy, s.st, c.bc, (2 * nu + 1) * pow(h, 2 * nu + 1) * v.v / pow(h, 2 * nu) AS V FROM vv_w w JOIN vv_s_ s USING (fit) JOIN vv_bc c USING (fit) JOIN vv_vv v USING (fit))"""]
    width, prev = "rng + 1e-8", None
    for p, o, order, regularised in (("dd_", 3, 4, False), ("bb_", 2, 3, True), ("hh_", 1, 2, True)):
        h = "p.rng + 1e-8" if prev is None else f"(SELECT q.bw FROM {prev}x q WHERE q.sel = p.sel AND q.side = p.side)"
        out.append(f"""{p}w AS MATERIALIZED (SELECT sel * 10 + side AS fit, sel, side, c, w.h, w.h AS scale, {order} AS o, base, rng, floor_ FROM (SELECT p.*, {h} AS h, p.sel * 100 + p.side * 10 + {o} AS base FROM pil p) w)""")
        out.append(_fits(p, f"{p}w"))
        out.append(f"""{p}co AS MATERIALIZED (SELECT w.fit, sum(CASE WHEN b.col = 0 THEN v.sy * b.v WHEN b.col = 1 THEN v.st * b.v ELSE -(v.sy * g.gy + v.st * g.gt) * b.v END) / pow(any_value(w.h), {o + 1}) AS v
  FROM {p}w w JOIN {p}b b ON b.fit = w.fit AND b.i = {o + 1} AND b.col < {IDENTITY} JOIN vv_all v ON v.fit = w.base LEFT JOIN vv_gam g ON g.fit = w.base AND g.col = b.col GROUP BY w.fit)""")
        if regularised:
            out.append(f"{p}of AS (SELECT fit, base FROM {p}w)")
            out.append(_combined(p, "vv_", "s.fit").replace("JOIN vv_s s", "JOIN vv_s_ s"))
            out.append(_neighbours(p, f"{p}vr", "sum(k * k * pow(z, m) * E) AS hh"))
            out.append(_variance(p, str(o + 1)))
            reg = f"2 * ({o + 1} - v.nu) * 3 * v.bc * v.bc * (SELECT q.v FROM {p}vv q WHERE q.fit = w.fit) / pow(w.h, {2 * (o + 1)})"
        else:
            reg = "0"
        out.append(f"""{p}x AS MATERIALIZED (SELECT w.sel, w.side, greatest(least(pow(v.V / (2 * ({o + 1} - v.nu) * v.bc * v.bc * c.v * c.v + {reg}), 1.0 / {2 * o + 3}), w.rng), w.floor_) AS bw
  FROM {p}w w JOIN vv_all v ON v.fit = w.base JOIN {p}co c ON c.fit = w.fit)""")
        prev = p
    out.append("bw AS MATERIALIZED (SELECT p.sel, p.side, h.bw AS h, b.bw AS b, p.pilot, p.n FROM pil p JOIN hh_x h USING (sel, side) JOIN bb_x b USING (sel, side))")
    return ",\n".join(out)


def _head(base: str, selections: Sequence[tuple]) -> str:
    rows = ", ".join(f"({i}, {o}, {_dbl(c)}, {int(fz)})" for i, (o, c, fz) in enumerate(selections))
    return f"""WITH RECURSIVE {base},
gi AS MATERIALIZED (SELECT g, col FROM (SELECT g, row_number() OVER (ORDER BY g) AS col FROM (SELECT DISTINCT g FROM b0)) WHERE col >= 2),
sel(sel, o, c, fz) AS (VALUES {rows}),
cnt AS MATERIALIZED (SELECT s.sel, count(CASE WHEN b.x < s.c THEN 1 END) AS n_left, count(CASE WHEN b.x >= s.c THEN 1 END) AS n_right FROM sel s JOIN b0 b ON b.o = s.o GROUP BY s.sel)"""


def bandwidth_sql(base: str, selections: Sequence[tuple], rules: Sequence[str], digits: int) -> str:
    rule = " UNION ALL ".join(f"SELECT '{r}' AS rule, {'pow(n, -1.0 / 20)' if r == 'certwo' else '1.0'} AS f, * FROM b2" for r in rules)
    r = lambda c: f"round({c}, {digits})"
    return f"""{_head(base, selections)},
{_selection()},
b2 AS (SELECT l.sel, l.h AS hl, r.h AS hr, l.b AS bl, r.b AS br, l.pilot, l.n FROM bw l JOIN bw r ON l.sel = r.sel AND l.side = 0 AND r.side = 1)
SELECT rule, {r('f * hl')} AS h_left, {r('f * hr')} AS h_right, {r('bl')} AS b_left, {r('br')} AS b_right, {r('pilot')} AS pilot, n_left, n_right
FROM ({rule}) JOIN cnt USING (sel)"""


def estimates_sql(base: str, outcomes: Sequence[str], specs: Sequence, digits: int, fixed: bool = False, mass: bool = False) -> str:
    """Rows of RESULT_SCHEMA for AutoSpecs, or for RDSpecs with `fixed`."""
    of = [(outcomes.index(s.outcome), float(s.c), bool(s.fuzzy)) for s in specs]
    selections = list(dict.fromkeys(of))
    if fixed:
        values = ", ".join(f"({i}, '{s.name}', '{s.outcome}', {selections.index(o)}, {_dbl(s.h_left)}, {_dbl(s.h_right)}, {_dbl(s.b_left)}, {_dbl(s.b_right)})" for i, (s, o) in enumerate(zip(specs, of)))
        chosen, given = "", f"spec(spec, name, outcome, sel, hl, hr, bl, br) AS (VALUES {values})"
    else:
        chosen = _selection(mass) + ",\n"
        rows = []
        for i, (s, o) in enumerate(zip(specs, of)):
            rule = "pow(l.n, -1.0 / 20)" if s.bwselect == "certwo" else "1.0"
            h = [f"{rule} * {side}.h" for side in "lr"]
            b = [f"{side}.b" for side in "lr"]
            if s.factor is not None:
                h = b = [f"{_dbl(s.factor)} * {v}" for v in (h if s.base == "h" else b)]
            rows.append(f"SELECT {i} AS spec, '{s.name}' AS name, '{s.outcome}' AS outcome, l.sel, {h[0]} AS hl, {h[1]} AS hr, {b[0]} AS bl, {b[1]} AS br FROM bw l JOIN bw r ON l.sel = r.sel AND l.side = 0 AND r.side = 1 WHERE l.sel = {selections.index(o)}")
        given = "spec AS MATERIALIZED (" + " UNION ALL ".join(rows) + ")"
    parts = [f"""{given},
sw AS MATERIALIZED (SELECT spec, sel, side, c, fz, CASE WHEN side = 1 THEN hr ELSE hl END AS h, CASE WHEN side = 1 THEN br ELSE bl END AS b FROM spec JOIN sel USING (sel), range(0, 2) r(side)),
pp_w AS MATERIALIZED (SELECT spec * 10 + side AS fit, spec, sel, side, c, fz, h, greatest(h, b) AS scale, 1 AS o FROM sw),
qq_w AS MATERIALIZED (SELECT spec * 10 + side AS fit, spec, sel, side, c, fz, b AS h, greatest(h, b) AS scale, 2 AS o FROM sw)""",
             _fits("pp_", "pp_w"), _fits("qq_", "qq_w"), _gammas("pp_", "pp_w", "spec"),
             f"""pp_gl AS MATERIALIZED (SELECT w.fit, a.i, sum(a.v * s.v) AS v FROM pp_w w JOIN pp_b a ON a.fit = w.fit AND a.col >= {IDENTITY} JOIN pp_s s ON s.fit = w.fit AND s.m = (a.col - {IDENTITY}) + 2 GROUP BY w.fit, a.i),
jump AS MATERIALIZED (SELECT w.spec, b.col, sum(CASE WHEN w.side = 1 THEN 1 ELSE -1 END * b.v) AS cl, sum(CASE WHEN w.side = 1 THEN 1 ELSE -1 END * (b.v - g.v * q.v)) AS bc
  FROM pp_w w JOIN pp_b b ON b.fit = w.fit AND b.i = 0 AND b.col < {IDENTITY} JOIN pp_gl g ON g.fit = w.fit AND g.i = 0 JOIN qq_b q ON q.fit = w.fit AND q.i = 2 AND q.col = b.col GROUP BY w.spec, b.col),
adj AS MATERIALIZED (SELECT j.spec, sum(CASE WHEN j.col = 0 THEN j.cl WHEN j.col >= 2 THEN -g.gy * j.cl ELSE 0 END) AS ycl, sum(CASE WHEN j.col = 0 THEN j.bc WHEN j.col >= 2 THEN -g.gy * j.bc ELSE 0 END) AS ybc,
    sum(CASE WHEN j.col = 1 THEN j.cl WHEN j.col >= 2 THEN -g.gt * j.cl ELSE 0 END) AS tcl, sum(CASE WHEN j.col = 1 THEN j.bc WHEN j.col >= 2 THEN -g.gt * j.bc ELSE 0 END) AS tbc
  FROM jump j LEFT JOIN pp_gam g ON g.fit = j.spec AND g.col = j.col GROUP BY j.spec),
tau AS MATERIALIZED (SELECT a.spec, CASE WHEN fz = 1 THEN ycl / tcl ELSE ycl END AS cl, CASE WHEN fz = 1 THEN ybc / tbc ELSE ybc END AS bc,
    CASE WHEN fz = 1 THEN 1 / tcl ELSE 1.0 END AS sy, CASE WHEN fz = 1 THEN -ycl / (tcl * tcl) ELSE 0.0 END AS st FROM adj a JOIN (SELECT DISTINCT spec, fz FROM sw) USING (spec)),
rr_vr AS MATERIALIZED (SELECT w.spec * 10 + w.side AS fit, b.x, (b.x - w.c) / greatest(w.h, w.b) AS z, CASE WHEN abs(b.x - w.c) <= w.h THEN (1 - abs(b.x - w.c) / w.h) / w.h ELSE 0.0 END AS k,
    CASE WHEN abs(b.x - w.c) <= w.b THEN (1 - abs(b.x - w.c) / w.b) / w.b ELSE 0.0 END AS kb, t.sy * (b.y - coalesce(m.gy, 0)) + t.st * (b.t - coalesce(m.gt, 0)) AS v
  FROM sw w JOIN tau t USING (spec) JOIN sel s ON s.sel = w.sel JOIN b0 b ON b.o = s.o LEFT JOIN gi ON gi.g = b.g LEFT JOIN pp_gam m ON m.fit = w.spec AND m.col = gi.col
  WHERE abs(b.x - w.c) <= greatest(w.h, w.b) AND (b.x >= w.c) = (w.side = 1))""",
             _neighbours("rr_", "rr_vr", "sum(k * k * pow(z, m) * E) AS hh, sum(k * kb * pow(z, m) * E) AS hb, sum(kb * kb * pow(z, m) * E) AS bb"),
             f"""rr_i AS MATERIALIZED (SELECT fit, col - {IDENTITY} AS j, v FROM pp_b WHERE i = 0 AND col >= {IDENTITY}),
rr_a AS MATERIALIZED (SELECT fit, col - {IDENTITY} AS j, v FROM qq_b WHERE i = 2 AND col >= {IDENTITY}),
rr_l AS MATERIALIZED (SELECT fit, v FROM pp_gl WHERE i = 0),
rr_cl AS MATERIALIZED (SELECT a.fit, sum(a.v * c.v * m.hh) AS v FROM rr_i a JOIN rr_i c ON c.fit = a.fit JOIN rr_mt m ON m.fit = a.fit AND m.m = a.j + c.j GROUP BY a.fit),
rr_hb AS MATERIALIZED (SELECT a.fit, sum(a.v * c.v * m.hb) AS v FROM rr_i a JOIN rr_a c ON c.fit = a.fit JOIN rr_mt m ON m.fit = a.fit AND m.m = a.j + c.j GROUP BY a.fit),
rr_bb AS MATERIALIZED (SELECT a.fit, sum(a.v * c.v * m.bb) AS v FROM rr_a a JOIN rr_a c ON c.fit = a.fit JOIN rr_mt m ON m.fit = a.fit AND m.m = a.j + c.j GROUP BY a.fit),
vars AS MATERIALIZED (SELECT c.fit // 10 AS spec, sum(c.v) AS vcl, sum(c.v - 2 * l.v * h.v + l.v * l.v * b.v) AS vrb FROM rr_cl c JOIN rr_l l USING (fit) JOIN rr_hb h USING (fit) JOIN rr_bb b USING (fit) GROUP BY 1),
eff AS MATERIALIZED (SELECT fit, count(CASE WHEN k > 0 THEN 1 END) AS n FROM pp_row GROUP BY fit),
res AS MATERIALIZED (SELECT s.*, c.n_left, c.n_right, l.n AS n_eff_left, r.n AS n_eff_right, method, CASE WHEN method = 'conventional' THEN t.cl ELSE t.bc END AS est, sqrt(CASE WHEN method = 'robust' THEN v.vrb ELSE v.vcl END) AS se
  FROM spec s JOIN cnt c USING (sel) JOIN tau t USING (spec) JOIN vars v USING (spec) JOIN eff l ON l.fit = s.spec * 10 JOIN eff r ON r.fit = s.spec * 10 + 1, (VALUES ('conventional'), ('bias_corrected'), ('robust')) q(method))"""]
    r = lambda c: f"round({c}, {digits})"
    return f"""{_head(base, selections)},
{chosen}{(',' + chr(10)).join(parts)}
SELECT name AS spec, outcome, method, {r('est')} AS estimate, {r('se')} AS std_error, {r('est / se')} AS statistic, {r(pnorm2('est / se'))} AS p_value,
       {r(f'est - {Z975} * se')} AS conf_low, {r(f'est + {Z975} * se')} AS conf_high, n_left, n_right, n_eff_left, n_eff_right,
       {r('hl')} AS h_left, {r('hr')} AS h_right, {r('bl')} AS b_left, {r('br')} AS b_right FROM res"""
