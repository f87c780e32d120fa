"""Oracle SQL for the estimator exercises (closed forms for p=1, q=2,
triangular kernel, hc1 variance, fixed bandwidths)."""

from __future__ import annotations

from panelrd.plans import estimates as EST

Z975 = "1.959963984540054"


def pnorm2(zexpr: str) -> str:
    """Two-sided normal p-value via the everywhere-convergent positive series of erf."""
    return (f"(SELECT CASE WHEN a = 0 THEN 1.0::DOUBLE WHEN a > 6 THEN 0.0::DOUBLE ELSE 1 - 2 / sqrt(pi()) * exp(-a * a) * "
            f"sum(exp(2 * n * ln(2) + (2 * n + 1) * ln(a) - lgamma(2 * n + 2) + lgamma(n + 1))) END "
            f"FROM (SELECT abs({zexpr}) / sqrt(2) AS a) q, range(0, 200) r(n) GROUP BY a)")


def pt2(texpr: str, dfexpr: str) -> str:
    """Two-sided Student-t p-value by Simpson's rule on the density (2000 panels)."""
    dens = "exp(lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * ln(df * pi()) - (df + 1) / 2 * ln(1 + (i * tt / 2000) * (i * tt / 2000) / df))"
    return (f"(SELECT CASE WHEN tt = 0 THEN 1.0::DOUBLE WHEN tt > 40 AND df > 30 THEN 0.0::DOUBLE ELSE 1 - 2 * (tt / 6000) * "
            f"sum(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {dens}) END "
            f"FROM (SELECT abs({texpr}) AS tt, CAST({dfexpr} AS DOUBLE) AS df) q, range(0, 2001) r(i) GROUP BY tt, df)")


def _dbl(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def spec_values(specs) -> str:
    rows = ", ".join(
        f"('{s.name}', '{s.outcome}', {_dbl(s.c)}, {_dbl(s.h_left)}, {_dbl(s.h_right)}, {_dbl(s.b_left if s.b_left is not None else s.h_left)}, "
        f"{_dbl(s.b_right if s.b_right is not None else s.h_right)}, {1 if s.fuzzy else 0})" for s in specs)
    return f"specs(spec, outcome, c, hl, hr, bl, br, fz) AS (VALUES {rows})"


def rd_core(rd_cte: str, specs, vce: str = "hc1") -> str:
    """CTEs up to per-(spec, side) fits `m5`, estimates `est2` and variances `v`."""
    meat = _HC_MEAT if vce == "hc1" else _nn_meat()
    return f"""WITH {rd_cte}, {spec_values(specs)},
tot AS (SELECT spec, count(CASE WHEN x < c THEN 1 END) AS n_left, count(CASE WHEN x >= c THEN 1 END) AS n_right FROM rd, specs GROUP BY spec),
e0 AS (SELECT s.*, rd.x, rd.t, CASE s.outcome WHEN 'y' THEN rd.y WHEN 'e' THEN rd.e WHEN 't' THEN rd.t END AS yv,
              CASE WHEN rd.x >= s.c THEN 1 ELSE 0 END AS side
       FROM rd JOIN specs s ON rd.x >= s.c - greatest(s.hl, s.bl) AND rd.x <= s.c + greatest(s.hr, s.br)),
e1 AS (SELECT *, x - c AS u, CASE WHEN side = 1 THEN hr ELSE hl END AS h, CASE WHEN side = 1 THEN br ELSE bl END AS b FROM e0),
e AS (SELECT spec, side, fz, x AS xr, yv AS y, t, u / greatest(h, b) AS z, greatest(h, b) AS sc,
             CASE WHEN abs(u) / h <= 1 THEN (1 - abs(u) / h) / h ELSE 0.0 END AS wh,
             CASE WHEN abs(u) / b <= 1 THEN (1 - abs(u) / b) / b ELSE 0.0 END AS wb FROM e1),
m1 AS (SELECT spec, side, max(fz) AS fz, max(sc) AS sc, count(*) AS nw, count(CASE WHEN wh > 0 THEN 1 END) AS nh,
              sum(wh) AS H0, sum(wh * z) AS H1, sum(wh * z * z) AS H2, sum(wh * z * z * z) AS H3,
              sum(wb) AS B0, sum(wb * z) AS B1, sum(wb * z * z) AS B2, sum(wb * z * z * z) AS B3, sum(wb * z * z * z * z) AS B4,
              sum(wh * y) AS HY0, sum(wh * z * y) AS HY1, sum(wh * t) AS HT0, sum(wh * z * t) AS HT1,
              sum(wb * y) AS BY0, sum(wb * z * y) AS BY1, sum(wb * z * z * y) AS BY2,
              sum(wb * t) AS BT0, sum(wb * z * t) AS BT1, sum(wb * z * z * t) AS BT2
       FROM e GROUP BY spec, side),
m2 AS (SELECT *, H0 * H2 - H1 * H1 AS dp,
              B2 * B4 - B3 * B3 AS A11, -(B1 * B4 - B2 * B3) AS A12, B1 * B3 - B2 * B2 AS A13,
              B0 * B4 - B2 * B2 AS A22, -(B0 * B3 - B1 * B2) AS A23, B0 * B2 - B1 * B1 AS A33 FROM m1),
m3 AS (SELECT *, B0 * A11 + B1 * A12 + B2 * A13 AS dq FROM m2),
m4 AS (SELECT *, (H2 * HY0 - H1 * HY1) / dp AS py0, (-H1 * HY0 + H0 * HY1) / dp AS py1,
              (H2 * HT0 - H1 * HT1) / dp AS pt0, (-H1 * HT0 + H0 * HT1) / dp AS pt1,
              (A11 * BY0 + A12 * BY1 + A13 * BY2) / dq AS qy0, (A12 * BY0 + A22 * BY1 + A23 * BY2) / dq AS qy1,
              (A13 * BY0 + A23 * BY1 + A33 * BY2) / dq AS qy2,
              (A11 * BT0 + A12 * BT1 + A13 * BT2) / dq AS qt0, (A12 * BT0 + A22 * BT1 + A23 * BT2) / dq AS qt1,
              (A13 * BT0 + A23 * BT1 + A33 * BT2) / dq AS qt2,
              (H2 * H2 - H1 * H3) / dp AS gl0, H2 / dp AS i00, -H1 / dp AS i01,
              A13 / dq AS ar0, A23 / dq AS ar1, A33 / dq AS ar2 FROM m3),
m5 AS (SELECT *, py0 - gl0 * qy2 AS cy0, pt0 - gl0 * qt2 AS ct0 FROM m4),
est AS (SELECT l.spec, l.fz, r.py0 - l.py0 AS ty_cl, r.cy0 - l.cy0 AS ty_bc, r.pt0 - l.pt0 AS tt_cl, r.ct0 - l.ct0 AS tt_bc
        FROM m5 l JOIN m5 r ON l.spec = r.spec AND l.side = 0 AND r.side = 1),
est2 AS (SELECT spec, CASE WHEN fz = 1 THEN ty_cl / tt_cl ELSE ty_cl END AS tau_cl,
                CASE WHEN fz = 1 THEN ty_bc / tt_bc ELSE ty_bc END AS tau_bc,
                CASE WHEN fz = 1 THEN 1 / tt_cl ELSE 1.0 END AS sy, CASE WHEN fz = 1 THEN -ty_cl / (tt_cl * tt_cl) ELSE 0.0 END AS st
         FROM est),
k AS (SELECT m5.*, sy, st, py0 * sy + pt0 * st AS kp0, py1 * sy + pt1 * st AS kp1,
             qy0 * sy + qt0 * st AS kq0, qy1 * sy + qt1 * st AS kq1, qy2 * sy + qt2 * st AS kq2 FROM m5 JOIN est2 USING (spec)),
{meat}res AS (SELECT spec, tau_cl, tau_bc, sqrt(v_cl) AS se_cl, sqrt(v_rb) AS se_rb FROM est2 JOIN v USING (spec)),
info AS (SELECT s.spec, s.outcome, s.hl, s.hr, s.bl, s.br, tot.n_left, tot.n_right, l.nh AS n_eff_left, r.nh AS n_eff_right
         FROM specs s JOIN tot USING (spec) JOIN m1 l ON l.spec = s.spec AND l.side = 0 JOIN m1 r ON r.spec = s.spec AND r.side = 1),
rr AS (SELECT spec, 'conventional' AS method, tau_cl AS estimate, se_cl AS std_error FROM res
       UNION ALL SELECT spec, 'bias_corrected', tau_bc, se_cl FROM res
       UNION ALL SELECT spec, 'robust', tau_bc, se_rb FROM res),
full_res AS (SELECT rr.spec, info.outcome, method, estimate, std_error, estimate / std_error AS statistic,
                    n_left, n_right, n_eff_left, n_eff_right, hl, hr, bl, br FROM rr JOIN info USING (spec))"""


_HC_MEAT = """r2 AS (SELECT e.spec, e.side, e.wh, e.wb, e.z,
              k.sy * e.y + k.st * e.t - (k.kp0 + k.kp1 * e.z) AS eh,
              k.sy * e.y + k.st * e.t - (k.kq0 + k.kq1 * e.z + k.kq2 * e.z * e.z) AS eb,
              k.ar0 + k.ar1 * e.z + k.ar2 * e.z * e.z AS a, k.H2 AS L0, k.H3 AS L1
       FROM e JOIN k ON e.spec = k.spec AND e.side = k.side),
r3 AS (SELECT *, wh - L0 * wb * a AS q0, wh * z - L1 * wb * a AS q1 FROM r2),
mt AS (SELECT r3.spec, r3.side, sum(wh * wh * eh * eh) AS MC0, sum(wh * wh * z * eh * eh) AS MC1, sum(wh * wh * z * z * eh * eh) AS MC2,
              sum(q0 * q0 * eb * eb) AS MR00, sum(q0 * q1 * eb * eb) AS MR01, sum(q1 * q1 * eb * eb) AS MR11 FROM r3 GROUP BY r3.spec, r3.side),
v AS (SELECT mt.spec, sum((i00 * i00 * MC0 + 2 * i00 * i01 * MC1 + i01 * i01 * MC2) * nw / (nw - 2)) AS v_cl,
             sum((i00 * i00 * MR00 + 2 * i00 * i01 * MR01 + i01 * i01 * MR11) * nw / (nw - 3)) AS v_rb
      FROM mt JOIN m5 ON mt.spec = m5.spec AND mt.side = m5.side GROUP BY mt.spec),
"""


def _nn_meat(J: int = 3) -> str:
    """Nearest-neighbour meat: distinct values, lag/lead over each (spec, side), unrolled expansion."""
    lagcols = ", ".join(f"lag({c}, {j}) OVER w AS l{c}{j}, lead({c}, {j}) OVER w AS r{c}{j}"
                        for j in range(1, J + 1) for c in ("xr", "d", "S"))
    steps = ["s0 AS (SELECT *, d - 1 AS k, 0.0 AS A, 0 AS li, 0 AS ri FROM lg)"]
    for i in range(J):
        pick = lambda side, c, idx: "CASE " + idx + " " + " ".join(f"WHEN {j - 1} THEN {side}{c}{j}" for j in range(1, J + 1)) + " END"
        steps.append(f"""p{i} AS (SELECT *, {pick('l', 'xr', 'li')} AS nlx, {pick('l', 'd', 'li')} AS nld, {pick('l', 'S', 'li')} AS nlS,
            {pick('r', 'xr', 'ri')} AS nrx, {pick('r', 'd', 'ri')} AS nrd, {pick('r', 'S', 'ri')} AS nrS,
            k < least({J}, n - 1) AS need FROM s{i}),
t{i} AS (SELECT *, coalesce(need AND nlx IS NOT NULL AND (nrx IS NULL OR xr - nlx <= nrx - xr), false) AS tl,
            coalesce(need AND nrx IS NOT NULL AND (nlx IS NULL OR xr - nlx >= nrx - xr), false) AS tr FROM p{i}),
s{i + 1} AS (SELECT * EXCLUDE (k, A, li, ri, nlx, nld, nlS, nrx, nrd, nrS, need, tl, tr),
            k + CASE WHEN tl THEN nld ELSE 0 END + CASE WHEN tr THEN nrd ELSE 0 END AS k,
            A + CASE WHEN tl THEN nlS ELSE 0.0 END + CASE WHEN tr THEN nrS ELSE 0.0 END AS A,
            li + CASE WHEN tl THEN 1 ELSE 0 END AS li, ri + CASE WHEN tr THEN 1 ELSE 0 END AS ri FROM t{i})""")
    return f"""wrow AS (SELECT e.spec, e.side, e.xr, k.sy * e.y + k.st * e.t AS w, e.wh, e.wb, e.z,
              k.ar0 + k.ar1 * e.z + k.ar2 * e.z * e.z AS a, k.H2 AS L0, k.H3 AS L1
       FROM e JOIN k ON e.spec = k.spec AND e.side = k.side),
dv AS (SELECT spec, side, xr, count(*) AS d, sum(w) AS S, sum(w * w) AS Q,
              first(wh * wh) AS c0, first(wh * wh * z) AS c1, first(wh * wh * z * z) AS c2,
              first((wh - L0 * wb * a) * (wh - L0 * wb * a)) AS q00, first((wh - L0 * wb * a) * (wh * z - L1 * wb * a)) AS q01,
              first((wh * z - L1 * wb * a) * (wh * z - L1 * wb * a)) AS q11
       FROM wrow GROUP BY spec, side, xr),
nk AS (SELECT spec, side, sum(d) AS n FROM dv GROUP BY spec, side),
lg AS (SELECT dv.*, nk.n, {lagcols} FROM dv JOIN nk USING (spec, side) WINDOW w AS (PARTITION BY spec, side ORDER BY xr)),
{", ".join(steps)},
ee AS (SELECT *, sqrt(k / (k + 1.0)) AS cf FROM s{J}),
ef AS (SELECT *, cf * (1 + 1.0 / k) AS al, cf * (S + A) / k AS be FROM ee),
eg AS (SELECT *, al * al * Q - 2 * al * be * S + d * be * be AS E FROM ef),
mt AS (SELECT spec, side, sum(c0 * E) AS MC0, sum(c1 * E) AS MC1, sum(c2 * E) AS MC2,
              sum(q00 * E) AS MR00, sum(q01 * E) AS MR01, sum(q11 * E) AS MR11 FROM eg GROUP BY spec, side),
v AS (SELECT mt.spec, sum(i00 * i00 * MC0 + 2 * i00 * i01 * MC1 + i01 * i01 * MC2) AS v_cl,
             sum(i00 * i00 * MR00 + 2 * i00 * i01 * MR01 + i01 * i01 * MR11) AS v_rb
      FROM mt JOIN m5 ON mt.spec = m5.spec AND mt.side = m5.side GROUP BY mt.spec),
"""


def rd_result_sql(rd_cte: str, specs, vce: str = "hc1") -> str:
    return rd_core(rd_cte, specs, vce) + f"""
SELECT spec, outcome, method, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error, round(statistic, 6) AS statistic,
       round({pnorm2('statistic')}, 6) AS p_value,
       round(estimate - {Z975} * std_error, 6) AS conf_low, round(estimate + {Z975} * std_error, 6) AS conf_high,
       n_left, n_right, n_eff_left, n_eff_right, round(hl, 6) AS h_left, round(hr, 6) AS h_right, round(bl, 6) AS b_left, round(br, 6) AS b_right
FROM full_res"""


def fitted_sql(rd_cte: str, specs, h: float) -> str:
    return rd_core(rd_cte, specs) + f""",
co AS (SELECT spec, side, 'Y' AS role, py0 AS a, py1 / sc AS b FROM m5
       UNION ALL SELECT spec, side, 'T', pt0, pt1 / sc FROM m5 WHERE fz = 1),
pts AS (SELECT x, CASE WHEN x >= 0.0 THEN 1 ELSE 0 END AS side FROM rd WHERE x >= 0.0 - {_dbl(h)} AND x <= 0.0 + {_dbl(h)})
SELECT co.spec, CASE WHEN co.side = 1 THEN 'right' ELSE 'left' END AS side, role, round(x, 6) AS x, round(a + b * (x - 0.0), 6) AS fitted
FROM pts JOIN co ON pts.side = co.side"""


def model_table_sql(rd_cte: str, specs) -> str:
    names = [s.name for s in specs]
    cells = ", ".join(f"min(CASE WHEN spec = '{n}' THEN cell END) AS \"{n}\"" for n in names)
    return rd_core(rd_cte, specs) + f""",
pv AS (SELECT *, {pnorm2('statistic')} AS p FROM full_res),
cl AS (SELECT spec, method, 'estimate' AS "row", printf('%.3f', estimate) ||
              CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.1 THEN '*' ELSE '' END AS cell FROM pv
       UNION ALL SELECT spec, method, 'std_error', '(' || printf('%.3f', std_error) || ')' FROM pv)
SELECT method, "row", {cells} FROM cl GROUP BY method, "row\""""


def ols_sql(rd_cte: str) -> dict[str, str]:
    simple = f"""WITH {rd_cte},
s AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy,
             regr_sxy(y, x) AS sxy, avg(x) AS mx FROM rd),
f AS (SELECT *, (syy - sxy * sxy / sxx) / (n - 2) AS s2, 1 - (syy - sxy * sxy / sxx) / syy AS r2 FROM s),
tt AS (SELECT '(Intercept)' AS term, a AS estimate, sqrt(s2 * (1.0 / n + mx * mx / sxx)) AS se, n, r2 FROM f
       UNION ALL SELECT 'x', b, sqrt(s2 / sxx), n, r2 FROM f)
SELECT '{{model}}' AS model, term, round(estimate, 6) AS estimate, round(se, 6) AS std_error, round(estimate / se, 6) AS statistic,
       round({pt2('estimate / se', 'n - 2')}, 6) AS p_value, n, round(r2, 6) AS r2 FROM tt"""
    multi2 = f"""
s2m AS (SELECT count(*) AS n, avg(x) AS mx, avg(t) AS mt, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxx(y, t) AS stt,
               regr_sxy(t, x) AS sxt, regr_sxy(y, x) AS sxy, regr_sxy(y, t) AS sty, regr_syy(y, x) AS syy FROM rd),
g AS (SELECT *, sxx * stt - sxt * sxt AS det FROM s2m),
bb AS (SELECT *, (stt * sxy - sxt * sty) / det AS bx, (-sxt * sxy + sxx * sty) / det AS bt, stt / det AS ixx, sxx / det AS itt,
              -sxt / det AS ixt FROM g),
ff AS (SELECT *, syy - (bx * sxy + bt * sty) AS rss FROM bb),
f2 AS (SELECT *, rss / (n - 3) AS s2, 1 - rss / syy AS r2, my - bx * mx - bt * mt AS a FROM ff),
t2 AS (SELECT '(Intercept)' AS term, a AS estimate, sqrt(s2 * (1.0 / n + mx * mx * ixx + 2 * mx * mt * ixt + mt * mt * itt)) AS se, n, r2 FROM f2
       UNION ALL SELECT 'x', bx, sqrt(s2 * ixx), n, r2 FROM f2 UNION ALL SELECT 't', bt, sqrt(s2 * itt), n, r2 FROM f2)"""
    m1_body = simple.split(f"WITH {rd_cte},", 1)[1].replace("'{model}'", "'m1'")
    multi = (f"WITH {rd_cte}, m1 AS (SELECT * FROM (WITH {m1_body.strip()})), {multi2.strip()}\n"
             f"SELECT * FROM m1 UNION ALL SELECT 'm2' AS model, term, round(estimate, 6), round(se, 6), round(estimate / se, 6), "
             f"round({pt2('estimate / se', 'n - 3')}, 6), n, round(r2, 6) FROM t2")
    return {"ols_simple": simple.replace("{model}", "simple"), "ols_multi": multi}


def ols_masks_sql(rd_cte: str) -> str:
    """Each model over its own complete rows of a table with holes."""
    def over(where: str) -> dict[str, str]:
        holes = "rdm AS (SELECT CASE WHEN id % 7 <> 0 THEN y END AS y, CASE WHEN id % 11 <> 0 THEN x END AS x, CASE WHEN id % 13 <> 0 THEN t END AS t FROM rd_all)"
        return ols_sql(f"{rd_cte.replace('rd AS (', 'rd_all AS (', 1)}, {holes}, rd AS (SELECT * FROM rdm WHERE {where})")

    m1 = over("y IS NOT NULL AND x IS NOT NULL")["ols_simple"].replace("'simple' AS model", "'m1' AS model")
    m2 = over("y IS NOT NULL AND x IS NOT NULL AND t IS NOT NULL")["ols_multi"]
    return f"SELECT * FROM ({m1}) UNION ALL SELECT * FROM ({m2}) WHERE model = 'm2'"


def density_sql(rd_cte: str) -> dict[str, str]:
    b, h = _dbl(EST.DENSITY_BIN), _dbl(EST.DENSITY_H)

    def bins(src: str) -> str:
        return f"""d AS (SELECT x FROM {src} WHERE x IS NOT NULL),
lim AS (SELECT count(*) AS n, CAST(floor((min(x) - 0.0) / {b}) AS BIGINT) AS jlo, CAST(floor((max(x) - 0.0) / {b}) AS BIGINT) AS jhi FROM d),
cnt AS (SELECT CAST(floor((x - 0.0) / {b}) AS BIGINT) AS bin, count(*) AS n FROM d GROUP BY 1),
grid AS (SELECT unnest(range(jlo, jhi + 1)) AS bin FROM lim),
bt AS (SELECT grid.bin, 0.0 + (grid.bin + 0.5) * {b} AS mid, coalesce(cnt.n, 0) AS n,
              coalesce(cnt.n, 0) / (CAST(lim.n AS DOUBLE) * {b}) AS height,
              CASE WHEN grid.bin >= 0 THEN 'right' ELSE 'left' END AS side,
              CASE WHEN abs(0.0 + (grid.bin + 0.5) * {b} - 0.0) / {h} <= 1 THEN 1 - abs(0.0 + (grid.bin + 0.5) * {b} - 0.0) / {h} ELSE 0.0 END AS weight
       FROM grid CROSS JOIN lim LEFT JOIN cnt ON grid.bin = cnt.bin)"""

    def test(src: str, label: str) -> str:
        return f"""(WITH {bins(src)},
sd AS (SELECT side, sum(weight) AS s0, sum(weight * (mid - 0.0)) AS s1, sum(weight * (mid - 0.0) * (mid - 0.0)) AS s2,
              sum(weight * height) AS t0, sum(weight * (mid - 0.0) * height) AS t1 FROM bt WHERE weight > 0 GROUP BY side),
f AS (SELECT side, (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) AS f FROM sd),
th AS (SELECT (SELECT f FROM f WHERE side = 'left') AS fl, (SELECT f FROM f WHERE side = 'right') AS fr, (SELECT n FROM lim) AS n),
th2 AS (SELECT *, ln(fr) - ln(fl) AS theta, sqrt((1.0 / (n * {h})) * (24.0 / 5.0) * (1.0 / fr + 1.0 / fl)) AS se FROM th)
SELECT round(theta, 6) AS theta, round(se, 6) AS std_error, round(theta / se, 6) AS statistic, round({pnorm2('theta / se')}, 6) AS p_value,
       round(fl, 6) AS f_left, round(fr, 6) AS f_right, n, round({b}, 6) AS bin_width, round({h}, 6) AS bandwidth, '{label}' AS sample FROM th2)"""

    curve = f"""WITH {rd_cte}, {bins('rd')},
pr AS (SELECT j.bin, j.side, k.height, (k.bin - j.bin) * {b} AS dx FROM bt j JOIN bt k ON j.side = k.side
       AND k.bin BETWEEN j.bin - {int(EST.DENSITY_H // EST.DENSITY_BIN)} AND j.bin + {int(EST.DENSITY_H // EST.DENSITY_BIN)}),
pw AS (SELECT *, greatest(0.0, 1.0 - abs(dx) / {h}) AS w FROM pr),
ft AS (SELECT bin, side, sum(w) AS s0, sum(w * dx) AS s1, sum(w * dx * dx) AS s2, sum(w * height) AS t0, sum(w * dx * height) AS t1
       FROM pw WHERE w > 0 GROUP BY bin, side)
SELECT bt.bin, round(bt.mid, 6) AS mid, bt.side, bt.n, round(bt.height, 6) AS height,
       round(CASE WHEN s0 * s2 - s1 * s1 = 0 THEN NULL ELSE (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) END, 6) AS density
FROM bt LEFT JOIN ft ON bt.bin = ft.bin AND bt.side = ft.side"""
    binned = f"""WITH {rd_cte}, {bins('rd')}
SELECT bin, round(mid, 6) AS mid, n, round(height, 6) AS height, side, round(weight, 6) AS weight FROM bt"""
    bunched = "(SELECT * FROM rd WHERE NOT (x >= -3 AND x < 0 AND grp IN ('1-URGENT', '2-HIGH')))"
    dtest = f"WITH {rd_cte} SELECT * FROM {test('rd', 'full')} UNION ALL SELECT * FROM {test(bunched, 'bunched')}"
    # variance constant of the order-2 fit with the triangular kernel: the integrals are rational, and it is 40/7
    hh, const = _dbl(EST.DENSITY_LP_H), "(40.0::DOUBLE / 7)"

    def lp(src: str, label: str) -> str:
        return f"""(WITH d AS (SELECT x FROM {src} WHERE x IS NOT NULL),
nn AS (SELECT count(*) AS n FROM d),
ec AS (SELECT x, count(*) OVER (ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM d),
w AS (SELECT x, cum / CAST(n AS DOUBLE) AS Fh, CASE WHEN x >= 0.0 THEN 1 ELSE 0 END AS side, (x - 0.0) / {hh} AS z,
             CASE WHEN abs(x - 0.0) / {hh} <= 1 THEN (1 - abs(x - 0.0) / {hh}) / {hh} ELSE 0.0 END AS wt
      FROM ec, nn WHERE x >= 0.0 - {hh} AND x <= 0.0 + {hh}),
m AS (SELECT side, CAST(sum(CASE WHEN wt > 0 THEN 1 ELSE 0 END) AS BIGINT) AS nh, sum(wt) AS B0, sum(wt * z) AS B1, sum(wt * z * z) AS B2,
             sum(wt * z * z * z) AS B3, sum(wt * z * z * z * z) AS B4, sum(wt * Fh) AS T0, sum(wt * z * Fh) AS T1, sum(wt * z * z * Fh) AS T2
      FROM w GROUP BY side),
c2 AS (SELECT *, -(B1 * B4 - B2 * B3) AS A12, B0 * B4 - B2 * B2 AS A22, -(B0 * B3 - B1 * B2) AS A23,
              B0 * (B2 * B4 - B3 * B3) + B1 * (-(B1 * B4 - B2 * B3)) + B2 * (B1 * B3 - B2 * B2) AS det FROM m),
f AS (SELECT side, nh, (A12 * T0 + A22 * T1 + A23 * T2) / det / {hh} AS f FROM c2),
tt AS (SELECT (SELECT f FROM f WHERE side = 0) AS fl, (SELECT f FROM f WHERE side = 1) AS fr,
              (SELECT nh FROM f WHERE side = 0) AS nl, (SELECT nh FROM f WHERE side = 1) AS nr, (SELECT n FROM nn) AS n),
t2 AS (SELECT *, fr - fl AS diff, sqrt((fl + fr) * {const} / (n * {hh})) AS se FROM tt)
SELECT round(fl, 6) AS f_left, round(fr, 6) AS f_right, round(diff, 6) AS difference, round(se, 6) AS std_error,
       round(diff / se, 6) AS statistic, round({pnorm2('diff / se')}, 6) AS p_value, n, nl AS n_left_h, nr AS n_right_h,
       round({hh}, 6) AS bandwidth, CAST({EST.DENSITY_LP_P} AS INTEGER) AS p, '{label}' AS sample FROM t2)"""

    dlp = f"WITH {rd_cte} SELECT * FROM {lp('rd', 'full')} UNION ALL SELECT * FROM {lp(bunched, 'bunched')}"
    return {"density_binned": binned, "density_test": dtest, "density_curve": curve, "density_lp": dlp, "density_lp_buckets": dlp}


def all_sql(rd_cte: str) -> dict[str, str]:
    out = {
        "rd_sharp": rd_result_sql(rd_cte, EST.SHARP_SPECS),
        "rd_fuzzy": rd_result_sql(rd_cte, EST.FUZZY_SPECS, vce="nn"),
        "rd_fuzzy_buckets": rd_result_sql(rd_cte, EST.FUZZY_SPECS, vce="nn"),
        "rd_spec_grid": rd_result_sql(rd_cte, EST.GRID_SPECS),
        "fitted_lines": fitted_sql(rd_cte, EST.FUZZY_SPECS, EST.RD_H),
        "model_table": model_table_sql(rd_cte, EST.TABLE_SPECS),
    }
    out.update(ols_sql(rd_cte))
    out["ols_masks"] = ols_masks_sql(rd_cte)
    out.update(density_sql(rd_cte))
    return out
