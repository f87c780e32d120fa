"""Local-polynomial RD estimation as two aggregation passes.

Notation (Calonico, Cattaneo and Titiunik 2014): on each side of the cutoff c,
weights w_h = K(u/h)/h with u = x − c, design r_p(u) = (1, u, …, u^p).
Γ_p = Σ w_h r_p r_pᵀ, β_p = Γ_p⁻¹ Σ w_h r_p D, and the bias-corrected
β_bc = β_p − Γ_p⁻¹ L β_q[p+1] with L = Σ w_h r_p u^{p+1} and β_q the order-q
fit with bandwidth b.  Robust variance uses q_i = w_h r_p − L·(e_{p+1}ᵀ Γ_q⁻¹ r_q) w_b.
Group controls enter as dummies with a coefficient common to both sides
(Calonico, Cattaneo, Farrell and Titiunik 2019), partialled out from the same
moments.  Variance: heteroskedasticity-robust (hc0 / hc1) from residuals.

Pass 1 sums w·zᵐ, w·zᵐ·y, w·zᵐ·t per (spec, side, group); pass 2 sums the
squared-residual weighted outer products per (spec, side).  Each row is
emitted once per specification whose window contains it (the spec list is a
parameter, so this multiplies rows by at most the number of specs, and the
copies are combined map-side before any shuffle).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrd.operators.rd.cells import CellTable, Fit, kernel_weight, known, powers, solve
from panelrd.operators.stats import Z975, norm_sf2
from panelrd.session import jit_friendly, materialize

RESULT_COLUMNS = ["spec", "outcome", "method", "estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high",
                  "n_left", "n_right", "n_eff_left", "n_eff_right", "h_left", "h_right", "b_left", "b_right"]
RESULT_SCHEMA = ("spec string, outcome string, method string, estimate double, std_error double, statistic double, "
                 "p_value double, conf_low double, conf_high double, n_left long, n_right long, n_eff_left long, "
                 "n_eff_right long, h_left double, h_right double, b_left double, b_right double")
SIDE_COLUMNS = ["spec", "side", "role", "power", "coef"]
SIDE_SCHEMA = "spec string, side string, role string, power int, coef double"
METHODS = ("conventional", "bias_corrected", "robust")


@dataclass(frozen=True)
class RDSpec:
    """One estimate: outcome, cutoff, bandwidths per side (b defaults to h), fuzzy or sharp."""

    name: str
    outcome: str
    c: float = 0.0
    h_left: float = 1.0
    h_right: float = 1.0
    b_left: float | None = None
    b_right: float | None = None
    fuzzy: bool = False

    def filled(self) -> "RDSpec":
        return replace(self, b_left=self.h_left if self.b_left is None else self.b_left,
                       b_right=self.h_right if self.b_right is None else self.b_right)


def _pick(values: Sequence, k: Column) -> Column:
    """Per-row constant of spec `k` from a literal array (spec list is a parameter)."""
    return F.element_at(F.array(*[F.lit(None).cast("double") if v is None else F.lit(float(v)) for v in values]), k + 1)


def _inv(A: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.inv(A)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(A)


def rd_grid(df: DataFrame, x: str, specs: Sequence[RDSpec], treat: str | None = None, group: str | None = None,
            p: int = 1, q: int = 2, kernel: str = "triangular", vce: str = "nn", level: float = 95.0,
            return_sides: bool = False, nnmatch: int = 3, variance: bool = True, materialize_mode: str = "none",
            nn_bucket: int | None = None):
    """Estimate every spec in one pair of passes; returns the result DataFrame
    (schema `RESULT_SCHEMA`, three rows per spec) and, with `return_sides`, the
    per-side polynomial coefficients (schema `SIDE_SCHEMA`).  `variance=False`
    skips the second pass (standard errors and p-values are then NULL).

    The pruned input (running variable, outcomes, treatment, group) is scanned
    three or four times.  `materialize_mode` says what to keep of it: `"none"` (rescan
    the pruned columns), `"persist"` (for an input with an expensive plan; recomputed
    from lineage if an executor is lost) or `"checkpoint"` (written to the cluster's
    `spark.checkpoint.dir`, cutting the lineage)."""
    if q < p + 1:
        raise ValueError("q must be at least p + 1")
    if vce not in ("hc0", "hc1", "nn"):
        raise ValueError("vce must be 'nn', 'hc0' or 'hc1'")
    specs = [s.filled() for s in specs]
    if any(s.fuzzy for s in specs) and treat is None:
        raise ValueError("a fuzzy spec needs `treat`")
    spark = df.sparkSession
    K = len(specs)
    xc = F.col(x).cast("double")
    need = [x] + ([treat] if treat else []) + ([group] if group else [])
    base, release = materialize(df.select(*{c: None for c in need + [s.outcome for s in specs]}.keys()), materialize_mode)
    try:
        if vce == "nn" and variance or group:
            return _rd_grid_cells(base, x, specs, treat, group, p, q, kernel, vce if variance else None, level, return_sides, nnmatch, nn_bucket)
        return _rd_grid(base, spark, K, xc, need, x, specs, treat, group, p, q, kernel, vce, level, return_sides, nnmatch, variance, nn_bucket)
    finally:
        release()


def _rd_grid_cells(base, x, specs, treat, group, p, q, kernel, vce, level, return_sides, nnmatch, nn_bucket):
    """Fixed bandwidths with neighbour variance or groups: cells of the rows inside the windows; the rest is only counted."""
    xc, counts = F.col(x).cast("double"), []
    for i, s in enumerate(specs):
        valid = known(xc) & known(F.col(s.outcome).cast("double"))
        valid = valid & known(F.col(treat).cast("double")) if treat else valid
        valid = valid & F.col(group).isNotNull() if group else valid
        counts += [F.count_if(valid & (xc < s.c)).alias(f"l{i}"), F.count_if(valid & (xc >= s.c)).alias(f"r{i}")]
    totals = base.agg(*counts).first()
    reach = (min(s.c - max(s.h_left, s.b_left) for s in specs), max(s.c + max(s.h_right, s.b_right) for s in specs))
    cells = CellTable(base, x, list(dict.fromkeys(s.outcome for s in specs)), treat, group, reach, nnmatch, nn_bucket, neighbours=vce == "nn")
    try:
        return _grid_from_cells(cells, specs, [(int(totals[f"l{i}"]), int(totals[f"r{i}"])) for i in range(len(specs))], p, q, kernel, level, return_sides, vce)
    finally:
        cells.drop()


def _rd_grid(base, spark, K, xc, need, x, specs, treat, group, p, q, kernel, vce, level, return_sides, nnmatch, variance, nn_bucket):
    valid = []
    for s in specs:
        v = known(F.col(s.outcome).cast("double"))
        for c in need:
            v = v & (F.col(c).isNotNull() if c == group else known(F.col(c).cast("double")))
        valid.append(v)

    # side totals (whole sample, per spec): one small aggregate
    tot_exprs = []
    for i, s in enumerate(specs):
        tot_exprs += [F.count_if(valid[i] & (xc < s.c)).alias(f"l{i}"), F.count_if(valid[i] & (xc >= s.c)).alias(f"r{i}")]
    totals = base.agg(*tot_exprs).first()

    # ---------------------------------------------------------------- pass 1
    in_win = []
    for i, s in enumerate(specs):
        wl, wr = max(s.h_left, s.b_left), max(s.h_right, s.b_right)
        in_win.append(F.when(valid[i] & (xc >= s.c - wl) & (xc <= s.c + wr), F.lit(i)))
    # one range over all windows, which the scan can push down
    lo = min(s.c - max(s.h_left, s.b_left) for s in specs)
    hi = max(s.c + max(s.h_right, s.b_right) for s in specs)
    e = base.filter((F.col(x) >= lo) & (F.col(x) <= hi)).select("*", F.explode(F.array_compact(F.array(*in_win))).alias("k"))
    k = F.col("k")
    c = _pick([s.c for s in specs], k)
    side = F.when(xc >= c, F.lit(1)).otherwise(F.lit(0))
    e = e.withColumn("side", side)
    sd = F.col("side") == 1
    h = F.when(sd, _pick([s.h_right for s in specs], k)).otherwise(_pick([s.h_left for s in specs], k))
    b = F.when(sd, _pick([s.b_right for s in specs], k)).otherwise(_pick([s.b_left for s in specs], k))
    scale = F.greatest(h, b)
    ycol = F.element_at(F.array(*[F.col(s.outcome).cast("double") for s in specs]), k + 1)
    u = xc - c
    e = e.select("k", "side", xc.alias("xr"),
                 (u / scale).alias("z"), kernel_weight(u, h, kernel).alias("wh"), kernel_weight(u, b, kernel).alias("wb"),
                 ycol.alias("y"), (F.col(treat).cast("double") if treat else F.lit(0.0)).alias("t"))
    z, wh, wb, yy, tt = F.col("z"), F.col("wh"), F.col("wb"), F.col("y"), F.col("t")
    zs = powers(z, 2 * q)
    aggs = [F.count(F.lit(1)).alias("nw"), F.count_if(wh > 0).alias("nh"), F.count_if(wb > 0).alias("nb")]
    aggs += [F.sum(wh * zs[m]).alias(f"H{m}") for m in range(2 * p + 2)]
    aggs += [F.sum(wb * zs[m]).alias(f"B{m}") for m in range(2 * q + 1)]
    aggs += [F.sum(wh * zs[m] * yy).alias(f"HY{m}") for m in range(p + 1)]
    aggs += [F.sum(wh * zs[m] * tt).alias(f"HT{m}") for m in range(p + 1)]
    aggs += [F.sum(wb * zs[m] * yy).alias(f"BY{m}") for m in range(q + 1)]
    aggs += [F.sum(wb * zs[m] * tt).alias(f"BT{m}") for m in range(q + 1)]
    with jit_friendly(spark):
        mom = [r.asDict() for r in e.groupBy("k", "side").agg(*aggs).collect()]

    parts = {(r["k"], r["side"]): {c: v or 0.0 for c, v in r.items() if c not in ("k", "side")} for r in mom}

    def meat_of(const_rows, fits):
        """Sums of squared residuals of the fits, from the rows."""
        cschema = "k int, side int, sy double, st double, kp array<double>, kq array<double>, arow array<double>, L array<double>"
        cdf = F.broadcast(spark.createDataFrame(const_rows, cschema))   # 2 rows per spec: size fixed by the spec list
        e2 = e.join(cdf, on=["k", "side"], how="inner")
        poly = lambda arr, n: sum((F.col(arr)[m] * zs[m] for m in range(1, n)), F.col(arr)[0])
        lhs = F.col("sy") * yy + F.col("st") * tt
        e_h = lhs - poly("kp", p + 1)
        e_b = lhs - poly("kq", q + 1)
        a_i = poly("arow", q + 1)
        Q = [wh * zs[j] - F.col("L")[j] * wb * a_i for j in range(p + 1)]
        aggs2 = [F.sum(wh * wh * zs[m] * e_h * e_h).alias(f"MC{m}") for m in range(2 * p + 1)]
        aggs2 += [F.sum(Q[j] * Q[l] * e_b * e_b).alias(f"MR{j}_{l}") for j in range(p + 1) for l in range(j, p + 1)]
        with jit_friendly(spark):
            return {(r["k"], r["side"]): r.asDict() for r in e2.groupBy("k", "side").agg(*aggs2).collect()}

    return _finish(spark, specs, parts, [(int(totals[f"l{i}"]), int(totals[f"r{i}"])) for i in range(K)], p, q, vce, level, return_sides, meat_of if variance else None)


def _grid_from_cells(cells: CellTable, specs, totals, p, q, kernel, level, return_sides, vce="nn"):
    """The estimates from a cell table: the number of jobs does not depend on that of specs.  `vce` None: no variances."""
    spark, place = cells.spark, {o: i for i, o in enumerate(cells.outcomes)}
    wide = {(i, side): max((s.h_right, s.b_right) if side else (s.h_left, s.b_left)) for i, s in enumerate(specs) for side in (0, 1)}
    window = lambda i, side, h, b=None: Fit(place[specs[i].outcome], specs[i].c, bool(side), float(h), b, float(wide[i, side]))
    pick = lambda s, side: (s.h_right, s.b_right) if side else (s.h_left, s.b_left)
    # an empty window has no rows, and no scale to divide by
    sides = [k for k in wide if wide[k] > 0 and min(pick(specs[k[0]], k[1])) > 0]
    moments = cells.moments([window(*k, pick(specs[k[0]], k[1])[which]) for k in sides for which in (0, 1)], kernel, max(2 * p + 1, 2 * q), q) if sides else []
    # group coefficients are common to both sides, from the fits with bandwidth h; outcome and treatment go on without them
    sets = {i: [2 * n for n, k in enumerate(sides) if k[0] == i] for i in dict.fromkeys(k[0] for k in sides)}
    gid = {i: n for n, i in enumerate(sets)}
    gammas = cells.gammas(moments, [(ws, p) for ws in sets.values()]) if sides else None
    clean = cells.adjusted(moments, {2 * n + which: gid[k[0]] for n, k in enumerate(sides) for which in (0, 1)}, gammas, q) if sides else {}
    parts: dict = {}
    for n, k in enumerate(sides):
        a, b = clean[2 * n], clean[2 * n + 1]
        parts[k] = {"nw": max(a["n"], b["n"]), "nh": a["np"], "nb": b["np"], **{f"H{m}": a.get(f"S{m}") or 0.0 for m in range(2 * p + 2)}, **{f"B{m}": b.get(f"S{m}") or 0.0 for m in range(2 * q + 1)},
                    **{f"H{c}{m}": a.get(f"{c}{m}") or 0.0 for c in "YT" for m in range(p + 1)}, **{f"B{c}{m}": b.get(f"{c}{m}") or 0.0 for c in "YT" for m in range(q + 1)}}

    def meat_of(const_rows, fits):
        """Sums of squared residuals; those for products of both kernels come from the same pass."""
        const = {(r[0], r[1]): r for r in const_rows}
        asked = [k for k in sides if fits[k]["tot"].get("nw") and np.isfinite(const[k][2:4]).all()]
        wanted = []
        for k in asked:
            h, b = pick(specs[k[0]], k[1])
            wanted.append(replace(window(*k, h, float(b)), n=int(fits[k]["tot"]["nw"]), sy=const[k][2], st=const[k][3], kh=const[k][4], kb=const[k][5], gid=gid[k[0]]))
        out = {}
        hh = "HH" if vce == "nn" else "HHb"
        for k, r in zip(asked, cells.residuals(wanted, kernel, vce, 2 * q, gammas) if wanted else []):
            arow, L = const[k][6], const[k][7]
            get = lambda name, m: r.get(f"{name}{m}") or 0.0
            m = {f"MC{j}": get("HH", j) for j in range(2 * p + 1)}
            for j in range(p + 1):
                for l in range(j, p + 1):
                    cross = sum(a * (L[l] * get("HB", j + i) + L[j] * get("HB", l + i)) for i, a in enumerate(arow))
                    own = sum(a * a2 * get("BB", i + i2) for i, a in enumerate(arow) for i2, a2 in enumerate(arow))
                    m[f"MR{j}_{l}"] = get(hh, j + l) - cross + L[j] * L[l] * own
            out[k] = m
        return out

    return _finish(spark, specs, parts, totals, p, q, vce, level, return_sides, meat_of if vce else None)


def _finish(spark, specs, parts, totals, p, q, vce, level, return_sides, meat_of):
    """Estimates and errors from the moments of each (spec, side); `meat_of` gives the sums of squared residuals."""
    keys = ["nw", "nh", "nb"] + [f"H{m}" for m in range(2 * p + 2)] + [f"B{m}" for m in range(2 * q + 1)] + \
           [f"{a}{m}" for a in ("HY", "HT") for m in range(p + 1)] + [f"{a}{m}" for a in ("BY", "BT") for m in range(q + 1)]
    fits = {}
    for i in range(len(specs)):
        for side in (0, 1):
            tot = dict.fromkeys(keys, 0.0) | parts.get((i, side), {})
            Gp = np.array([[tot[f"H{a + b}"] for b in range(p + 1)] for a in range(p + 1)])
            Gq = np.array([[tot[f"B{a + b}"] for b in range(q + 1)] for a in range(q + 1)])
            L = np.array([tot[f"H{j + p + 1}"] for j in range(p + 1)])
            bp = solve(Gp, np.array([[tot[f"HY{j}"], tot[f"HT{j}"]] for j in range(p + 1)]))
            bq = solve(Gq, np.array([[tot[f"BY{j}"], tot[f"BT{j}"]] for j in range(q + 1)]))
            fits[(i, side)] = dict(tot=tot, Gp=Gp, Gq=Gq, L=L, bp=bp, bq=bq, bbc=bp - np.outer(solve(Gp, L), bq[p + 1, :]))

    results, side_rows, const_rows = [], [], []
    est = {}
    for i, s in enumerate(specs):
        fl, fr = fits[(i, 0)], fits[(i, 1)]
        cl, bc = fr["bp"][0] - fl["bp"][0], fr["bbc"][0] - fl["bbc"][0]
        tY_cl, tY_bc = float(cl[0]), float(bc[0])
        if min(fl["tot"]["nh"], fr["tot"]["nh"]) < p + 1 or min(fl["tot"]["nb"], fr["tot"]["nb"]) < q + 1:
            # not enough observations on a side for the fits: the estimate is undefined (NULL row)
            tY_cl = tY_bc = float("nan")
        if s.fuzzy:
            tT_cl, tT_bc = float(cl[1]), float(bc[1])
            tau_cl = tY_cl / tT_cl if tT_cl != 0 else float("nan")
            tau_bc = tY_bc / tT_bc if tT_bc != 0 else float("nan")
            svec = np.array([1.0 / tT_cl, -tY_cl / tT_cl ** 2]) if tT_cl != 0 else np.full(2, float("nan"))
        else:
            tau_cl, tau_bc, svec = tY_cl, tY_bc, np.array([1.0, 0.0])
        est[i] = (tau_cl, tau_bc)
        for side, f in ((0, fl), (1, fr)):
            arow = _inv(f["Gq"])[p + 1, :]
            sc = max(s.h_right, s.b_right) if side else max(s.h_left, s.b_left)
            const_rows.append((i, side, float(svec[0]), float(svec[1]), [float(v) for v in f["bp"] @ svec], [float(v) for v in f["bq"] @ svec],
                               [float(v) for v in arow], [float(v) for v in f["L"]]))
            for c, role in enumerate("YT" if s.fuzzy else "Y"):
                for j in range(p + 1):
                    side_rows.append((s.name, "right" if side else "left", role, j, float(f["bp"][j, c]) / sc ** j if sc else None))
    meat = meat_of(const_rows, fits) if meat_of is not None else None

    zq = Z975 if level == 95.0 else _zq(level)
    for i, s in enumerate(specs):
        V = {"cl": 0.0, "rb": 0.0} if meat is not None else {"cl": float("nan"), "rb": float("nan")}
        for sside in (0, 1):
            f = fits[(i, sside)]
            if meat is None:
                continue
            m = meat.get((i, sside), {})
            n = f["tot"]["nw"]
            MC = np.array([[m.get(f"MC{a + bb}") or 0.0 for bb in range(p + 1)] for a in range(p + 1)])
            MR = np.zeros((p + 1, p + 1))
            for a in range(p + 1):
                for bb in range(a, p + 1):
                    MR[a, bb] = MR[bb, a] = m.get(f"MR{a}_{bb}") or 0.0
            if vce == "hc1":
                MC = MC * (n / (n - (p + 1)) if n > p + 1 else float("nan"))
                MR = MR * (n / (n - (q + 1)) if n > q + 1 else float("nan"))
            Gi = _inv(f["Gp"])
            V["cl"] += float((Gi @ MC @ Gi)[0, 0])
            V["rb"] += float((Gi @ MR @ Gi)[0, 0])
        tau_cl, tau_bc = est[i]
        se_cl = math.sqrt(V["cl"]) if V["cl"] >= 0 else float("nan")
        se_rb = math.sqrt(V["rb"]) if V["rb"] >= 0 else float("nan")
        if math.isnan(tau_cl):
            se_cl = se_rb = float("nan")
        fl, fr = fits[(i, 0)], fits[(i, 1)]
        common = (*totals[i], int(fl["tot"]["nh"]), int(fr["tot"]["nh"]),
                  float(s.h_left), float(s.h_right), float(s.b_left), float(s.b_right))
        for method, tau, se in (("conventional", tau_cl, se_cl), ("bias_corrected", tau_bc, se_cl), ("robust", tau_bc, se_rb)):
            zst = tau / se if se and not math.isnan(se) and se > 0 else float("nan")
            results.append((s.name, s.outcome, method, _f(tau), _f(se), _f(zst), _f(norm_sf2(zst)),
                            _f(tau - zq * se), _f(tau + zq * se)) + common)
    res = spark.createDataFrame(results, RESULT_SCHEMA)
    if return_sides:
        return res, spark.createDataFrame(side_rows, SIDE_SCHEMA)
    return res


def _f(v):
    return None if v is None or (isinstance(v, float) and (math.isnan(v) or math.isinf(v))) else float(v)


def _zq(level: float) -> float:
    """Normal quantile for a two-sided `level`% interval (bisection on erfc)."""
    target = 1 - level / 100.0
    lo, hi = 0.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if math.erfc(mid / math.sqrt(2)) > target:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def rd(df: DataFrame, x: str, y: str, c: float = 0.0, treat: str | None = None, group: str | None = None,
       h: float | tuple | None = None, b: float | tuple | None = None, p: int = 1, q: int = 2,
       kernel: str = "triangular", vce: str = "nn", bwselect: str = "msetwo", name: str | None = None,
       return_sides: bool = False, nnmatch: int = 3, materialize_mode: str = "none", masspoints: str = "off"):
    """One RD estimate (sharp, or fuzzy with `treat`, optional group controls).

    `h`/`b` may be a number or a (left, right) pair; when `h` is None both are
    chosen by `rd_bandwidth` (`bwselect` = "msetwo" or "certwo").  The pruned
    input is materialised once for the selection and the estimate (see `rd_grid`).
    """
    cols = [c_ for c_ in dict.fromkeys([x, y, treat, group]) if c_]
    base, release = materialize(df.select(*cols), materialize_mode)
    try:
        return _rd(base, x, y, c, treat, group, h, b, p, q, kernel, vce, bwselect, name, return_sides, nnmatch, masspoints)
    finally:
        release()


def _rd(df, x, y, c, treat, group, h, b, p, q, kernel, vce, bwselect, name, return_sides, nnmatch, masspoints):
    if h is None and vce == "nn":
        from panelrd.operators.rd.robustness import AutoSpec, rd_robustness

        spec = AutoSpec(name or y, y, c, treat is not None, bwselect)
        return rd_robustness(df, x, [spec], treat, group, p, q, kernel, nnmatch=nnmatch, return_sides=return_sides, masspoints=masspoints)
    if h is None:
        from panelrd.operators.rd.bandwidth import rd_bandwidth

        bw = rd_bandwidth(df, x, y, c=c, treat=treat, group=group, p=p, q=q, kernel=kernel, vce=vce, rule=bwselect,
                          as_dict=True, nnmatch=nnmatch, masspoints=masspoints)
        hl, hr, bl, br = bw["h_left"], bw["h_right"], bw["b_left"], bw["b_right"]
        if hl is None:  # too few rows on a side: no window, so a row of NULLs
            hl = hr = bl = br = 0.0
    else:
        hl, hr = (h, h) if not isinstance(h, tuple) else h
        if b is None:
            bl, br = hl, hr
        else:
            bl, br = (b, b) if not isinstance(b, tuple) else b
    spec = RDSpec(name or y, y, c, hl, hr, bl, br, fuzzy=treat is not None)
    return rd_grid(df, x, [spec], treat=treat, group=group, p=p, q=q, kernel=kernel, vce=vce, return_sides=return_sides,
                   nnmatch=nnmatch, materialize_mode="none")
