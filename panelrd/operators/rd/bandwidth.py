"""Data-driven RD bandwidths: MSE-optimal per side ("msetwo") and its
coverage-error rescaling ("certwo").

The selector follows the staged plug-in of Calonico, Cattaneo and Titiunik
(2014) with the regularisation term and the coverage-error rate of Calonico,
Cattaneo and Farrell (2020):

1. pilot c = C_K · min(sd(x), IQR(x)/1.349) · N^(−1/5);
2. d (for the order-(q+1) derivative) from an order-(q+2) fit on each whole side;
3. b from the order-q derivative bias with pilot d;
4. h from the order-p intercept bias with pilot b.

Group controls (dummies of `group`, first level dropped) are partialled out
inside every stage on each side, as in the covariate-adjusted estimator.
Each stage is one aggregation of kernel-weighted moments per (window, group)
plus one residual aggregation (nearest-neighbour by default, or hc0/hc1) over
the cell table (cells.py), for all selections at once: the rows are read once.
The quartiles of the pilot are exact order statistics found by counting cells,
so nothing is sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrd.operators.rd.cells import CellTable, Fit, gram, solve
from panelrd.operators.rd.core import _inv

# Rule-of-thumb pilot constants per kernel.
PILOT_CONSTANT = {"triangular": 2.576, "uniform": 1.843, "epanechnikov": 2.435}


BANDWIDTH_SCHEMA = ("rule string, h_left double, h_right double, b_left double, b_right double, "
                    "pilot double, n_left long, n_right long")
#: Part of a side's rows that repeat others' values from which these count as mass points; distinct values in a window then.
MASS_SHARE, MASS_VALUES = 0.2, 10
#: Cells that a quantile's range is cut into at each step.
QUANTILE_CELLS = 4096


def exact_quantiles(df: DataFrame, x: str, n: int, lo: float, hi: float, probs: Sequence[float], weight: str | None = None) -> list[float]:
    """Quantiles of n observations, `weight` of them in each row, by linear interpolation of the two order statistics around p (n − 1), exact and without a sort.

    Rows are counted in QUANTILE_CELLS equal cells of a range; the cells that hold the wanted ranks become the next ranges,
    until a range is one value.  Each step is one aggregation with a row per cell and wanted rank.
    """
    many = F.col(weight) if weight else F.lit(1)
    ranks = sorted({k for p in probs for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
    found: dict = {}
    todo = {k: (lo, hi, k) for k in ranks}          # rank → range that holds it, and its rank in that range
    while todo:
        ranges = sorted({(a, b) for a, b, _ in todo.values()})
        for k, (a, b, _) in list(todo.items()):
            if a == b:
                found[k] = a
                del todo[k]
        ranges = [r for r in ranges if r[0] < r[1]]
        if not ranges:
            break
        xc = F.col(x)
        which = F.explode(F.array_compact(F.array(*[
            F.when((xc >= a) & (xc <= b), F.struct(F.lit(i).alias("i"), F.least(F.floor((xc - a) / (b - a) * QUANTILE_CELLS), F.lit(QUANTILE_CELLS - 1)).alias("cell")))
            for i, (a, b) in enumerate(ranges)])))
        cells: dict = {}
        for r in df.select(xc.alias("x"), which.alias("w"), many.alias("many")).groupBy("w.i", "w.cell").agg(F.sum("many").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
            cells.setdefault(r["i"], []).append((r["cell"], r["n"], r["lo"], r["hi"]))
        for k, (a, b, inside) in list(todo.items()):
            for _, m, c_lo, c_hi in sorted(cells[ranges.index((a, b))]):
                if inside < m:
                    todo[k] = (c_lo, c_hi, inside)
                    break
                inside -= m
    out = []
    for p in probs:
        at = p * (n - 1)
        a, b = found[math.floor(at)], found[math.ceil(at)]
        out.append(a + (at - math.floor(at)) * (b - a))
    return out


def _combination(beta: np.ndarray, nu: int, h: float, fuzzy: bool) -> np.ndarray:
    """Weights of outcome and treatment in what a stage targets: the outcome, or the ratio linearised at the fit's derivatives."""
    if not fuzzy:
        return np.array([1.0, 0.0])
    ty, tt = (math.factorial(nu) * beta[nu, c] / h ** nu for c in (0, 1))
    return np.array([1.0 / tt, -ty / tt ** 2]) if tt else np.full(2, float("nan"))


def _vmat(G, M: dict, order: int, n: int, vce: str) -> np.ndarray:
    """(Γ⁻¹ M Γ⁻¹) with the hc1 small-sample factor where asked."""
    Mm = np.array([[M.get(f"HH{a + b}") or 0.0 for b in range(order + 1)] for a in range(order + 1)])
    if vce == "hc1":
        Mm = Mm * (n / (n - order - 1) if n > order + 1 else float("nan"))
    Gi = _inv(G)
    return Gi @ Mm @ Gi


@dataclass(frozen=True)
class Selection:
    """What bandwidths are chosen for: a sample of a cell table, a cutoff, and whether the estimate is a ratio."""

    o: int
    c: float
    fuzzy: bool


def select_bandwidths(cells: CellTable, selections: Sequence[Selection], p: int = 1, q: int = 2, kernel: str = "triangular", vce: str = "nn",
                      scaleregul: float = 1.0, masspoints: str = "off") -> list[dict]:
    """h_left, h_right, b_left, b_right, pilot, n_left and n_right for each selection; the number of jobs does not depend on theirs.

    A selection with too few rows on a side has bandwidths None.  With `masspoints` "adjust", where MASS_SHARE of a side's rows
    repeat others' values, the pilot counts distinct values in place of rows, and no window holds fewer than
    MASS_VALUES of them on a side.
    """
    if masspoints not in ("off", "adjust"):
        raise ValueError("masspoints must be 'off' or 'adjust'")
    counts = cells.sides([(s.o, s.c) for s in selections])
    found: list[dict] = [dict(dict.fromkeys(("h_left", "h_right", "b_left", "b_right", "pilot")), n_left=nl, n_right=nr, N=nl + nr) for nl, nr in counts]
    live = [i for i, (nl, nr) in enumerate(counts) if nl + nr >= 10 and nl >= 5 and nr >= 5]
    if not live:
        return found
    spreads = _spreads(cells, sorted({selections[i].o for i in live}))
    hc = vce != "nn"
    distinct = cells.distinct_sides([(selections[i].o, selections[i].c) for i in live]) if masspoints == "adjust" else [counts[i] for i in live]
    ranges, pilot, floors = {}, {}, {}
    for i, values in zip(live, distinct):
        s = selections[i]
        sample = cells.samples[s.o]
        ranges[i] = (abs(sample["lo"] - s.c), abs(sample["hi"] - s.c))
        massed = any(1 - m / n >= MASS_SHARE for m, n in zip(values, counts[i]))
        floors[i] = cells.nearest(s.o, s.c, MASS_VALUES) if massed else (0.0, 0.0)
        pilot[i] = max(min(PILOT_CONSTANT[kernel] * spreads[s.o] * (sum(values) if massed else sample["n"]) ** (-0.2), max(ranges[i])), *floors[i])
    sides = [(i, side) for i in live for side in (0, 1)]

    def window(i: int, side: int, h: float) -> Fit:
        return Fit(selections[i].o, selections[i].c, bool(side), float(h))

    def residual_fit(f: Fit, n: int, s: np.ndarray, set_: int, beta: np.ndarray) -> Fit:
        coefficients = [float(v) for v in beta @ s] if hc else []
        return replace(f, n=int(n), sy=float(s[0]), st=float(s[1]), kh=coefficients, kb=coefficients, gid=set_)

    # variance parts: all stages use the pilot window; orders q+1, q, p with derivative q+1, p+1, 0
    stages = [(q + 1, q + 1), (q, p + 1), (p, 0)]
    most = q + 2
    fits = [window(i, s, pilot[i]) for i, s in sides] + [window(i, s, ranges[i][s] + 1e-8) for i, s in sides]
    moments = cells.moments(fits, kernel, 2 * most, most)
    place, behind = {k: n for n, k in enumerate(sides)}, len(sides)
    sets = [((place[k],), o) for k in sides for o, _ in stages]
    gammas = cells.gammas(moments, sets)
    gid = {(*k, o): n for n, (k, o) in enumerate((k, o) for k in sides for o, _ in stages)}
    parts, asked = {}, []
    for i, s in sides:
        m = moments[place[i, s]]
        own = {o: cells.adjusted(moments, {place[i, s]: gid[i, s, o]}, gammas, most)[place[i, s]] if hc else m for o, _ in stages}
        for o, nu in stages:
            G, R = gram(m, o)
            combination = _combination(solve(G, R), nu, pilot[i], selections[i].fuzzy)
            v = np.array([m.get(f"S{j + o + 1}") or 0.0 for j in range(o + 1)])
            parts[i, s, o] = dict(G=G, s=combination, bconst=float((_inv(G) @ v)[nu]), nu=nu)
            asked.append(((i, s, o), residual_fit(window(i, s, pilot[i]), m["n"], combination, gid[i, s, o], solve(*gram(own[o], o)))))
    for (key, f), r in zip(asked, cells.residuals([f for _, f in asked], kernel, vce, 2 * (q + 1), gammas)):
        part, h = parts[key], f.h
        V = _vmat(part["G"], r, key[2], f.n, vce)
        part["V"] = (2 * part["nu"] + 1) * h ** (2 * part["nu"] + 1) * float(V[part["nu"], part["nu"]]) / h ** (2 * part["nu"])

    def stage(o: int, order: int, h: dict, regularised: bool, known: bool = False) -> dict:
        """(V, bias, regularisation) for each side, the bias from a fit of `order` with window h."""
        ms = moments if known else cells.moments([window(*k, h[k]) for k in sides], kernel, 2 * most, most)
        at = {k: n + behind * known for k, n in place.items()}
        clean = cells.adjusted(ms, {at[k]: gid[*k, o] for k in sides}, gammas, most)
        fitted = {k: (gram(clean[at[k]], order)[0], solve(*gram(clean[at[k]], order))) for k in sides}
        rs = {}
        if regularised:
            again = [residual_fit(window(*k, h[k]), ms[at[k]]["n"], parts[*k, o]["s"], gid[*k, o], fitted[k][1]) for k in sides]
            rs = dict(zip(sides, cells.residuals(again, kernel, vce, 2 * order, gammas)))
        out = {}
        for k in sides:
            part, (G, beta) = parts[*k, o], fitted[k]
            nu = part["nu"]
            bias = math.sqrt(2 * (o + 1 - nu)) * part["bconst"] * float(beta[o + 1] @ part["s"]) / h[k] ** (o + 1)
            reg = 0.0
            if regularised:
                var = float(_vmat(G, rs[k], order, ms[at[k]]["n"], vce)[o + 1, o + 1]) / h[k] ** (2 * (o + 1))
                reg = scaleregul * 2 * (o + 1 - nu) * 3 * part["bconst"] ** 2 * var
            out[k] = (part["V"], bias, reg)
        return out

    def widths(parts_: dict, o: int) -> dict:
        return {k: max(min((V / (B ** 2 + scaleregul * R)) ** (1.0 / (2 * o + 3)), ranges[k[0]][k[1]]), floors[k[0]][k[1]]) for k, (V, B, R) in parts_.items()}

    # d: order q+1 derivative, bias from an order q+2 fit on the whole side (no regularisation)
    d_bw = widths(stage(q + 1, q + 2, {(i, s): ranges[i][s] + 1e-8 for i, s in sides}, False, True), q + 1)
    b_bw = widths(stage(q, q + 1, d_bw, scaleregul > 0), q)
    h_bw = widths(stage(p, q, b_bw, scaleregul > 0), p)
    for i in live:
        found[i] |= dict(h_left=float(h_bw[i, 0]), h_right=float(h_bw[i, 1]), b_left=float(b_bw[i, 0]), b_right=float(b_bw[i, 1]), pilot=float(pilot[i]))
    return found


def _spreads(cells: CellTable, samples: Sequence[int]) -> dict[int, float]:
    """min(sd, IQR / 1.349) of the running variable in each sample."""
    own, out = cells.own(), {}
    means = {o: cells.samples[o]["sum"] / cells.samples[o]["n"] for o in samples}
    gap = F.col("x") - F.element_at(F.create_map(*(F.lit(v) for kv in means.items() for v in kv)), F.col("o"))
    squares = {r["o"]: r["ss"] for r in own.filter(F.col("o").isin(list(means))).groupBy("o").agg(F.sum(F.col("n") * gap * gap).alias("ss")).collect()}
    for o in samples:
        s = cells.samples[o]
        sd = math.sqrt(squares[o] / (s["n"] - 1))
        q1, q3 = exact_quantiles(own.filter(F.col("o") == o), "x", s["n"], s["lo"], s["hi"], (0.25, 0.75), weight="n")
        out[o] = min(sd, (q3 - q1) / 1.349) if q3 > q1 else sd
    return out


def rule_factor(rule: str, n: int, p: int) -> float:
    """What a rule scales the MSE-optimal h by."""
    return n ** (-(p / ((3 + p) * (3 + 2 * p)))) if rule == "certwo" else 1.0


def rd_bandwidth(df: DataFrame, x: str, y: str, c: float = 0.0, treat: str | None = None, group: str | None = None,
                 p: int = 1, q: int = 2, kernel: str = "triangular", vce: str = "nn", rule: str | Sequence[str] = "msetwo",
                 scaleregul: float = 1.0, as_dict: bool = False, nnmatch: int = 3, masspoints: str = "off"):
    """Per-side bandwidths (h_left, h_right, b_left, b_right) for the order-p estimate at `c`.

    `rule` may be a list ("msetwo", "certwo"): the coverage-error rule only rescales
    h, so every listed rule comes from the same passes (one row per rule).
    """
    rules = [rule] if isinstance(rule, str) else list(rule)
    if not rules or any(r not in ("msetwo", "certwo") for r in rules):
        raise ValueError("rule must be 'msetwo' or 'certwo'")
    cells = CellTable(df, x, [y], treat, group, nnmatch=nnmatch, neighbours=vce == "nn")
    try:
        [got] = select_bandwidths(cells, [Selection(0, c, treat is not None)], p, q, kernel, vce, scaleregul, masspoints)
    finally:
        cells.drop()
    outs = []
    for r in rules:
        h = {k: None if got[k] is None else got[k] * rule_factor(r, got["N"], p) for k in ("h_left", "h_right")}
        outs.append(dict(rule=r, **h, **{k: got[k] for k in ("b_left", "b_right", "pilot", "n_left", "n_right")}))
    if as_dict:
        return outs[0] if isinstance(rule, str) else outs
    return df.sparkSession.createDataFrame([tuple(o.values()) for o in outs], BANDWIDTH_SCHEMA)
