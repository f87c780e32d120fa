"""One table of sufficient statistics from which any number of RD fits are computed.

Rows are summed once to cells (sample, x, group): their number and the sums of y, y², t, t² and yt.  A sample is an outcome
with its own complete rows.  Cells are written, in buckets of ordered x with the neighbours of each bucket's border
values, so that bandwidth stages, factors, cutoffs and variances read the table and never the rows again; neighbours on
the other side of a cutoff or outside a window are left out by the window's own bounds.

A pass takes a list of fits and is one job whatever its length.  The list goes into the plan as one literal, so the
generated code of a pass does not depend on the numbers in it and is compiled once.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrd.operators.attach import BROADCAST_ROWS, attach
from panelrd.operators.rd import nn
from panelrd.session import drop_shared, jit_friendly, save_shared

_FIT = ("array<struct<w:int,o:int,c:double,right:boolean,lo:double,hi:double,h:double,b:double,scale:double,n:bigint,gid:int,"
        "sy:double,st:double,kh:array<double>,kb:array<double>>>")
_NUMBER = ("n", "Y", "T", "YY", "TT", "YT")


@dataclass
class Fit:
    """A window of one sample on one side of c, with kernels of bandwidths h and b and powers of (x − c)/scale.

    For residuals: n rows of the window, the combination sy·y + st·t less the coefficients of the group in set `gid`, and
    for residuals from a fit its coefficients.
    """

    o: int
    c: float
    right: bool
    h: float
    b: float | None = None
    scale: float | None = None
    n: int = 0
    sy: float = 1.0
    st: float = 0.0
    kh: list[float] = field(default_factory=list)
    kb: list[float] = field(default_factory=list)
    gid: int = -1

    def row(self, w: int) -> dict:
        b = self.h if self.b is None else self.b
        wide = max(self.h, b)
        lo, hi = (self.c, self.c + wide) if self.right else (self.c - wide, self.c)
        scale = wide if self.scale is None else self.scale
        return dict(w=w, o=self.o, c=self.c, right=self.right, lo=lo, hi=hi, h=self.h, b=b, scale=scale, n=int(self.n), gid=self.gid, sy=self.sy, st=self.st,
                    kh=[float(v) for v in self.kh], kb=[float(v) for v in self.kb])


class Moments(list):
    """Sums of each fit (dicts), and with groups `levels`: the same by (w, g), the number of the fit and the level."""

    levels: DataFrame | None = None


def solve(A: np.ndarray, B: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(A, B)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(A) @ B


def gram(m: dict, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Γ and Σ w r (y, t) of a fit from its moments."""
    get = lambda name: m.get(name) or 0.0
    G = np.array([[get(f"S{a + b}") for b in range(order + 1)] for a in range(order + 1)])
    return G, np.array([[get(f"Y{a}"), get(f"T{a}")] for a in range(order + 1)])


def known(c: Column) -> Column:
    """Neither NULL nor NaN."""
    return c.isNotNull() & ~F.isnan(c)


def kernel_weight(u: Column, h, kernel: str) -> Column:
    """K(u/h)/h for the triangular, uniform or Epanechnikov kernel (0 outside |u| ≤ h)."""
    h = h if isinstance(h, Column) else F.lit(float(h))
    r = F.abs(u) / h
    if kernel == "triangular":
        k = 1.0 - r
    elif kernel == "uniform":
        k = F.lit(0.5)
    elif kernel == "epanechnikov":
        k = 0.75 * (1.0 - r * r)
    else:
        raise ValueError(f"unknown kernel {kernel}")
    return F.when(r <= 1.0, k / h).otherwise(F.lit(0.0))


def powers(z: Column, most: int) -> list[Column]:
    """z⁰ … z^most by multiplication."""
    out = [F.lit(1.0), z]
    while len(out) <= most:
        out.append(out[len(out) // 2] * out[len(out) - len(out) // 2])
    return out


class CellTable:
    """Cells of `df` for each of `outcomes`; `x_range` keeps only the rows that the fits will read.  Call `drop` when done."""

    def __init__(self, df: DataFrame, x: str, outcomes: Sequence[str], treat: str | None = None, group: str | None = None,
                 x_range: tuple[float, float] | None = None, nnmatch: int = 3, per_bucket: int | None = None, neighbours: bool = True):
        self.outcomes, self.group, self.nnmatch = list(outcomes), group, nnmatch
        self.tables: list[DataFrame] = []
        xc, t = F.col(x).cast("double"), F.col(treat).cast("double") if treat else F.lit(0.0)
        valid = known(xc) & known(t) if treat else known(xc)
        if group:
            valid = valid & F.col(group).isNotNull()
        if x_range:
            valid = valid & (F.col(x) >= x_range[0]) & (F.col(x) <= x_range[1])
        y = F.explode(F.array_compact(F.array(*(F.when(known(F.col(o).cast("double")), F.struct(F.lit(i).alias("o"), F.col(o).cast("double").alias("y"))) for i, o in enumerate(self.outcomes)))))
        rows = df.filter(valid).select(xc.alias("x"), t.alias("t"), (F.col(group).cast("string") if group else F.lit("")).alias("g"), y.alias("s"))
        yc, tc = F.col("s.y"), F.col("t")
        sums = [F.sum(v).alias(name) for name, v in zip(_NUMBER[1:], (yc, tc, yc * yc, tc * tc, yc * tc))]
        with jit_friendly(df.sparkSession):
            cells = self._keep(rows.groupBy(F.col("s.o").alias("o"), "x", "g").agg(F.count(F.lit(1)).alias("n"), *sums))
            self.spark = df.sparkSession
            self.samples = {r["o"]: r.asDict() for r in cells.groupBy("o").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum(F.col("n") * F.col("x")).alias("sum"), F.min("g").alias("base")).collect()}
            per_bucket = per_bucket or nn.PER_BUCKET
            if neighbours and any(s["cells"] > per_bucket for s in self.samples.values()):
                cells = self._keep(nn.with_halo(cells, ["o"], "x", nnmatch, per_bucket))
            else:  # every sample is one bucket
                cells = cells.withColumns({"_b": F.array(F.lit(0).cast("long")), "_halo": F.lit(False)})
        self.cells = cells

    def _keep(self, df: DataFrame) -> DataFrame:
        self.tables.append(save_shared(df, "rd-cells"))
        return self.tables[-1]

    def drop(self) -> None:
        """Delete the written tables."""
        for t in self.tables:
            drop_shared(t)
        self.tables = []

    def own(self) -> DataFrame:
        """The cells without the copies at bucket borders."""
        return self.cells.filter(~F.col("_halo"))

    def sides(self, at: Sequence[tuple[int, float]]) -> list[tuple[int, int]]:
        """Rows on the left and right for each (sample, cutoff)."""
        cuts = sorted(set(at))
        sums = [F.sum(F.when((F.col("o") == o) & side, F.col("n"))).alias(f"{name}{i}") for i, (o, c) in enumerate(cuts) for name, side in (("l", F.col("x") < c), ("r", F.col("x") >= c))]
        r = self.own().agg(*sums).first()
        found = {cut: (int(r[f"l{i}"] or 0), int(r[f"r{i}"] or 0)) for i, cut in enumerate(cuts)}
        return [found[(o, c)] for o, c in at]

    def distinct_sides(self, at: Sequence[tuple[int, float]]) -> list[tuple[int, int]]:
        """Distinct values on the left and right for each (sample, cutoff)."""
        cuts = sorted(set(at))
        values = self.own().select("o", "x").distinct() if self.group else self.own().select("o", "x")
        sums = [F.count_if((F.col("o") == o) & side).alias(f"{name}{i}") for i, (o, c) in enumerate(cuts) for name, side in (("l", F.col("x") < c), ("r", F.col("x") >= c))]
        r = values.agg(*sums).first()
        found = {cut: (int(r[f"l{i}"]), int(r[f"r{i}"])) for i, cut in enumerate(cuts)}
        return [found[(o, c)] for o, c in at]

    def nearest(self, o: int, c: float, k: int) -> tuple[float, float]:
        """How far the k-th distinct value of each side is from c; the farthest where there are fewer."""
        out = []
        for side in (F.col("x") < c, F.col("x") >= c):
            gap = F.abs(F.col("x") - F.lit(c)).alias("gap")
            out.append(max(r["gap"] for r in self.own().filter((F.col("o") == o) & side).select(gap).distinct().orderBy("gap").limit(k).collect()))
        return tuple(out)

    def _windows(self, cells: DataFrame, fits: Sequence[Fit], *keep: str) -> DataFrame:
        """Each cell once for every fit whose window holds it, with `f`, the fit."""
        rows = [f.row(i) for i, f in enumerate(fits)]
        given = F.from_json(F.lit(json.dumps(rows)), _FIT)
        x = F.col("x")
        holds = lambda f: (f["o"] == F.col("o")) & (x >= f["lo"]) & (x <= f["hi"]) & (f["right"] | (x < f["c"]))
        near = cells.filter((x >= min(r["lo"] for r in rows)) & (x <= max(r["hi"] for r in rows)))
        return near.select("x", "g", *_NUMBER, *keep, F.explode(F.filter(given, holds)).alias("f"))

    def moments(self, fits: Sequence[Fit], kernel: str, most: int, most_y: int) -> Moments:
        """For each fit: n, rows with weight `np`, Σ k zᵐ as S, Σ k zᵐ y as Y, Σ k zᵐ t as T; with groups also by level, as a table."""
        e = self._windows(self.own(), fits)
        u = F.col("x") - F.col("f.c")
        e = e.select(F.col("f.w").alias("w"), "g", "n", "Y", "T", (u / F.col("f.scale")).alias("z"), kernel_weight(u, F.col("f.h"), kernel).alias("k"))
        z, k = powers(F.col("z"), max(most, most_y)), F.col("k")
        sums = [F.sum("n").alias("n"), F.sum(F.when(k > 0, F.col("n")).otherwise(F.lit(0))).alias("np")] + [F.sum(k * z[m] * F.col("n")).alias(f"S{m}") for m in range(most + 1)]
        sums += [F.sum(k * z[m] * F.col(c)).alias(f"{c}{m}") for c in "YT" for m in range(most_y + 1)]
        out = Moments(dict(n=0, np=0) for _ in fits)
        with jit_friendly(self.spark):
            if self.group:
                out.levels = self._few_or_kept(e.groupBy("w", "g").agg(*sums))
                e = out.levels
                sums = [F.sum(c).alias(c) for c in e.columns if c not in ("w", "g")]
            for r in e.groupBy("w").agg(*sums).collect():
                out[r["w"]] |= r.asDict()
        return out

    def _few_or_kept(self, df: DataFrame) -> DataFrame:
        """A table by group level: held by the driver while it has few rows (fetched up to a bound), written else."""
        rows = df.limit(BROADCAST_ROWS + 1).collect()
        return self.spark.createDataFrame(rows, df.schema) if len(rows) <= BROADCAST_ROWS else self._keep(df)

    def gammas(self, moments: Moments, sets: Sequence[tuple[Sequence[int], int]]) -> DataFrame | None:
        """Group coefficients (gid, g, gy, gt) of each of `sets` (fits, order), common to its fits: one fit, or both sides of a cutoff.

        With Γ = Σ w r rᵀ and β of each fit, and U = Σ w r, d = Σ w, ζ = Σ w (y, t) of a level (over its fits), the normal equations
        of the dummies are diagonal minus low rank.  So a level's coefficients are (ζ − Uᵀ q) / d with one small q for all levels,
        which follows from Σ U Uᵀ / d and Σ U ζᵀ / d: only these sums come to the driver, however many levels there are.
        """
        if not self.group:
            return None
        size = max(o for _, o in sets) + 1
        sides = max(len(ws) for ws, _ in sets)
        rows = [dict(gid=gid, w=w, pos=pos, k=o + 1) for gid, (ws, o) in enumerate(sets) for pos, w in enumerate(ws)]
        given = F.from_json(F.lit(json.dumps(rows)), "array<struct<gid:int,w:int,pos:int,k:int>>")
        base = min(s["base"] for s in self.samples.values())  # the first level is the base
        e = moments.levels.filter(F.col("g") != base).select("*", F.explode(F.filter(given, lambda q: q["w"] == F.col("w"))).alias("q"))
        names = [f"p{s}_{m}" for s in range(sides) for m in range(size)]
        own = [F.sum(F.when((F.col("q.pos") == s) & (F.col("q.k") > m), F.col(f"S{m}")).otherwise(F.lit(0.0))).alias(f"p{s}_{m}") for s in range(sides) for m in range(size)]
        by = e.groupBy("q.gid", "g").agg(*own, F.sum("S0").alias("d"), F.sum("Y0").alias("zy"), F.sum("T0").alias("zt")).filter(F.col("d") > 0)
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
        sums = [F.sum(F.col(a) * F.col(b) / F.col("d")).alias(f"{a}x{b}") for a, b in pairs] + [F.sum(F.col(a) * F.col(c) / F.col("d")).alias(f"{a}{c}") for a in names for c in ("zy", "zt")]
        with jit_friendly(self.spark):
            got = {r["gid"]: r for r in by.groupBy("gid").agg(*sums).collect()}
        solved = []
        for gid, (ws, o) in enumerate(sets):
            if gid not in got:
                continue
            r, k = got[gid], o + 1
            mine = [f"p{s}_{m}" for s in range(len(ws)) for m in range(k)]
            A = np.array([[r[f"{a}x{b}"] if f"{a}x{b}" in r else r[f"{b}x{a}"] for b in mine] for a in mine])
            B = np.array([[r[f"{a}zy"], r[f"{a}zt"]] for a in mine])
            M, beta = np.zeros((len(mine), len(mine))), np.zeros((len(mine), 2))
            for s, w in enumerate(ws):
                G, R = gram(moments[w], o)
                M[s * k:(s + 1) * k, s * k:(s + 1) * k], beta[s * k:(s + 1) * k] = G, solve(G, R)
            q = beta - np.linalg.pinv(M - A) @ (B - A @ beta)
            full = np.zeros((sides * size, 2))
            for s in range(len(ws)):
                full[s * size:s * size + k] = q[s * k:(s + 1) * k]
            solved.append(dict(gid=gid, qy=full[:, 0].tolist(), qt=full[:, 1].tolist()))
        q = F.filter(F.from_json(F.lit(json.dumps(solved)), "array<struct<gid:int,qy:array<double>,qt:array<double>>>"), lambda x: x["gid"] == F.col("gid"))[0]
        by = by.withColumn("q", q)
        less = lambda z, c: ((F.col(z) - sum((F.col(n) * F.col(f"q.{c}")[i] for i, n in enumerate(names)), F.lit(0.0))) / F.col("d"))
        return self._few_or_kept(by.select("gid", "g", less("zy", "qy").alias("gy"), less("zt", "qt").alias("gt")))

    def adjusted(self, moments: Moments, of: dict[int, int], gammas: DataFrame | None, most_y: int) -> dict[int, dict]:
        """The moments of the fits in `of` (fit → set) with y and t less their groups' coefficients of that set."""
        out = {w: dict(moments[w]) for w in of}
        if gammas is None or not of:
            return out
        given = F.from_json(F.lit(json.dumps([dict(w=w, gid=g) for w, g in of.items()])), "array<struct<w:int,gid:int>>")
        e = moments.levels.select("*", F.explode(F.filter(given, lambda q: q["w"] == F.col("w"))["gid"]).alias("gid")).join(gammas, ["gid", "g"])
        sums = [F.sum(F.col(f"S{m}") * F.col(c)).alias(f"{name}{m}") for name, c in (("Y", "gy"), ("T", "gt")) for m in range(most_y + 1)]
        for r in e.groupBy("w").agg(*sums).collect():
            for name, v in r.asDict().items():
                if name != "w":
                    out[r["w"]][name] = (out[r["w"]].get(name) or 0.0) - (v or 0.0)
        return out

    def residuals(self, fits: Sequence[Fit], kernel: str, vce: str, most: int, gammas: DataFrame | None = None) -> list[dict]:
        """For each fit: Σ E zᵐ k_h² as HH, Σ E zᵐ k_h k_b as HB, Σ E zᵐ k_b² as BB, E the squared residuals of the combination.

        "nn": residuals from the nearest neighbours.  "hc": from the fits given by kh, and by kb for the sums with k_b.
        """
        e = self._windows(self.cells if vce == "nn" else self.own(), fits, "_b", "_halo")
        if gammas is not None:
            e = attach(e.withColumn("gid", F.col("f.gid")), gammas, ["gid", "g"])
            sg = -(F.col("f.sy") * F.coalesce("gy", F.lit(0.0)) + F.col("f.st") * F.coalesce("gt", F.lit(0.0)))
        else:
            sg = F.lit(0.0)
        n, y, t, sy, st = (F.col(c) for c in ("n", "Y", "T", "f.sy", "f.st"))
        s = sy * y + st * t + sg * n
        q = sy * sy * F.col("YY") + 2 * sy * st * F.col("YT") + st * st * F.col("TT") + 2 * sg * (sy * y + st * t) + sg * sg * n
        e = e.select(F.col("f.w").alias("w"), "_b", "_halo", "x", "f", n.alias("_d"), s.alias("_S"), q.alias("_Q"), F.col("f.n").alias("_n"))
        if vce == "nn":
            if self.group:
                e = e.groupBy("w", "_b", "x").agg(*(F.sum(c).alias(c) for c in ("_d", "_S", "_Q")), *(F.first(c).alias(c) for c in ("f", "_n", "_halo")))
            e = nn.squared_residuals(e, ["w", "_b"], "x", self.nnmatch).filter(~F.col("_halo")).withColumns({"_Eh": F.col("_E"), "_Eb": F.col("_E")})
        u = F.col("x") - F.col("f.c")
        e = e.withColumns({"z": u / F.col("f.scale"), "kh": kernel_weight(u, F.col("f.h"), kernel), "kb": kernel_weight(u, F.col("f.b"), kernel)})
        z, kh, kb = powers(F.col("z"), max(most, 1)), F.col("kh"), F.col("kb")
        if vce != "nn":
            fitted = lambda c: sum((F.coalesce(F.get(F.col(f"f.{c}"), F.lit(m)), F.lit(0.0)) * z[m] for m in range(most // 2 + 1)), F.lit(0.0))
            left = lambda v: F.col("_Q") - 2 * v * F.col("_S") + v * v * F.col("_d")
            e = e.withColumns({"_vh": fitted("kh"), "_vb": fitted("kb")}).withColumns({"_Eh": left(F.col("_vh")), "_Eb": left(F.col("_vb"))})
        sums = [F.sum(F.col(E) * k * z[m]).alias(f"{name}{m}") for name, E, k in (("HH", "_Eh", kh * kh), ("HB", "_Eb", kh * kb), ("BB", "_Eb", kb * kb), *([("HHb", "_Eb", kh * kh)] if vce != "nn" else [])) for m in range(most + 1)]
        with jit_friendly(self.spark):
            found = {r["w"]: r.asDict() for r in e.groupBy("w").agg(*sums).collect()}
        return [found.get(i, {}) for i in range(len(fits))]
