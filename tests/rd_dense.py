"""Dense single-machine RD formulas, used only by the tests as a cross-check
of the distributed moment implementation (small collected fixtures only)."""

from __future__ import annotations

import numpy as np


def kw(u, h, kernel="triangular"):
    r = np.abs(u) / h
    if kernel == "triangular":
        k = 1 - r
    elif kernel == "uniform":
        k = 0.5 * np.ones_like(r)
    else:
        k = 0.75 * (1 - r * r)
    return np.where(r <= 1, k / h, 0.0)


def side_fit(x, D, c, h, b, p, q, kernel):
    u = x - c
    ind = np.abs(u) <= max(h, b)
    u, D = u[ind], D[ind]
    wh, wb = kw(u, h, kernel), kw(u, b, kernel)
    Rq = np.vander(u, q + 1, increasing=True)
    Rp = Rq[:, : p + 1]
    Gp = (Rp * wh[:, None]).T @ Rp
    Gq = (Rq * wb[:, None]).T @ Rq
    iGp, iGq = np.linalg.inv(Gp), np.linalg.inv(Gq)
    L = (Rp * wh[:, None]).T @ (u ** (p + 1))
    e = np.zeros(q + 1)
    e[p + 1] = 1
    Q = (Rp * wh[:, None]).T - np.outer(L, e) @ (iGq @ (Rq * wb[:, None]).T)
    bp = iGp @ (Rp * wh[:, None]).T @ D
    bq = iGq @ (Rq * wb[:, None]).T @ D
    bbc = iGp @ Q @ D
    return dict(u=u, D=D, wh=wh, wb=wb, Rp=Rp, Rq=Rq, iGp=iGp, Q=Q, bp=bp, bq=bq, bbc=bbc, n=len(u), nh=int((wh > 0).sum()))


def rd_dense(x, y, c, h, b, t=None, groups=None, p=1, q=2, kernel="triangular", vce="hc1"):
    """Returns (tau_cl, tau_bc, se_cl, se_rb) following the published estimator."""
    cols = [y] + ([t] if t is not None else [])
    nbase = len(cols)
    if groups is not None:
        levels = sorted(set(groups))[1:]
        cols += [(groups == g).astype(float) for g in levels]
    D = np.column_stack(cols)
    fl = side_fit(x[x < c], D[x < c], c, h, b, p, q, kernel)
    fr = side_fit(x[x >= c], D[x >= c], c, h, b, p, q, kernel)
    nD = D.shape[1]
    if nD > nbase:
        Z = list(range(nbase, nD))
        ZWZ = np.zeros((len(Z), len(Z)))
        ZWY = np.zeros((len(Z), nbase))
        for f in (fl, fr):
            Zm = f["D"][:, Z]
            U = (f["Rp"] * f["wh"][:, None]).T @ f["D"]
            ZWD = (Zm * f["wh"][:, None]).T @ f["D"]
            UiGU = U[:, Z].T @ f["iGp"] @ U
            ZWZ += ZWD[:, Z] - UiGU[:, Z]
            ZWY += ZWD[:, :nbase] - UiGU[:, :nbase]
        gamma = np.linalg.pinv(ZWZ) @ ZWY
    else:
        gamma = np.zeros((0, nbase))
    sY = np.concatenate([[1.0], [0.0] * (nbase - 1), -gamma[:, 0]])
    dp = fr["bp"][0] - fl["bp"][0]
    dbc = fr["bbc"][0] - fl["bbc"][0]
    if t is None:
        tau_cl, tau_bc, s = sY @ dp, sY @ dbc, sY
    else:
        sT = np.concatenate([[0.0, 1.0], -gamma[:, 1]])
        tY, tT = sY @ dp, sT @ dp
        tau_cl = tY / tT
        tau_bc = (sY @ dbc) / (sT @ dbc)
        s = sY / tT - tY / tT ** 2 * sT
    V = {"cl": 0.0, "rb": 0.0}
    for f in (fl, fr):
        res_h = (f["D"] - f["Rp"] @ f["bp"]) @ s
        res_b = (f["D"] - f["Rq"] @ f["bq"]) @ s
        n = f["n"]
        wcl = n / (n - p - 1) if vce == "hc1" else 1.0
        wrb = n / (n - q - 1) if vce == "hc1" else 1.0
        RW = f["Rp"] * f["wh"][:, None]
        Mcl = (RW * (res_h ** 2)[:, None]).T @ RW * wcl
        Mrb = (f["Q"] * (res_b ** 2)[None, :]) @ f["Q"].T * wrb
        V["cl"] += (f["iGp"] @ Mcl @ f["iGp"])[0, 0]
        V["rb"] += (f["iGp"] @ Mrb @ f["iGp"])[0, 0]
    return float(tau_cl), float(tau_bc), float(np.sqrt(V["cl"])), float(np.sqrt(V["rb"]))


def nn_residuals(x, w, J=3):
    """Nearest-neighbour residuals (matches J, ties taken as whole groups), x sorted ascending."""
    n = len(x)
    dups = np.zeros(n, dtype=int)
    dupsid = np.zeros(n, dtype=int)
    i = 0
    while i < n:
        j = i
        while j < n and x[j] == x[i]:
            j += 1
        dups[i:j] = j - i
        dupsid[i:j] = np.arange(1, j - i + 1)
        i = j
    res = np.zeros(n)
    for pos in range(n):
        rpos = dups[pos] - dupsid[pos]
        lpos = dupsid[pos] - 1
        while lpos + rpos < min(J, n - 1):
            if pos - lpos - 1 < 0:
                rpos += dups[pos + rpos + 1]
            elif pos + rpos + 1 >= n:
                lpos += dups[pos - lpos - 1]
            elif x[pos] - x[pos - lpos - 1] > x[pos + rpos + 1] - x[pos]:
                rpos += dups[pos + rpos + 1]
            elif x[pos] - x[pos - lpos - 1] < x[pos + rpos + 1] - x[pos]:
                lpos += dups[pos - lpos - 1]
            else:
                rpos += dups[pos + rpos + 1]
                lpos += dups[pos - lpos - 1]
        lo, hi = pos - lpos, pos + rpos
        yJ = w[lo:hi + 1].sum() - w[pos]
        Ji = hi - lo
        res[pos] = np.sqrt(Ji / (Ji + 1)) * (w[pos] - yJ / Ji)
    return res


def rd_dense_nn(x, y, c, h, b, t=None, p=1, q=2, kernel="triangular", J=3, groups=None, hr=None, br=None):
    """Sharp/fuzzy RD with nearest-neighbour variance, optional group controls and per-side bandwidths."""
    cols = [y, t if t is not None else np.zeros_like(y)]
    if groups is not None:
        levels = sorted(set(groups))[1:]
        cols += [(groups == g).astype(float) for g in levels]
    D = np.column_stack(cols)
    hr = h if hr is None else hr
    br = b if br is None else br
    fits = []
    for mask, hh, bb in ((x < c, h, b), (x >= c, hr, br)):
        o = np.argsort(x[mask], kind="stable")
        fits.append(side_fit(x[mask][o], D[mask][o], c, hh, bb, p, q, kernel))
    fl, fr = fits
    nz = D.shape[1] - 2
    if nz:
        ZWZ = np.zeros((nz, nz))
        ZWY = np.zeros((nz, 2))
        for f in fits:
            U = (f["Rp"] * f["wh"][:, None]).T @ f["D"]
            ZWD = (f["D"][:, 2:] * f["wh"][:, None]).T @ f["D"]
            UiGU = U[:, 2:].T @ f["iGp"] @ U
            ZWZ += ZWD[:, 2:] - UiGU[:, 2:]
            ZWY += ZWD[:, :2] - UiGU[:, :2]
        gamma = np.linalg.pinv(ZWZ) @ ZWY
    else:
        gamma = np.zeros((0, 2))
    sY = np.concatenate([[1.0, 0.0], -gamma[:, 0]])
    sT = np.concatenate([[0.0, 1.0], -gamma[:, 1]])
    dp = fr["bp"][0] - fl["bp"][0]
    dbc = fr["bbc"][0] - fl["bbc"][0]
    if t is None:
        s = sY
        tau_cl, tau_bc = sY @ dp, sY @ dbc
    else:
        tY, tT = sY @ dp, sT @ dp
        tau_cl, tau_bc = tY / tT, (sY @ dbc) / (sT @ dbc)
        s = sY / tT - tY / tT ** 2 * sT
    V = {"cl": 0.0, "rb": 0.0}
    for f in fits:
        xs = f["u"]
        res = nn_residuals(xs, f["D"] @ s, J)
        RW = f["Rp"] * f["wh"][:, None]
        Mcl = (RW * (res ** 2)[:, None]).T @ RW
        Mrb = (f["Q"] * (res ** 2)[None, :]) @ f["Q"].T
        V["cl"] += (f["iGp"] @ Mcl @ f["iGp"])[0, 0]
        V["rb"] += (f["iGp"] @ Mrb @ f["iGp"])[0, 0]
    return float(tau_cl), float(tau_bc), float(np.sqrt(V["cl"])), float(np.sqrt(V["rb"]))


def _bw_side(x, D, c, o, nu, o_B, h_V, h_B, scale, s_fixed, kernel, vce, J, nz):
    """One side of one plug-in stage (dense).  Returns V, B, R and the s vector."""
    import math

    u = x - c
    indV = np.abs(u) <= h_V
    uV, DV = u[indV], D[indV]
    w = kw(uV, h_V, kernel)
    R = np.vander(uV, o + 1, increasing=True)
    G = (R * w[:, None]).T @ R
    iG = np.linalg.inv(G)
    beta = iG @ (R * w[:, None]).T @ DV
    if nz:
        U = (R * w[:, None]).T @ DV
        Z = DV[:, 2:]
        ZWD = (Z * w[:, None]).T @ DV
        UiGU = U[:, 2:].T @ iG @ U
        gamma = np.linalg.pinv(ZWD[:, 2:] - UiGU[:, 2:]) @ (ZWD[:, :2] - UiGU[:, :2])
    else:
        gamma = np.zeros((0, 2))
    if s_fixed is None:
        s = np.concatenate([[1.0, 0.0], -gamma[:, 0]])
    else:
        ty, tt = math.factorial(nu) * beta[nu, 0], math.factorial(nu) * beta[nu, 1]
        s = np.concatenate([[1 / tt, -ty / tt ** 2], -gamma[:, 0] / tt + ty / tt ** 2 * gamma[:, 1]])

    def meat(uu, DD, RR, ww, bb):
        o_ = np.argsort(uu, kind="stable")
        if vce == "nn":
            r = nn_residuals(uu[o_] + c, (DD @ s)[o_], J)
            rr = np.empty_like(r)
            rr[o_] = r
        else:
            rr = (DD - RR @ bb) @ s
            if vce == "hc1":
                rr = rr * np.sqrt(len(uu) / (len(uu) - RR.shape[1]))
        RW = RR * ww[:, None]
        return (RW * (rr ** 2)[:, None]).T @ RW

    VV = (iG @ meat(uV, DV, R, w, beta) @ iG)[nu, nu]
    v = (R * w[:, None]).T @ ((uV / h_V) ** (o + 1))
    Hp = h_V ** np.arange(o + 1)
    BConst = (Hp * (iG @ v))[nu]
    indB = np.abs(u) <= h_B
    uB, DB = u[indB], D[indB]
    wB = kw(uB, h_B, kernel)
    RB = np.vander(uB, o_B + 1, increasing=True)
    GB = (RB * wB[:, None]).T @ RB
    iGB = np.linalg.inv(GB)
    betaB = iGB @ (RB * wB[:, None]).T @ DB
    BWreg = 0.0
    if scale > 0:
        VB = (iGB @ meat(uB, DB, RB, wB, betaB) @ iGB)[o + 1, o + 1]
        BWreg = 3 * BConst ** 2 * VB
    B = np.sqrt(2 * (o + 1 - nu)) * BConst * (s @ betaB[o + 1, :])
    V = (2 * nu + 1) * h_V ** (2 * nu + 1) * VV
    Rr = scale * (2 * (o + 1 - nu)) * BWreg
    return V, B, Rr


def bw_dense(x, y, c=0.0, t=None, groups=None, p=1, q=2, kernel="triangular", vce="nn", J=3, scale=1.0, c_bw=None, floors=(0.0, 0.0)):
    """Dense per-side MSE bandwidths (h_l, h_r, b_l, b_r) by the staged plug-in."""
    cols = [y, t if t is not None else np.zeros_like(y)]
    nz = 0
    if groups is not None:
        levels = sorted(set(groups))[1:]
        cols += [(groups == g).astype(float) for g in levels]
        nz = len(levels)
    D = np.column_stack(cols)
    N = len(x)
    sd = np.std(x, ddof=1)
    q1, q3 = np.quantile(x, [0.25, 0.75])
    spread = min(sd, (q3 - q1) / 1.349)
    rl, rr = abs(x.min() - c), abs(x.max() - c)
    C = {"triangular": 2.576, "uniform": 1.843, "epanechnikov": 2.435}[kernel]
    if c_bw is None:
        c_bw = min(C * spread * N ** (-0.2), max(rl, rr))
    out = {}
    for side, mask, rng in ((0, x < c, rl), (1, x >= c, rr)):
        xs, Ds = x[mask], D[mask]
        fz = None if t is None else True
        V, B, _ = _bw_side(xs, Ds, c, q + 1, q + 1, q + 2, c_bw, rng + 1e-8, 0.0, fz, kernel, vce, J, nz)
        d = max(min((V / B ** 2) ** (1 / (2 * (q + 1) + 3)), rng), floors[side])
        V, B, R = _bw_side(xs, Ds, c, q, p + 1, q + 1, c_bw, d, scale, fz, kernel, vce, J, nz)
        b = max(min((V / (B ** 2 + scale * R)) ** (1 / (2 * q + 3)), rng), floors[side])
        V, B, R = _bw_side(xs, Ds, c, p, 0, q, c_bw, b, scale, fz, kernel, vce, J, nz)
        h = max(min((V / (B ** 2 + scale * R)) ** (1 / (2 * p + 3)), rng), floors[side])
        out[side] = (h, b, c_bw)
    return out[0][0], out[1][0], out[0][1], out[1][1]
