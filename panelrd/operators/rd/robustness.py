"""Many RD estimates with bandwidths chosen from the data, all from one cell table.

Outcomes, cutoffs, bandwidth rules and factors of a robustness study share the same rows: they are read once, bandwidths are
selected for every different (outcome, cutoff) at the same time, and the estimates of all specifications take two jobs more.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from panelrd.operators.rd.bandwidth import Selection, rule_factor, select_bandwidths
from panelrd.operators.rd.cells import CellTable
from panelrd.operators.rd.core import RDSpec, _grid_from_cells


@dataclass(frozen=True)
class AutoSpec:
    """One estimate with selected bandwidths.

    `factor` takes h and b at that multiple of the selected bandwidth `base`: "h", the estimate's, or "b", the bias's;
    without it, both are as selected.
    """

    name: str
    outcome: str
    c: float = 0.0
    fuzzy: bool = True
    bwselect: str = "msetwo"
    factor: float | None = None
    base: str = "h"


def rd_robustness(df: DataFrame, x: str, specs: Sequence[AutoSpec], treat: str | None = None, group: str | None = None, p: int = 1, q: int = 2,
                  kernel: str = "triangular", level: float = 95.0, nnmatch: int = 3, return_sides: bool = False, nn_bucket: int | None = None, masspoints: str = "off"):
    """Estimates (RESULT_SCHEMA, three rows for each spec) with neighbour variance; the number of jobs does not depend on that of specs.

    Rows with NULL or NaN in x, the outcome, the treatment or the group take no part in that outcome's fits.  A spec whose
    sample has too few rows on a side gives rows of NULLs.  `masspoints` "adjust" lets bandwidths heed repeated values of x.
    """
    if q < p + 1:
        raise ValueError("q must be at least p + 1")
    if any(s.bwselect not in ("msetwo", "certwo") or s.base not in ("h", "b") for s in specs):
        raise ValueError("bwselect must be 'msetwo' or 'certwo', base 'h' or 'b'")
    if any(s.fuzzy for s in specs) and treat is None:
        raise ValueError("a fuzzy spec needs `treat`")
    cells = CellTable(df, x, list(dict.fromkeys(s.outcome for s in specs)), treat, group, None, nnmatch, nn_bucket)
    try:
        place = {o: i for i, o in enumerate(cells.outcomes)}
        of = [Selection(place[s.outcome], float(s.c), s.fuzzy) for s in specs]
        selections = list(dict.fromkeys(of))
        chosen = dict(zip(selections, select_bandwidths(cells, selections, p, q, kernel, masspoints=masspoints)))
        filled, totals = [], []
        for s, selection in zip(specs, of):
            got = chosen[selection]
            totals.append((got["n_left"], got["n_right"]))
            if got["h_left"] is None:  # too few rows on a side: no window, so rows of NULLs
                filled.append(RDSpec(s.name, s.outcome, s.c, 0.0, 0.0, 0.0, 0.0, s.fuzzy))
                continue
            rule = rule_factor(s.bwselect, got["N"], p)
            h, b = [got[f"h_{side}"] * rule for side in ("left", "right")], [got[f"b_{side}"] for side in ("left", "right")]
            if s.factor is not None:
                h = b = [s.factor * v for v in (h if s.base == "h" else b)]
            filled.append(RDSpec(s.name, s.outcome, s.c, *h, *b, s.fuzzy))
        return _grid_from_cells(cells, filled, totals, p, q, kernel, level, return_sides)
    finally:
        cells.drop()
