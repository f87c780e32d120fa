"""Regression discontinuity on Spark: local-polynomial estimates (sharp, fuzzy,
with group controls), spec grids, data-driven bandwidths.

Every pass over the data is one `groupBy(spec, side[, group])` of kernel-weighted
moment sums (map-side combined, so hot keys cost nothing extra); the driver only
solves (p+1)×(p+1) and (q+1)×(q+1) systems per specification.
"""

from panelrd.operators.rd.core import RDSpec, rd_grid, rd, RESULT_COLUMNS, SIDE_COLUMNS
from panelrd.operators.rd.bandwidth import rd_bandwidth
from panelrd.operators.rd.robustness import AutoSpec, rd_robustness

__all__ = ["AutoSpec", "RDSpec", "rd_robustness", "rd_grid", "rd", "rd_bandwidth", "RESULT_COLUMNS", "SIDE_COLUMNS"]
