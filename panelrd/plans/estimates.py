"""Fixed parameters of the estimator exercises (shared by the Spark queries and
their oracle SQL, so both sides use identical numbers)."""

from panelrd.operators.rd import AutoSpec, RDSpec

RD_H, RD_B = 15.0, 25.0
SHARP_SPECS = [RDSpec("sharp_y", "y", 0.0, RD_H, RD_H, RD_B, RD_B), RDSpec("balance_e", "e", 0.0, RD_H, RD_H, RD_B, RD_B)]
FUZZY_SPECS = [RDSpec("fuzzy_y", "y", 0.0, RD_H, RD_H, RD_B, RD_B, fuzzy=True)]
GRID_SPECS = [
    RDSpec("h_half", "y", 0.0, RD_H * 0.5, RD_H * 0.5, RD_B, RD_B, fuzzy=True),
    RDSpec("h_base", "y", 0.0, RD_H, RD_H, RD_B, RD_B, fuzzy=True),
    RDSpec("h_one_and_half", "y", 0.0, RD_H * 1.5, RD_H * 1.5, RD_B, RD_B, fuzzy=True),
    RDSpec("placebo_minus5", "y", -5.0, RD_H, RD_H, RD_B, RD_B),
    RDSpec("placebo_plus5", "y", 5.0, RD_H, RD_H, RD_B, RD_B),
]
TABLE_SPECS = [RDSpec("Y", "y", 0.0, RD_H, RD_H, RD_B, RD_B), RDSpec("T", "t", 0.0, RD_H, RD_H, RD_B, RD_B),
               RDSpec("E", "e", 0.0, RD_H, RD_H, RD_B, RD_B)]
#: Main estimate, coverage-error bandwidths, half and one and a half of the selected ones (of h, and of b), placebo cutoffs, a covariate.
ROBUST_SPECS = [
    AutoSpec("main", "y"), AutoSpec("cer", "y", bwselect="certwo"), AutoSpec("half", "y", factor=0.5), AutoSpec("one_and_half", "y", factor=1.5),
    AutoSpec("half_of_b", "y", factor=0.5, base="b"), AutoSpec("one_and_half_of_b", "y", factor=1.5, base="b"), AutoSpec("placebo_minus5", "y", c=-5.0), AutoSpec("placebo_plus5", "y", c=5.0),
    AutoSpec("balance_e", "e", fuzzy=False), AutoSpec("balance_e_cer", "e", fuzzy=False, bwselect="certwo"),
]
SHARP_AUTO_SPECS = [AutoSpec("sharp_y", "y", fuzzy=False), AutoSpec("balance_e", "e", fuzzy=False)]
MASS_SPECS = [AutoSpec("mass_y", "y"), AutoSpec("mass_cer", "y", bwselect="certwo"), AutoSpec("mass_sharp", "y", fuzzy=False)]
MAIN_SPECS = [AutoSpec("fuzzy_auto", "y")]
STUDY_SPECS = [AutoSpec("persistence_2y", "persist_1")]
#: Places that estimates with selected bandwidths are compared on: these go through chains of solved systems.
AUTO_DIGITS = 4
DENSITY_BIN, DENSITY_H = 1.0, 20.0
HIST_BINS, HIST_LO, HIST_HI, HIST_SHIFT = 30, 0.0, 130.0, 95.0
DENSITY_LP_H, DENSITY_LP_P = 10.0, 2
CURVE_POINTS, CURVE_REACH, DENSITY_DIGITS = 15, 3.0, 5
