"""Column-level helpers (NA-exact predicates, recoding, number parsing)."""

from panelrd.functions.na import in_set, strict, n_unique, to_number, skip_mean, fill_and_cast, within
from panelrd.functions.recode import Rule, any_of, recode, bracket, lookup, backfill, deflate, refine, persistence, flag, tri_state

__all__ = [
    "in_set", "strict", "n_unique", "to_number", "skip_mean", "fill_and_cast", "within",
    "Rule", "any_of", "recode", "bracket", "lookup", "backfill", "deflate", "refine", "persistence", "flag", "tri_state",
]
