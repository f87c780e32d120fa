"""Conditional recoding: ordered rule lists folded into one `CASE WHEN`.

All rules become built-in expressions, so a recode stays inside whole-stage
codegen; nothing runs in Python per row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelrd.functions.na import in_set, _col


@dataclass(frozen=True)
class Rule:
    """One ordered rule: `when` (values set, or a text pattern) → `value`."""

    when: tuple | str
    value: object


def _fold(conds: Sequence[tuple[Column, object]], default=None) -> Column:
    """Fold (condition, value) pairs in order; the first matching condition wins."""
    if not conds:
        return F.lit(default)
    expr = None
    for cond, val in conds:
        v = val if isinstance(val, Column) else F.lit(val)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default)) if default is not None else expr


def recode(col, rules: Sequence[Rule], default=None) -> Column:
    """Set recode (`case_when(x %in% s ~ v, ...)`): a `None` in a set matches NULL.

    An unmatched value gets `default` (NULL when not given), like `case_when`
    without a `TRUE ~` arm.
    """
    c = _col(col)
    return _fold([(in_set(c, r.when), r.value) for r in rules], default)


def bracket(col, rules: Sequence[Rule], match: str = "literal", default=None) -> Column:
    """Ordered text-pattern bracket → number (first matching rule wins, else NULL).

    `match="literal"` tests substring containment; `match="regex"` tests a Java
    regular expression (so `.` is a wildcard and `$` an end anchor, as in the
    original script's patterns).  A NULL text matches nothing.
    """
    c = _col(col)
    if match == "literal":
        conds = [(F.coalesce(c.contains(r.when), F.lit(False)), r.value) for r in rules]
    elif match == "regex":
        conds = [(F.coalesce(c.rlike(r.when), F.lit(False)), r.value) for r in rules]
    else:
        raise ValueError("match must be 'literal' or 'regex'")
    return _fold(conds, default)


def lookup(col, mapping: Mapping, default=None) -> Column:
    """Word → number (small, fixed mapping) as a literal map lookup."""
    if not mapping:
        return F.lit(default)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    out = m[_col(col)]
    return F.coalesce(out, F.lit(default)) if default is not None else out


def backfill(target, when, value=1) -> Column:
    """`case_when(is.na(a) & cond ~ value, TRUE ~ a)`."""
    t = _col(target)
    cond = _col(when)
    return F.when(t.isNull() & F.coalesce(cond, F.lit(False)), F.lit(value)).otherwise(t)


def refine(coarse, fine, for_values: Sequence) -> Column:
    """Replace a coarse category by a finer one for the listed coarse values."""
    c = _col(coarse)
    return F.when(in_set(c, for_values), _col(fine)).otherwise(c)


def flag(cond, default: int | None = 0) -> Column:
    """Binary 0/1 double flag; NULL condition counts as not matched.

    `default=None` makes it tri-state: 1 when true, `0` only where `cond` is
    false, NULL where it is unknown.
    """
    c = _col(cond)
    if default is None:
        return F.when(c, F.lit(1.0)).when(~c, F.lit(0.0))
    return F.when(c, F.lit(1.0)).otherwise(F.lit(float(default)))


def persistence(dur, thresholds: Sequence[float], prefix: str = "persist_") -> list[Column]:
    """Persistence ladder: one 0/1 column per threshold k, 1 when `dur > k`."""
    d = _col(dur)
    return [flag(d > k).alias(f"{prefix}{i + 1}") for i, k in enumerate(thresholds)]


def any_of(*conds) -> Column:
    """OR of conditions where an unknown condition counts as false (two-source dummies)."""
    return reduce(lambda a, b: a | b, [F.coalesce(_col(c), F.lit(False)) for c in conds])


def tri_state(col, yes: tuple, no: tuple) -> Column:
    """1 when the value is in `yes`, 0 when in `no`, NULL otherwise (unknown)."""
    c = _col(col)
    return F.when(in_set(c, yes), F.lit(1.0)).when(in_set(c, no), F.lit(0.0))


def deflate(amount: Column, year: Column, factors: Mapping[int, float]) -> Column:
    """`amount` in the prices of the base year: times the factor of its year, NULL for a year that is not listed (C10).

    The factors are literals in the expression (one map entry for each listed year), so no join is planned.
    """
    table = F.create_map(*[F.lit(v) for y, f in factors.items() for v in (int(y), float(f))])
    return amount * F.try_element_at(table, year.cast("int"))
