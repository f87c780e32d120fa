"""Collapse to one row per unit, spell durations, joins with exact key semantics.

The per-unit collapse (group flags, conditional duration and the first row in
a total order) is a single `groupBy` with partially-aggregable functions
(`min`, `max`, `sum`, `min_by`): each task pre-combines its rows, so even a unit
holding a third of all rows adds one small record per task to the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrd.functions.na import strict, _col
from panelrd.operators.attach import BROADCAST_ROWS, SALTS
from panelrd.session import save_shared


def term_to_number(term, sep_pos: int = 6) -> Column:
    """`YYYY/S` term code → `YYYY + S * 0.5`; malformed text → NULL."""
    t = _col(term)
    year = F.substring(t, 1, 4).try_cast("double")
    sem = F.substring(t, sep_pos, 1).try_cast("double")
    return year + sem * F.lit(0.5)


def spell_duration(end_term, entry, censor: float) -> Column:
    """Years in a spell: end term as a number (NULL end → `censor`) minus entry year."""
    end = F.when(_col(end_term).isNull(), F.lit(float(censor))).otherwise(term_to_number(end_term))
    return end - _col(entry).cast("double")


def collapse_spells(
    df: DataFrame,
    unit: Sequence[str],
    drop_flag: str,
    done_flag: str,
    duration: str,
    order_by: Sequence[str] | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """One row per unit (e.g. student × cohort) from many spells.

    - `dropped` = 1 when every spell is a drop-out (`min(drop_flag) == 1`; a NULL
      flag makes the minimum unknown, so 0), `finished` = 1 when any spell is
      finished (`max(done_flag) == 1`, same NULL rule);
    - `years` = largest `duration * done_flag` when some spell is finished, else
      the largest `duration` (the product, not a filter: it differs for negative
      durations); NULL if an input is NULL;
    - the other columns (`keep`, default all) come from the first spell in the
      total order `order_by` (default: all columns), replacing file order.
    """
    unit = list(unit)
    keep = [c for c in (keep if keep is not None else df.columns) if c not in unit]
    order_by = list(order_by) if order_by else [c for c in df.columns]
    drop_c, done_c, dur_c = F.col(drop_flag), F.col(done_flag), F.col(duration)
    n_done = strict(F.sum, done_c)
    agg = [
        F.when(strict(F.min, drop_c) == 1, F.lit(1.0)).otherwise(F.lit(0.0)).alias("dropped"),
        F.when(strict(F.max, done_c) == 1, F.lit(1.0)).otherwise(F.lit(0.0)).alias("finished"),
        F.when(n_done >= 1, strict(F.max, dur_c * done_c)).when(n_done == 0, strict(F.max, dur_c)).alias("years"),
        F.count(F.lit(1)).alias("n_spells"),
    ]
    if keep:
        agg.append(F.min_by(F.struct(*[F.col(c) for c in keep]), F.struct(*[F.col(c) for c in order_by])).alias("_first"))
    out = df.groupBy(*unit).agg(*agg)
    if keep:
        out = out.select(*unit, "dropped", "finished", "years", "n_spells", *[F.col("_first")[c].alias(c) for c in keep])
    return out


def collapse_terms(
    spells: DataFrame,
    unit: Sequence[str],
    drop_flag: str,
    done_flag: str,
    end_term: str,
    units: DataFrame,
    entry: str,
    censor: float,
) -> DataFrame:
    """`collapse_spells` for durations of the form (end term as a number, NULL → `censor`)
    − the unit's entry year, where the entry year lives on the unit table.

    The spells need no entry year: each unit's spells are pre-aggregated on the fact
    side (map-side combined, so a unit holding a third of all spells becomes one
    record per task before any shuffle), then the unit table is joined 1:1.  With 0/1
    flags, max(dur·done) = max(0 if any unfinished spell, latest finished end − entry)
    and max(dur) = latest end − entry; a malformed end term makes `years` NULL, as the
    strict maxima do.
    """
    unit = list(unit)
    end = F.when(F.col(end_term).isNull(), F.lit(float(censor))).otherwise(term_to_number(end_term))
    s = spells.withColumn("_end", end)
    drop_c, done_c = F.col(drop_flag), F.col(done_flag)
    agg = s.groupBy(*unit).agg(
        F.when(strict(F.min, drop_c) == 1, F.lit(1.0)).otherwise(F.lit(0.0)).alias("dropped"),
        F.when(strict(F.max, done_c) == 1, F.lit(1.0)).otherwise(F.lit(0.0)).alias("finished"),
        strict(F.sum, done_c).alias("_ndone"),
        F.count_if(F.col("_end").isNull()).alias("_nbad"),
        F.max(F.when(done_c == 0, F.lit(1))).alias("_open"),
        F.max(F.when(done_c == 1, F.col("_end"))).alias("_end_done"),
        F.max("_end").alias("_end_all"),
        F.count(F.lit(1)).alias("n_spells"),
    )
    j = agg.join(units.select(*unit, entry), on=unit, how="inner")
    e = F.col(entry).cast("double")
    years = (F.when(F.col("_nbad") > 0, F.lit(None).cast("double"))
             .when(F.col("_ndone") >= 1, F.greatest(F.when(F.col("_open") == 1, F.lit(0.0)), F.col("_end_done") - e))
             .when(F.col("_ndone") == 0, F.col("_end_all") - e))
    return j.select(*unit, entry, "dropped", "finished", years.alias("years"), "n_spells")


def group_flags(df: DataFrame, unit: Sequence[str], drop_flag: str, done_flag: str, units: DataFrame | None = None) -> DataFrame:
    """Spell-level rows with the unit's `dropped`/`finished` flags attached (P1).

    The flags are aggregated (combined map-side) and, with `units` (one row per unit), joined
    with its columns 1:1; that table is written to the shared folder and read back, and the
    spells are joined once and last.  Reading it back matters: a join with the aggregate itself
    reuses the aggregate's partitioning, and Spark cannot split a hot unit's partition then.
    """
    flags = df.groupBy(*unit).agg(
        F.when(strict(F.min, F.col(drop_flag)) == 1, F.lit(1.0)).otherwise(F.lit(0.0)).alias("dropped"),
        F.when(strict(F.max, F.col(done_flag)) == 1, F.lit(1.0)).otherwise(F.lit(0.0)).alias("finished"),
    )
    if units is not None:
        flags = flags.join(units, on=list(unit), how="inner")
    return df.join(save_shared(flags, "group-flags"), on=list(unit), how="left" if units is None else "inner")


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] | None = None) -> DataFrame:
    """Keep the first row per key (all columns), first in the total order `order_by`.

    `min_by(struct(row), struct(order))` aggregates partially, so no group is ever
    sorted or gathered in one task.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    order_by = list(order_by) if order_by else rest
    if not rest:
        return df.select(*keys).distinct()
    out = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order_by])).alias("_first"))
    return out.select(*[F.col(c) for c in df.columns if c in keys] + [F.col("_first")[c].alias(c) for c in rest]).select(*df.columns)


def join_on(a: DataFrame, b: DataFrame, pairs: Sequence[tuple[str, str]] | Mapping[str, str], how: str = "left", null_safe: bool = True) -> DataFrame:
    """Equi-join on key pairs with different names, keeping one copy of each key: inner, left, right or full.

    Keys keep the left names; for a right join the key values come from the right
    side.  `null_safe=True` matches NULL keys to NULL keys (as dplyr does).

    Rows with a NULL among their keys would all meet in one task, so they are joined apart from the others: the side with few
    of them is broadcast (counted first), or its rows are repeated over salts; rows without a partner are added for
    the sides that keep theirs.
    """
    pairs = list(pairs.items()) if isinstance(pairs, Mapping) else list(pairs)
    how = {"left_outer": "left", "right_outer": "right", "outer": "full", "full_outer": "full"}.get(how, how)
    if how not in ("inner", "left", "right", "full"):
        raise ValueError("how must be 'inner', 'left', 'right' or 'full'")
    keys = [f"_k{i}" for i in range(len(pairs))]
    a_rest = [c for c in a.columns if c not in {lk for lk, _ in pairs}]
    b_rest = [c for c in b.columns if c not in {rk for _, rk in pairs}]
    left = a.select(*(F.col(lk).alias(k) for k, (lk, _) in zip(keys, pairs)), *(F.col(c).alias(f"_a{i}") for i, c in enumerate(a_rest)))
    right = b.select(*(F.col(rk).alias(k) for k, (_, rk) in zip(keys, pairs)), *(F.col(c).alias(f"_b{i}") for i, c in enumerate(b_rest)))
    names = [*keys, *(f"_a{i}" for i in range(len(a_rest))), *(f"_b{i}" for i in range(len(b_rest)))]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    parts = [left.filter(known).join(right.filter(known), keys, how).select(*names)]
    parts += [p.select(*names) for p in _null_keys(left.filter(~known), right.filter(~known), keys, how, null_safe)]
    out = reduce(DataFrame.unionByName, parts)
    return out.select(*(F.col(k).alias(lk) for k, (lk, _) in zip(keys, pairs)), *(F.col(f"_a{i}").alias(c) for i, c in enumerate(a_rest)), *(F.col(f"_b{i}").alias(c) for i, c in enumerate(b_rest)))


def _null_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, null_safe: bool, bound: int = BROADCAST_ROWS, salts: int = SALTS) -> list[DataFrame]:
    """The parts of a join whose rows have a NULL among their keys."""
    spark = left.sparkSession
    alone = lambda rows, other: rows.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema.fields if f.name not in keys))
    few = lambda df: spark.createDataFrame(got, df.schema) if len(got := df.limit(bound + 1).collect()) <= bound else None
    parts = []
    small_right = few(right)
    if not null_safe or small_right is not None and small_right.isEmpty():
        return [alone(left, right)] * (how in ("left", "full")) + [alone(right, left)] * (how in ("right", "full"))

    def joined(x: DataFrame, y: DataFrame, kind: str) -> DataFrame:
        """x with y, the side with few rows or repeated ones; kind: inner or left_anti."""
        small = small_right if y is right else few(y)
        if small is not None:
            return x.join(F.broadcast(small.withColumnsRenamed({k: f"_{k}" for k in keys})), reduce(lambda p, q: p & q, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), kind).drop(*(f"_{k}" for k in keys))
        salted = y.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnsRenamed({k: f"_{k}" for k in keys})
        dealt = x.withColumn("_part", F.pmod(F.xxhash64(*x.columns), F.lit(salts)).cast("int"))
        on = reduce(lambda p, q: p & q, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.col("_part") == F.col("_salt"))
        return dealt.join(salted, on, kind).drop("_part", "_salt", *(f"_{k}" for k in keys))

    parts.append(joined(left, right, "inner"))
    if how in ("left", "full"):
        parts.append(alone(joined(left, right.select(*keys).distinct(), "left_anti"), right))
    if how in ("right", "full"):
        parts.append(alone(joined(right, left.select(*keys).distinct(), "left_anti"), left))
    return parts


def join_fill(a: DataFrame, b: DataFrame, keys: Sequence[str], fill: Mapping[str, object]) -> DataFrame:
    """Left join `b` onto `a` and replace NULLs from unmatched rows by `fill`."""
    out = a.join(b, on=list(keys), how="left")
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in fill.items()})
