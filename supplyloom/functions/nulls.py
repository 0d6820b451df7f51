"""Missing-value rules as column expressions.

The statistical sources treat missing values as contagious in sums and
comparisons, while membership tests are never missing.  SQL's defaults differ,
so every rule is spelled out here once and reused everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def if_else(cond: Column, yes, no) -> Column:
    """Three-valued conditional: an unknown condition gives null, not ``no``."""
    return F.when(cond, yes).when(~cond, no)


def in_set(col: Column | str, values: Sequence) -> Column:
    """Membership that is never null: a null is simply not in the set."""
    return F.coalesce(_c(col).isin(list(values)), F.lit(False))


def not_in(col: Column | str, values: Sequence) -> Column:
    """Complement of :func:`in_set`; keeps rows whose value is null."""
    return ~in_set(col, values)


def kept_by(col: Column | str, values: Sequence) -> Column:
    """:func:`in_set` as a filter; a scan can use it, since a filter drops nulls anyway."""
    return _c(col).isin(list(values))


def dropped_by(col: Column | str, values: Sequence) -> Column:
    """:func:`not_in` as a filter that a scan can use."""
    return _c(col).isNull() | ~_c(col).isin(list(values))


def no_nan(col: Column | str) -> Column:
    """Double column with NaN turned into null."""
    return F.nanvl(_c(col).cast("double"), F.lit(None).cast("double"))


def strict(agg: Column, col: Column | str) -> Column:
    """Keep ``agg`` only where no input of the group was null."""
    return F.when(F.count(_c(col)) == F.count(F.lit(1)), agg)


def strict_sum(col: Column | str) -> Column:
    return strict(F.sum(_c(col)), col)


def strict_mean(col: Column | str) -> Column:
    return strict(F.avg(_c(col)), col)


def strict_sd(col: Column | str) -> Column:
    return strict(F.stddev_samp(_c(col)), col)


def zero_sum(col: Column | str) -> Column:
    """Sum that ignores nulls; a group without any value sums to 0."""
    return F.coalesce(F.sum(_c(col)), F.lit(0))


def mean_ok(col: Column | str) -> Column:
    """Mean over known values only, NaN counted as unknown."""
    return F.avg(no_nan(col))


#: Digits behind the point that sums in fixed point keep.
FIXED_DIGITS = 12


def fixed_sum(col: Column | str, digits: int = FIXED_DIGITS) -> Column:
    """Sum of known values in fixed point: the same bits in whatever order rows come.

    Floating sums differ in their last bits with the order of the rows, which breaks
    ties of equal means.  Decimals add up exactly.  A value counts to ``digits``
    places and must stay below 10 ** (26 - digits); a larger one is an error.
    """
    return F.sum(no_nan(col).cast(f"decimal(26,{digits})")).cast("double")


def fixed_mean(col: Column | str, digits: int = FIXED_DIGITS) -> Column:
    """Mean over known values with :func:`fixed_sum`."""
    return F.try_divide(fixed_sum(col, digits), F.count(no_nan(col)).cast("double"))


def ratio(num: Column | str, den: Column | str) -> Column:
    """Double division, null where the denominator is zero."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def pct(num: Column | str, den: Column | str) -> Column:
    """100 x num / den as double, null where the denominator is zero."""
    return F.try_divide(F.lit(100.0) * _c(num).cast("double"), _c(den).cast("double"))


def cap(col: Column | str, upper) -> Column:
    """Upper bound that leaves nulls alone (``least`` would not)."""
    c = _c(col)
    return F.when(c > upper, F.lit(upper)).otherwise(c)


def floor_zero(col: Column | str) -> Column:
    """Negative values become 0, nulls stay null."""
    c = _c(col)
    return if_else(c < 0, F.lit(0).cast("double"), c)


def negative_part(col: Column | str) -> Column:
    """The negative residue that :func:`floor_zero` cuts off, else 0."""
    c = _c(col)
    return if_else(c < 0, c, F.lit(0).cast("double"))


def censor(col: Column | str, low, high) -> Column:
    """Values outside [low, high] become null."""
    c = _c(col)
    return F.when(c.between(low, high), c)
