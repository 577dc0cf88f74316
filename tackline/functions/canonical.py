"""Rounding and angles, as Column expressions.

Stored results are rounded half away from zero on a scaled value, so that
platforms agree bit for bit; a missing value stays missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Decimal places by quantity.
PLACES = {"degrees": 9, "knots": 6, "metres": 3, "ratio": 6, "env": 2, "env_degrees": 1}
ON_AXIS = 1e-9


def col(x) -> Column:
    """A column from a name, a number or a column."""
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def rounded(x, places: int) -> Column:
    """Half away from zero at ``places``, for values below 1e15; -0 becomes 0.

    These functions name their argument once where they can: the optimizer may write an argument out wherever it is named.
    """
    scale = float(10**places)
    return F.round(col(x) * scale) / scale + 0.0


def knots(x) -> Column:
    return rounded(x, PLACES["knots"])


def degrees(x) -> Column:
    return rounded(x, PLACES["degrees"])


def wrap_360(x) -> Column:
    """[0, 360); what is already there stays bit for bit. The second remainder turns a 360 that rounding made into 0."""
    return F.pmod(F.pmod(col(x), F.lit(360.0)), F.lit(360.0))


def wrap_lon(x) -> Column:
    """[-180, 180)."""
    x = col(x)
    return F.when((x >= -180) & (x < 180), x).otherwise(wrap_360(x + 180.0) - 180.0)


def angle_between(a, b) -> Column:
    """The unsigned angle between two directions, [0, 180]."""
    d = wrap_360(col(a) - col(b))
    return F.least(d, 360.0 - d)


angle_off = angle_between


def holds(condition: Column) -> Column:
    """A predicate that a missing value fails, also under negation."""
    return F.coalesce(condition, F.lit(False))


def is_zero_row(twa) -> Column:
    """0 and 360 degrees: a boat makes no way head to wind, so these rows are no evidence."""
    twa = col(twa)
    return (F.abs(twa) <= ON_AXIS) | (F.abs(twa - 360.0) <= ON_AXIS)


def settled(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds or replaces columns as one row of one struct.

    A predicate on them stays above this step. Through plain projections it would be pushed with its columns written out,
    and long chains of arithmetic grow with every step.
    """
    keep = [c for c in frame.columns if c not in columns]
    return frame.select(*keep, F.inline(F.array(F.struct(*[e.alias(n) for n, e in columns.items()]))))
