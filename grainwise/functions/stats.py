"""Ratios and interval estimates over already aggregated counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """Double division; null instead of an error when the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def percent(num: Column, den: Column, digits: int | None = 2) -> Column:
    value = F.lit(100.0) * ratio(num, den)
    return value if digits is None else F.round(value, digits)


def money(total: Column, digits: int = 2) -> Column:
    """Exact decimal total rounded half-up and published as a double."""
    return F.round(total, digits).cast("double")


def count_true(condition: Column) -> Column:
    """Rows for which the condition holds (null counts as not); 0 on empty input."""
    return F.count_if(condition)


def wilson_bounds(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a proportion, clamped to [0, 1]; (0, 0) for no trials."""
    trials = n.cast("double")
    p = ratio(hits, trials)
    shrink = 1.0 + F.try_divide(F.lit(z * z), trials)
    centre = p + F.try_divide(F.lit(z * z / 2), trials)
    spread = z * F.sqrt(
        F.try_divide(p * (1.0 - p), trials) + F.try_divide(F.lit(z * z / 4), trials * trials)
    )
    low = F.greatest(F.lit(0.0), (centre - spread) / shrink)
    high = F.least(F.lit(1.0), (centre + spread) / shrink)
    none = n == 0
    return F.when(none, 0.0).otherwise(low), F.when(none, 0.0).otherwise(high)


def correlation(mxx: Column, myy: Column, mxy: Column) -> Column:
    """Pearson r of centred second moments; null where a variable does not vary."""
    spread = mxx * myy
    return F.try_divide(mxy, F.sqrt(F.when(spread > 0, spread)))
