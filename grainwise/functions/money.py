"""Exact money totals.

A decimal sum wider than 18 digits is kept as an object per group and costs about
twice a BIGINT sum. Totals per parent are therefore summed in minor units (cents,
or finer) and turned into a decimal once per group. A group may reach 9.2e18 units;
beyond that ANSI mode raises. Totals over whole tables use :func:`wide_total`, or
decimals where the input is already one row per parent.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    """Minor units of a double that carries two decimals."""
    return F.floor(amount * 100.0 + 0.5)


def minor_units(amount: Column, scale: int = 2) -> Column:
    """Minor units of a decimal column with ``scale`` decimals."""
    return (amount * F.lit(10**scale)).cast("bigint")


def in_units(units: Column, scale: int = 2) -> Column:
    """BIGINT minor units as an exact decimal."""
    return units.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-scale))


def exact_total(units: Column, scale: int = 2) -> Column:
    """Aggregate: sum of minor units as an exact decimal."""
    return in_units(F.sum(units), scale)


def wide_total(units: Column, scale: int = 2) -> Column:
    """Aggregate: like :func:`exact_total` for any number of rows.

    The low 20 bits and the rest are summed apart, so neither BIGINT sum overflows.
    """
    high, low = F.sum(F.shiftright(units, 20)), F.sum(units.bitwiseAND(F.lit((1 << 20) - 1)))
    whole = high.cast("decimal(30,0)") * F.lit(Decimal(1 << 20)) + low.cast("decimal(30,0)")
    return (whole.cast("decimal(30,0)") * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal(30,{scale})")
