"""Exact money sums and rounding that every engine reproduces bit for bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    return _col(c).cast("decimal(18,2)")


def price(c: Column | str) -> Column:
    """A factor of a product of two amounts; narrow enough to keep the product exact."""
    return _col(c).cast("decimal(12,2)")


def total(c: Column) -> Column:
    """Sum kept exact in decimal, given as double."""
    return F.sum(c).cast("double")


def mean(c: Column) -> Column:
    """Mean from the exact sum; the result does not depend on the order of rows."""
    return F.sum(c).cast("double") / F.count(c)


def half_up(c: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0 or NULL."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
