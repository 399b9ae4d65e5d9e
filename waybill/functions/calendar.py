"""Calendar attributes of a date column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_columns(day: Column, holidays: Sequence[str] = (), fiscal_start: int = 1) -> list[Column]:
    """Key, parts, names, ISO week, weekend, holiday and fiscal year and quarter.

    ``fiscal_start`` is the first month of the fiscal year; later than January, the fiscal year
    is named after the calendar year in which it ends. ``holidays`` are MM-dd texts.
    """
    shifted = F.add_months(F.trunc(day, "month"), (13 - fiscal_start) % 12)
    dow = F.weekday(day) + 1  # Monday 1 … Sunday 7
    number = lambda c: c.cast("long")
    return [
        number(F.year(day) * 10000 + F.month(day) * 100 + F.day(day)).alias("date_key"),
        day.alias("date"),
        number(F.year(day)).alias("year"),
        number(F.quarter(day)).alias("quarter"),
        number(F.month(day)).alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        number(F.weekofyear(day)).alias("week_of_year"),
        number(F.day(day)).alias("day_of_month"),
        number(dow).alias("day_of_week"),
        F.date_format(day, "EEEE").alias("day_name"),
        (dow >= 6).alias("is_weekend"),
        F.date_format(day, "MM-dd").isin(*holidays).alias("is_holiday"),
        number(F.year(shifted)).alias("fiscal_year"),
        number(F.quarter(shifted)).alias("fiscal_quarter"),
    ]
