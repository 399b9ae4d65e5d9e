"""Consistent sampling: an id is either always kept or never."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_hash(c: Column) -> Column:
    """h = h * 31 + byte over the characters of an ASCII id, in 32 bits."""
    codes = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.ascii(F.substring(c, i, F.lit(1))).cast("long"))
    folded = F.aggregate(codes, F.lit(0).cast("long"), lambda h, b: (h * 31 + b) % F.lit(4294967296))
    return F.when(F.length(c) > 0, folded).otherwise(F.lit(0).cast("long"))


def keep_trace(c: Column, rate: float) -> Column:
    if rate <= 0:
        return F.lit(False)
    if rate >= 1:
        return F.lit(True)
    return (sample_hash(c) % 100) < F.lit(rate * 100)
