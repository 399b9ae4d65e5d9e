"""Line-by-line comparison of two versions of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_diff(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """Lines at the same position: ``-`` only old, ``+`` only new, ``~`` changed, ``=`` same. Keys are unique on each side.

    The two versions of a text meet as wholes, a row each, and are split where they are; lines are not shuffled.
    """

    def lines(column: str):
        return F.coalesce(F.split(column, "\n", -1), F.array().cast("array<string>"))

    both = old.select(key, F.col(text).alias("old_text")).join(new.select(key, F.col(text).alias("new_text")), key, "full_outer")
    pairs = F.posexplode(F.arrays_zip(lines("old_text").alias("old_line"), lines("new_text").alias("new_line"))).alias("pos", "pair")
    both = both.select(key, pairs).select(key, (F.col("pos") + 1).cast("long").alias("line_no"), F.col("pair")["old_line"].alias("old_line"), F.col("pair")["new_line"].alias("new_line"))
    mark = (
        F.when(F.col("new_line").isNull(), "-")
        .when(F.col("old_line").isNull(), "+")
        .when(F.col("old_line") != F.col("new_line"), "~")
        .otherwise("=")
    )
    return both.withColumn("mark", mark)
