"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pieces(df: DataFrame, least: int) -> int:
    """Into how many parts rows are dealt: the partitions the session shuffles into, ``least`` at least."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def heavy_keys(df: DataFrame, key: str, share: int | None = None, salts: int | None = None) -> DataFrame:
    """Keys that hold more than 1/``share`` of the rows, at most ``share`` of them, and their part of ``salts`` salts."""
    share, salts = share or pieces(df, 200), salts or pieces(df, 32)
    counts = df.groupBy(key).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("n")).scalar()  # from the counts, so the rows are not read again
    return counts.where(F.col("__n") * share > total).select(
        F.col(key).alias("__heavy"), F.ceil(F.col("__n") * salts / total).cast("int").alias("__salts")
    )


def skew_join(facts: DataFrame, dims: DataFrame, key: str, how: str = "inner", salts: int | None = None) -> DataFrame:
    """Join facts to a table with one row per ``key`` (``how``: inner or left).

    Rows of a heavy key are spread over partitions, as many of ``salts`` as the key's share of the rows, and only
    the matching rows of ``dims`` are repeated. The list of heavy keys is bounded, so it may be broadcast. Rows
    without a key match nothing and are spread too.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"skew_join supports inner and left, not {how}")
    salts = salts or pieces(facts, 32)
    heavy = F.broadcast(heavy_keys(facts, key, salts=salts))
    hashed = F.xxhash64(*[c for c in facts.columns])
    own = F.when(F.col("__heavy").isNotNull(), F.pmod(hashed, F.col("__salts"))).when(F.col(key).isNull(), F.pmod(hashed, F.lit(salts)))
    left = (
        facts.join(heavy, F.col(key) == F.col("__heavy"), "left")
        .withColumn("__salt", F.coalesce(own, F.lit(0)).cast("int"))
        .drop("__heavy", "__salts")
    )
    copies = F.when(F.col("__heavy").isNotNull(), F.sequence(F.lit(0), F.col("__salts") - 1)).otherwise(F.array(F.lit(0)))
    right = (
        dims.join(heavy, F.col(key) == F.col("__heavy"), "left")
        .withColumn("__salt", F.explode(copies))
        .drop("__heavy", "__salts")
    )
    return left.join(right, [key, "__salt"], how).drop("__salt")
