"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waybill.session import fresh_dir

#: A word is a run of characters other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write to a new folder below the shared one and read it again: the lineage ends there and sizes are known."""
    spark = df.sparkSession
    path = fresh_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have yet, whatever columns it brings."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(df: DataFrame, rows: int, per_task: int) -> int:
    """Tasks for ``rows`` rows at ``per_task`` each, at least as many as the session shuffles into."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def word_count(text) -> F.Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def byte_size(text) -> F.Column:
    """UTF-8 bytes of a text plus 1, so that empty texts count too."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def same_columns(df: DataFrame, like: StructType) -> DataFrame:
    return df.select(*[F.col(f"`{f.name}`") for f in like.fields])
