"""A log of changes that consumers read from where each of them left off.

A version is one folder of change rows (``change``: insert, update or delete; ``seq``: their order; the key; the other columns). A consumer's
position is the last version it has taken; reading gives the net change of each key since then, and the position moves only when the consumer says that
it is done, so a reader that fails reads again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.streaming.runner import run_to_end


def _versions(root: str) -> str:
    return f"{root}/changes"


def append_version(changes: DataFrame, root: str, version: int) -> None:
    """Write the changes of a version; written again, as after a failed batch, a version is replaced."""
    changes.write.mode("overwrite").parquet(f"{_versions(root)}/version={version}")


def log_changes(feed: DataFrame, root: str) -> None:
    """Take a stream of changes into the log: each micro-batch is a version. Called again the stream goes on where it ended."""
    run_to_end(feed, f"{root}/stream", write=lambda rows, batch: append_version(rows, root, batch))


def changes_between(spark: SparkSession, root: str, schema: T.StructType, after: int, upto: int | None = None) -> DataFrame:
    """The change rows of the versions after one, up to another; only their folders are read. A log that is not there yet is empty."""
    whole = T.StructType([*schema.fields]).add("version", T.LongType())
    try:
        rows = spark.read.schema(whole).parquet(_versions(root))
    except AnalysisException:
        rows = spark.createDataFrame([], whole)
    rows = rows.where(F.col("version") > after)
    return rows if upto is None else rows.where(F.col("version") <= upto)


def net_changes(changes: DataFrame, key: str) -> DataFrame:
    """One row per key with what came of all its changes, ordered by version and ``seq``: ``change``, key and the columns as they are at the end.

    Insert then delete is nothing, delete then insert an update; a key that was new stays an insert however often it was updated. Deletes carry the
    columns of their last change. Changes are reduced before the shuffle, so a key that changes often costs no more than others.
    """
    rest = [c for c in changes.columns if c not in (key, "change", "version")]
    at = F.struct("version", "seq")
    ends = changes.groupBy(key).agg(F.min_by("change", at).alias("__first"), F.max_by(F.struct("change", *rest), at).alias("__last"))
    new, gone = F.col("__first") == "insert", F.col("__last.change") == "delete"
    kind = F.when(new & gone, None).when(new, "insert").when(gone, "delete").otherwise("update")
    return ends.select(kind.alias("change"), key, *[F.col(f"__last.{c}").alias(c) for c in rest]).where(F.col("change").isNotNull())


class Consumer:
    """A named reader of a log. ``read`` gives the net changes since its position, ``done`` moves it there."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: T.StructType, key: str):
        self.spark, self.root, self.name, self.schema, self.key = spark, root, name, schema, key
        self.reached: int | None = None

    @property
    def position(self) -> int:
        """The last version taken; -1 before the first."""
        try:
            taken = self.spark.read.schema("upto long").parquet(f"{self.root}/positions/{self.name}")
        except AnalysisException:
            return -1
        last = taken.agg(F.max("upto")).first()[0]
        return -1 if last is None else last

    def read(self, upto: int | None = None) -> DataFrame:
        """Net changes of the versions after the position, up to ``upto`` or the newest there is now."""
        position = self.position
        found = changes_between(self.spark, self.root, self.schema, position, upto)
        self.reached = found.agg(F.max("version")).first()[0]
        # versions that arrive while the rows are used wait for the next read
        bounded = found.where(F.col("version") <= (position if self.reached is None else self.reached))
        return net_changes(bounded, self.key)

    def done(self) -> None:
        """What was read last is taken; without a read, or with nothing new, the position stays."""
        if self.reached is not None:
            self.spark.createDataFrame([(self.reached,)], "upto long").coalesce(1).write.mode("append").parquet(f"{self.root}/positions/{self.name}")
            self.reached = None
