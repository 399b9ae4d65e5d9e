"""Sources, sinks and runs shared by the streaming jobs.

Sinks write one folder per micro-batch and replace it when the batch is repeated, so a restart
from the checkpoint never doubles rows.
"""

from __future__ import annotations

import re
import threading
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def as_instant(c: Column) -> Column:
    """Zone-free time as an instant in UTC, as watermarks need it, whatever the session zone."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), c))


def as_zone_free(c: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.expr(_EPOCH))


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def start(
    stream: DataFrame,
    root: str,
    write: Callable[[DataFrame, int], None],
    mode: str = "append",
    interval: str | None = None,
) -> StreamingQuery:
    """Start a job below ``root``; without ``interval`` it takes what is there and ends."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(write)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def batch_folder(root: str, name: str = "data") -> Callable[[DataFrame, int], None]:
    """Sink: rows of micro-batch n go to ``root/name/batch=n``."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")

    return write


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Queries started inside run with another setting; they keep it for their life."""
    usual = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if usual is None else spark.conf.set(name, usual)


def run_to_end(stream: DataFrame, root: str, mode: str = "append", write: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    query = start(stream, root, write or batch_folder(root), mode)
    query.awaitTermination()
    return query


class _LateRows(StreamingQueryListener):
    """Adds up the rows that watermarks dropped, over all micro-batches; a query itself remembers its last hundred only."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self.ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        late = sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)
        self.dropped[run] = self.dropped.get(run, 0) + late

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)].set()


@contextmanager
def late_rows(spark: SparkSession) -> Iterator[Callable[[StreamingQuery], int]]:
    """Within the block late rows are counted; what it gives tells the count of a query that has ended."""
    listener = _LateRows()
    spark.streams.addListener(listener)

    def count(query: StreamingQuery) -> int:
        # progress comes in order before the end, but both come after awaitTermination returns
        if not listener.ended[str(query.runId)].wait(60):
            raise TimeoutError(f"no end of query {query.id} was reported")
        spark.streams.removeListener(listener)
        return listener.dropped.get(str(query.runId), 0)

    yield count


def sink_rows(spark: SparkSession, root: str, name: str = "data") -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


#: Micro-batches of an update-mode sink after which its rows are merged into a snapshot.
MERGE_EVERY = 16


def partition_values(rows: DataFrame, *names: str) -> list[tuple[int, ...]]:
    """Numbers of the partition folders that a table has, from the listing of its files; nothing is read."""
    pattern = re.compile("/".join(rf"{n}=(\d+)" for n in names) + "/")
    return sorted({tuple(map(int, m.groups())) for f in rows.inputFiles() if (m := pattern.search(f))})


def _snapshot(spark: SparkSession, root: str) -> tuple[int, DataFrame | None]:
    """The newest snapshot of an update-mode sink and the last batch in it; -1 and none before the first."""
    try:
        rows = spark.read.parquet(f"{root}/snapshot")
    except AnalysisException:
        return -1, None
    newest = max(partition_values(rows, "upto"), default=(-1,))[0]
    return newest, rows.where(F.col("upto") == newest).drop("upto")


def _latest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def updates(root: str, keys: Sequence[str], every: int | None = None) -> Callable[[DataFrame, int], None]:
    """Sink for update mode: a folder per micro-batch, and every so many batches a snapshot of the latest row per key.

    A repeated batch replaces its folder and, where it ends a snapshot, that snapshot, from the one before.
    """
    every, put = every or MERGE_EVERY, batch_folder(root)

    def write(rows: DataFrame, batch: int) -> None:
        put(rows, batch)
        if (batch + 1) % every == 0:
            merged = latest_rows(rows.sparkSession, root, keys, upto=batch)
            merged.write.mode("overwrite").parquet(f"{root}/snapshot/upto={batch}")

    return write


def latest_rows(spark: SparkSession, root: str, keys: Sequence[str], upto: int | None = None) -> DataFrame:
    """Rows of an update-mode sink as of the last batch that touched each key: the newest snapshot and the batches after it.

    ``upto`` leaves out later batches, and snapshots that hold that batch.
    """
    last, snapshot = _snapshot(spark, root)
    rows = sink_rows(spark, root)
    if upto is not None:
        rows = rows.where(F.col("batch") <= upto)
        if last >= upto:  # a batch is repeated: its snapshot is made again, from the batches
            last, snapshot = -1, None
    if snapshot is None:
        return _latest(rows, keys)
    known = snapshot.withColumn("batch", F.lit(last))
    return _latest(known.unionByName(rows.where(F.col("batch") > last).select(*known.columns)), keys)
