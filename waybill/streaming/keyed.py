"""Per-key state of streams: jobs whose next output depends on the one before, kept in Spark's state store (RocksDB).

A micro-batch brings the rows of a key in no order; they are gathered and sorted for the key. A chain gathers the rows of one rotation of a
log at a time; the others wait on the task's disk.
"""

from __future__ import annotations

import os
import pickle
from collections.abc import Iterable, Iterator, Sequence
from hashlib import sha256
from itertools import chain
from tempfile import TemporaryDirectory

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from waybill.operators.audit import anchor_of, link_after, part_of
from waybill.streaming.runner import as_instant, as_zone_free, run_to_end, setting, sink_rows

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which ``transformWithState`` asks for."""
    return setting(spark, _PROVIDER, _ROCKSDB)


def _as_key(c: Column) -> Column:
    """A value as text that is never null: state is looked up by it, and a null number would be taken for another key."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def _from_key(c: Column, kind: T.DataType) -> Column:
    return F.when(c != "", F.substring(c, F.lit(2), F.length(c))).cast(kind)


class OncePer(StatefulProcessor):
    """The first row of a key, then always the first at least ``wait`` microseconds after the one before.

    Rows of one time count once, by their least id. A row before the last one that came through is silent. With ``forget``, a timer drops a
    key's state once the watermark has passed its wait: every row still to come comes through then anyway.
    """

    def __init__(self, wait: int, forget: bool):
        self.wait, self.forget = wait, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        least: pd.Series | None = None
        for batch in rows:
            found = batch.groupby("at")["ident"].min()
            least = found if least is None else pd.concat([least, found]).groupby(level=0).min()
        times, idents = least.index.to_numpy(np.int64), least.to_numpy()
        until = self.last.get()[0] + self.wait if self.last.exists() else None
        at, chosen = 0 if until is None else int(np.searchsorted(times, until)), []
        while at < len(times):
            chosen.append(at)
            at = int(np.searchsorted(times, times[at] + self.wait))
        if not chosen:
            return
        last = int(times[chosen[-1]])
        self.last.update((last,))
        if self.forget:
            self.handle.registerTimer(self._end(last))
        yield pd.DataFrame({"key": [key[0]] * len(chosen), "at": times[chosen], "ident": idents[chosen]})

    def _end(self, last: int) -> int:
        return -(-(last + self.wait) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a timer of an earlier row may ring after a later row has come through
        if self.last.exists() and self._end(self.last.get()[0]) <= timerValues.getCurrentWatermarkInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def once_per(rows: DataFrame, root: str, key: str, ts: str, ident: str, seconds: int, delay: str | None = None) -> DataFrame:
    """Rows (``key``, ``ts``, ``ident``) that come through when a key is let through once in ``seconds``.

    ``ts`` is a zone-free time, ``ident`` a whole number; rows without a time never come through; rows without a key are a key of their own. A
    row that arrives late, before the last one of its key that came through, is silent. With ``delay`` rows more than that behind the
    newest time are dropped and the state of a key ends when its wait is over; without it nothing is dropped and there is one state per key ever seen. Called
    again with the same ``root`` the job goes on with what arrived since.
    """
    spark, kinds = rows.sparkSession, {f.name: f.dataType for f in rows.schema}
    at = as_instant(F.col(ts))
    timed = rows.where(F.col(ts).isNotNull()).select(at.alias("__at"), _as_key(F.col(key)).alias("key"), F.unix_micros(at).alias("at"), F.col(ident).alias("ident"))
    timed = timed.withWatermark("__at", delay) if delay else timed
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("at", T.LongType()), T.StructField("ident", kinds[ident])])
    through = (
        timed.groupBy("key")
        .transformWithStateInPandas(OncePer(seconds * 1_000_000, bool(delay)), schema, "append", "EventTime" if delay else "None")
        .select(_from_key(F.col("key"), kinds[key]).alias(key), as_zone_free(F.timestamp_micros("at")).alias(ts), F.col("ident").alias(ident))
    )
    with rocksdb(spark):
        run_to_end(through, root)
    return sink_rows(spark, root).drop("batch")


#: Rows of a key that are held at once before they go to disk, and entries of a state that are written at once.
HELD_ROWS, STATE_ROWS = 50_000, 10_000


def by_rotation(batches: Iterable[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """The rows of each rotation, null first; memory holds those of one rotation, or ``HELD_ROWS``."""
    held, count, places = [], 0, {}
    with TemporaryDirectory() as folder:

        def put() -> None:
            for value, rows in pd.concat(held).groupby(column, dropna=False, sort=False):
                place = places.setdefault(None if pd.isna(value) else value, len(places))
                with open(os.path.join(folder, str(place)), "ab") as file:
                    pickle.dump(rows, file)
            held.clear()

        def get(place: int) -> Iterator[pd.DataFrame]:
            with open(os.path.join(folder, str(place)), "rb") as file:
                while file.peek(1):
                    yield pickle.load(file)

        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= HELD_ROWS:
                put()
                count = 0
        if held:
            put()
        for value in sorted(places, key=lambda v: (v is not None, v or "")):
            yield pd.concat(get(places[value]))


class Chain(StatefulProcessor):
    """Goes on with the hash chain of a log from its last link. State: that link, and the payload digests of the open rotation."""

    def __init__(self, order: Sequence[str]):
        self.order = [*order, "payload"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "rotation string, seq long, hash string")
        self.parts = handle.getListState("parts", "seq long, part string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        known = self.head.get()[1] if self.head.exists() else 0
        newest = initialState.loc[initialState["seq"].idxmax()]
        if newest["seq"] > known:
            self.head.update(tuple(None if pd.isna(newest[c]) else newest[c] for c in ("rotation", "seq", "hash")))
        self.parts.appendList([(int(n), part) for n, part in zip(initialState["seq"], initialState["part"], strict=True)])

    def _digest(self, more: list[tuple[int, str]]) -> str:
        """Of the open rotation, whose digests are read in their order; only what stands out of it waits."""
        made, at, waiting = sha256(), 1, {}
        for number, part in chain(self.parts.get(), more):
            waiting[number] = part
            while at in waiting:
                made.update(waiting.pop(at).encode())
                at += 1
        return made.hexdigest()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rotation, seq, last = closed, any_before, _ = self.head.get() if self.head.exists() else (None, 0, None)
        more: list[tuple[int, str]] = []
        for events in by_rotation((batch for batch in rows if len(batch)), "rotation_text"):
            events = events.sort_values(self.order, na_position="first", kind="stable")
            log, to = (None if pd.isna(v) else v for v in events[["log_text", "rotation_text"]].iloc[0])
            out = events.drop(columns=["key", "log_text", "rotation_text"])
            late = bool(any_before) and (to or "") < (closed or "")
            if late:  # a closed rotation stays as it is: its digest is in the next one's anchor
                nothing = [None] * len(events)
                yield out.assign(seq=pd.array(nothing, dtype="Int64"), prev_hash=nothing, hash=nothing, late=True)
                continue
            if not seq or to != rotation:
                last, rotation = anchor_of(log, to, self._digest(more) if seq else None), to
                seq, more = 0, []
                self.parts.clear()
            numbers, before, made = [], [], []
            for payload in events["payload"]:
                seq += 1
                more.append((seq, part_of(payload)))
                numbers.append(seq), before.append(last)
                last = link_after(last, payload)
                made.append(last)
            yield out.assign(seq=pd.array(numbers, dtype="Int64"), prev_hash=before, hash=made, late=False)
        if seq:
            self.head.update((rotation, seq, last))
        for k in range(0, len(more), STATE_ROWS):
            self.parts.appendList(more[k : k + STATE_ROWS])

    def close(self) -> None:
        pass


def chained(events: DataFrame, root: str, log: str, rotation: str, order: Sequence[str], payload: str, heads: DataFrame | None = None) -> DataFrame:
    """The hash chain of ``operators.audit.running_hash_chain``, built as events arrive; the rows of all runs so far.

    Events of a rotation arrive in their order from one micro-batch to the next; inside a batch they are sorted. An event of a rotation
    that a later one has closed is ``late``: it comes back without number and hashes, and the chain stands. ``heads`` (``audit.chain_heads``) gives the
    last links of logs that exist already; it counts when a job starts for the first time.
    """
    spark, columns = events.sparkSession, [log, rotation, *order, payload]
    # inside, columns have names of their own: Spark hands a state processor no names that begin with an underscore
    inner = ["log", "rotation", *[f"o{i}" for i in range(len(order))], "payload"]
    named = events.select(*columns).toDF(*inner)
    schema = T.StructType(list(named.schema.fields)).add("seq", "long").add("prev_hash", "string").add("hash", "string").add("late", "boolean")
    texts = [F.col(c).cast("string").alias(f"{c}_text") for c in ("log", "rotation")]
    named = named.select(_as_key(F.col("log")).alias("key"), *inner, *texts)
    start = None if heads is None else heads.select(_as_key(F.col(log)).alias("key"), "rotation", "seq", "hash", "part").groupBy("key")
    links = named.groupBy("key").transformWithStateInPandas(Chain(inner[2:-1]), schema, "append", "None", start)
    with rocksdb(spark):
        run_to_end(links.toDF(*columns, "seq", "prev_hash", "hash", "late"), root)
    return sink_rows(spark, root).select(log, rotation, "seq", *order, payload, "prev_hash", "hash", "late")
