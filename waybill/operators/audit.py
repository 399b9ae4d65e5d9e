"""Hash chains over audit logs.

A log is written in rotations (files, days), given by a column. Inside a rotation each event's hash covers its payload and the hash of
the event before. The first event of a rotation is chained to an anchor: a digest of the log, the rotation and all payloads of
the rotation before. So rotations are chained and checked in parallel, and a change, a removal or a reordering breaks a hash
or a link. SHA-256 is sequential, so a rotation is the unit of sequential work: its events stream through one task in order, a batch
at a time, and no row holds more than one event, however long the rotation. ``order`` is unique in a rotation.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from waybill.operators.ordered import ordered_by_key


def _link(before: Column, payload: Column) -> Column:
    return F.sha2(F.concat(before, F.lit("|"), payload), 256)


def _hex(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def link_after(before: str | None, payload: str | None) -> str | None:
    """The hash of one event, in Python."""
    return None if before is None or payload is None else _hex(f"{before}|{payload}")


def part_of(payload: str | None) -> str:
    """What one event adds to the digest of its rotation."""
    return "" if payload is None else _hex(payload)


def anchor_of(log: str | None, rotation: str | None, digest: str | None) -> str:
    """What a rotation's first event is chained to; ``digest`` is that of the rotation before, if there is one."""
    return _hex("|".join(p for p in ("log", log, rotation, digest or "") if p is not None))


def _streamed(rows: DataFrame, log: str, rotation: str, order: list[str], tie: str) -> DataFrame:
    """The rows of a rotation one after the other in one partition; the sort spills to disk."""
    return rows.repartition(log, rotation).sortWithinPartitions(log, rotation, *order, tie)


def _digests(entries: DataFrame, log: str, rotation: str, order: list[str], payload: str) -> DataFrame:
    """log, rotation and the digest of its payloads' digests; only those travel, not the payloads."""
    parts = entries.select(log, rotation, *order, F.sha2(payload, 256).alias("__part"))
    rows = _streamed(parts, log, rotation, order, "__part").select(log, rotation, "__part")
    kind = StructType(rows.schema.fields[:2]).add("__digest", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = head = made = None
        for batch in batches:
            for k, (at, part) in enumerate(zip(_keys(batch), batch.column(2).to_pylist(), strict=True)):
                if made is None or at != key:
                    if made:
                        yield _with(head, {"__digest": [made.hexdigest()]})
                    key, made = at, sha256()
                    head = batch.slice(k, 1).select([0, 1])
                made.update((part or "").encode())
        if made:
            yield _with(head, {"__digest": [made.hexdigest()]})

    return rows.mapInArrow(run, kind)


def _keys(batch: pa.RecordBatch) -> list[tuple]:
    """Log and rotation of each row."""
    return list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))


def _with(batch: pa.RecordBatch, more: dict[str, list]) -> pa.RecordBatch:
    added = [pa.array(v, pa.int64() if n == "seq" else pa.string()) for n, v in more.items()]
    return pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *more])


def _anchored(entries: DataFrame, log: str, rotation: str, order: list[str], payload: str) -> DataFrame:
    """The events with the anchor of their rotation."""
    before = F.lag("__digest").over(Window.partitionBy(log).orderBy(rotation))
    parts = [F.lit("log"), F.col(log).cast("string"), F.col(rotation).cast("string"), F.coalesce(before, F.lit(""))]
    anchors = _digests(entries, log, rotation, order, payload).select(
        F.col(log).alias("__log"), F.col(rotation).alias("__of"), F.sha2(F.concat_ws("|", *parts), 256).alias("__anchor")
    )
    same = F.col(log).eqNullSafe(F.col("__log")) & F.col(rotation).eqNullSafe(F.col("__of"))
    return entries.join(anchors, same).drop("__log", "__of")


def running_hash_chain(events: DataFrame, log: str, rotation: str, order: list[str], payload: str) -> DataFrame:
    """Events with seq (from 1 in their rotation), prev_hash and hash = sha256(prev_hash | payload).

    A null payload has no hash, nor has what follows it in its rotation.
    """
    events = events.select(log, rotation, *order, payload)
    rows = _streamed(_anchored(events, log, rotation, order, payload), log, rotation, order, payload)
    kind = StructType(list(rows.schema.fields)).add("seq", LongType()).add("prev_hash", StringType()).add("hash", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seq, last = None, 0, None
        for batch in batches:
            numbers, links, made = [], [], []
            values, anchors = batch.column(payload).to_pylist(), batch.column("__anchor").to_pylist()
            for at, value, anchor in zip(_keys(batch), values, anchors, strict=True):
                if not seq or at != key:
                    key, seq, last = at, 0, anchor
                seq += 1
                numbers.append(seq)
                links.append(last)
                last = link_after(last, value)
                made.append(last)
            yield _with(batch, {"seq": numbers, "prev_hash": links, "hash": made})

    return rows.mapInArrow(run, kind).select(log, rotation, "seq", *order, payload, "prev_hash", "hash")


def audit_chain_verify(entries: DataFrame, log: str, rotation: str, order: list[str], payload: str) -> DataFrame:
    """Whether each event's hash fits its payload and prev_hash, and its link fits the event or rotation before.

    A link needs only the event before, which slices find however long the rotation; only the digests are sequential.
    """
    linked = ordered_by_key(_anchored(entries, log, rotation, order, payload), [log, rotation], order, lag={"__before": "hash"})
    return (
        linked.withColumn("hash_ok", F.coalesce(F.col("hash") == _link(F.col("prev_hash"), F.col(payload)), F.lit(False)))
        .withColumn("link_ok", F.col("prev_hash").eqNullSafe(F.coalesce("__before", "__anchor")))
        .drop("__anchor", "__before")
    )


def chain_heads(entries: DataFrame, log: str, rotation: str, payload: str) -> DataFrame:
    """What a chain needs to go on: the events of each log's last rotation as ``log``, rotation (text), seq, hash and part of the digest."""
    last = entries.groupBy(log).agg(F.max(rotation).alias("__of")).select(F.col(log).alias("__log"), "__of")
    same = F.col(log).eqNullSafe(F.col("__log")) & F.col(rotation).eqNullSafe(F.col("__of"))
    part = F.coalesce(F.sha2(payload, 256), F.lit("")).alias("part")
    return entries.join(last, same).select(log, F.col(rotation).cast("string").alias("rotation"), "seq", "hash", part)
