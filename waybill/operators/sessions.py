"""Sessions by inactivity gap, split over time so that one busy user does not fill one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.operators.ordered import KEY, SLICE_COLUMNS, keyed, sliced


def sessions(
    events: DataFrame,
    user: str,
    ts: str,
    event_id: str,
    gap_minutes: int,
    counts: dict[str, Column],
) -> DataFrame:
    """One row per session of a user: number, start, end, rows and the given counts.

    A session ends when the next event of the user comes later than ``gap_minutes``.
    ``counts`` maps an output name to a condition whose true rows are counted.

    Sessions are first built inside time slices, which leaves one row per piece of a session.
    A table with one row per (user, slice) then tells whether a slice's first piece goes on from
    the slice before and how many sessions came earlier; pieces of one session are added up last.
    """
    gap = F.expr(f"INTERVAL '{gap_minutes}' MINUTE")
    within = [KEY, *SLICE_COLUMNS]
    inside = Window.partitionBy(*within).orderBy(ts, event_id)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.when(F.col(ts) - F.lag(ts).over(inside) > gap, 1).otherwise(0).cast("long")
    pieces = (
        keyed(sliced(events, [ts, event_id]), [user])
        .withColumn("__opens", opens)
        .withColumn("__piece", F.sum("__opens").over(running))
        .groupBy(*within, "__piece")
        .agg(
            F.min(ts).alias("__start"),
            F.max(ts).alias("__end"),
            F.count("*").alias("__rows"),
            *[F.count_if(cond).alias(f"__n_{name}") for name, cond in counts.items()],
        )
    )
    across = Window.partitionBy(KEY).orderBy(*SLICE_COLUMNS)
    before = F.lag("__last").over(across)
    starts_new = F.when(before.isNull() | (F.col("__first") - before > gap), 1).otherwise(0).cast("long")
    offsets = (
        pieces.groupBy(*within)
        .agg(F.min("__start").alias("__first"), F.max("__end").alias("__last"), F.max("__piece").alias("__inner"))
        .withColumn("__new", starts_new)
        .withColumn("__upto", F.sum(F.col("__inner") + F.col("__new")).over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .select(*within, (F.col("__upto") - F.col("__inner")).alias("__offset"))
    )
    return (
        pieces.join(offsets, within, "left")
        .groupBy(F.col(KEY)[user].alias(user), (F.col("__offset") + F.col("__piece")).alias("session_no"))
        .agg(
            F.min("__start").alias("session_start"),
            F.max("__end").alias("session_end"),
            F.sum("__rows").alias("events_count"),
            *[F.sum(f"__n_{name}").alias(name) for name in counts],
        )
    )
