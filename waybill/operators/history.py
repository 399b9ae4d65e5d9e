"""Deployment history: search, previous and latest records, retention, recovery points, chains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.operators.ordered import newest_by_key, ordered_by_key
from waybill.operators.skew import skew_join
from waybill.session import checkpointed


def event_search(
    events: DataFrame,
    ts: str,
    key: str,
    since: str | None = None,
    until: str | None = None,
    equal: Mapping[str, str] | None = None,
    contains: Mapping[str, str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Events in an inclusive time range that match every test, newest first."""
    tests: list[Column] = []
    if since:
        tests.append(F.col(ts) >= F.expr(f"TIMESTAMP_NTZ '{since}'"))
    if until:
        tests.append(F.col(ts) <= F.expr(f"TIMESTAMP_NTZ '{until}'"))
    tests += [F.col(c) == v for c, v in (equal or {}).items()]
    tests += [F.col(c).contains(v) for c, v in (contains or {}).items()]
    for test in tests:
        events = events.where(test)
    found = events.orderBy(F.desc(ts), F.desc(key))
    return found.limit(limit) if limit is not None else found


def previous_record(records: DataFrame, keys: Sequence[str], ts: str, ident: str, out: str = "previous_id") -> DataFrame:
    """Each record with the id of the one before it under the same keys."""
    return ordered_by_key(records, keys, [ts, ident], lag={out: ident})


def latest_record(records: DataFrame, keys: Sequence[str], ts: str, ident: str) -> DataFrame:
    """The newest record per key; an aggregate, so only one row per key and task is shuffled."""
    rest = [c for c in records.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(ts, ident)).alias("r")
    return records.groupBy(*keys).agg(newest).select(*keys, "r.*")


def retention_prune(records: DataFrame, keys: Sequence[str], ts: str, ident: str, cutoff: Column, keep: int = 100) -> DataFrame:
    """Records not older than ``cutoff``, then the newest ``keep`` of each key."""
    young = records.where(F.col(ts) >= cutoff)
    return newest_by_key(young, keys, [F.desc(ts), F.desc(ident)], ident, keep, "__n").drop("__n")


def recovery_point_asof(requests: DataFrame, points: DataFrame, key: str, ts: str, ident: str) -> DataFrame:
    """For each request the greatest point (time, id) of its key at or before the request's time.

    Requests and points are one ordered stream per key; a point at the same time comes first.
    """
    stream = points.select(key, ts, ident, F.lit(0).alias("__kind"), F.struct(ts, ident).alias("__point")).unionByName(
        requests.select(key, ts, ident, F.lit(1).alias("__kind"), F.lit(None).cast(points.select(F.struct(ts, ident)).schema[0].dataType).alias("__point"))
    )
    # one number that puts points before requests at equal times and then follows the id, so that
    # many rows at one time can still be cut into slices
    ordered = stream.withColumn("__at", F.expr(f"CAST(__kind AS DECIMAL(1,0)) * 100000000000000000000BD + CAST({ident} AS DECIMAL(20,0))"))
    filled = ordered_by_key(ordered, [key], [ts, "__at"], last_known={"__found": "__point"})
    return filled.where("__kind = 1").select(
        F.col(ident).alias("request_id"), key, F.col(ts).alias("request_ts"),
        F.col(f"__found.{ident}").alias("point_id"), F.col(f"__found.{ts}").alias("point_ts"),
    )


def chain_depths(records: DataFrame, ident: str, parent: str) -> DataFrame:
    """Walk every record's parent chain: root, steps to it, and whether the chain is sound.

    ``status`` is ``ok``, ``gap`` (an ancestor is missing) or ``cycle``. Pointers double each
    round, so a chain of n records takes log2(n) rounds whatever its shape; records whose walk
    has ended leave the join. Each round is checkpointed in the shared folder.
    """
    records = checkpointed(records.select(ident, parent))
    known = records.select(F.col(ident).alias("__p")).withColumn("__exists", F.lit(True))
    nodes = skew_join(records.select(F.col(ident).alias("id"), F.col(parent).alias("__p")), known, "__p", "left")
    gap = F.col("__p").isNotNull() & F.col("__exists").isNull()
    state = checkpointed(
        nodes.select(
            "id",
            F.when(~gap, F.col("__p")).alias("jump"),
            F.when(F.col("__p").isNotNull() & ~gap, F.lit(1)).otherwise(0).cast("long").alias("steps"),
            F.when(~gap & F.col("__p").isNotNull(), F.col("__p")).otherwise(F.col("id")).alias("root"),
            gap.alias("gap"),
        )
    )
    left = state.where("jump IS NOT NULL").count()
    while left:
        ahead = state.select(
            F.col("id").alias("jump"), F.col("jump").alias("j2"), F.col("steps").alias("s2"), F.col("root").alias("r2"), F.col("gap").alias("g2")
        )
        moved = skew_join(state.where("jump IS NOT NULL"), ahead, "jump").select(
            "id", F.col("j2").alias("jump"), (F.col("steps") + F.col("s2")).alias("steps"), F.col("r2").alias("root"), F.col("g2").alias("gap")
        )
        state = checkpointed(state.where("jump IS NULL").unionByName(moved))
        still = state.where("jump IS NOT NULL").count()
        if still == left:  # no walk ended in a round: what is left runs in circles
            break
        left = still
    status = F.when(F.col("jump").isNotNull(), "cycle").when(F.col("gap"), "gap").otherwise("ok")
    ended = F.col("jump").isNull()
    return state.select(
        F.col("id").alias(ident), F.when(ended, F.col("root")).alias("root"), F.when(ended, F.col("steps")).alias("depth"), status.alias("status")
    )


def rollback_candidates(deployments: DataFrame, files: DataFrame) -> DataFrame:
    """Each deployment's way back: warnings, the strategy to use, and how many files it touched.

    A known deployment can always be rolled back; the warnings say that it has no snapshot, or that another deployment is the latest successful
    one of its schema. Without a snapshot a deployment in progress is undone in its transaction, others step by step. ``files`` has a row (deployment_id)
    for each file that a deployment executed.
    """
    keys = ["database_name", "schema_name"]
    latest = deployments.groupBy(*keys).agg(
        F.max(F.when(F.col("state") == "completed", F.struct("started_at", "deployment_id"))).alias("__latest"),
        F.count("*").alias("deployments_in_schema"),
    )
    # one row per schema on the right; a hot schema on the left is spread
    joined = skew_join(
        deployments.withColumn("__schema", F.struct(*keys)),
        latest.select(F.struct(*keys).alias("__schema"), F.col("__latest.deployment_id").alias("__latest"), "deployments_in_schema"),
        "__schema",
    )
    touched = files.groupBy("deployment_id").agg(F.count("*").alias("affected_files"))  # one row per deployment
    joined = joined.join(touched, "deployment_id", "left")
    has_snapshot = F.col("snapshot_id").isNotNull()
    warnings = F.array_compact(
        F.array(F.when(~has_snapshot, "no snapshot"), F.when(F.col("__latest") != F.col("deployment_id"), "schema modified since"))
    )
    strategy = (
        F.when(has_snapshot, "snapshot").when(F.col("state") == "in_progress", "transaction").otherwise("incremental")
    )
    return joined.select(
        "deployment_id", *keys, "state", F.lit(True).alias("can_rollback"), F.array_join(warnings, "; ").alias("warnings"),
        strategy.alias("strategy"), F.coalesce("affected_files", F.lit(0).cast("long")).alias("affected_files"), "deployments_in_schema",
    )
