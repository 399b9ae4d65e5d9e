"""The streaming jobs: windows, sessions, late data, ingestion, change feeds, alerts and running state."""

from __future__ import annotations

from contextlib import suppress

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.operators.monitor import query_log_aggregates
from waybill.operators.sketches import sketch_of
from waybill.operators.writes import upserted
from waybill.streaming.keyed import once_per
from waybill.streaming.runner import as_instant, as_zone_free, batch_folder, late_rows, latest_rows, partition_values, run_to_end, setting, sink_rows, updates


def _instants(stream: DataFrame, ts: str) -> DataFrame:
    return stream.withColumn(ts, as_instant(F.col(ts)))


def sliding_query_metrics(log: DataFrame, root: str, width: str = "5 minutes", every: str = "1 minute") -> DataFrame:
    """Summary of the last ``width`` of a query log, every ``every``; windows are updated as queries arrive."""
    windows = (
        _instants(log, "start_time")
        .withWatermark("start_time", "1 day")
        .groupBy(F.window("start_time", width, every).alias("w"))
        .agg(*query_log_aggregates())
        .select(as_zone_free(F.col("w.start")).alias("window_start"), "*")
        .drop("w")
    )
    run_to_end(windows, root, "update", updates(root, ["window_start"]))
    return latest_rows(log.sparkSession, root, ["window_start"])


def tumbling_credits(log: DataFrame, root: str, width: str = "1 day") -> DataFrame:
    windows = (
        _instants(log, "start_time")
        .withWatermark("start_time", "2 days")
        .groupBy(F.window("start_time", width).alias("w"), "warehouse")
        .agg((F.sum(F.col("compute_centi") * 10 + F.col("cloud_milli")).cast("double") / 1000.0).alias("credits"), F.count("*").alias("query_count"))
        .select(as_zone_free(F.col("w.start")).alias("window_start"), "warehouse", "credits", "query_count")
    )
    keys = ["window_start", "warehouse"]
    run_to_end(windows, root, "update", updates(root, keys))
    return latest_rows(log.sparkSession, root, keys)


def closed_sessions(events: DataFrame, root: str, gap: str, delay: str) -> DataFrame:
    """Sessions by inactivity gap, given out once the watermark has passed their end.

    Events of a user that one task reads are merged to sessions before they are shuffled, so a hot user costs the state's task a row per
    session and input split, not per event.
    """
    kind = F.col("event_type")
    found = (
        _instants(events, "ts")
        .withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(
            F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("events_count"),
            F.count_if(kind == "view").alias("page_views"), F.count_if(kind == "purchase").alias("purchases"),
        )
        .select(
            "user_id", as_zone_free(F.col("first")).alias("session_start"), as_zone_free(F.col("last")).alias("session_end"),
            "events_count", "page_views", (F.col("purchases") > 0).alias("conversion"),
        )
    )
    with setting(events.sparkSession, "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true"):
        run_to_end(found, root)
    return sink_rows(events.sparkSession, root).drop("batch")


def hourly_counts_with_retention(events: DataFrame, root: str, keep: str = "24 hours") -> tuple[DataFrame, int]:
    """Hourly counts whose state is kept for ``keep``; later rows are dropped and counted.

    The count is of the partial aggregates that came too late. Called again with the same ``root``
    the job goes on with the files that arrived since.
    """
    counts = (
        _instants(events, "ts")
        .withWatermark("ts", keep)
        .groupBy(F.window("ts", "1 hour").alias("w"))
        .agg(F.count("*").alias("n"))
        .select(as_zone_free(F.col("w.start")).alias("window_start"), "n")
    )
    with late_rows(events.sparkSession) as late:
        query = run_to_end(counts, root, "update", updates(root, ["window_start"]))
    return latest_rows(events.sparkSession, root, ["window_start"]), late(query)


def stream_insert(rows: DataFrame, root: str) -> DataFrame:
    """Buffered append: each micro-batch is written as one idempotent folder.

    Live runs pass ``interval='5 seconds'`` to ``runner.start`` and bound a batch by files per trigger.
    """
    run_to_end(rows, root)
    return sink_rows(rows.sparkSession, root).drop("batch")


def pipe_ingest(lines: DataFrame, root: str, fields: dict[str, tuple[str, str]], required: list[str]) -> tuple[DataFrame, DataFrame]:
    """JSON lines into a typed table; lines that do not parse or miss a required field go to a reject table.

    ``fields`` maps an output column to (path in the document, type).
    """
    doc = lines.select("value", F.try_parse_json("value").alias("__doc"))
    typed = doc.select("value", *[F.try_variant_get("__doc", path, kind).alias(name) for name, (path, kind) in fields.items()])
    good = F.lit(True)
    for name in required:
        good = good & F.col(name).isNotNull()
    marked = typed.withColumn("__good", good)
    loaded, rejected = batch_folder(root, "loaded"), batch_folder(root, "rejected")

    def write(rows: DataFrame, batch: int) -> None:
        rows.persist()  # two sinks, one parse
        loaded(rows.where("__good").select(*fields), batch)
        rejected(rows.where("NOT __good").select("value"), batch)
        rows.unpersist()

    run_to_end(marked, root, write=write)
    spark = lines.sparkSession
    return sink_rows(spark, root, "loaded").drop("batch"), sink_rows(spark, root, "rejected").drop("batch")


#: Rows of a bucket of an image, when it is first written.
BUCKET_ROWS = 1_000_000


def apply_changes(feed: DataFrame, base: DataFrame, key: str, root: str, buckets: int | None = None) -> DataFrame:
    """Apply a change feed (``change``, ``seq``, key, columns) to a table; returns the image after all changes.

    The image lies in folders by key hash, each in versions; a micro-batch writes a new version of the buckets that it
    touches, and only the newest version of a bucket is ever read. There are as many buckets as the table needs at ``BUCKET_ROWS`` when the job first starts, 64 at
    least. Within a batch the change with the highest ``seq`` wins per key. Called again with the same ``root`` the job goes
    on where it ended; a batch that is repeated starts from the versions before it.
    """
    spark, columns, path = base.sparkSession, base.columns, f"{root}/image"
    schema = T.StructType([*base.schema, T.StructField("__live", T.BooleanType()), T.StructField("__bucket", T.IntegerType()), T.StructField("__version", T.LongType())])

    def put(rows: DataFrame, version: int) -> None:
        writer = rows.withColumn("__version", F.lit(version)).write.partitionBy("__bucket", "__version")
        writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)

    def image(upto: int | None = None) -> DataFrame:
        rows = spark.read.schema(schema).parquet(path)
        newest: dict[int, int] = {}
        for b, version in partition_values(rows, "__bucket", "__version"):  # ascending
            if upto is None or version <= upto:
                newest[b] = version
        place = F.concat_ws(":", F.col("__bucket").cast("string"), F.col("__version").cast("string"))  # folders alone decide
        return rows.where(place.isin([f"{b}:{v}" for b, v in newest.items()])).where("__live").select(*columns, "__bucket")

    def write(changes: DataFrame, batch: int) -> None:
        rest = [c for c in changes.columns if c != key]
        latest = changes.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(key, "r.*").persist()
        touched = latest.select(bucket).distinct()  # a row per bucket at most
        old = image(batch).join(F.broadcast(touched), "__bucket").select(*columns)
        kept = old.join(latest.where("change = 'delete'").select(key), key, "left_anti").select(*columns)
        merged = upserted(kept, latest.where("change <> 'delete'").select(*columns), key)
        # a row that is not live in each touched bucket: a bucket whose rows were all deleted has a new version too
        empty = touched.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema], F.lit(False).alias("__live"), "__bucket")
        put(merged.select(*columns, F.lit(True).alias("__live"), bucket).unionByName(empty), batch + 1)
        latest.unpersist()

    started, known = f"{root}/started", None
    with suppress(AnalysisException):  # before the first start there is no such folder
        known = spark.read.schema("buckets int").parquet(started).first()[0]
    buckets = known or buckets or max(64, -(-base.count() // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("__bucket")
    if known is None:
        put(base.select(*columns, F.lit(True).alias("__live"), bucket), 0)
        spark.createDataFrame([(buckets,)], "buckets int").write.parquet(started)
    run_to_end(feed, root, write=write)
    return image().select(*columns)


def cooldown_alerts(alerts: DataFrame, root: str, rule: str, ts: str, ident: str, seconds: int) -> DataFrame:
    """Fires of a stream of alerts: a rule is silent until its cool-down is over. State is the time of a rule's last fire.

    An alert fires in the micro-batch that brings it; one that arrives late, before the last fire of its rule, is silent.
    """
    return once_per(alerts, root, rule, ts, ident, seconds)


def running_metrics(points: DataFrame, root: str, name: str, value: str) -> DataFrame:
    """Running count, extremes and mean per metric, updated with every micro-batch."""
    exact = F.col(value).cast("decimal(18,2)")
    state = points.groupBy(name).agg(
        F.count("*").alias("count"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        (F.sum(exact).cast("double") / F.count(exact)).alias("mean_value"),
    )
    run_to_end(state, root, "update", updates(root, [name]))
    return latest_rows(points.sparkSession, root, [name])


def daily_heartbeats(events: DataFrame, root: str, user: str, ts: str, delay: str = "1 day") -> DataFrame:
    """At most one heartbeat per user and calendar day; duplicates are known for ``delay`` of event time."""
    first = (
        events.withColumn("day", F.col(ts).cast("date"))
        .withColumn("__at", as_instant(F.col(ts)))
        .withWatermark("__at", delay)
        .dropDuplicatesWithinWatermark([user, "day"])
        .select(user, "day")
    )
    run_to_end(first, root)
    return sink_rows(events.sparkSession, root).drop("batch")


def heartbeats(events: DataFrame, root: str, user: str, ts: str, ident: str, seconds: int = 24 * 3600, delay: str = "1 day") -> DataFrame:
    """At most one heartbeat per user in ``seconds``: the first event, then always the first at least that long after the last heartbeat."""
    return once_per(events, root, user, ts, ident, seconds, delay)


def active_users_stream(events: DataFrame, root: str, user: str, ts: str) -> DataFrame:
    counts = (
        _instants(events, ts)
        .withWatermark(ts, "2 days")
        .groupBy(F.window(ts, "1 day").alias("w"))
        .agg(F.approx_count_distinct(user, 0.02).alias("active_users"))
        .select(as_zone_free(F.col("w.start")).alias("window_start"), "active_users")
    )
    run_to_end(counts, root, "update", updates(root, ["window_start"]))
    return latest_rows(events.sparkSession, root, ["window_start"])


def active_user_sketches(events: DataFrame, root: str, user: str, ts: str) -> DataFrame:
    """window_start, rows and the sketch of the users of each day, as of the last delivery; ``operators.sketches`` merges them to longer periods.

    State is one sketch per day that the watermark has not passed, however many users there are.
    """
    days = (
        _instants(events, ts)
        .withWatermark(ts, "2 days")
        .groupBy(F.window(ts, "1 day").alias("w"))
        .agg(F.count("*").alias("rows"), sketch_of(F.col(user), events.schema[user].dataType).alias("sketch"))
        .select(as_zone_free(F.col("w.start")).alias("window_start"), "rows", "sketch")
    )
    run_to_end(days, root, "update", updates(root, ["window_start"]))
    return latest_rows(events.sparkSession, root, ["window_start"])


def error_rate_windows(events: DataFrame, root: str, ts: str, width: str, failed: Column, limit: float) -> DataFrame:
    """Windows whose share of failures is above ``limit`` once all their rows have arrived."""
    counts = (
        _instants(events, ts)
        .withWatermark(ts, "1 day")
        .groupBy(F.window(ts, width).alias("w"))
        .agg(F.count("*").alias("total"), F.count_if(failed).alias("failed"))
        .select(as_zone_free(F.col("w.start")).alias("window_start"), "total", "failed")
    )
    run_to_end(counts, root, "update", updates(root, ["window_start"]))
    final = latest_rows(events.sparkSession, root, ["window_start"])
    return final.withColumn("error_rate", F.col("failed").cast("double") / F.col("total")).where(F.col("error_rate") > limit)
