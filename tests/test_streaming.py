"""Streaming jobs in several micro-batches against their batch twins."""

import pytest
from pyspark.sql import functions as F

from waybill.operators import cooldown, monitor, windows
from waybill.plans.tables import Tables
from waybill.session import fresh_dir
from waybill.streaming import jobs
from waybill.streaming.runner import file_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


def rows(df, *cols):
    return sorted(tuple(str(v) for v in r) for r in df.select(*cols).collect())


def replay(spark, df, part, parts):
    """Write rows as one file per arrival, for a file stream that reads one file at a time."""
    path = fresh_dir(spark, "replay")
    marked = df.withColumn("__part", part).cache()
    for i in range(parts):
        marked.where(F.col("__part") == i).drop("__part").coalesce(1).write.mode("append").parquet(path)
    return path


def arrivals(spark, df, parts=3):
    days = F.datediff(F.col("ts").cast("date"), F.expr("DATE '2024-01-01'"))
    path = replay(spark, df, F.least(F.lit(parts - 1), F.floor(days * parts / 31)).cast("int"), parts)
    return file_stream(spark, path, df.schema, max_files=1)


def test_windows_over_micro_batches(spark, tables):
    stream = arrivals(spark, tables.events)
    got = jobs.active_users_stream(stream, fresh_dir(spark, "a"), "user_id", "ts")
    assert rows(got, "window_start") == rows(windows.active_users(tables.events, "ts", "user_id"), "window_start")
    metrics = jobs.running_metrics(stream, fresh_dir(spark, "m"), "event_type", "value")
    batch = monitor.metric_rollup(tables.events, "event_type", "ts", "event_id", "value")
    columns = ["event_type", "count", "min_value", "max_value", "mean_value"]
    assert rows(metrics, *columns) == rows(batch, *columns)
    failed = F.col("event_type") == "error"
    alerts = jobs.error_rate_windows(stream, fresh_dir(spark, "e"), "ts", "1 day", failed, 0.2)
    columns = ["window_start", "total", "failed"]
    assert rows(alerts, *columns) == rows(monitor.error_rate_by_window(tables.events, "ts", "1 day", failed, 0.2), *columns)


def test_late_rows_are_dropped(spark, tables):
    day = lambda n, count, at: tables.events.limit(count).select(F.expr(f"TIMESTAMP_NTZ '2024-01-{n:02d} {at}:00:00'").alias("ts"), F.lit(n).alias("part"))
    made = day(1, 5, "01").unionAll(day(5, 5, "01")).unionAll(day(6, 5, "01"))
    late = tables.events.limit(3).select(F.expr("TIMESTAMP_NTZ '2024-01-01 02:00:00'").alias("ts"), F.lit(7).alias("part"))
    every = made.unionAll(late)
    part = F.when(F.col("part") == 1, 0).when(F.col("part") == 5, 1).when(F.col("part") == 6, 2).otherwise(3)
    path = replay(spark, every, part, 4)
    counts, dropped = jobs.hourly_counts_with_retention(file_stream(spark, path, every.schema, max_files=1), fresh_dir(spark, "late-job"))
    assert dropped == 1  # the late rows are one partial count when they reach the state
    assert counts.agg(F.sum("n")).first()[0] == 15


def test_cooldown_across_batches(spark, tables):
    stream = arrivals(spark, tables.events)
    got = jobs.cooldown_alerts(stream, fresh_dir(spark, "cool"), "event_type", "ts", "event_id", 36 * 3600)
    want = cooldown.cooldown_fires(tables.events, "event_type", "ts", "event_id", 36 * 3600)
    assert rows(got, "event_type", "event_id") == rows(want, "event_type", "event_id")


def test_change_feed(spark, tables):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    feed = spark.createDataFrame(
        [("update", 1, 1, "a1"), ("delete", 2, 2, None), ("insert", 3, 4, "d"), ("update", 4, 1, "a2"), ("delete", 5, 4, "d"), ("insert", 6, 2, "b2")],
        "change string, seq int, k long, v string",
    )
    path = replay(spark, feed, F.floor((F.col("seq") - 1) / 3).cast("int"), 2)
    got = jobs.apply_changes(file_stream(spark, path, feed.schema, max_files=1), base, "k", fresh_dir(spark, "cdc"))
    assert rows(got, "k", "v") == [("1", "a2"), ("2", "b2"), ("3", "c")]


def test_change_feed_goes_on_after_a_restart(spark, tables):
    base = spark.createDataFrame([(k, "a") for k in range(40)], "k long, v string")
    one = spark.createDataFrame([("update", 1, 1, "b"), ("delete", 2, 2, None)], "change string, seq int, k long, v string")
    two = spark.createDataFrame([("delete", 3, k, None) for k in range(30)] + [("insert", 4, 99, "new")], one.schema)
    path, root = fresh_dir(spark, "feed"), fresh_dir(spark, "cdc")
    run = lambda: rows(jobs.apply_changes(file_stream(spark, path, one.schema), base, "k", root, buckets=8), "k", "v")
    one.write.mode("append").parquet(path)
    first = sorted([("1", "b")] + [(str(k), "a") for k in range(40) if k not in (1, 2)])
    assert run() == first
    assert run() == first  # nothing new: the image after the last batch, not the base
    two.write.mode("append").parquet(path)
    assert run() == sorted([("99", "new")] + [(str(k), "a") for k in range(30, 40)])


def test_late_rows_of_all_batches_are_counted(spark, tables):
    """Spark remembers the progress of so many batches only; the count does not depend on that."""
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 1)
    try:
        test_late_rows_are_dropped(spark, tables)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


def test_stream_insert_repeats_nothing(spark, tables):
    stream = arrivals(spark, tables.events)
    root = fresh_dir(spark, "insert")
    assert jobs.stream_insert(stream, root).count() == tables.events.count()
    # a second run continues from the checkpoint and finds nothing new
    assert jobs.stream_insert(stream, root).count() == tables.events.count()


def test_deliveries_leave_out_no_row(spark, tables):
    """Rows of any time, also before 2024 and without one, are delivered, in order and over several deliveries."""
    from waybill.plans.streams import DELIVERIES, _deliveries, delivered

    for start in ("2019-05-01", "2024-01-01", "2031-01-01"):
        times = F.expr(f"CASE WHEN id > 0 THEN TIMESTAMP_NTZ '{start} 00:00:00' + make_interval(0, 0, 0, CAST(id AS INT)) END")
        table = spark.range(90).select("id", times.alias("ts"))
        got = delivered(tables, table, lambda stream, root: spark.read.parquet(root.removesuffix("job") + "in"))
        assert sorted(r["id"] for r in got.collect()) == list(range(90))
        dealt = [r["d"] for r in table.orderBy("id").select(_deliveries(table).alias("d")).collect()]
        assert dealt == sorted(dealt) and set(dealt) == set(range(DELIVERIES))


def seconds_after(spark, made):
    """(key, seconds, id, delivery) as a table with a zone-free time."""
    start = "timestampadd(SECOND, s, TIMESTAMP_NTZ '2024-01-01 00:00:00')"
    return spark.createDataFrame(made, "user string, s int, id long, d int").selectExpr("user", f"{start} AS ts", "id", "d")


def let_through(got):
    return sorted((r["user"] or "", r["id"]) for r in got.collect())


def test_cooldown_goes_on_after_a_restart(spark):
    """State outlives the run; a late alert, older than the last fire, is silent, also if it would have fired in time."""
    path, root = fresh_dir(spark, "alerts"), fresh_dir(spark, "cool")
    made = seconds_after(spark, [
        ("a", 0, 1, 0), ("a", 0, 0, 0), ("a", 9, 2, 0), (None, 5, 3, 0), ("b", 3, 4, 0),
        ("a", 10, 5, 1), ("a", 50, 6, 1), ("b", 12, 7, 1), (None, 15, 8, 1),
        ("a", 30, 9, 2), ("a", 59, 10, 2), ("a", 60, 11, 2), ("b", 13, 12, 2), ("c", None, 13, 2),
    ])
    want = [[("", 3), ("a", 0), ("b", 4)], [("", 3), ("", 8), ("a", 0), ("a", 5), ("a", 6), ("b", 4)]]
    want += [sorted([*want[1], ("a", 11), ("b", 12)])]
    for d in range(3):
        made.where(F.col("d") == d).drop("d").write.mode("append").parquet(path)
        for _ in range(2):  # a run that finds nothing new changes nothing
            got = jobs.cooldown_alerts(file_stream(spark, path, made.drop("d").schema), root, "user", "ts", "id", 10)
            assert let_through(got) == want[d]


def test_busy_rule_against_a_walk(spark):
    """A third of all alerts belong to one rule; several micro-batches."""
    import random

    rng, made = random.Random(7), []
    for k in range(3000):
        made.append((f"r{rng.randrange(40)}" if k % 3 else "hot", rng.randrange(5000), k, 0))
    made = [(u, s, i, s // 1700) for u, s, i, _ in made]
    table = seconds_after(spark, made)
    path = replay(spark, table, F.col("d"), 3)
    got = jobs.cooldown_alerts(file_stream(spark, path, table.schema, max_files=1), fresh_dir(spark, "cool"), "user", "ts", "id", 60)
    want, last = [], {}
    for u, s, i, _ in sorted(made, key=lambda m: (m[1], m[2])):
        if u not in last or s >= last[u] + 60:
            last[u] = s
            want.append((u, i))
    assert let_through(got) == sorted(want)


def test_heartbeat_in_24_hours(spark):
    """Not the calendar day: 23:00 and 01:00 the next day are one heartbeat. State that a timer dropped changes nothing."""
    hour = 3600
    made = seconds_after(spark, [
        ("a", 23 * hour, 1, 0), ("a", 25 * hour, 2, 0), ("b", 0, 3, 0),
        ("a", 47 * hour - 1, 4, 1), ("a", 47 * hour, 5, 1), ("b", 24 * hour, 6, 1), ("c", 40 * hour, 7, 1),
        ("b", 200 * hour, 8, 2), ("a", 201 * hour, 9, 2),
        ("b", 223 * hour, 10, 3), ("c", 225 * hour, 11, 3), ("b", 224 * hour, 12, 3), ("late", 3 * hour, 13, 3),
    ])
    path = replay(spark, made, F.col("d"), 4)
    got = jobs.heartbeats(file_stream(spark, path, made.schema, max_files=1), fresh_dir(spark, "beat"), "user", "ts", "id")
    assert let_through(got) == sorted([("a", 1), ("b", 3), ("a", 5), ("b", 6), ("c", 7), ("b", 8), ("a", 9), ("b", 12), ("c", 11)])


def chain_events(spark, made):
    return spark.createDataFrame(made, "log int, part int, id int, payload string")


def test_chain_as_events_arrive(spark):
    """Three deliveries, the second of which begins inside a rotation, give the batch chain; a new start goes on from stored links."""
    from waybill.operators import audit
    from waybill.streaming import keyed

    made = [(None if k % 4 == 0 else k % 3, k // 100, k, None if k == 333 else f"p{k}") for k in range(400)]
    whole, names = audit.running_hash_chain(chain_events(spark, made), "log", "part", ["id"], "payload"), ["log", "part", "id", "payload", "seq", "prev_hash", "hash"]
    want = rows(whole, *names)
    path = replay(spark, chain_events(spark, made), F.when(F.col("id") < 150, 0).when(F.col("id") < 151, 1).otherwise(2), 3)
    stream = lambda p: file_stream(spark, p, chain_events(spark, made).schema, max_files=1)
    root = fresh_dir(spark, "chain")
    got = keyed.chained(stream(path), root, "log", "part", ["id"], "payload")
    assert rows(got, *names) == want
    # an event of a closed rotation is handed back; the chain stands
    chain_events(spark, [(1, 0, 9999, "late"), (1, 4, 10000, "next")]).write.mode("append").parquet(path)
    again = keyed.chained(stream(path), root, "log", "part", ["id"], "payload")
    assert rows(again.where("late"), "id", "seq", "hash") == [("9999", "None", "None")]
    checked = audit.audit_chain_verify(again.where("NOT late").drop("late"), "log", "part", ["id"], "payload")
    odd = audit.audit_chain_verify(whole, "log", "part", ["id"], "payload").where("NOT hash_ok OR NOT link_ok")  # after the null payload
    assert rows(checked.where("NOT hash_ok OR NOT link_ok"), "id") == rows(odd, "id")
    # stored links of the first 250 events, then a new job for the rest
    first = audit.running_hash_chain(chain_events(spark, made[:250]), "log", "part", ["id"], "payload")
    rest = fresh_dir(spark, "rest")
    chain_events(spark, made[250:]).coalesce(1).write.parquet(rest)
    heads = audit.chain_heads(first, "log", "part", "payload")
    more = keyed.chained(stream(rest), fresh_dir(spark, "chain"), "log", "part", ["id"], "payload", heads)
    assert rows(first.select(*names).unionByName(more.select(*names)), *names) == want


def test_a_rotation_of_a_log_is_gathered_at_a_time(monkeypatch):
    """The rows of a log come out by rotation, all of them, and never more than a rotation's or the held ones at once."""
    import pandas as pd
    from waybill.streaming import keyed

    monkeypatch.setattr(keyed, "HELD_ROWS", 20)
    made = [(None if k % 5 == 4 else f"d{k % 5}", k) for k in range(500)]
    pieces, most, concat = (pd.DataFrame(made[k : k + 7], columns=["to", "k"]) for k in range(0, 500, 7)), [], pd.concat
    monkeypatch.setattr(pd, "concat", lambda parts: most.append(len(whole := concat(list(parts)))) or whole)
    got = [(None if pd.isna(rows["to"].iloc[0]) else rows["to"].iloc[0], rows["k"].tolist()) for rows in keyed.by_rotation(pieces, "to")]
    assert got == [(to, [k for v, k in made if v == to]) for to in (None, "d0", "d1", "d2", "d3")]
    assert max(most) == 100


def test_sessions_are_merged_before_the_shuffle(spark, monkeypatch):
    """A hot user's events reach the state as sessions of each input split."""
    queries = []
    monkeypatch.setattr(jobs, "run_to_end", lambda stream, root, *rest: queries.append(run(stream, root, *rest)) or queries[-1])
    run = __import__("waybill.streaming.runner", fromlist=["run_to_end"]).run_to_end
    minute = "timestampadd(MINUTE, CAST(id AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')"
    hot = spark.range(3000).selectExpr("IF(id % 3 = 0, 1L, id % 50) AS user_id", f"{minute} AS ts", "'view' AS event_type", "id")
    path = replay(spark, hot, F.floor(F.col("id") / 1500).cast("int"), 2)
    found = jobs.closed_sessions(file_stream(spark, path, hot.schema, max_files=1), fresh_dir(spark, "s"), "200 minutes", "1 hour")
    plan = queries[0]._jsq.explainInternal(False)
    assert "MergingSessions" in plan and plan.index("SessionWindowStateStoreRestore") < plan.rindex("MergingSessions")
    assert plan.count("MergingSessions") >= 2
    assert spark.conf.get("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition") == "false"
    assert found.count() == 0  # all sessions go on to the end


def test_update_sinks_read_a_snapshot_and_what_came_after(spark, tables, monkeypatch):
    from waybill.streaming import runner

    monkeypatch.setattr(runner, "MERGE_EVERY", 2)
    table = tables.events.select("event_type", "value", "event_id").limit(70).cache()
    path, root = replay(spark, table, F.pmod(F.col("event_id"), F.lit(5)).cast("int"), 5), fresh_dir(spark, "m")
    got = jobs.running_metrics(file_stream(spark, path, table.schema, max_files=1), root, "event_type", "value")
    want = table.groupBy("event_type").agg(F.count("*").alias("count"), F.max("value").alias("max_value"))
    columns = ["event_type", "count", "max_value"]
    assert rows(got, *columns) == rows(want, *columns)
    assert runner.partition_values(spark.read.parquet(f"{root}/snapshot"), "upto") == [(1,), (3,)]
    # of five batches only the last is read besides the snapshot
    read = {f for f in got.select("event_type").inputFiles() if "/data/" in f}
    plan = got._jdf.queryExecution().toString()
    assert "upto" in plan and read
    scans = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert any("(batch" in line and "> 3" in line for line in scans)
    # a batch is repeated: its snapshot comes from the batches before it
    again = runner.latest_rows(spark, root, ["event_type"], upto=1)
    assert rows(again, *columns) == rows(spark.read.parquet(f"{root}/snapshot/upto=1"), *columns)


def test_old_versions_of_an_image_are_not_read(spark):
    import glob

    base = spark.createDataFrame([(k, "a") for k in range(40)], "k long, v string")
    feed = spark.createDataFrame([("update", s, k, f"b{s}") for s in (1, 2) for k in range(40)], "change string, seq int, k long, v string")
    path, root = replay(spark, feed, F.col("seq") - 1, 2), fresh_dir(spark, "cdc")
    got = jobs.apply_changes(file_stream(spark, path, feed.schema, max_files=1), base, "k", root, buckets=4)
    spoilt = [f for f in glob.glob(f"{root.removeprefix('file:')}/image/*/*/*.parquet") if "__version=2" not in f]
    assert spoilt
    for file in spoilt:
        with open(file, "wb") as out:
            out.write(b"not parquet")
    assert rows(got, "k", "v") == sorted((str(k), "b2") for k in range(40))
    # a later start keeps the number of buckets it began with
    assert rows(jobs.apply_changes(file_stream(spark, path, feed.schema, max_files=1), base, "k", root, buckets=9), "k", "v") == rows(got, "k", "v")
