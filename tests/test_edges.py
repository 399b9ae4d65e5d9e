"""Errors, empty inputs, repeated keys, chains, loads and restores."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.functions.registry import transforms
from waybill.operators import access, audit, cooldown, diff, governance, history, marts, quality, rows, scan, writes
from waybill.session import fresh_dir
from waybill.sources import backup, bulk, export


def test_map_columns(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    with pytest.raises(ValueError, match="required"):
        rows.map_columns(df, [rows.Mapping("c", "c", required=True)])
    out = rows.map_columns(df, [rows.Mapping("b", "b", default="x"), rows.Mapping("c", "c"), rows.Mapping("d", "d", default=5)])
    assert out.columns == ["b", "d"] and out.first()["b"] is None
    with pytest.raises(KeyError, match="no transform"):
        transforms()["NOPE"]


def test_real_predicates(spark):
    df = spark.range(10)
    assert rows.filter_conjunction(df, [rows.Filter("id >= 8")]).count() == 2
    assert rows.filter_conjunction(df, []).count() == 10


def test_lookup_key_must_be_unique(spark):
    table = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="look-up key repeats"):
        rows.lookup_enrich(spark.createDataFrame([(1,)], "k int"), "k", table, "k", "v", "out").collect()


def test_upsert_with_repeated_source_keys(spark):
    target = spark.createDataFrame([(1, 1, "old"), (2, 1, "keep")], "k int, seq int, v string")
    source = spark.createDataFrame([(1, 2, "new"), (1, 3, "newer"), (3, 1, "add")], "k int, seq int, v string")
    with pytest.raises(Exception, match="source key repeats"):
        writes.upserted(target, source, "k").collect()
    got = {r["k"]: r["v"] for r in writes.upserted(target, source, "k", latest_by="seq").collect()}
    assert got == {1: "newer", 2: "keep", 3: "add"}


def test_sync_and_identical_tables(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert writes.sync_operations(a, a, "k").select("op").distinct().collect()[0]["op"] == "KEEP"
    assert diff.row_snapshot_diff(a, a, "k").count() == 0
    assert diff.row_multiset_diff(a, a.unionAll(a)).agg(F.sum("copies")).first()[0] == 2
    image = writes.synced(writes.sync_operations(a, a.where("k = 1"), "k"))
    assert [r["k"] for r in image.collect()] == [1]


def test_gate_stops_on_error_and_critical(spark):
    df = spark.range(3)
    assert quality.gate(df, [quality.Rule("w", "id < 0", "WARNING"), quality.Rule("off", "id < 0", "ERROR", enabled=False)]) is df
    for level in ("ERROR", "CRITICAL"):
        with pytest.raises(quality.QualityError):
            quality.gate(df, [quality.Rule("e", "id < 2", level)])


def test_chain_with_gap_and_cycle(spark):
    nodes = [(1, None), (2, 1), (3, 2), (4, 99), (5, 4), (6, 7), (7, 8), (8, 6), (9, 6)] + [(i, 1) for i in range(100, 200)]
    got = {r["id"]: (r["root"], r["depth"], r["status"]) for r in history.chain_depths(spark.createDataFrame(nodes, "id long, parent long"), "id", "parent").collect()}
    assert got[1] == (1, 0, "ok") and got[3] == (1, 2, "ok") and got[150] == (1, 1, "ok")
    assert got[4] == (4, 0, "gap") and got[5] == (4, 1, "gap")
    assert {got[i][2] for i in (6, 7, 8, 9)} == {"cycle"}


def test_long_chain(spark):
    chain = spark.range(1000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    assert history.chain_depths(chain, "id", "parent").agg(F.max("depth")).first()[0] == 999


def _fires(alerts, seconds):
    out, last = [], {}
    for rule, at, ident in sorted(alerts):
        if rule not in last or at - last[rule] >= seconds:
            last[rule] = at
            out.append((rule, ident))
    return sorted(out)


def test_cooldown_against_a_plain_loop(spark):
    alerts = [("hot", (i * 37) % 5000 + 10_000 * (i % 2), i) for i in range(600)] + [("b", i * 100, 1000 + i) for i in range(30)] + [("c", 5, 2000), ("c", 5, 2001)]
    df = spark.createDataFrame(alerts, "rule string, at int, id long").withColumn(
        "ts", F.expr("timestampadd(SECOND, at, TIMESTAMP_NTZ '2024-01-01 00:00:00')")
    )
    for seconds in (1, 250):
        got = cooldown.cooldown_fires(df, "rule", "ts", "id", seconds)
        assert sorted((r["rule"], r["id"]) for r in got.collect()) == _fires(alerts, seconds)


def _audit_log(spark):
    events = spark.range(2500).select(F.lit(1).alias("log"), (F.col("id") / 900).cast("int").alias("part"), "id", F.concat(F.lit("p"), "id").alias("payload"))
    return audit.running_hash_chain(events, "log", "part", ["id"], "payload")


def test_hash_chain_is_linked(spark):
    import hashlib

    got = sorted(_audit_log(spark).collect(), key=lambda r: r["id"])
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [r["id"] for r in got] == list(range(2500)) and [r["seq"] for r in got] == [i % 900 + 1 for i in range(2500)]
    for i, r in enumerate(got):
        assert r["hash"] == digest(f"{r['prev_hash']}|p{i}")
        if i % 900:
            assert r["prev_hash"] == got[i - 1]["hash"]
    assert got[0]["prev_hash"] == digest("log|1|0|")
    assert got[900]["prev_hash"] == digest("log|1|1|" + digest("".join(digest(f"p{i}") for i in range(900))))


def test_no_row_holds_a_rotation(spark):
    """Plans gather no events in a row, and rotations longer than a batch, over several batches, chain like short ones."""
    import hashlib

    log = _audit_log(spark)
    for made in (log, audit.audit_chain_verify(log, "log", "part", ["id"], "payload")):
        text = made._jdf.queryExecution().toString()
        assert "collect_list" not in text and "array_sort" not in text
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        rows = [(None if k % 3 else 1, k % 2, k, f"p{k}" if k != 300 else None) for k in range(400)]
        events = spark.createDataFrame(rows, "log int, part int, id int, payload string")
        got = audit.running_hash_chain(events, "log", "part", ["id"], "payload").collect()
        whole = audit.running_hash_chain(events.fillna("p300", "payload"), "log", "part", ["id"], "payload")
        checked = audit.audit_chain_verify(whole, "log", "part", ["id"], "payload")
        assert checked.count() == checked.where("hash_ok and link_ok").count() == 400
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(r["id"] for r in got) == list(range(400))
    for key in {(r["log"], r["part"]) for r in got}:
        own = sorted((r for r in got if (r["log"], r["part"]) == key), key=lambda r: r["id"])
        last = own[0]["prev_hash"]
        for seq, r in enumerate(own, 1):
            assert r["seq"] == seq and r["prev_hash"] == last
            last = hashlib.sha256(f"{last}|{r['payload']}".encode()).hexdigest() if last and r["payload"] else None
            assert r["hash"] == last


def test_every_change_to_a_chain_is_seen(spark):
    log = _audit_log(spark)
    seen = lambda changed: {
        r["id"] for r in audit.audit_chain_verify(changed, "log", "part", ["id"], "payload").collect() if not (r["hash_ok"] and r["link_ok"])
    }
    assert seen(log) == set()
    assert seen(log.withColumn("hash", F.when(F.col("id") == 7, "x").otherwise(F.col("hash")))) == {7, 8}
    assert seen(log.withColumn("payload", F.when(F.col("id") == 7, "x").otherwise(F.col("payload")))) == {7, 900}
    assert seen(log.where("id <> 7")) == {8, 900}
    # whoever forges an event together with its hash and the next link is betrayed by the next hash
    forged = F.when(F.col("id") == 7, "x").otherwise(F.col("payload"))
    made = log.where("id = 7").select(F.sha2(F.concat("prev_hash", F.lit("|x")), 256).alias("h")).first()["h"]
    both = log.withColumns({"payload": forged, "hash": F.when(F.col("id") == 7, made).otherwise(F.col("hash")), "prev_hash": F.when(F.col("id") == 8, made).otherwise(F.col("prev_hash"))})
    assert seen(both) == {8, 900}


def test_access_rules(spark):
    requests = spark.createDataFrame([("ann", "a.b", "read", "x")], "user_name string, resource string, action string, env string")
    users = spark.createDataFrame([("ann", True, ["r"])], "user_name string, active boolean, roles array<string>")
    decide = lambda role, policies=None: access.access_decisions(requests, users, {"r": role}, policies or {}).first()["reason"]
    assert decide(access.Role((access.Permission("a.*", ("*",)),))) == "role permission"
    assert decide(access.Role((access.Permission("aXb", ("*",)),))) == "no matching rule"
    first_wins = {"p": [access.PolicyRule("deny", "*", ("read",)), access.PolicyRule("allow", "*", ("*",))]}
    assert decide(access.Role(policies=("p",)), first_wins) == "denied by policy"
    missing = {"p": [access.PolicyRule("allow", "*", ("*",), (access.Condition("env", "not_equals", "x"),))]}
    assert decide(access.Role(policies=("p",)), missing) == "no matching rule"


def test_scan_cases(spark):
    files = [
        ("a.go", 'password = "abcdef"\n_ := f(x)'), ("b.txt", 'password = "abcdef"'), ("vendor/c.go", 'password = "abcdef"'),
        ("d.py", 'password = "abcdef" # example'), ("e.txt", "x\n-----BEGIN EC PRIVATE KEY-----\n-----BEGIN EC PRIVATE KEY-----"), ("noext", "pwd"),
    ]
    got = scan.security_scan(spark.createDataFrame(files, "path string, text string"), "path", "text").collect()
    assert sorted((r["path"], r["rule_id"], r["line"]) for r in got) == [("a.go", "CRED001", 1), ("a.go", "ERROR001", 2), ("e.txt", "CRED003", 0)]


SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.DoubleType())])


def test_load_on_error(spark):
    path = fresh_dir(spark, "csv")
    spark.createDataFrame([("1,2.5",), ("2,oops",), ("3,",), ("x,1",)], "value string").write.text(path)
    good, bad = bulk.load_with_errors(spark, path, SCHEMA, "CONTINUE 2")
    assert sorted(r["k"] for r in good.collect()) == [1, 3] and sorted(r["error"] for r in bad.collect()) == ["k: x", "v: oops"]
    for policy in ("ABORT_STATEMENT", "CONTINUE 1"):
        with pytest.raises(bulk.LoadError):
            bulk.load_with_errors(spark, path, SCHEMA, policy)
    with pytest.raises(ValueError, match="unknown file format"):
        bulk.bulk_load(spark, path, "XML", SCHEMA)
    with pytest.raises(RuntimeError, match="AVRO"):
        bulk.bulk_load(spark, path, "AVRO", SCHEMA)


def test_json_array_load(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k": 1, "v": 2.0}, {"k": 2, "v": 3.0}]')
    got = bulk.bulk_load(spark, str(tmp_path), "json", SCHEMA, bulk.LoadOptions(strip_outer_array=True))
    assert sorted(r["k"] for r in got.collect()) == [1, 2]


def test_raw_scan_numbers_lines_in_order(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(f'{{"n": {i}}}' for i in range(1, 300)))
    (tmp_path / "b.json").write_text('{"n": 1}\n{broken\n{"n": 3}')
    got = bulk.external_raw_scan(spark, str(tmp_path)).select("filename", "file_row_number", F.variant_get("event_data", "$.n", "int").alias("n"))
    assert got.where("n <> file_row_number").count() == 0 and got.count() == 302 and got.where("n IS NULL").count() == 1


def test_backup_restore(spark):
    assert backup.selected(["a", "ab", "c"], ["a*"], ["ab"]) == ["a"]
    df = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    expected = backup.table_checksum(df)
    assert expected.first() == backup.table_checksum(df.orderBy(F.desc("k")).repartition(3)).first()
    with pytest.raises(backup.BackupError):
        backup.restore(df.withColumn("v", F.lit("y")), None, "k", expected=expected)
    kept = backup.restore(df, spark.createDataFrame([(1, "current")], "k int, v string"), "k", skip_existing=True)
    assert {r["k"]: r["v"] for r in kept.collect()} == {1: "current", 2: None}


def test_export_counts_while_writing(spark):
    result = export.bulk_export(spark.range(100), fresh_dir(spark, "out"), "json", single_file=True)
    assert result.rows == 100 and result.bytes > 0


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "user_id long, ts timestamp_ntz, event_id long, event_type string")
    assert marts.user_sessions(none).count() == 0
    ids = spark.createDataFrame([], "id long")
    log = governance.erasure_log({"t": (none, "user_id")}, ids).first()
    assert (log["rows_before"], log["rows_deleted"], log["rows_left"]) == (0, 0, 0)
    assert quality.rule_report(none, {"r": F.count_if(F.col("user_id") < 0)}).first()["result"] == "PASS"


def test_orphans_ignore_null_keys(spark):
    child = spark.createDataFrame([(1,), (None,), (7,), (7,)], "k int")
    assert [tuple(r) for r in quality.fk_orphans(child, "k", spark.createDataFrame([(1,)], "id int"), "id").collect()] == [(7, 2)]


def test_asof_ties_and_missing_points(spark):
    make = lambda data: spark.createDataFrame(data, "k int, ts int, id long")
    got = history.recovery_point_asof(make([(1, 5, 100), (1, 1, 101), (2, 9, 102)]), make([(1, 5, 7), (1, 5, 8), (1, 6, 9)]), "k", "ts", "id")
    assert {r["request_id"]: r["point_id"] for r in got.collect()} == {100: 8, 101: None, 102: None}


def test_shared_folder_comes_from_the_session(spark):
    from waybill.session import shared_root

    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_root(spark) == (named or shared_root(spark))
    assert fresh_dir(spark, "x") != fresh_dir(spark, "x")


def test_merges_are_dealt_by_rows(spark, monkeypatch):
    """However well the rows compress, a task merges a bounded number; keys repeat in the target and are null."""
    monkeypatch.setattr(writes, "MERGE_ROWS", 100)
    target = spark.range(0, 1000).selectExpr("IF(id % 10 = 9, NULL, id DIV 2) AS k", "'old' AS v")
    source = spark.range(400, 1400).selectExpr("id AS k", "'new' AS v")
    image = writes.upserted(target, source, "k")
    want = sorted([(k, "new") for k in range(400, 1400)] + [(None if i % 10 == 9 else i // 2, "old") for i in range(1000) if i % 10 == 9 or i // 2 < 400], key=str)
    assert sorted(map(tuple, image.collect()), key=str) == want
    most = image.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert image.rdd.getNumPartitions() >= 10 and most < 500
