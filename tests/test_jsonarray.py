"""Arrays cut into records from many small splits, against a parser that reads a file as a whole."""

import json
import random

import pytest

from waybill.sources import bulk
from waybill.sources.jsonarray import array_records

STRANGE = ["", "}", "{", '"', "\\", '\\"', "]", "[", "},{", '"},{"', "é漢🙂", "\n", "a\\\\", "x" * 300]


def value(rng, depth=0):
    kind = rng.randrange(6 if depth < 4 else 3)
    if kind == 0:
        return "".join(rng.choice(STRANGE) for _ in range(rng.randrange(6)))
    if kind < 3:
        return rng.choice([None, True, 1, -2.5, 10**12])
    if kind == 3:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(STRANGE) + str(k): value(rng, depth + 1) for k in range(rng.randrange(4))}


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize(("size", "broadcast"), [(499, "10m"), (999, "-1")])
def test_records_of_many_splits(spark, tmp_path, small_splits, size, broadcast):
    rng, wanted = random.Random(size), []
    for k in range(4):
        rows = [{"k": k, "i": i, "v": value(rng)} for i in range(60)]
        text = json.dumps(rows, ensure_ascii=bool(k % 2), indent=2 if k > 1 else None)
        (tmp_path / f"f{k}.json").write_text(("\ufeff" if k == 2 else "") + text + "\n" * (k % 2), encoding="utf-8")
        wanted += rows
    small_splits(size)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() > 20
        got = [json.loads(r["record"]) for r in array_records(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted(got, key=lambda r: (r["k"], r["i"])) == wanted


def test_a_record_longer_than_many_splits(spark, tmp_path, small_splits):
    rows = [{"a": "}" * 5000}, {"a": [{"b": "{"}] * 400}, {"a": 1}]
    (tmp_path / "f.json").write_text(json.dumps(rows))
    small_splits(256)
    assert sorted(len(r["record"]) for r in array_records(spark, str(tmp_path)).collect()) == sorted(len(json.dumps(r)) for r in rows)


@pytest.mark.parametrize("text", ["", " \n", "[]", "[ ]\n"])
def test_nothing_inside(spark, tmp_path, text):
    (tmp_path / "f.json").write_text(text)
    assert array_records(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2', '[{"a": 1}', '[{"a": 1}, 3]', '{"a": 1}', '[{"a": 1},]', '[[{"a": 1}]]', '[{"a": 1}] x', "[1]", '[{"a": "}'])
def test_what_is_no_array_of_objects_is_an_error(spark, tmp_path, text):
    (tmp_path / "f.json").write_text(text)
    with pytest.raises(Exception, match="not one JSON array"):
        array_records(spark, str(tmp_path)).collect()


def test_typed_rows(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "f.json").write_text('[{"a": 1, "b": "x"}, {"b": null}, {"a": 3, "c": {}}]')
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    options = bulk.LoadOptions(strip_outer_array=True)
    got = bulk.bulk_load(spark, str(tmp_path), "json", schema, options).collect()
    assert sorted(map(tuple, got), key=str) == [(1, "x"), (3, None), (None, None)]
    (tmp_path / "g.json").write_text('[{"a": "no number"}]')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        bulk.bulk_load(spark, str(tmp_path), "json", schema, options).collect()


def test_large_loads_keep_brackets_with_their_rows(spark, tmp_path):
    """Without broadcasts, as on large tables, an array is still one file; rows of one key, the first included, stay apart."""
    import __spark_entry__ as contract

    keys = [0, 0, 1, 19_999, 20_000, 45_000, 45_000]
    row = "id AS o_orderkey, id AS o_custkey, 'O' AS o_orderstatus, 1.5D AS o_totalprice, TIMESTAMP_NTZ '1999-01-01 00:00:00' AS o_orderdate, '1' AS o_orderpriority"
    spark.createDataFrame([(k,) for k in keys], "id long").selectExpr(*row.split(", ")).write.parquet(str(tmp_path / "orders.parquet"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = contract.queries()["bulk_load_json_array"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted((r["o_orderkey"], r["depth"]) for r in got) == [(k, k % 3) for k in keys]
    assert all(r["note"] == '\\"}, {[' + f"{r['o_orderkey']}\n" for r in got)
