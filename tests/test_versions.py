"""Stored versions with hash trees, and logs that consumers read from their positions."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from waybill.operators import diff
from waybill.session import fresh_dir
from waybill.sources import changelog, hashtree


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def old(spark):
    return spark.range(4000).selectExpr("id AS k", "id % 7 AS a", "CASE WHEN id % 5 > 0 THEN CONCAT('t', id) END AS b", "CAST(id / 3 AS DOUBLE) AS __clash")


@pytest.mark.parametrize("buckets", [1, 16, 100, 256])
def test_diff_of_stored_versions(spark, old, buckets):
    new = old.where("k % 991 <> 3").withColumn("a", F.when(F.col("k") % 1009 == 4, 99).otherwise(F.col("a")))
    new = new.unionByName(spark.range(5000, 5003).selectExpr("id AS k", "1L AS a", "'new' AS b", "0.5 AS __clash"))
    a, b = fresh_dir(spark, "v1"), fresh_dir(spark, "v2")
    hashtree.store(old, "k", a, buckets)
    hashtree.store(new.repartition(3), "k", b, buckets)
    assert rows(hashtree.stored_diff(a, b, old, "k")) == rows(diff.row_snapshot_diff(old, new, "k").select("k", "old_checksum", "new_checksum", "verdict"))
    assert rows(hashtree.stored_restore(a, b, old, "k")) == rows(diff.restore_operations(old, new, "k"))
    changed = hashtree.changed_buckets(hashtree.tree_of(spark, a), hashtree.tree_of(spark, b))
    want = {r[0] for r in hashtree.bucketed(diff.row_snapshot_diff(old, new, "k").select("k"), "k", buckets).select(hashtree.BUCKET).distinct().collect()}
    assert set(changed) == want


def test_equal_buckets_are_not_read(spark, old):
    """The files of buckets that are equal are spoilt; a diff that opened one would fail."""
    new = old.withColumn("a", F.when(F.col("k") == 17, 99).otherwise(F.col("a")))
    a, b = fresh_dir(spark, "v1"), fresh_dir(spark, "v2")
    for table, root in ((old, a), (new, b)):
        hashtree.store(table, "k", root, 64)
    (bucket,) = hashtree.changed_buckets(hashtree.tree_of(spark, a), hashtree.tree_of(spark, b))
    spoilt = 0
    for root in (a, b):
        for path in glob.glob(f"{root.removeprefix('file:')}/rows/{hashtree.BUCKET}=*/*.parquet"):
            if f"{hashtree.BUCKET}={bucket}/" not in path:
                with open(path, "wb") as file:
                    file.write(b"not parquet")
                for crc in glob.glob(path.replace("/part-", "/.part-") + ".crc"):
                    with open(crc, "wb") as file:
                        file.write(b"")
                spoilt += 1
    assert spoilt > 100
    assert [(r["k"], r["verdict"]) for r in hashtree.stored_diff(a, b, old, "k").collect()] == [(17, "modified")]
    same = hashtree.stored_verify(old, a, "k").first()
    assert tuple(same) == (4000, 4000, True, 0)
    assert tuple(hashtree.stored_verify(new, a, "k").first()) == (4000, 4000, False, 1)


def test_tree_does_not_depend_on_order_or_place(spark, old):
    made = [rows(hashtree.hash_tree(hashtree.bucketed(t, "k", 256), "k", 256)) for t in (old, old.orderBy(F.desc("b")).repartition(9))]
    assert made[0] == made[1] and [r for r in made[0] if r[0] == 0][0][2] == 4000
    assert max(r[0] for r in made[0]) == hashtree.tree_height(256) == 2


def test_versions_that_do_not_compare(spark, old):
    a, b, none = (fresh_dir(spark, "v") for _ in range(3))
    hashtree.store(old, "k", a, 16)
    hashtree.store(old, "k", b, 32)
    with pytest.raises(ValueError, match="16, 32"):
        hashtree.changed_buckets(hashtree.tree_of(spark, a), hashtree.tree_of(spark, b))
    hashtree.store(old.where("k < 0"), "k", none, 16)
    assert hashtree.stored_diff(none, a, old, "k").where("verdict = 'added'").count() == 4000
    assert hashtree.stored_diff(none, none, old, "k").count() == 0


SCHEMA = "change string, seq long, k long, v string"


def test_net_changes_against_a_walk(spark):
    rng, made, model = random.Random(4), [], {}
    for version in range(4):
        for seq in range(60):
            k = rng.randrange(25)
            change = rng.choice(["update", "delete"]) if k in model else "insert"
            if change == "delete":
                made.append((version, "delete", seq, k, model.pop(k)))
            else:
                model[k] = f"v{version}-{seq}"
                made.append((version, change, seq, k, model[k]))
    table = spark.createDataFrame(made, f"version long, {SCHEMA}")
    for after in range(-1, 4):
        state, later = {}, {}
        for version, change, _, k, v in made:
            side = state if version <= after else later
            side.setdefault(k, []).append((change, v))
        there = {k for k, c in state.items() if c[-1][0] != "delete"}
        want = set()
        for k, changes in later.items():
            stays = changes[-1][0] != "delete"
            if k in there or stays:
                want.add((k, "insert" if k not in there else "update" if stays else "delete", changes[-1][1]))
        got = changelog.net_changes(table.where(F.col("version") > after), "k")
        assert {(r["k"], r["change"], r["v"]) for r in got.collect()} == want


def test_consumers_at_their_own_positions(spark):
    root, schema = fresh_dir(spark, "log"), spark.createDataFrame([], SCHEMA).schema
    consumer = lambda name: changelog.Consumer(spark, root, name, schema, "k")
    put = lambda version, *made: changelog.append_version(spark.createDataFrame(made, schema), root, version)
    found = lambda reader: sorted((r["k"], r["change"], r["v"]) for r in reader.read().collect())
    a, b = consumer("a"), consumer("b")
    assert found(a) == [] and a.position == -1
    put(0, ("insert", 1, 1, "x"), ("insert", 2, 2, "y"))
    assert found(a) == found(b) == [(1, "insert", "x"), (2, "insert", "y")]
    a.done()
    assert a.position == 0 and b.position == -1
    put(1, ("delete", 1, 1, "x"), ("update", 2, 2, "z"))
    put(1, ("delete", 1, 1, "x"), ("update", 2, 2, "z"))  # a repeated batch replaces its version
    assert found(a) == [(1, "delete", "x"), (2, "update", "z")]
    a = consumer("a")  # it failed before it was done, and reads the same again
    assert found(a) == [(1, "delete", "x"), (2, "update", "z")]
    assert found(b) == [(2, "insert", "z")]
    waiting = a.read()
    put(2, ("insert", 1, 1, "again"))
    assert sorted(r["k"] for r in waiting.collect()) == [1, 2]  # what came after the read is for the next one
    a.done()
    assert a.position == 1 and found(a) == [(1, "insert", "again")]
    assert found(b) == [(1, "insert", "again"), (2, "insert", "z")]
    a.done(), a.done()
    assert found(a) == [] and a.position == 2
