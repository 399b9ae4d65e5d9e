"""Stored tables with a hash tree, so that two versions are compared without reading what is equal.

Rows lie in buckets by a hash of their key, each with its checksum. A bucket's digest depends on its rows but not on their order; a node's digest covers
those of its ``FAN`` children, up to one root. Two versions are compared from the root down, along the nodes that differ; only the buckets at the
end of that walk are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.operators.diff import row_checksum, row_verdicts, undoing

FAN = 16
BUCKET, CHECKSUM = "__bucket", "__checksum"
_DIGITS = 15  # hexadecimal digits of a checksum in one sum


def tree_height(buckets: int) -> int:
    """Levels between the root and ``buckets`` buckets."""
    height, width = 0, 1
    while width < buckets:
        height, width = height + 1, width * FAN
    return height


def bucketed(table: DataFrame, key: str, buckets: int) -> DataFrame:
    """``table`` with the checksum of each row without its key, and its bucket. Rows without a key are dealt by their content."""
    checksum = row_checksum([c for c in table.columns if c != key])
    spread = F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(CHECKSUM))
    return table.withColumn(CHECKSUM, checksum).withColumn(BUCKET, F.pmod(spread, F.lit(buckets)).cast("int"))


def _content(key: str) -> list[Column]:
    """Rows and two order-free sums over independent parts of a hash of key and checksum."""
    digest = F.sha2(F.concat_ws("\u0001", F.coalesce(F.col(key).cast("string"), F.lit("\u0002")), CHECKSUM), 256)
    sums = [F.sum(F.conv(F.substring(digest, at, _DIGITS), 16, 10).cast("decimal(20,0)")).alias(f"sum_{at}") for at in (1, 17)]
    return [F.count(F.lit(1)).alias("rows"), *sums]


def hash_tree(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """level (0: root), node, rows and digest of every node that holds rows; ``rows`` as ``bucketed`` gives them."""
    sums = ("sum_1", "sum_17")
    leaves = rows.groupBy(F.col(BUCKET).alias("node")).agg(*_content(key))
    height = tree_height(buckets)
    digest = F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ("rows", *sums)]), 256)
    level = leaves.select(F.lit(height).alias("level"), F.col("node").cast("long").alias("node"), "rows", digest.alias("digest"))
    out = level
    for depth in reversed(range(height)):
        children = F.sort_array(F.collect_list(F.struct("node", "digest")))  # FAN at most
        above = level.groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(F.sum("rows").alias("rows"), children.alias("c"))
        text = F.array_join(F.transform("c", lambda c: F.concat_ws("=", c["node"].cast("string"), c["digest"])), ",")
        level = above.select(F.lit(depth).alias("level"), F.col("node").cast("long").alias("node"), "rows", F.sha2(text, 256).alias("digest"))
        out = out.unionByName(level)
    return out


def store(table: DataFrame, key: str, root: str, buckets: int = 256) -> None:
    """Write a version of a table below ``root``: its rows in folders by bucket, and its tree.

    Choose ``buckets`` so that a bucket is worth reading by itself, the same for all versions. ``key`` is unique; a table without rows has an empty tree.
    """
    bucketed(table, key, buckets).hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{root}/rows")
    tree = hash_tree(rows_of(table.sparkSession, root, table.schema), key, buckets)
    tree.withColumn("buckets", F.lit(buckets)).coalesce(1).write.parquet(f"{root}/tree")


def rows_of(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The rows of a stored version with checksum and bucket; ``schema`` is that of the table, or of the columns wanted."""
    return spark.read.schema(T.StructType([*schema.fields]).add(CHECKSUM, T.StringType()).add(BUCKET, T.IntegerType())).parquet(f"{root}/rows")


def tree_of(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/tree")


def changed_buckets(old: DataFrame, new: DataFrame) -> list[int]:
    """Buckets whose digests differ between two trees, found from the root down: of each level only children of nodes that differ are compared."""
    layouts = {r[0] for r in old.select("buckets").union(new.select("buckets")).distinct().collect()}
    if len(layouts) > 1:
        raise ValueError(f"the versions have different numbers of buckets: {sorted(layouts)}")
    differing: list[int] = [0]
    for level in range(tree_height(layouts.pop()) + 1 if layouts else 0):
        sides = [t.where(F.col("level") == level).select("node", F.col("digest").alias(name)) for t, name in ((old, "a"), (new, "b"))]
        if level:
            sides = [s.where(F.floor(F.col("node") / FAN).isin(differing)) for s in sides]
        apart = sides[0].join(sides[1], "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
        differing = [r["node"] for r in apart.select("node").orderBy("node").collect()]  # no more than there are buckets
        if not differing:
            return []
    return differing


def in_buckets(rows: DataFrame, buckets: Sequence[int]) -> DataFrame:
    """The rows of some buckets; the folders of others are not read."""
    return rows.where(F.col(BUCKET).isin(list(buckets)))


def stored_diff(old: str, new: str, table: DataFrame, key: str) -> DataFrame:
    """``diff.row_snapshot_diff`` of two stored versions of ``table``, of which only the type of ``key`` is asked: changed buckets are all that is read."""
    spark, wanted = table.sparkSession, T.StructType([table.schema[key]])
    changed = changed_buckets(tree_of(spark, old), tree_of(spark, new))
    sides = [in_buckets(rows_of(spark, root, wanted), changed).select(key, F.col(CHECKSUM).alias(name)) for root, name in ((old, "old_checksum"), (new, "new_checksum"))]
    return row_verdicts(*sides, key)


def stored_restore(version: str, current: str, table: DataFrame, key: str) -> DataFrame:
    """What takes the stored version ``current`` back to ``version``: key and operation, as ``diff.restore_operations`` has them."""
    return undoing(stored_diff(version, current, table, key), key)


def stored_verify(table: DataFrame, root: str, key: str) -> DataFrame:
    """Whether a table still is what was stored: source_rows, backup_rows, verified and the number of rows that differ.

    The table is read for its tree; of the stored version the tree and the buckets that differ, and those of the table once more.
    """
    spark, stored = table.sparkSession, tree_of(table.sparkSession, root)
    buckets = stored.agg(F.max("buckets")).first()[0] or 1
    rows = bucketed(table, key, buckets)
    made = hash_tree(rows, key, buckets).withColumn("buckets", F.lit(buckets))
    live = spark.createDataFrame(made.collect(), made.schema)  # not two rows a bucket
    changed = changed_buckets(stored, live)
    before = in_buckets(rows_of(spark, root, table.schema), changed).select(key, F.col(CHECKSUM).alias("old_checksum"))
    apart = row_verdicts(before, in_buckets(rows, changed).select(key, F.col(CHECKSUM).alias("new_checksum")), key)
    facts = [F.lit("source").alias("of"), F.lit(0).cast("long").alias("changed")]
    sides = live.where("level = 0").select("rows", *facts).unionByName(stored.where("level = 0").select("rows", F.lit("backup").alias("of"), facts[1]))
    sides = sides.unionByName(apart.agg(F.count(F.lit(1)).alias("changed")).select(F.lit(0).cast("long").alias("rows"), F.lit("changed").alias("of"), "changed"))
    rows_in = lambda of: F.coalesce(F.sum(F.when(F.col("of") == of, F.col("rows"))), F.lit(0))
    return sides.agg(
        rows_in("source").alias("source_rows"), rows_in("backup").alias("backup_rows"), F.lit(not changed).alias("verified"), F.sum("changed").alias("changed_rows"),
    )
