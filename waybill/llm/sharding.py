"""Sharding by a k-d tree over document metadata.

A node of the tree is split along its widest dimension at the weighted median (more generally: at the share of its bytes that its
left shards are due), until every leaf holds the target bytes. Equal texts are one unit with one place in the tree, so they
meet in one shard; a unit too heavy for that is divided by doc_id first. The median of all nodes of a level is found at once by
counting bytes: sixteen bits of the sort key at a time, in every pass over the units only the bytes per node and digit are
gathered, at most 65,536 rows a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.base import byte_size, partitions, stored
from waybill.operators.skew import skew_join

#: Dimensions of the tree: columns of a unit that are scaled to [0, 1] over the whole table.
DIMENSIONS = ("chars", "lang", "source", "doc")
#: Bits of a dimension in the sort key; the rest is a hash that tells units with equal values apart.
VALUE_BITS, DIGIT = 32, 16
#: Rows of a shard that one task numbers, and the heaviest unit as a share of a shard.
ROWS_PER_CHUNK, HEAVIEST = 100_000, 1 / 8


def _ordinals(units: DataFrame, column: str) -> DataFrame:
    """The values of a text dimension as their rank among its different values in code point order; null is 0.

    The values are sorted over all tasks; a value's rank is its place in its partition plus the rows of the partitions before.
    """
    values = units.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().orderBy("value")
    at = F.monotonically_increasing_id()  # the partition, and 33 bits for the place in it
    placed = stored(values.select("value", F.shiftright(at, 33).alias("of"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "shard-values")
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("of").agg(F.count(F.lit(1)).alias("n")).select("of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranks = placed.join(F.broadcast(sizes), "of")  # a row per partition of the sort
    ranks = ranks.select(F.col("value").alias(column), (F.col("before") + F.col("at") + 1).cast("double").alias("rank"))
    return skew_join(units, ranks, column, "left").withColumn(column, F.coalesce("rank", F.lit(0.0))).drop("rank")


def _units(docs: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """Rows of documents with the key of their unit, and the units with bytes and metadata; both written."""
    rows = stored(
        docs.select(
            "doc_id",
            byte_size(F.col("text")).alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("same"),
            F.length(F.coalesce("text", F.lit(""))).cast("double").alias("chars"),
            "lang",
            "source",
        ),
        "shard-rows",
    )
    texts = rows.groupBy("same", "text_crc32", "size").agg(F.count(F.lit(1)).alias("docs"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    most = max(1.0, total / shards * HEAVIEST)
    weight = F.col("docs") * F.col("size")
    heavy = stored(
        texts.where((weight > most) & (F.col("docs") > 1)).select(
            "same", "text_crc32", "size", F.ceil(weight / F.lit(most)).alias("parts")
        ),
        "shard-heavy",
    )
    key = ["same", "text_crc32", "size"]
    if heavy.take(1):  # at most shards / HEAVIEST rows, each being that share of all bytes
        part = F.pmod(F.xxhash64("doc_id", "lang", "source"), F.coalesce("parts", F.lit(1)))
        rows = rows.join(F.broadcast(heavy), key, "left").withColumn("part", part).drop("parts")
    else:
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    units = rows.groupBy(*key, "part").agg(
        F.sum("size").alias("bytes"),
        F.min("chars").alias("chars"),
        F.min("lang").alias("lang"),
        F.min("source").alias("source"),
        F.coalesce(F.min("doc_id"), F.lit(-1)).cast("double").alias("doc"),
    )
    units = units.withColumn("hash", F.xxhash64("same", "size", "part"))
    for column in ("lang", "source"):  # written in between: ranking reads the units several times
        units = _ordinals(stored(units, "shard-units"), column)
    return rows, stored(units, "shard-units")


def _sort_key(low: F.Column, high: F.Column, value: F.Column) -> F.Column:
    """64 bits, signed order: the place of the value between low and high, then the unit's hash."""
    place = F.when(high > low, (value - low) / (high - low) * (2**VALUE_BITS - 1)).otherwise(F.lit(0.0))
    top = F.shiftleft(F.floor(place).cast("long") - F.lit(1 << (VALUE_BITS - 1)), 64 - VALUE_BITS)
    return top.bitwiseOR(F.shiftrightunsigned(F.col("hash"), VALUE_BITS))


def _split(units: DataFrame, nodes: dict[int, int], bounds: dict[str, tuple[float, float]]) -> tuple[dict, dict]:
    """For every node with more than one shard: the dimension to split, and the cut in its sort key."""
    spans = units.where(F.col("node").isin(list(nodes))).groupBy("node").agg(
        *[F.min(d).alias(f"low_{d}") for d in DIMENSIONS], *[F.max(d).alias(f"high_{d}") for d in DIMENSIONS]
    )
    widest = {}
    for r in spans.collect():  # a row per node
        widths = {d: (r[f"high_{d}"] - r[f"low_{d}"]) / ((bounds[d][1] - bounds[d][0]) or 1.0) for d in DIMENSIONS}
        best = max(DIMENSIONS, key=lambda d: widths[d])
        widest[r["node"]] = (best, r[f"low_{best}"], r[f"high_{best}"])
    if not widest:
        return {}, {}
    keyed = units.where(F.col("node").isin(list(widest))).select("node", "bytes", _keys(widest).alias("key"))
    cuts = {n: 0 for n in widest}  # the digits of the cut found so far, as an unsigned number
    ahead = Window.partitionBy("node").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    wanted: dict[int, float] = {}
    for shift in range(64 - DIGIT, -1, -DIGIT):
        unsigned = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
        digit = F.shiftrightunsigned(unsigned, shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        within = keyed
        if shift < 64 - DIGIT:
            known = _by_node({n: c for n, c in cuts.items()}, "long")
            within = keyed.where(F.shiftrightunsigned(unsigned, shift + DIGIT) == known)
        sums = within.groupBy("node", digit.alias("digit")).agg(F.sum("bytes").alias("bytes"))
        if not wanted:  # the share of the left shards in the node's bytes
            sums = stored(sums, "shard-digits")
            for r in sums.groupBy("node").agg(F.sum("bytes").alias("bytes")).collect():
                wanted[r["node"]] = r["bytes"] * (nodes[r["node"]] // 2) / nodes[r["node"]]
        goal = _by_node(wanted, "double")
        before = F.coalesce(F.sum("bytes").over(ahead), F.lit(0))
        found = (
            sums.withColumn("before", before)
            .where((F.col("before") <= goal) & (goal < F.col("before") + F.col("bytes")))
            .select("node", "digit", "before", "bytes")
            .collect()  # a row per node
        )
        for r in found:
            n = r["node"]
            cuts[n] = (cuts[n] << DIGIT) | r["digit"]
            wanted[n] -= r["before"]
            if not shift and 2 * wanted[n] > r["bytes"]:  # the unit at the cut goes where it fits better
                cuts[n] += 1
    return widest, cuts


def _by_node(values: dict, kind: str) -> F.Column:
    out = F.lit(None).cast(kind)
    for node, value in values.items():
        out = F.when(F.col("node") == node, F.lit(value).cast(kind)).otherwise(out)
    return out


def _keys(widest: dict) -> F.Column:
    out = F.lit(None).cast("long")
    for node, (d, low, high) in widest.items():
        key = _sort_key(F.lit(float(low)), F.lit(float(high)), F.col(d))
        out = F.when(F.col("node") == node, key).otherwise(out)
    return out


def tree_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, shard (from 0) and slot (gapless from 0 in a shard) of every row.

    Shards get near equal sizes: each cut misses its share by half of the unit that it meets, and no unit is heavier than
    ``HEAVIEST`` of a shard unless it is one document. Equal texts share a shard as far as that allows; null counts as the
    empty text. Ties in a dimension are ordered by a hash of the text, repeated rows are copies. Null metadata sort first.
    An empty table gives no rows. Other columns of ``docs`` (doc_id, text, lang, source) play no part.

    The driver holds one cut per node of the tree, so as many as there are shards.
    """
    rows, units = _units(docs, shards)
    span = units.agg(*[F.min(d).alias(f"low_{d}") for d in DIMENSIONS], *[F.max(d).alias(f"high_{d}") for d in DIMENSIONS])
    ends = span.first()
    bounds = {d: (ends[f"low_{d}"] or 0.0, ends[f"high_{d}"] or 0.0) for d in DIMENSIONS}
    units = units.withColumn("node", F.lit(0))  # a node is named by its first shard
    nodes = {0: shards}
    while any(n > 1 for n in nodes.values()):
        open_nodes = {k: n for k, n in nodes.items() if n > 1}
        widest, cuts = _split(units, open_nodes, bounds)
        if not widest:
            break
        key = _keys(widest).bitwiseXOR(F.lit(-(1 << 63)))
        # cuts are unsigned: compare with the top bit turned over, as signed numbers
        right = _keys(widest) >= _by_node({n: _signed(c) for n, c in cuts.items()}, "long")
        half = _by_node({n: k // 2 for n, k in open_nodes.items()}, "int")
        units = units.withColumn("node", F.when(right, F.col("node") + half).otherwise(F.col("node")))
        units = stored(units, "shard-units")
        nodes = {c: m for k, n in nodes.items() for c, m in (((k, n // 2), (k + n // 2, n - n // 2)) if n > 1 else ((k, n),))}
    placed = rows.join(
        units.select("same", "text_crc32", "size", "part", F.col("node").alias("shard")),
        ["same", "text_crc32", "size", "part"],
    ).select("doc_id", "size", "text_crc32", "shard")
    return _numbered(stored(placed, "shard-placed"))


def _signed(cut: int) -> int:
    return min(cut, (1 << 64) - 1) - (1 << 63)


def _numbered(placed: DataFrame) -> DataFrame:
    """Slots: rows are numbered inside chunks of a shard by hash, and a chunk starts where those before it end."""
    chunks = partitions(placed, placed.count(), ROWS_PER_CHUNK)
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(chunks)))
    sums = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("rows"))
    ahead = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", "chunk", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("place", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "chunk"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"))
    )
