"""SimHash fingerprints and near-duplicate groups by a Gray-order hierarchical index.

The index, over the distinct fingerprints only:

1. Fingerprints are sorted by Gray rank, so neighbours share most bits. The sorted list is cut into blocks.
2. A node holds what its fingerprints have in common: the mask of bits on which they all agree, and those bits. Upper nodes
   join ``FAN`` nodes each.
3. Pairs of nodes are followed from the top. Bits that both masks share and that differ are differences that every pair of
   fingerprints below has, so a pair of nodes with more than ``distance`` of them is dropped with all that stands below.
4. Pairs of blocks that are left go to tasks, where the same tree goes on inside the blocks down to single fingerprints.

A task reports a spanning forest of the links it found instead of all pairs: at most one row per fingerprint and pair of blocks,
however large a group of near copies is, and no connection is lost. Blocks have equal sizes, so a dense region is just more blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.base import partitions, stored, unused
from waybill.llm.components import components

#: Seed of the shingle hash; the same as in Spark's xxhash64.
SEED = 42
#: Fingerprints in a block of the index, and nodes below one upper node.
BLOCK, FAN = 1024, 32
#: Fingerprints or nodes below a node inside a block.
TWIG = 8
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint_of(text: bytes | None, shingle: int) -> int:
    """SimHash of a UTF-8 text: a bit is 1 if set in over half of the shingle hashes; 0 for a text without words."""
    words = text.lower().split() if text else []  # on bytes both know ASCII only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    ones, total = np.zeros(64, dtype=np.int64), len(words) - shingle + 1
    for start in range(0, total, CHUNK):
        stop = min(start + CHUNK, total)
        runs = zip(*(words[start + k : stop + k] for k in range(shingle)), strict=True)
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in runs), np.uint64, stop - start)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprint(text: F.Column, shingle: int = 3) -> F.Column:
    """The fingerprint of a text column as a signed long; null and empty texts give 0."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            prints = np.fromiter((fingerprint_of(t, shingle) for t in batch), np.uint64, len(batch))
            yield pd.Series(prints.view(np.int64))

    return run(text.cast("binary"))


def gray_rank(code: F.Column) -> F.Column:
    """Position of a code in Gray order as a signed long that sorts like the unsigned one."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def _apart(a: str, b: str) -> F.Column:
    """Bits on which all of node ``a`` differ from all of node ``b``: known to both, and not the same.

    ``lo`` is the AND of a node's codes and ``hi`` their OR; a bit is shared where the two agree.
    """
    col = F.col
    known = F.bitwise_not(col(f"{a}.lo").bitwiseXOR(col(f"{a}.hi")).bitwiseOR(col(f"{b}.lo").bitwiseXOR(col(f"{b}.hi"))))
    return F.bit_count(col(f"{a}.lo").bitwiseXOR(col(f"{b}.lo")).bitwiseAND(known))


def _joined(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy((F.col("node") / FAN).cast("long").alias("node")).agg(
        F.bit_and("lo").alias("lo"), F.bit_or("hi").alias("hi")
    )


def block_pairs(nodes: DataFrame, distance: int) -> DataFrame:
    """Pairs (a <= b) of blocks that may hold fingerprints within ``distance`` bits; nodes: node, lo, hi."""
    levels, top = [nodes], nodes.agg(F.max("node")).first()[0] or 0
    while top >= FAN:
        levels.append(stored(_joined(levels[-1]), "simhash-nodes"))
        top //= FAN
    pairs = levels[-1].select(F.col("node").alias("a"), F.explode(F.sequence("node", F.lit(top))).alias("b"))
    for depth, level in reversed(list(enumerate(levels))):
        pairs = (
            pairs.alias("p")
            .join(level.alias("x"), F.col("p.a") == F.col("x.node"))
            .join(level.alias("y"), F.col("p.b") == F.col("y.node"))
            .where(_apart("x", "y") <= distance)
            .select("a", "b")
        )
        if depth:
            for side in ("a", "b"):
                below = F.sequence(F.col(side) * FAN, F.col(side) * FAN + FAN - 1)
                pairs = pairs.withColumn(side, F.explode(below))
            pairs = pairs.where("a <= b")
    return pairs


def _levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """AND and OR of the nodes of each level, single codes first; a node has TWIG nodes of the level below."""
    out = [(codes, codes)]
    while len(out[-1][0]) > TWIG:
        starts = np.arange(0, len(out[-1][0]), TWIG)
        out.append((np.bitwise_and.reduceat(out[-1][0], starts), np.bitwise_or.reduceat(out[-1][1], starts)))
    return out


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices into the Gray-sorted codes a and b whose codes differ in at most ``distance`` bits; i < j if a is b."""
    same, la = a is b, _levels(a.view(np.uint64))  # of signed numbers numpy counts the bits of the absolute value
    lb = la if same else _levels(b.view(np.uint64))
    while len(la) < len(lb):
        la.append(la[-1])
    while len(lb) < len(la):
        lb.append(lb[-1])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(la[-1][0])), np.arange(len(lb[-1][0])), indexing="ij"))
    for depth in range(len(la) - 1, -1, -1):
        (alo, ahi), (blo, bhi) = la[depth], lb[depth]
        known = ~((alo ^ ahi)[i] | (blo ^ bhi)[j])
        keep = np.bitwise_count((alo[i] ^ blo[j]) & known) <= distance
        i, j = i[keep], j[keep]
        if depth:
            i, j = np.repeat(_children(i, la, depth), TWIG, axis=1), np.tile(_children(j, lb, depth), (1, TWIG))
            inside = (i < len(la[depth - 1][0])) & (j < len(lb[depth - 1][0]))
            if same:
                inside &= i <= j
            i, j = i[inside], j[inside]
    return (i[i < j], j[i < j]) if same else (i, j)


def _children(nodes: np.ndarray, levels: list, depth: int) -> np.ndarray:
    """TWIG children of each node in a row; those beyond the end of the level below do not exist."""
    if levels[depth][0] is levels[depth - 1][0]:  # a shorter tree, filled up: a node is its own only child
        return nodes[:, None] + np.arange(TWIG)[None, :] * len(levels[depth][0])
    return nodes[:, None] * TWIG + np.arange(TWIG)[None, :]


def _forest(codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Rows (code, root) that connect what the links i-j connect."""
    root = np.arange(len(codes))
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, before[i], low)
        np.minimum.at(root, before[j], low)
        root = root[root]
        if (root == before).all():
            break
    away = np.nonzero(root != np.arange(len(codes)))[0]
    return np.stack([codes[away], codes[root[away]]], axis=1)


def _links(distance: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for a, b, xs, ys in zip(*(batch[c] for c in ("a", "b", "xs", "ys")), strict=True):
                left = np.asarray(xs, dtype=np.int64)
                right = left if a == b else np.asarray(ys, dtype=np.int64)
                i, j = _near(left, right, distance)
                if a == b:
                    found.append(_forest(left, i, j))
                else:
                    found.append(_forest(np.concatenate([left, right]), i, j + len(left)))
            edges = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
            yield pd.DataFrame({"u": edges[:, 0], "v": edges[:, 1]})

    return run


def near_links(codes: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of ``codes.code`` (distinct) within ``distance`` bits."""
    count = codes.count()
    ranked = codes.select("code", gray_rank(F.col("code")).alias("rank"))
    blocks = stored(
        ranked.repartitionByRange(max(1, math.ceil(count / block)), "rank")
        .groupBy(F.spark_partition_id().cast("long").alias("node"))
        .agg(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]).alias("codes"),
            F.bit_and("code").alias("lo"),
            F.bit_or("code").alias("hi"),
        ),
        "simhash-blocks",
    )
    pairs = stored(block_pairs(blocks.select("node", "lo", "hi"), distance), "simhash-pairs")
    tasks = partitions(codes, pairs.count(), 64)
    left = blocks.select(F.col("node").alias("a"), F.col("codes").alias("xs"))
    right = blocks.select(F.col("node").alias("b"), F.col("codes").alias("ys"))
    work = pairs.join(left, "a").join(right, "b").repartition(tasks, "a", "b")
    return work.mapInPandas(_links(distance), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links of at most ``distance`` differing bits reach, the row's own included.
    Null and empty texts have fingerprint 0, which links like any other. A null doc_id never names a component; where a
    component has no other, component_id is null. Repeated rows come back as often as they stand in the input. Other columns
    are ignored, so their names do not matter. An empty table gives an empty result.
    """
    prints = stored(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("code")), "simhash-prints")
    return _classes(prints, distance, block).select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _classes(prints: DataFrame, distance: int, block: int) -> DataFrame:
    """The rows of ``prints`` (doc_id, code, ...) with ``root`` and ``component_id`` of their component."""
    codes = stored(prints.groupBy("code").agg(F.min("doc_id").alias("least")), "simhash-codes")
    groups = components(near_links(codes, distance, block))
    rooted = codes.join(groups, codes["code"] == groups["node"], "left").select(
        codes["code"], "least", F.coalesce("root", codes["code"]).alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("code", "root", "component_id"), "code")


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 2, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest doc_id stays.

    All columns stay. Null doc_ids come last; between rows of one doc_id a hash of the text decides, and of rows alike in both
    one stays. Empty texts are one component.
    """
    first, second = unused(docs, "key", "check")
    key = F.xxhash64("doc_id", "text"), F.hash("doc_id", "text")
    prints = stored(
        docs.select(
            "doc_id", fingerprint(F.col("text"), shingle).alias("code"), key[0].alias(first), key[1].alias(second)
        ),
        "simhash-prints",
    )
    kept = stored(
        _classes(prints, distance, block)
        .groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", first, second)).alias("least"))
        .select(f"least.{first}", f"least.{second}"),
        "simhash-kept",
    )
    rows = docs.withColumns({first: key[0], second: key[1]}).join(kept, [first, second], "left_semi")
    if prints.groupBy(first, second).count().where("count > 1").join(kept, [first, second], "left_semi").take(1):
        rows = rows.dropDuplicates([first, second])
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
