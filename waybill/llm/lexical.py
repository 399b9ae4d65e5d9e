"""Ranked lexical search: a K2-treap over the grid of terms and documents.

A grid has a row for each term that is asked for and a column for each document; a cell holds the impact of the term in the document.
A quadtree over the grid is kept level by level: a node is a mask of its quadrants that are not empty and the place of its first child, and
holds the greatest impact below it. A search starts with the whole range of documents and one path for each of its item's terms. Ranges
wait in a queue by their upper bound, the sum of weight times greatest impact over the paths; halving a range moves every path one
level down in its own row. A range of one document has its exact score as bound. The search ends when no bound reaches the k-th score.

Documents are read once, into their lengths and the counts of the terms asked for. A task then builds the treaps of its share of the documents, one
after the other, and runs all items in each; the k-th scores found in one treap are the start for the next.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from waybill.llm.base import stored
from waybill.session import fresh_dir

#: A term is a run of ASCII letters and digits and of all characters beyond ASCII.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Documents and cells of a treap, ranges that a search takes from its queue at once, bytes of item text that a pass over the documents serves.
SHARD, CELLS, AT_ONCE, BLOCK = 4096, 2_000_000, 128, 8 << 20

#: Quadrants before quadrant q in a mask.
_BEFORE = np.array([[bin(mask & ((1 << q) - 1)).count("1") for q in range(4)] for mask in range(16)], dtype=np.int64)


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(text.translate(LOWER)) if text else []


def impact(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8 m) with m = 10 + (90 n docs) div length."""
    m = 10 + 90 * n * docs // length
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class K2Treap:
    """Levels of a quadtree from the whole grid down to single cells. Quadrant 2 r + c: lower rows have r = 1, later documents c = 1."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, side: int):
        """A cell stands in ``rows`` and ``columns`` once at most; all places are below ``side``."""
        self.height = max(1, (side - 1).bit_length())
        place = np.zeros(len(rows), dtype=np.int64)
        for bit in range(self.height):
            place |= ((rows >> bit) & 1) << (2 * bit + 1) | ((columns >> bit) & 1) << (2 * bit)
        order = np.argsort(place, kind="stable")
        cells, most = place[order], impacts[order].astype(np.int64)
        levels = [(cells, most, np.zeros(len(cells), dtype=np.int64), np.zeros(len(cells), dtype=np.int64))]
        for _ in range(self.height):
            parents = cells >> 2
            first = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]]) if len(cells) else np.zeros(0, dtype=np.int64)
            mask = np.bitwise_or.reduceat(1 << (cells & 3), first) if len(cells) else np.zeros(0, dtype=np.int64)
            most = np.maximum.reduceat(most, first) if len(cells) else most
            cells = parents[first]
            levels.append((cells, most, mask, first))
        levels.reverse()
        starts = np.cumsum([0, *[len(level[0]) for level in levels]])
        self.most = np.concatenate([level[1] for level in levels])
        self.mask = np.concatenate([level[2] for level in levels])
        # a child's place among all nodes
        self.first = np.concatenate([level[3] + start for level, start in zip(levels, starts[1:], strict=True)])

    def search(self, rows: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
        """(score, document) from the best on, of documents with score above 0; send the least score that still counts."""
        if not len(self.most) or not len(rows):
            return
        root = int(weights.sum() * self.most[0])
        # a range: -bound, order of arrival, level, first document / width, nodes of its terms, their rows and weights
        queue, arrived = [(-root, 0, 0, 0, np.zeros(len(rows), dtype=np.int64), rows, weights)], 0
        while queue:
            batch = []
            while queue and len(batch) < AT_ONCE and -queue[0][0] >= max(1, least):
                bound, _, level, at, nodes, own, heavy = queue[0]
                if level == self.height:
                    if batch:
                        break  # what is in the batch may hold equal documents that come first
                    heapq.heappop(queue)
                    sent = yield -bound, at
                    least = least if sent is None else max(least, sent)
                    continue
                batch.append(heapq.heappop(queue))
            if not batch:
                return
            sizes = [len(r[4]) for r in batch]
            nodes, own, heavy = (np.concatenate([r[i] for r in batch]) for i in (4, 5, 6))
            shift = np.repeat([self.height - 1 - r[2] for r in batch], sizes)
            ends = np.cumsum([0, *sizes])
            lower, mask, first = 2 * ((own >> shift) & 1), self.mask[nodes], self.first[nodes]
            for side in (0, 1):
                quadrant = lower + side
                there = np.flatnonzero((mask >> quadrant) & 1)
                child = first[there] + _BEFORE[mask[there], quadrant[there]]
                weighted, rows_left = heavy[there], own[there]
                cuts = np.searchsorted(there, ends)  # where the paths of each range begin among those that go on
                upto = np.r_[0, np.cumsum(weighted * self.most[child])]
                bounds = upto[cuts[1:]] - upto[cuts[:-1]]
                for i in np.flatnonzero(bounds >= max(1, least)).tolist():
                    arrived += 1
                    a, b, r = cuts[i], cuts[i + 1], batch[i]
                    heapq.heappush(queue, (-int(bounds[i]), arrived, r[2] + 1, 2 * r[3] + side, child[a:b], rows_left[a:b], weighted[a:b]))


def _counted(vocabulary: dict[str, int]):
    """doc_id, none, n and the counts of the terms in ``vocabulary``, for documents with terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, none, text in zip(batch["doc_id"], batch["none"], batch["text"], strict=True):
                words = terms_of(text)
                if words:
                    asked = sorted((vocabulary[t], tf) for t, tf in Counter(words).items() if t in vocabulary)
                    out.append((doc, none, len(words), [t for t, _ in asked], [tf for _, tf in asked]))
            yield pd.DataFrame(out, columns=["doc_id", "none", "n", "terms", "counts"])

    return run


def _ranked(items: list[tuple[int, np.ndarray, np.ndarray]], docs: int, length: int, k: int, shard: int):
    """The ``k`` best documents of a partition for each item (number, rows, weights)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list[tuple]] = {number: [] for number, *_ in items}

        def searched(gathered: list[tuple]) -> None:
            gathered.sort(key=lambda g: g[1])  # documents of one length have impacts of one size: their ranges get close bounds
            ids = [g[0] for g in gathered]  # (no doc_id, doc_id)
            sizes = [len(g[2]) for g in gathered]
            rows = np.concatenate([np.asarray(g[2], dtype=np.int64) for g in gathered])
            tf = np.concatenate([np.asarray(g[3], dtype=np.int64) for g in gathered])
            impacts = impact(tf, np.repeat(np.array([g[1] for g in gathered], dtype=np.int64), sizes), docs, length)
            # of the rows asked for only those that occur; their order stays
            present, row = np.unique(rows, return_inverse=True)
            treap = K2Treap(row.astype(np.int64), np.repeat(np.arange(len(ids)), sizes), impacts, max(len(present), len(ids)))
            for number, asked, weights in items:
                at = np.searchsorted(present, asked)
                there = (at < len(present)) & (present[np.minimum(at, len(present) - 1)] == asked) if len(present) else np.zeros(len(asked), dtype=bool)
                own = best[number]
                found = treap.search(at[there], weights[there], -own[-1][0] if len(own) == k else 0)
                try:
                    score, column = next(found)
                    while True:
                        key = (-score, *ids[column])  # without a doc_id last among equals
                        if len(own) < k or key < own[-1]:
                            insort(own, key)
                            del own[k:]
                        score, column = found.send(-own[-1][0] if len(own) == k else None)
                except StopIteration:
                    pass

        gathered, cells = [], 0
        for batch in batches:
            for doc, none, n, terms, counts in batch[["doc_id", "none", "n", "terms", "counts"]].itertuples(index=False):
                if len(gathered) >= shard or cells + len(terms) > CELLS and gathered:
                    searched(gathered)
                    gathered, cells = [], 0
                if len(terms):
                    gathered.append(((bool(none), int(doc)), int(n), terms, counts))
                    cells += len(terms)
        if gathered:
            searched(gathered)
        out = [(number, doc, none, -score) for number, own in best.items() for score, none, doc in own]
        yield pd.DataFrame(out, columns=["number", "doc_id", "none", "score"])

    return run


def _blocks(items: DataFrame, block: int) -> list[DataFrame]:
    """item_id and terms in parts of about ``block`` bytes of text; rows that share an item_id are one item."""
    sizes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-sizes // block) or 1
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    return [items.where(part == i) if parts > 1 else items for i in range(parts)]


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` documents of highest score for each item; score above 0, equal scores by doc_id.

    docs: doc_id (a whole number), text; items: item_id, text; other columns play no part. Every row of ``docs`` is a document: repeated rows
    count in all statistics and are ranked each. A null or empty text has no terms. A document without doc_id is ranked after those of equal score, with a null
    doc_id. Rows that share an item_id, null included, are one item with the terms of all. Items without terms, or whose terms no
    document has, give no rows, nor does an empty table. Items are taken in blocks of ``block`` bytes, one pass over the documents each; a block's
    vocabulary and items go to all tasks.
    """
    spark, path = docs.sparkSession, fresh_dir(docs.sparkSession, "lexical")
    schema = items.select("item_id").schema.add("doc_id", "long").add("score", "long")
    spark.createDataFrame([], schema).write.parquet(path)
    # Python reads a column of numbers and nulls as doubles, so the nulls travel apart
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "text")
    for part in _blocks(items, block):
        _block(docs, part, k, shard, schema).write.mode("append").parquet(path)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (
        spark.read.schema(schema)
        .parquet(path)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )


def _block(docs: DataFrame, items: DataFrame, k: int, shard: int, schema: StructType) -> DataFrame:
    spark = docs.sparkSession
    asked: dict = {}
    for item, text in items.select("item_id", "text").toLocalIterator():  # a block's bytes at most
        asked.setdefault(item, set()).update(terms_of(text))
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*asked.values())))}
    if not vocabulary:
        return spark.createDataFrame([], schema)
    counted = stored(docs.mapInPandas(_counted(vocabulary), "doc_id long, none boolean, n long, terms array<int>, counts array<int>"), "lexical-counts")
    total, length = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not total:
        return spark.createDataFrame([], schema)
    df = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1))).toLocalIterator())  # a row per term of the block
    weights = {t: weight(total, n) for t, n in df.items()}
    numbers = list(asked)
    rows = []
    for number, item in enumerate(numbers):
        own = np.array(sorted(t for t in map(vocabulary.get, asked[item]) if weights.get(t)), dtype=np.int64)
        rows.append((number, own, np.array([weights[t] for t in own.tolist()], dtype=np.int64)))
    found = counted.mapInPandas(_ranked(rows, total, length, k, shard), "number long, doc_id long, none boolean, score long")
    names = spark.createDataFrame(list(enumerate(numbers)), StructType([StructField("number", LongType()), schema["item_id"]]))
    return found.join(F.broadcast(names), "number").select("item_id", F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "score")
