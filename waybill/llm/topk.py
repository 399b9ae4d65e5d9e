"""Exact top-k search by inner product: a ball tree in every shard, searched by branch and bound.

Shards are the cells of the top of a ball tree that a bounded sample of the vectors shapes; every vector is dealt to its cell, and a cell with more
vectors than a shard holds is divided by a hash of the id. A task builds the ball tree of a shard and then lets the queries stream by, so it
holds one shard and one batch of queries. For each query nodes are visited in the order of their upper bound q.c + |q| r, and
the search of a shard ends at the first node that cannot reach the current k-th score. Queries first run in the shard they
come from; the k-th score found there is shared with all other shards: a query is sent only to those whose centre and radius let them
reach it, and its search there starts from it.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.base import stored

#: Vectors of a shard, and of a leaf of its tree.
SHARD, LEAF = 8192, 64
#: Vectors, and components, of the sample that shapes the cells; vectors of it that a cell stands for.
SAMPLE, COMPONENTS, CELL = 20_000, 1 << 22, 16
#: Steps that move the two means.
MEANS = 10
#: Shards whose centres a task compares with queries at a time, queries that it compares at a time, queries of a slice.
BLOCK, CHUNK, SLICE = 4096, 16, 1 << 16
#: Components up to this size have inner products that a double holds exactly (at up to 4,096 of them).
EXACT = 1 << 20
LONG = (1 << 63) - 1


class Cells:
    """The top of a ball tree over sampled vectors of one length: halves between two means, down to numbered cells."""

    def __init__(self, points: np.ndarray, cells: int, first: int):
        self.nodes, self.next = [], first
        with np.errstate(all="ignore"):
            self._grow(points, cells)

    def _grow(self, points: np.ndarray, cells: int) -> int:
        node = len(self.nodes)
        self.nodes.append(None)
        if cells > 1 and len(points) >= 2 * CELL:
            direction, cut = self._between(points)
            left = points @ direction < cut
            if 0 < left.sum() < len(points):
                share = min(cells - 1, max(1, round(cells * left.mean())))
                self.nodes[node] = (direction, cut, (self._grow(points[left], share), self._grow(points[~left], cells - share)))
                return node
        self.nodes[node], self.next = self.next, self.next + 1
        return node

    @staticmethod
    def _between(points: np.ndarray) -> tuple[np.ndarray, float]:
        """The plane between two means, which begin at far points; at the median instead where one side would have under 1/16."""
        one = points[((points - points.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        two = points[((points - one) ** 2).sum(axis=1).argmax()]
        for _ in range(MEANS):
            direction = one - two
            cut = (one + two) @ direction / 2
            left = points @ direction < cut
            if not 1 / 16 <= left.mean() <= 15 / 16:
                return direction, np.median(points @ direction)
            one, two = points[~left].mean(axis=0), points[left].mean(axis=0)
        return direction, cut

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        out, todo = np.zeros(len(vectors), np.int32), [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(self.nodes[node], int):
                out[rows] = self.nodes[node]
                continue
            direction, cut, children = self.nodes[node]
            with np.errstate(all="ignore"):
                left = vectors[rows] @ direction < cut
            todo += [(children[0], rows[left]), (children[1], rows[~left])]
        return out


def _cells(vectors: DataFrame, longest: int, shards: int) -> dict[int, Cells]:
    """Cells by length of vector, of a sample that a hash of the id chooses; lengths that it does not hold have none."""
    if shards < 2 or not longest:
        return {}
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE, COMPONENTS // longest)).select("scaled").toPandas()["scaled"]
    out, first = {}, 1
    for size, part in sample.groupby(sample.map(len)):
        if size:
            out[size] = Cells(_floored(part, size), min(-(-shards * len(part) // len(sample)), len(part) // CELL), first)
            first = out[size].next
    return out


def _celled(cells: dict[int, Cells]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["cell"] = np.zeros(len(batch), np.int32)
            for size, part in batch.groupby(batch["scaled"].map(len)):
                if size in cells:
                    batch.loc[part.index, "cell"] = cells[size].of(_floored(part["scaled"], size))
            yield batch

    return run


def dealt(vectors: DataFrame, shard: int) -> tuple[DataFrame, int]:
    """vec_id, scaled and the shard of every vector, and the number of shards.

    A cell is divided by a hash of the id where it holds more than ``shard`` vectors; there are ``SAMPLE / CELL`` cells at most, of vectors of all
    other lengths one more.
    """
    n, longest = vectors.agg(F.count(F.lit(1)), F.max(F.size("scaled"))).first()
    cells = _cells(vectors, longest, -(-n // shard))
    kept = stored(vectors.mapInPandas(_celled(cells), "vec_id long, scaled array<double>, cell int"), "topk-cells")
    first, parts = 0, []
    for cell, rows in sorted(tuple(r) for r in kept.groupBy("cell").count().collect()):
        parts.append((cell, first, -(-rows // shard)))
        first += parts[-1][2]
    of_cell = F.broadcast(vectors.sparkSession.createDataFrame(parts, "cell int, first int, parts int"))
    at = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    return kept.join(of_cell, "cell").select("vec_id", "scaled", at.alias("shard")), max(1, first)


class BallTree:
    """Balls over the different vectors of a shard; of equal vectors the ``k + 1`` smallest ids are kept, more never count."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.vectors, place = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, place.ravel()))
        starts = np.searchsorted(place.ravel()[order], np.arange(len(self.vectors) + 1))
        self.ids = [ids[order[a : min(b, a + k + 1)]].tolist() for a, b in zip(starts, starts[1:], strict=False)]
        self.exact = float(np.abs(vectors).max(initial=0)) <= EXACT and vectors.shape[1] <= 4096
        self.centers, self.radii, self.members, self.children = [], [], [], []
        self._grow(np.arange(len(self.vectors)))
        self.centers, self.radii = np.array(self.centers), np.array(self.radii)

    def _grow(self, members: np.ndarray) -> int:
        points = self.vectors[members]
        node, center = len(self.centers), points.mean(axis=0)
        self.centers.append(center)
        self.radii.append(float(np.sqrt(((points - center) ** 2).sum(axis=1).max(initial=0))))
        self.members.append(members)
        self.children.append(None)
        if len(members) > LEAF:
            far = points[((points - center) ** 2).sum(axis=1).argmax()]
            other = points[((points - far) ** 2).sum(axis=1).argmax()]
            order = np.argsort(points @ (far - other), kind="stable")
            half = len(members) // 2
            self.children[node] = (self._grow(members[order[:half]]), self._grow(members[order[half:]]))
        return node

    def search(self, own: int, query: np.ndarray, bounds: np.ndarray, k: int, least: float) -> list[tuple[int, int]]:
        """The best (-score, id) without the query's own id; those below ``least`` may be left out."""
        best: list[tuple[int, int]] = []
        if not self.exact or np.abs(query).max(initial=0) > EXACT:
            whole = [int(x) for x in query]
            for vector, ids in zip(self.vectors, self.ids, strict=True):
                score = sum(a * int(b) for a, b in zip(whole, vector, strict=True))
                best += [(-max(-LONG - 1, min(LONG, score)), i) for i in ids if i != own]
            return heapq.nsmallest(k, best)
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            kth = max(least, -best[k - 1][0]) if len(best) >= k else least
            if -bound + 1 + 1e-9 * abs(bound) < kth:
                break
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-bounds[child], child))
                continue
            members = self.members[node]
            scores = self.vectors[members] @ query
            for m in np.nonzero(scores >= kth)[0]:
                score = int(scores[m])
                for i in self.ids[members[m]]:
                    if i != own and (len(best) < k or (-score, i) < best[k - 1]):
                        insort(best, (-score, i))
                        del best[k:]
        return best


FOUND = "query_id long, vec_id long, score long, shard int, size int, center array<double>, radius double"


def _search(k: int):
    """Found rows, and one row for each shard and length of vector with centre and radius; a radius without bound where scores are not exact."""

    def found(trees: dict[int, BallTree], batch: pd.DataFrame) -> list[tuple]:
        out = []
        lengths = batch["vector"].map(len)
        for size, part in batch.groupby(lengths):
            if not (tree := trees.get(size)):
                continue
            queries = _floored(part["vector"], size)
            norms = np.sqrt((queries**2).sum(axis=1))
            bounds = queries @ tree.centers.T + norms[:, None] * tree.radii[None, :]
            for q, own, least, row in zip(queries, part["id"], part["least"], bounds, strict=True):
                out += [(own, i, -s) for s, i in tree.search(own, q, row, k, least)]
        return out

    def told(shard: int, trees: dict[int, BallTree]) -> list[tuple]:
        return [(None, None, None, shard, n, t.centers[0], float(t.radii[0]) if t.exact else float("inf")) for n, t in trees.items()]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([(*r, *[None] * (7 - len(r))) for r in rows], columns=[c.split()[0] for c in FOUND.split(", ")])
        return out.astype({c: "Int64" for c in ("query_id", "vec_id", "score", "shard", "size")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, gathered, trees = None, [], None
        for batch in batches:
            rows = []
            for (at, asks), part in batch.groupby(["shard", "asks"], sort=True):
                if at != shard:
                    if trees is None:
                        rows += told(shard, _trees(gathered, k))
                    shard, gathered, trees = at, [], None
                if not asks:
                    gathered.append(part[["id", "vector"]])
                    continue
                if trees is None:
                    trees = _trees(gathered, k)
                    gathered = []
                    rows += told(shard, trees)
                rows += found(trees, part)
            yield frame(rows)
        if trees is None:
            yield frame(told(shard, _trees(gathered, k)))

    return run


def _reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The shards of a block, other than its own, whose bound for a query is not below the query's k-th score."""
    at, gathered, known = None, [], None
    for batch in batches:
        for (block, piece, asks), part in batch.groupby(["block", "slice", "asks"], sort=True):
            if (block, piece) != at:
                at, gathered, known = (block, piece), [], None
            if not asks:
                gathered.append(part)
                continue
            if known is None:
                rows = pd.concat(gathered) if gathered else part[:0]
                known, gathered = dict(list(rows.groupby(rows["vector"].map(len)))), []
            for size, queries in part.groupby(part["vector"].map(len)):
                if size not in known:
                    continue
                shards, radii = known[size]["shard"].to_numpy(), known[size]["bound"].to_numpy()
                centers = np.array(known[size]["vector"].tolist(), dtype=float).reshape(len(shards), size)
                reach = np.sqrt((centers**2).sum(axis=1)) + radii
                for begin in range(0, len(queries), CHUNK):
                    some = queries[begin : begin + CHUNK]
                    asked = _floored(some["vector"], size)
                    least, large = some["bound"].to_numpy()[:, None], np.abs(asked).max(axis=1, initial=0)[:, None] > EXACT
                    norms = np.sqrt((asked**2).sum(axis=1))[:, None]
                    with np.errstate(all="ignore"):
                        bounds = asked @ centers.T + norms * radii[None, :] + 1 + 1e-9 * norms * reach[None, :]
                        sent = (~(bounds < least) | large) & (shards[None, :] != some["shard"].to_numpy()[:, None])
                    q, s = np.nonzero(sent)
                    out = some.iloc[q][["id", "vector", "bound"]]
                    out.insert(0, "shard", shards[s])
                    yield out


def shipments(queries: DataFrame, balls: DataFrame, shards: int) -> DataFrame:
    """shard, id, vector and least for each query and other shard that may hold a score as high as ``least``.

    Queries meet the centres in blocks of shards and slices of queries: neither goes to all tasks, and a query is copied once for each
    ``BLOCK`` shards.
    """
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices, blocks = max(tasks, -(-queries.count() // SLICE)), -(-shards // BLOCK)
    centers = balls.select(
        F.floor(F.col("shard") / BLOCK).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
        F.lit(False).alias("asks"), "shard", F.lit(None).cast("long").alias("id"), F.col("center").alias("vector"), F.col("radius").alias("bound"),
    )
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"),
        F.lit(True), F.col("home"), "id", "vector", F.col("least"),
    )
    work = centers.union(asked).repartition(slices * blocks, "block", "slice").sortWithinPartitions("block", "slice", "asks", "id")
    return work.mapInPandas(_reached, "shard int, id long, vector array<double>, bound double").withColumnRenamed("bound", "least")


def _floored(vectors: pd.Series, size: int) -> np.ndarray:
    """A row for each vector, rounded down."""
    return np.floor(np.array(vectors.tolist(), dtype=float).reshape(len(vectors), size))


def _trees(gathered: list[pd.DataFrame], k: int) -> dict[int, BallTree]:
    if not gathered:
        return {}
    rows = pd.concat(gathered)
    return {
        size: BallTree(part["id"].to_numpy(np.int64), _floored(part["vector"], size), k)
        for size, part in rows.groupby(rows["vector"].map(len))
    }


def scaled_vectors(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and scale * x of each component, for the rows all of whose components have a finite one."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.lit(scale))
    odd = F.exists(scaled, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (
        rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~odd)
        .groupBy("vec_id")
        .agg(F.min("embedding").alias("embedding"))
        .select("vec_id", scaled.alias("scaled"))
    )


def top_k(rows: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, shard: int = SHARD) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` best rows for each row whose vec_id is divisible by ``every``.

    rows: vec_id, embedding; other columns play no part. Scores are inner products of floor(scale * x), exact, and held to the
    range of a long. Ties go to the smaller vec_id. A query does not find its own id. Vectors that are null, hold null or
    non-finite components or become so when scaled take no part, nor do rows without an id. Rows repeating an id count once, by the
    least of their vectors. Vectors meet those of their own length only; an empty vector scores 0. Fewer than ``k``
    other vectors give fewer rows; an empty table none.
    """
    vectors, shards = dealt(stored(scaled_vectors(rows, scale), "topk-vectors"), shard)
    asks, none = F.lit(True), F.lit(float("-inf"))
    held = vectors.select("shard", ~asks, F.col("vec_id").alias("id"), F.col("scaled").alias("vector"), none)
    queries = vectors.where(F.col("vec_id") % every == 0).select(
        F.col("shard").alias("home"), F.col("vec_id").alias("id"), F.col("scaled").alias("vector")
    )

    def searched(asked: DataFrame) -> DataFrame:
        work = held.toDF("shard", "asks", "id", "vector", "least").union(asked.select("shard", asks, "id", "vector", "least"))
        return work.repartition(shards, "shard").sortWithinPartitions("shard", "asks", "id").mapInPandas(_search(k), FOUND)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    home = stored(searched(queries.select(F.col("home").alias("shard"), "id", "vector", none.alias("least"))), "topk-home")
    first = home.where(F.col("query_id").isNotNull()).select("query_id", "vec_id", "score")
    balls = home.where(F.col("query_id").isNull()).select("shard", "size", "center", "radius")
    ranked = first.withColumn("rank", F.row_number().over(order))
    kth = ranked.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("kth"))
    known = queries.join(kth, queries["id"] == kth["query_id"], "left").withColumn("least", F.coalesce("kth", none))
    away = searched(shipments(known, balls, shards)).where(F.col("query_id").isNotNull()).select("query_id", "vec_id", "score")
    return (
        first.union(away)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
