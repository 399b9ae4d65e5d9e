"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.base import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is hung below the least of the node and its neighbours."""
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung below the least of them. links: u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _state(links: DataFrame) -> tuple:
    """What tells two link tables apart: their size and two sums of 64-bit hashes."""
    hashes = [F.sum(F.xxhash64(*pair).cast("decimal(20,0)")) for pair in (("u", "v"), ("v", "u"))]
    return tuple(links.agg(F.count(F.lit(1)), *hashes).first())


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of ``links`` (u, v), each once.

    Stars: after O(log n) rounds every node hangs directly below its root. A node with very many neighbours costs no
    memory, since only its least neighbour is looked up. Every round is written to the shared folder.
    """
    directed = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = stored(directed, "components")
    state = _state(links)
    while state[0]:
        links = stored(_small_star(_large_star(links).distinct()).distinct(), "components")
        after = _state(links)
        if after == state:
            break
        state = after
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
