"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length, and from then on only the counts are worked on. Each source gets a budget in words. As many
whole rounds of the source as fit are taken; what is left of the budget is fitted by lengths: from the longest length down each
length gets its proportional number of documents, what cannot be met by whole documents being carried to the next length. When the
rest of the budget has come down to ``TABLE`` words, a bounded-knapsack table over the remaining lengths and their counts
finds the sum nearest to it. Which documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.base import stored, word_count

#: Words of a budget that the knapsack table covers.
TABLE = 1 << 16
#: The last document taken of a length is looked for by so many bits of its hash at a time, so often; then few are left to rank.
BITS, LEVELS = 8, 2


def water_level(sources: DataFrame, share: float, most: float) -> DataFrame:
    """source_id, weight, words -> target: ``share`` of all words by weight, none above ``most`` times its words.

    The excess of the stopped sources goes to the others by weight until none is above: the targets are
    min(most * words, level * weight) for one level, found by running sums over the sources in the order in which they stop.
    """
    cap = F.col("words") * F.lit(most)
    order = Window.orderBy(cap / F.col("weight"), "source_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ahead = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = sources.withColumns(
        {
            "rest": F.sum("words").over(everything) * F.lit(share) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)),
            "open": F.sum("weight").over(ahead),
        }
    ).withColumn("stops", F.col("rest") / F.col("open") * F.col("weight") >= cap)
    # sources stop in order, so the first that does not stop knows the level of all that follow
    first = F.struct((-F.col("place")).alias("place"), (F.col("rest") / F.col("open")).alias("level"))
    found = F.max(F.when(~F.col("stops"), first)).over(everything)
    return (
        level.withColumn("place", F.row_number().over(order))
        .withColumn("level", found["level"])
        .withColumn("target", F.when(F.col("stops"), cap).otherwise(F.col("level") * F.col("weight")).cast("double"))
        .select("source_id", "source", "words", "target")
    )


def _fill(lengths: np.ndarray, counts: np.ndarray, budget: float, table: int) -> np.ndarray:
    """How many documents of each length (descending) sum up as near to ``budget`` as the fit can get; of length 0 all or none."""
    if len(lengths) and not lengths[-1] and (lengths * counts).sum() > budget:  # no sum depends on it, and no share of it is defined
        return np.append(_fill(lengths[:-1], counts[:-1], budget, table), 0)
    taken = np.zeros(len(lengths), dtype=np.int64)
    words = lengths * counts
    total = int(words.sum())
    if total <= budget or not total:
        return counts.copy() if total else taken
    below = total - np.cumsum(words)  # words of the shorter lengths
    part, carry, left, k = budget / total, 0.0, float(budget), 0
    while k < len(lengths) and left > table:
        carry += part * words[k]
        taken[k] = min(counts[k], int(carry // lengths[k]), int(left // lengths[k]))
        carry -= taken[k] * lengths[k]
        left -= taken[k] * lengths[k]
        k += 1
    if k and left > (below[k - 1] if k else total):  # shorter lengths cannot use up the rest
        for j in range(k):
            more = min(counts[j] - taken[j], int((left - below[k - 1]) // lengths[j]) if left > below[k - 1] else 0)
            taken[j] += more
            left -= more * lengths[j]
    taken[k:] = _knapsack(lengths[k:], counts[k:], left)
    left = budget - float((taken * lengths).sum())
    over = [j for j in range(len(lengths)) if taken[j] < counts[j] and abs(left - lengths[j]) < abs(left)]
    if over:  # one document more comes nearer
        taken[min(over, key=lambda j: abs(left - lengths[j]))] += 1
    return taken


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """Bounded subset sum: the counts per length whose sum is nearest to ``budget``, the lower one if two are as near."""
    taken = np.zeros(len(lengths), dtype=np.int64)
    usable = [k for k in range(len(lengths)) if lengths[k] > 0 and counts[k] > 0]
    if not usable or budget <= 0:
        return taken
    size = int(min(int(np.ceil(budget)) + lengths[usable].max(), int((lengths * counts)[usable].sum())))
    last = np.full(size + 1, -1, dtype=np.int32)  # the length by which a sum was first reached
    reached = np.zeros(size + 1, dtype=bool)
    reached[0], goal = True, min(int(round(budget)), size)
    for k in usable:
        step = int(lengths[k])
        rows = -(-(size + 1) // step)
        grid = np.zeros(rows * step, dtype=bool)
        grid[: size + 1] = reached
        grid = grid.reshape(rows, step)
        row = np.arange(rows)[:, None]
        base = np.maximum.accumulate(np.where(grid, row, -rows - int(counts[k]) - 1), axis=0)
        fresh = ((row - base <= counts[k]) & ~grid).ravel()[: size + 1]
        last[fresh] = k
        reached |= fresh
        if reached[goal]:
            break
    sums = np.nonzero(reached)[0]
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        taken[last[at]] += 1
        at -= int(lengths[last[at]])
    return taken


def _fit(table: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ascending=False)
        lengths, counts = group["size"].to_numpy(np.int64), group["docs"].to_numpy(np.int64)
        words, target = int((lengths * counts).sum()), float(group["target"].iloc[0])
        rounds = int(target // words) if words else 0
        extra = _fill(lengths, counts, target - rounds * words, table)
        return group[["source_id", "size"]].assign(rounds=rounds, extra=extra)

    return run


def _rows(docs: DataFrame, keep: list[str], seed: int) -> DataFrame:
    """row (the kept columns as one, so that no name can clash), size, source and pick of every document."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        word_count(F.col("text")).alias("size"),
        "source",
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("pick"),
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
    table: int = TABLE,
) -> DataFrame:
    """doc_id, size, source_size, target and times of every row of ``docs`` (doc_id, text, source).

    ``times`` says how often the mix takes the row: the whole rounds of its source, and one more for the documents that the fit
    picks. Sources in code point order, null last, get ``weights`` in turn and share ``share`` of all words; a target stops at
    ``most`` times its source. Texts without words have size 0, and whether they are taken changes nothing. Repeated rows count
    as documents of their own. An empty table gives an empty mix. Other columns of ``docs`` play no part.

    One task holds the counts of one source by length: at most as many rows as there are different lengths.
    """
    rows = stored(_rows(docs, ["doc_id"], seed), "mix-rows")  # narrow: the texts are read once
    picks = stored(_picks(rows, weights, share, most, table), "mix-picks")
    return _times(rows, picks).select("row.doc_id", "size", "source_size", "target", "times")


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
    table: int = TABLE,
) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as ``mix`` takes it."""
    rows = _rows(docs, docs.columns, seed)
    facts = stored(rows.select("size", "source", "pick"), "mix-facts")
    picks = stored(_picks(facts, weights, share, most, table), "mix-picks")
    taken = _times(rows, picks).where("times > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")


def _picks(facts: DataFrame, weights: tuple[float, ...], share: float, most: float, table: int) -> DataFrame:
    """Per source and size: source_size, target, rounds, and the hash up to which documents get one round more."""
    counts = stored(
        facts.groupBy("source", "size", _slice(1).alias("slice")).agg(F.count(F.lit(1)).alias("docs")), "mix-counts"
    )
    by_size = counts.groupBy("source", "size").agg(F.sum("docs").alias("docs"))
    sources = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("words"))
    numbered = sources.withColumn(
        "source_id", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ).withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[(F.col("source_id") - 1) % len(weights)])
    targets = stored(water_level(numbered, share, most), "mix-targets")
    fits = (
        by_size.join(targets, by_size["source"].eqNullSafe(targets["source"]))
        .select("source_id", "size", "docs", "target")
        .groupBy("source_id")
        .applyInPandas(_fit(table), "source_id int, size long, rounds int, extra long")
    )
    fits = fits.join(targets, "source_id").withColumnRenamed("words", "source_size")
    # the slice in which the last document taken of a length lies, and how many of that slice are taken; level by level
    cut = fits.where("extra > 0").select("source", "size", F.col("extra").alias("last"))
    for level in range(1, LEVELS + 1):
        if level > 1:
            counts = _within(facts, cut, level - 1).groupBy("source", "size", _slice(level).alias("slice"))
            counts = counts.agg(F.count(F.lit(1)).alias("docs"))
        cut = stored(_reached(counts, cut.select("source", "size", "last"), "slice"), "mix-cut")
    # in the last slice documents are counted by hash, so equal rows meet in one row of counts
    near = _within(facts, cut, LEVELS).groupBy("source", "size", "pick").agg(F.count(F.lit(1)).alias("docs"))
    bound = _reached(near, cut.select("source", "size", "last"), "pick").select(
        "source", "size", F.col("pick").alias("bound"), F.col("last").alias("ties"), F.col("docs").alias("equals")
    )
    return fits.join(
        bound, fits["source"].eqNullSafe(bound["source"]) & (fits["size"] == bound["size"]), "left"
    ).select(fits["source"], fits["size"], "source_size", "target", "rounds", "bound", "ties", "equals")


def _slice(level: int) -> F.Column:
    """The first bits of the hash, in its order."""
    return F.shiftright("pick", 64 - BITS * level)


def _same_length(left: DataFrame, right: DataFrame) -> F.Column:
    return left["source"].eqNullSafe(right["source"]) & (left["size"] == right["size"])


def _within(facts: DataFrame, cut: DataFrame, level: int) -> DataFrame:
    """The documents in the slice that was found for their source and size."""
    at = facts.withColumn("at", _slice(level))
    return at.join(cut, _same_length(at, cut) & (at["at"] == cut["slice"])).select(at["source"], at["size"], "pick")


def _reached(counts: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """Of the ordered counts of a source and size the one in which its ``last`` document lies; ``last`` then counts inside it."""
    ahead = Window.partitionBy("source", "size").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.join(wanted, _same_length(counts, wanted))
        .select(counts["source"], counts["size"], by, "docs", "last")
        .withColumn("before", F.coalesce(F.sum("docs").over(ahead), F.lit(0)))
        .where("before < last and last <= before + docs")
        .select("source", "size", by, "docs", (F.col("last") - F.col("before")).alias("last"))
    )


def _times(rows: DataFrame, picks: DataFrame) -> DataFrame:
    picked = picks.withColumnsRenamed({"source": "of_source", "size": "of_size"})
    joined = rows.join(picked, rows["source"].eqNullSafe(picked["of_source"]) & (rows["size"] == picked["of_size"]))
    more = F.coalesce(F.col("pick") <= F.col("bound"), F.lit(False)).cast("int")
    done = joined.withColumn("times", F.col("rounds") + more)
    if picks.where("ties < equals").take(1):  # of equal rows some are taken and some are not
        tied = F.coalesce((F.col("ties") < F.col("equals")) & (F.col("pick") == F.col("bound")), F.lit(False))
        rank = F.row_number().over(Window.partitionBy("of_source", "of_size", "pick").orderBy(F.lit(0)))
        some = joined.where(tied).withColumn("times", F.col("rounds") + (rank <= F.col("ties")).cast("int"))
        done = done.where(~tied).unionByName(some)
    return done
