"""Ordered work per key (lag, lead, running totals, ranks, exact percentiles) without
putting a key's rows into one task.

A window ``PARTITION BY key ORDER BY t`` sends every row of a key to one task, so one hot
key decides the run time. Here each key's ordered rows are first cut into slices at
approximate quantiles of the order column taken over the whole table; a slice therefore
holds about 1/``slices`` of the *table* at most, however hot the key. Unless it is given, ``slices``
is the number of partitions that the session shuffles into, so slices shrink as a cluster is set up for more. A window runs inside
(key, slice), and what has to cross a slice boundary (the last row, a subtotal) comes from
a table with one row per (key, slice).

The quantiles come from sketches that are merged in two levels, so no task takes a sketch from every input split. The rows of a key
and a slice are moved once: windows and joins see keys as one struct that is never null, and agree on where its rows lie.

A value so frequent that it fills several quantile steps is cut once more on the second
order column, so ties do not defeat the slicing as long as ``order`` ends in a unique column.
All orders are ascending with NULL first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64  # at least
SKETCHES = 64  # into which the sketches of the input splits are merged first
_S, _T = SLICE_COLUMNS = "__slice", "__tie"
KEY = _K = "__key"
_TOTAL = "__total"


def slice_count(df: DataFrame) -> int:
    return max(SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _cut_points(df: DataFrame, columns: Sequence[str], slices: int) -> list[tuple[list[str], str]]:
    """Ascending cut points of each column as text, repeated where one value fills several steps, and their type.

    They are read once and become literals of the plan, so every branch of a query cuts alike, also when tasks or stages are
    repeated. They decide balance only. Input splits are dealt to ``SKETCHES`` groups; a task merges the sketches of a group, and
    the driver merges the groups' quantiles, weighted by their rows: ``SKETCHES * (slices - 1)`` values per column, whatever the table's size.
    """
    steps = [i / slices for i in range(1, slices)]
    kinds = [df.schema[c].dataType.simpleString() for c in columns]
    parts = []
    for i, (c, kind) in enumerate(zip(columns, kinds, strict=True)):
        found = F.percentile_approx(c, steps, 4 * slices)
        # instants travel as microseconds: their text repeats an hour when clocks go back
        found = F.transform(found, F.unix_micros) if kind == "timestamp" else found
        parts += [F.count(c).alias(f"n{i}"), found.alias(f"v{i}"), found.cast("array<string>").alias(f"t{i}")]
    group = F.pmod(F.spark_partition_id(), F.lit(SKETCHES)).alias("g")
    groups = df.select(group, *columns).groupBy("g").agg(*parts).collect()  # SKETCHES rows at most
    return [(_merged([(r[f"n{i}"], r[f"v{i}"], r[f"t{i}"]) for r in groups if r[f"n{i}"]], slices), kind) for i, kind in enumerate(kinds)]


def _merged(groups: Sequence[tuple[int, Sequence, Sequence[str]]], slices: int) -> list[str]:
    """The texts of the ``slices - 1`` quantiles of all groups: (rows, quantiles, their texts)."""
    weighted = [(v != v, v, n, text) for n, values, texts in groups for v, text in zip(values, texts, strict=True)]
    weighted.sort(key=lambda w: w[:2])  # NaN comes last, as Spark has it
    total, upto, out = sum(w[2] for w in weighted), 0, []
    for _, _, n, text in weighted:
        upto += n
        while len(out) < slices - 1 and upto * slices >= (len(out) + 1) * total:
            out.append(text)
    return out


def _literals(values: Sequence[str], kind: str) -> Column:
    if kind == "timestamp":
        return F.expr(f"transform(array({', '.join(values)}), x -> timestamp_micros(x))")
    texts = ", ".join(f"'{v}'" for v in values)
    return F.expr(f"CAST(array({texts}) AS array<{kind}>)")


def _position(cuts: Sequence[str], kind: str, value: Column) -> Column:
    """How many distinct cut points are <= value, by binary search in an array of literals."""
    points = list(dict.fromkeys(cuts))
    if not points:  # no rows, or no values
        return F.lit(0)
    steps = [2**i for i in reversed(range(len(points).bit_length()))]
    found, last = _literals(points, kind), len(points)
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda at, s: F.when((at + s <= last) & (F.get(found, at + s - 1) <= value), at + s).otherwise(at),
    )


def sliced(df: DataFrame, order: Sequence[str], slices: int | None = None, cuts_from: DataFrame | None = None) -> DataFrame:
    """Add the slice of each row; (slice, tie) is monotone in ``order``.

    ``cuts_from`` may name a cheaper table with the same order columns to take the cut points from.
    """
    slices = slices or slice_count(df)
    cuts = _cut_points(df if cuts_from is None else cuts_from, order[:2], slices)
    out = df.withColumn(_S, _position(*cuts[0], F.col(order[0])))
    values, kind = cuts[0]
    frequent = [v for v, n in Counter(values).items() if n > 1]
    if len(order) == 1 or not frequent:
        return out.withColumn(_T, F.lit(slices))
    tie = _position(*cuts[1], F.col(order[1]))
    is_frequent = F.array_contains(_literals(frequent, kind), F.col(order[0]))
    return out.withColumn(_T, F.when(is_frequent, tie).otherwise(F.lit(slices)))


def keyed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the keys as one struct. It is never null and equal where the keys are, null with null, so that plain joins find it."""
    return rows.withColumn(_K, F.struct(*keys) if keys else F.lit(True))


def ordered_by_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    lag: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    running: Mapping[str, str] | None = None,
    last_known: Mapping[str, str] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Window columns over ``PARTITION BY keys ORDER BY order``, each given as ``{output: source}``.

    ``lag`` and ``lead`` look one row back and ahead, ``running`` is the sum up to and including
    the row, ``last_known`` the latest non-NULL value at or before the row (an as-of look-up).
    All share one shuffle of the rows and one table of slice summaries.
    """
    lag, lead, running, last_known = lag or {}, lead or {}, running or {}, last_known or {}
    slices = slices or slice_count(df)
    rows = keyed(sliced(df, order, slices), keys)
    at = F.struct(*order)
    inside = Window.partitionBy(_K, _S, _T).orderBy(*order)
    here = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(_K).orderBy(_S, _T)
    before = across.rowsBetween(Window.unboundedPreceding, -1)

    def packed(values: Mapping[str, str]) -> Column:
        return F.struct(*[F.col(src).alias(out) for out, src in values.items()])

    summary, carry, result = {}, {}, {}
    if lag:
        summary["__tail"] = F.max_by(packed(lag), at)
        carry["__lag"] = F.lag("__tail").over(across)
        near = F.coalesce(F.lag(packed(lag)).over(inside), F.col("__lag"))
        result.update({out: near.getField(out) for out in lag})
    if lead:
        summary["__head"] = F.min_by(packed(lead), at)
        carry["__lead"] = F.lead("__head").over(across)
        near = F.coalesce(F.lead(packed(lead)).over(inside), F.col("__lead"))
        result.update({out: near.getField(out) for out in lead})
    for out, src in running.items():
        summary[f"__sum_{out}"] = F.sum(src)
        carry[f"__off_{out}"] = F.coalesce(F.sum(f"__sum_{out}").over(before), F.lit(0))
        result[out] = F.coalesce(F.sum(src).over(here), F.lit(0)) + F.col(f"__off_{out}")
    for out, src in last_known.items():
        summary[f"__known_{out}"] = F.max_by(src, F.when(F.col(src).isNotNull(), at))
        carry[f"__prior_{out}"] = F.last(f"__known_{out}", True).over(before)
        result[out] = F.coalesce(F.last(src, True).over(here), F.col(f"__prior_{out}"))

    edges = rows.groupBy(_K, _S, _T).agg(*[c.alias(n) for n, c in summary.items()])
    edges = edges.select(_K, _S, _T, *[c.alias(n) for n, c in carry.items()])
    joined = rows.join(edges, [_K, _S, _T], "left")
    return joined.select(*df.columns, *[c.alias(n) for n, c in result.items()])


def row_number_by_key(df, keys: Sequence[str], order: Sequence[str], out: str, slices: int | None = None) -> DataFrame:
    """``row_number()`` per key; ``order`` must be unique within the key."""
    ones = df.withColumn("__one", F.lit(1).cast("long"))
    return ordered_by_key(ones, keys, order, running={out: "__one"}, slices=slices).drop("__one")


def rank_by_key(df, keys: Sequence[str], order: Sequence[str], out: str, slices: int | None = None) -> DataFrame:
    """``rank() OVER (PARTITION BY keys ORDER BY order[0])``; ``order[1]`` only spreads ties."""
    slices = slices or slice_count(df)
    rows = keyed(sliced(df, order, slices), keys)
    counts = rows.groupBy(_K, _S, _T).agg(F.count("*").alias("__n"))
    by_slice = Window.partitionBy(_K).orderBy(_S, _T).rowsBetween(Window.unboundedPreceding, -1)
    by_value = Window.partitionBy(_K).orderBy(_S).rangeBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = counts.select(
        _K,
        _S,
        _T,
        F.when(F.col(_T) < slices, F.coalesce(F.sum("__n").over(by_value), zero))
        .otherwise(F.coalesce(F.sum("__n").over(by_slice), zero))
        .alias("__off"),
    )
    inside = Window.partitionBy(_K, _S, _T).orderBy(order[0])
    joined = rows.join(offsets, [_K, _S, _T], "left")
    return joined.withColumn(out, F.col("__off") + F.rank().over(inside)).select(*df.columns, out)


def values_at(df, keys: Sequence[str], value: str, picks: Mapping[str, Callable[[Column], Column]], slices: int | None = None) -> DataFrame:
    """One row per key with its count (``__total``) and the values at zero-based positions of its sorted values.

    ``picks`` maps an output name to a function from the key's row count to a position.
    Equal values are counted before the shuffle, so neither hot keys nor ties gather rows.
    NULL values are left out.
    """
    given = df.where(F.col(value).isNotNull())
    counts = given.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    # a slice holds no more distinct values than rows, so cuts of the rows bound it as well
    slices = slices or slice_count(df)
    rows = keyed(sliced(counts, [value], slices, cuts_from=given), keys)
    per_slice = rows.groupBy(_K, _S, _T).agg(F.sum("__n").alias("__m"))
    whole = Window.partitionBy(_K)
    before = whole.orderBy(_S).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        _K,
        _S,
        _T,
        F.coalesce(F.sum("__m").over(before), F.lit(0).cast("long")).alias("__off"),
        F.sum("__m").over(whole).alias("__total"),
    )
    here = Window.partitionBy(_K, _S, _T).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        rows.join(offsets, [_K, _S, _T], "left")
        .withColumn("__hi", F.col("__off") + F.sum("__n").over(here))
        .withColumn("__lo", F.col("__hi") - F.col("__n"))
    )
    total = F.col("__total")
    return placed.groupBy(*keys).agg(
        F.max(total).alias(_TOTAL),
        *[
            F.max(
                F.when((F.col("__lo") <= position(total)) & (position(total) < F.col("__hi")), F.col(value))
            ).alias(out)
            for out, position in picks.items()
        ]
    )


def percentiles_cont(df, keys: Sequence[str], value: str, fractions: Mapping[str, float], slices: int | None = None) -> DataFrame:
    """Exact interpolated percentiles (``percentile_cont``) per key."""
    picks: dict[str, Callable[[Column], Column]] = {}
    for name, p in fractions.items():
        picks[f"__lo_{name}"] = lambda n, p=p: F.floor((n - 1) * F.lit(p))
        picks[f"__hi_{name}"] = lambda n, p=p: F.ceil((n - 1) * F.lit(p))
    found = values_at(df, keys, value, picks, slices)
    out = []
    for name, p in fractions.items():
        spot = (F.col(_TOTAL) - 1) * F.lit(p)
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    return found.select(*keys, *out)


def percentiles_floor(df, keys: Sequence[str], value: str, points: Mapping[str, int], slices: int | None = None) -> DataFrame:
    """The value at position ``floor(p * n / 100)`` of the sorted values, clamped to the last."""
    picks = {
        name: (lambda n, p=p: F.least(F.floor(n * F.lit(p) / F.lit(100)), n - 1)) for name, p in points.items()
    }
    return values_at(df, keys, value, picks, slices).drop(_TOTAL)


def newest_by_key(df, keys: Sequence[str], newest_first: Sequence[Column], spread: str, n: int, out: str = "rn", salts: int | None = None) -> DataFrame:
    """The first ``n`` rows per key with their row number; ``salts`` is the number of partitions the session shuffles into unless it is given.

    ``spread`` is a near-unique column: rows are first cut to ``n`` per (key, salt), so a hot key
    reaches the final window as at most ``n * salts`` rows. Spark adds its own limit before each shuffle.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(salts or slice_count(df))).alias("__salt")
    first = Window.partitionBy(*keys, "__salt").orderBy(*newest_first)
    final = Window.partitionBy(*keys).orderBy(*newest_first)
    return (
        df.select("*", salt)
        .withColumn("__rn", F.row_number().over(first))
        .where(F.col("__rn") <= n)
        .withColumn(out, F.row_number().over(final))
        .where(F.col(out) <= n)
        .drop("__rn", "__salt")
    )
