"""The k-d tree against the law it keeps: near equal bytes, equal texts together, gapless slots."""

import random
import zlib

import pytest
from common import awkward, docs_table
from pyspark.sql import functions as F

from waybill.llm.sharding import HEAVIEST, _ordinals, tree_shards


def check(rows, placed, shards):
    got = placed.collect()
    facts = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == facts
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(shards))
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    return {k: sum(r["size"] for r in part) for k, part in by.items()}, got


def test_awkward_rows(spark):
    rows = awkward()
    _, first = check(rows, tree_shards(docs_table(spark, rows), 4), 4)
    _, again = check(rows, tree_shards(docs_table(spark, rows), 4), 4)
    assert sorted(map(str, first)) == sorted(map(str, again))


@pytest.mark.parametrize("shards", [16, 5])
def test_near_equal_bytes(spark, shards):
    rng = random.Random(4)
    texts = ["w" * rng.randint(0, 300) + str(k) for k in range(1500)]
    rows = [(k, rng.choice(texts), f"src{rng.randint(0, 3)}") for k in range(2500)]
    sizes, got = check(rows, tree_shards(docs_table(spark, rows), shards), shards)
    mean = sum(sizes.values()) / shards
    assert len(sizes) == shards and max(sizes.values()) < 1.1 * mean and min(sizes.values()) > 0.9 * mean
    place, text, weight = {}, {k: t for k, t, _ in rows}, {}
    for r in got:
        t = text[r["doc_id"]]
        place.setdefault(t, set()).add(r["shard"])
        weight[t] = weight.get(t, 0) + r["size"]
    assert all(len(p) == 1 for t, p in place.items() if weight[t] <= mean * HEAVIEST)


def test_heavy_copies_are_divided(spark):
    """A third of the bytes are copies of one text; no shard may hold them all."""
    rows = [(k, "the same text again", "a") for k in range(1000)] + [(k, f"text {k} " * 4, "b") for k in range(1000, 2000)]
    sizes, _ = check(rows, tree_shards(docs_table(spark, rows), 8), 8)
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) < 1.1 * mean and min(sizes.values()) > 0.9 * mean


def test_empty(spark):
    assert tree_shards(docs_table(spark, []), 16).count() == 0


def test_values_of_a_dimension_are_told_apart(spark):
    """Sources with a long common beginning or in other scripts are ranked in code point order, and the tree cuts between them."""
    names = ["src1", *[f"src1{k}" for k in range(10)], "漢字", "字", "🙂", "é", "Z", ""]
    units = spark.createDataFrame([(n,) for n in names] * 2 + [(None,)], "source string").withColumn("x", F.lit(1))
    got = {r["source"]: r["rank"] for r in _ordinals(units.withColumn("name", F.col("source")), "source").selectExpr("name AS source", "source AS rank").collect()}
    assert got == {n: float(i) for i, n in enumerate(sorted(names), 1)} | {None: 0.0}
    rows = [(7, f"text {k:04}", names[k % 11]) for k in range(1100)]  # nothing but the source differs
    of, held = {zlib.crc32(t.encode()): s for _, t, s in rows}, {}
    for r in tree_shards(docs_table(spark, rows), 11).collect():
        held.setdefault(of[r["text_crc32"]], set()).add(r["shard"])
    assert sum(len(s) for s in held.values()) <= 2 * len(held)  # a source lies in one shard, or in two next to each other


def test_languages_of_one_text(spark):
    """Equal texts under several languages, or none, are one unit."""
    rows = [(k, f"text {k // 3}", f"s{k % 5}") for k in range(900)]
    table = docs_table(spark, rows).withColumn("lang", F.expr("CASE doc_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'fr' END"))
    sizes, got = check(rows, tree_shards(table, 4), 4)
    assert max(sizes.values()) < 1.2 * sum(sizes.values()) / 4
    place = {}
    for r in got:
        place.setdefault(r["doc_id"] // 3, set()).add(r["shard"])
    assert all(len(p) == 1 for p in place.values())


def slow_tree(units, shards, low, high):
    """A plain k-d tree: (dimensions, bytes) of units, cut at the share of the bytes of the left shards; the widest dimension first."""
    if shards == 1 or not units:
        return [units]
    spans = {d: (max(u[0][d] for u in units) - min(u[0][d] for u in units)) / ((high[d] - low[d]) or 1) for d in low}
    best = max(spans, key=lambda d: spans[d])
    units = sorted(units, key=lambda u: u[0][best])
    goal, held, at = sum(u[1] for u in units) * (shards // 2) / shards, 0, 0
    while at < len(units) and held + units[at][1] <= goal:
        held, at = held + units[at][1], at + 1
    if at < len(units) and 2 * (goal - held) > units[at][1]:
        at += 1
    return slow_tree(units[:at], shards // 2, low, high) + slow_tree(units[at:], shards - shards // 2, low, high)


def test_against_a_slow_tree(spark):
    """All values differ in every dimension that is cut, so hashes decide nothing."""
    rng = random.Random(9)
    sizes = rng.sample(range(1, 4000), 300)
    rows = [(k * 10, "x" * n, f"src{k:04}") for k, n in enumerate(sizes)]
    units = [({"chars": float(len(t)), "lang": 1.0, "source": float(k), "doc": float(i)}, len(t) + 1, i) for k, (i, t, _) in enumerate(rows)]
    low, high = ({d: f(u[0][d] for u in units) for d in units[0][0]} for f in (min, max))
    first = slow_tree(units, 4, low, high)
    placed = {r["doc_id"]: r["shard"] for r in tree_shards(docs_table(spark, rows, clashing=False), 4).collect()}
    assert placed == {u[2]: k for k, part in enumerate(first) for u in part}
