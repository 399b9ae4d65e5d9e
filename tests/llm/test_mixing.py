"""Mixing against brute force: targets by resharing round after round, and knapsack sums by enumeration."""

import random
import re
from itertools import product

import numpy as np
import pytest
from common import awkward, docs_table

from waybill.llm.mixing import _fill, _knapsack, mix, mixed


def shared_targets(words: dict, weights=(3, 1, 2), share=1.5, most=2.0) -> dict:
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, out = share * sum(words.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * words[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = most * words[s]
        free -= set(over)
        left = share * sum(words.values()) - sum(out.values())
    return out


def check(rows, taken):
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    words = {}
    for (_, _, s), n in zip(rows, sizes, strict=True):
        words[s] = words.get(s, 0) + n
    targets = shared_targets(words)
    assert sorted(r["size"] for r in taken) == sorted(sizes)
    by_target = {}
    for r in taken:
        assert 0 <= r["times"] <= 2
        by_target.setdefault((r["source_size"], round(r["target"], 6)), 0)
        by_target[r["source_size"], round(r["target"], 6)] += r["size"] * r["times"]
    assert set(by_target) == {(words[s], round(t, 6)) for s, t in targets.items()}
    return by_target


def test_awkward_rows(spark):
    rows = awkward()
    taken = mix(docs_table(spark, rows)).collect()
    check(rows, taken)
    assert sorted(map(str, taken)) == sorted(map(str, mix(docs_table(spark, rows)).collect()))


def test_random_sources_meet_their_targets(spark):
    rng = random.Random(5)
    rows = [(k, "w " * rng.randint(0, 60), rng.choice(["s1", "s2", "s3", "S4", "é", None])) for k in range(400)]
    for (_, target), words in check(rows, mix(docs_table(spark, rows)).collect()).items():
        assert abs(words - target) < 1


def test_hot_equal_rows(spark):
    """Equal rows share a hash; just so many of them are taken as the fit says."""
    rows = [(1, "a b c", "x")] * 50 + [(k, "a b", "y") for k in range(2, 40)] + [(99, "c d e f", "z")] * 9
    table = docs_table(spark, rows)
    check(rows, (taken := mix(table)).collect())
    copies = mixed(table)
    assert copies.columns == table.columns
    assert copies.count() == sum(r["times"] for r in taken.collect())


def test_empty(spark):
    assert mix(docs_table(spark, [])).count() == 0
    assert mixed(docs_table(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_knapsack_is_nearest(seed):
    rng = random.Random(seed)
    lengths = np.array(sorted(rng.sample(range(15), rng.randint(1, 5)), reverse=True))
    counts = np.array([rng.randint(0, 4) for _ in lengths])
    budget = rng.random() * 80
    best = min(abs(np.dot(n, lengths) - budget) for n in product(*[range(c + 1) for c in counts]))
    taken = _knapsack(lengths, counts, budget)
    assert (taken <= counts).all() and abs(abs(np.dot(taken, lengths) - budget) - best) < 1e-9


def test_fill_beyond_the_table():
    rng = np.random.default_rng(1)
    lengths, counts = np.arange(3000, 0, -1), rng.integers(0, 90, 3000)
    budget = 0.37 * float((lengths * counts).sum())
    taken = _fill(lengths, counts, budget, 1 << 12)
    assert (taken <= counts).all() and abs((taken * lengths).sum() - budget) <= 1


def test_very_long_texts_and_an_empty_one(spark):
    lengths, counts = np.array([200_000, 0]), np.array([3, 1])
    taken = _fill(lengths, counts, 300_000, 1 << 16)
    assert (taken <= counts).all() and taken[0] in (1, 2)
    rows = [(k, "w " * 3000, "a") for k in range(5)] + [(5, "", "a"), (6, None, "a"), (7, "w " * 100, "b")]
    got = mix(docs_table(spark, rows), table=64)
    assert got.count() == 8 and sum(r["size"] * r["times"] for r in got.collect()) > 0
