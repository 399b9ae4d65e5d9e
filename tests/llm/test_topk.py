"""Ball-tree search against scoring every pair with whole numbers."""

import math
import random

import pytest

from waybill.llm import topk
from waybill.llm.topk import top_k

NAN, INF = float("nan"), float("inf")


def slow(rows, every=50, k=5):
    whole = {}
    for i, v in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1] and str(r[1]))):
        if all(x is not None and math.isfinite(x) for x in v) and i not in whole:
            whole[i] = [math.floor(256 * x) for x in v]
    out = set()
    for q in whole:
        if q % every == 0:
            scored = [(-sum(map(int.__mul__, whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])]
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "'x' AS rank", "0 AS shard")


def found(df):
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()}


def rounded(rows):
    """As floats keep them."""
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("shard", [64, 100_000])
def test_against_all_pairs(spark, shard):
    rng = random.Random(shard)
    rows = rounded([(k, [rng.gauss(0, 0.3) for _ in range(8)]) for k in range(900)])
    assert found(top_k(vectors(spark, rows), shard=shard)) == slow(rows)


def test_hot_vector_and_ties(spark):
    """A third of the rows are one vector: ties go to the smaller ids, and no query finds itself."""
    rng = random.Random(1)
    rows = [(k, [0.5, -0.25, 0.125] if k % 3 else [rng.choice([-1.0, 0.0, 0.5]) for _ in range(3)]) for k in range(700)]
    assert found(top_k(vectors(spark, rows), shard=50)) == slow(rows)


def test_awkward_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (50, [1.0, -2.0]), (100, None), (150, [None, 1.0]), (200, [NAN, 1.0]), (250, [INF, 1.0]),
        (300, [1.0]), (1, [0.001, -0.001]), (2, [3.0, 3.0]), (2, [3.0, 3.0]), (None, [9.0, 9.0]), (350, []), (3, []),
    ]
    rows = rounded(rows)
    assert found(top_k(vectors(spark, rows))) == slow(rows)


def test_large_components_stay_exact(spark):
    rows = rounded([(0, [1e7, 3.0]), (1, [1e7, 1.0]), (2, [1e7, 1.0039]), (3, [-5.0, 1e7]), (50, [3e4, 3e4])])
    assert found(top_k(vectors(spark, rows))) == slow(rows)


def test_queries_go_only_where_a_bound_reaches(spark, monkeypatch):
    """Clusters far apart: results as all pairs have them, and far fewer shipments than queries times other shards."""
    rng, sent = random.Random(5), []
    axes = [[(40.0 if c < 12 else -40.0) * (j == c % 12) for j in range(12)] for c in range(24)]
    rows = rounded([(i, [x + rng.gauss(0, 0.2) for x in axes[i % 24]]) for i in range(2400)])
    ships = topk.shipments

    def counted(queries, balls, shards):
        sent.append((queries.count() * (shards - 1), ships(queries, balls, shards)))
        return sent[-1][1]

    monkeypatch.setattr(topk, "shipments", counted)
    assert found(top_k(vectors(spark, rows), shard=100)) == slow(rows)
    pairs, shipped = sent[0][0], sent[0][1].count()
    assert pairs > 48 * 20 and shipped < pairs / 4, (shipped, pairs)


def test_lengths_outside_the_sample(spark, monkeypatch):
    monkeypatch.setattr(topk, "SAMPLE", 64)
    rng = random.Random(6)
    rows = rounded([(i, [rng.gauss(0, 1) for _ in range(4 if i % 40 else 1 + i // 40)]) for i in range(800)])
    assert found(top_k(vectors(spark, rows), shard=40)) == slow(rows)


def test_empty(spark):
    assert top_k(vectors(spark, [])).count() == 0
