"""Ranked search against scoring every document with whole numbers."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.common import awkward, docs_table
from waybill.llm.lexical import K2Treap, ranked


def slow_terms(text):
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", text)


def slow(docs, items, k=10):
    counted = [(i, Counter(slow_terms(t))) for i, t, *_ in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    total, length = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(slow_terms(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c, n in counted:
            m = 10 + (90 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank", "2 AS number", "'x' AS score", "0 AS doc_id")


def found(df):
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()], key=str)


def test_treap_against_a_plain_grid():
    rng = np.random.default_rng(4)
    for side in (1, 2, 5, 64, 100):
        grid = rng.integers(0, 50, (side, side)) * (rng.random((side, side)) < 0.2)
        rows, columns = np.nonzero(grid)
        treap = K2Treap(rows, columns, grid[rows, columns], side)
        asked = rng.permutation(side)[: max(1, side // 3)]
        weights = rng.integers(1, 9, len(asked))
        want = (grid[asked] * weights[:, None]).sum(axis=0)
        got = list(treap.search(asked, weights, 0))
        assert sorted(got) == sorted((int(s), d) for d, s in enumerate(want) if s > 0)
        assert [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)


@pytest.mark.parametrize(("shard", "block"), [(4096, 8 << 20), (7, 8 << 20), (64, 200)])
def test_against_every_document(spark, shard, block):
    """One treap as many, one block of items as several; words as frequent as in text, many ties."""
    rng = random.Random(shard)
    words = [f"w{k}" for k in range(60)] + ["The", "É", "漢字", "a-b", "x_y"]
    shares = [1 / (k + 1) for k in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, shares, k=rng.choice([1, 3, 8, 40]))), "a") for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 6, 20])))) for i in range(40)]
    assert found(ranked(docs_table(spark, docs), items_table(spark, items), shard=shard, block=block)) == slow(docs, items)


def test_hot_word_and_copies(spark):
    """Every document has one word, a third of them are copies: equal scores go by doc_id across treaps."""
    docs = [(1000 - i, "same old words" if i % 3 else f"same text {i} words words", "a") for i in range(300)]
    items = [(1, "same"), (2, "old words"), (3, "text 5 30 300"), (4, "nothing there")]
    assert found(ranked(docs_table(spark, docs), items_table(spark, items), shard=16)) == slow(docs, items)


def test_awkward_rows(spark):
    docs = [*awkward(), (None, "two rows without an id", "a"), (11, "two rows with an id", "a"), (12, "+-*/ \x00\t", "b")]
    items = [(1, "two words of a row id end"), (1, "é 漢字"), (None, "word1 the2"), (2, None), (3, ""), (4, "REPEATED repeated"), (5, "ÉX 🙂")]
    assert found(ranked(docs_table(spark, docs), items_table(spark, items))) == slow(docs, items)


def test_empty_tables(spark):
    some, none = docs_table(spark, [(1, "a b", "a")]), docs_table(spark, [])
    assert found(ranked(none, items_table(spark, [(1, "a")]))) == []
    assert found(ranked(some, items_table(spark, []))) == []
    assert found(ranked(docs_table(spark, [(1, "", "a")]), items_table(spark, [(1, "a")]))) == []
