"""Spelling variants against the edit table of all pairs of words."""

import random
import zlib
from collections import Counter

import pytest

from tests.llm.common import awkward, docs_table
from waybill.llm.spelling import one_edit, variants, word_counts


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slow(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and distance(v, w) == 1] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None))
    return out


def found(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def vocabulary(spark, counts):
    return spark.createDataFrame([(w, n) for w, n in counts.items()], "word string, n long").selectExpr("*", "'x' AS form", "0 AS node", "1 AS path", "2 AS root")


def mutated(rng, word, letters):
    i = rng.randrange(len(word) + 1)
    return rng.choice([word[:i] + rng.choice(letters) + word[i:], word[:i] + word[i + 1 :], word[:i] + rng.choice(letters) + word[i + 1 :]])


@pytest.mark.parametrize(("shard", "asking"), [(20_000, 200_000), (40, 60), (3, 5)])
def test_against_all_pairs(spark, shard, asking):
    """Whole in one shard as in many, with full paths cut into blocks and shards into copies."""
    rng, letters = random.Random(shard), "abcdeéñz"
    counts = {}
    for _ in range(120):
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))
        for _ in range(3):
            counts[word] = rng.choice([3, 4, 5, 10, 20, 50, 400])
            word = mutated(rng, word, letters)
    assert found(variants(vocabulary(spark, counts), shard=shard, asking=asking)) == slow(counts)


def test_anagrams_share_one_path(spark):
    """A third of the words in one leaf; chains of forms; ties."""
    rng = random.Random(1)
    counts = {"".join(rng.sample("aeinrtos", 8)): 7 for _ in range(150)}
    counts |= {"x" * k: 3 * 2**k for k in range(1, 14)} | {"xy": 3, "yx": 96, "xz": 96, "": 4, "ß÷×": 9, "ß÷": 40, "a" * 5000: 8, "a" * 4999 + "b": 20}
    assert found(variants(vocabulary(spark, counts), shard=10, asking=30)) == slow(counts)


def test_one_edit():
    rng = random.Random(3)
    for _ in range(4000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(6))) for _ in "ab")
        assert one_edit(a, b) == (distance(a, b) == 1), (a, b)


def slow_words(rows, thin):
    import re

    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if thin and h % thin == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += len(run) >= 5
    return {w: n for w, n in counts.items() if n >= 3}


@pytest.mark.parametrize("thin", [None, 3])
def test_words(spark, thin):
    rows = [*awkward(), (11, "ÀÉîõü ÀÉîõü àéîõü Große GROSSE große Grosse \U0001d400house×house housé " * 4, "a")]
    got = {r["word"]: r["n"] for r in word_counts(docs_table(spark, rows), thin=thin).collect()}
    assert got == slow_words(rows, thin)


def test_awkward_tables(spark):
    rows = spark.createDataFrame([(None, 5), ("alone", None), ("house", 5), ("houses", 2)], "word string, n long")
    assert found(variants(rows)) == {("house", None, "house", 5, 1, None), ("houses", "house", "house", 2, 1, 5)}
    assert variants(vocabulary(spark, {"a": 1}).limit(0)).count() == 0
    assert word_counts(docs_table(spark, [])).count() == 0
