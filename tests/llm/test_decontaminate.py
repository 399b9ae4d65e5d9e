"""Edit matching against the plain distance table."""

import random

import pytest
from common import awkward, docs_table

from waybill.llm.decontaminate import Matcher, best_match, contaminated, decontaminated, normal, pieces


def slow_match(pattern, text):
    """Least distance to any part of the text, and the first end of such a part."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row), row.index(min(row))


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        k = rng.randrange(len(out))
        out[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "z"])
    return "".join(out)


@pytest.mark.parametrize("seed", range(40))
def test_myers_is_exact(seed):
    rng = random.Random(seed)
    pattern = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 150)))
    noise = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 60))) for _ in range(2)]
    text = noise[0] + edited(rng, pattern, rng.randint(0, 4)) + noise[1]
    want = slow_match(pattern, text)
    got = best_match(pattern, text, len(pattern))
    assert got[0] == want[0] and (got == want or want[0] == len(pattern))


def test_pieces_cover_an_item():
    for length in range(1, 60):
        for budget in range(min(length, 9)):
            cut = pieces(length, budget)
            assert len(cut) == budget + 1 and cut[0][0] == 0 and cut[-1][1] == length
            assert all(a[1] == b[0] and a[0] < a[1] for a, b in zip(cut, cut[1:], strict=False))


def test_no_match_is_missed():
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "of", "the"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(8, 20)))) for k in range(12)]
    matcher = Matcher(items, 0.08, 32)
    for _ in range(150):
        filler = " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        item = rng.choice(items)[1]
        text = f"{filler} {edited(rng, item, rng.randint(0, 6))} {filler}"
        want = {}
        for k, t in items:
            t = normal(t)
            distance, end = slow_match(t, normal(text))
            if distance <= int(len(t) * 0.08):
                want[str(k)] = (distance, end)
        assert {i: (d, e) for i, d, _, _, e in matcher.hits(text)} == want


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "'x' AS clean", "0 AS distance")


def test_documents(spark):
    item = "What is the capital of the smallest country, and which river runs through it?"
    rows = awkward() + [
        (20, f"Before. {item.upper()} After.", "a"),
        (21, f"some words {item.replace('smallest', 'smalest').replace('river', 'rivers')} more", None),
        (22, "What is the capital of a large country, and who lives there all year?", "b"),
        (23, "Short one!", "b"),
        (24, "A short one that is longer", "b"),
    ]
    items = benchmark(spark, [(1, item), (1, item), (2, None), (3, ""), (4, "short ONE"), (None, "漢字 " * 20)])
    table = docs_table(spark, rows)
    for limit in (8_000_000, 40):  # one block, and several
        hits = {(r["doc_id"], r["item_id"], r["distance"]) for r in contaminated(table, items, limit=limit).collect()}
        assert hits == {(20, 1, 0), (21, 1, 2), (23, 4, 0)}
        kept = decontaminated(table, items, limit=limit)
        assert kept.columns == table.columns
        left = sorted(str(r["doc_id"]) for r in kept.collect())
        assert left == sorted(str(i) for i, _, _ in rows if i not in (20, 21, 23))


def test_short_items_inside_longer_documents(spark):
    rows = [
        (1, "First. What is the capital of France? Paris, of course, and has been for long.", "a"),
        (2, "what is the capital of francestan, and is it large", "a"),
        (3, "What is the capital of France?", "a"),
        (4, "what is the capitol of france to you and to me", "a"),
        (5, "seven", "a"),
        (6, "six or seven seven", "a"),
        (7, "", "a"),
    ]
    items = benchmark(spark, [(1, "What is the capital of France?"), (2, "seven SEVEN"), (3, "what is"), (None, "to you"), (5, "!")])
    for limit in (8_000_000, 20):
        hits = contaminated(docs_table(spark, rows), items, inside=True, limit=limit).collect()
        got = {(r["doc_id"], r["item_id"], r["distance"], r["match_start"], r["match_end"]) for r in hits}
        assert len(hits) == len(got) and got == {
            (1, 1, 0, 6, 35), (1, 3, 0, 6, 13), (2, 3, 0, 0, 7), (3, 1, 0, 0, 29), (3, 3, 0, 0, 7), (4, 3, 0, 0, 7),
            (4, None, 0, 30, 36), (6, 2, 0, 7, 18),
        }
        kept = decontaminated(docs_table(spark, rows), items, inside=True, limit=limit)
        assert sorted(r["doc_id"] for r in kept.collect()) == [5, 7]


def test_short_items_with_a_large_budget():
    """Lengths may differ by as much as the budget allows, whatever the error."""
    rng, letters = random.Random(3), "abc d"
    for error in (0.08, 0.2, 0.3):
        items = [(k, "".join(rng.choice(letters) for _ in range(rng.randrange(4, 31)))) for k in range(30)]
        texts = []
        for _, item in items:
            for _ in range(4):
                text = item
                for _ in range(rng.randrange(10)):
                    at = rng.randrange(len(text) + 1)
                    text = rng.choice([text[:at] + text[at + 1 :], text[:at] + rng.choice(letters) + text[at:]])
                texts.append(text)
        matcher = Matcher(items, error, 32)
        for text in texts:
            words = normal(text)
            want = {}
            for k, item in items:
                known = normal(item)
                row = list(range(len(words) + 1))
                for i, x in enumerate(known, 1):
                    last, row[0] = row[0], i
                    for j, y in enumerate(words, 1):
                        last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
                if known and row[-1] <= int(len(known) * error):
                    want[str(k)] = row[-1]
            assert {i: d for i, d, *_ in matcher.hits(text)} == want, (error, text)


def test_empty(spark):
    assert contaminated(docs_table(spark, []), benchmark(spark, [(1, "an item " * 9)])).count() == 0
    assert contaminated(docs_table(spark, awkward()), benchmark(spark, [])).count() == 0
    assert decontaminated(docs_table(spark, awkward()), benchmark(spark, [])).count() == len(awkward())
