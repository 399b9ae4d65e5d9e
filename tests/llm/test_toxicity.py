"""The grammar clause by clause, learning from labels, and held-out accuracy on the tables."""

import random
import zlib

import pytest
from common import awkward, docs_table

from waybill.llm.base import table
from waybill.llm.toxicity import SYMBOLS, Grammar, fit, toxicity, without_toxic

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def grammar():
    return Grammar({"idiot": "insult", "scum*": "insult", "kill": "threat"})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("the idiot came", {"insult": 1}),
        ("you are an idiot", {"insult": 1, "aimed": 1}),
        ("he said that idiot lied", {"insult": 1, "aimed": 1, "reported": 1}),
        ("this is not an idiot", {"insult": 1, "negated": 1}),
        ("not that it would matter to an idiot", {"insult": 1}),
        ("I will kill, you know", {"threat": 1}),
        ("Scummy! Scums. SCUM", {"insult": 3}),
        ("idiotic scu killer", {}),
        ("you said no", {}),
        ("", {}),
        (None, {}),
    ],
)
def test_clauses(grammar, text, want):
    assert dict(zip(SYMBOLS, grammar.features(text), strict=True)) == {s: want.get(s, 0) for s in SYMBOLS}


def corpus(rng, n):
    """Documents of random words; toxic ones have a made-up insult with one of many endings."""
    rows, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(40)]
        if toxic := int(k % 6 == 0):
            words[rng.randrange(40)] = "qwor" + rng.choice(["la", "mi", "to", "nen", "sul"])
        rows.append((k, " ".join(words), "a"))
        labels.append((k, 1, toxic))
    return rows, labels


def test_learns_word_beginnings(spark):
    rng = random.Random(6)
    rows, labels = corpus(rng, 700)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    patterns, _ = fit(docs_table(spark, rows), known)
    assert "qwor*" in patterns
    got = toxicity(docs_table(spark, rows + [(None, None, "a"), (9000, "", "a"), (1, rows[1][1], "a")]), known).collect()
    want = {k: t for k, _, t in labels}
    assert len(got) == 703
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) == want.get(r["doc_id"], 0)
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
    table_ = docs_table(spark, rows)
    kept = without_toxic(table_, known)
    assert kept.columns == table_.columns and kept.count() == sum(1 for _, _, t in labels if not t)


def test_held_out_labels_teach_nothing(spark):
    rng = random.Random(7)
    rows, labels = corpus(rng, 600)
    held = [(k, q, t) for k, q, t in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    known = spark.createDataFrame(held + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    assert "qwor*" not in fit(docs_table(spark, rows), known)[0]


def test_documents_that_share_a_line_all_teach(spark):
    rng = random.Random(6)
    rows, labels = corpus(rng, 700)
    for shared in ("the same licence line\n", "\n"):
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        lined = [(k, shared * 2 + text, s) for k, text, s in rows]
        assert "qwor*" in fit(docs_table(spark, lined), known)[0]
    # a line of its own that half of the clean documents have too is no sign, though all of them share another
    mixed = [(k, "licence\n" + text + ("\nqworse" if k % 2 else ""), s) for k, text, s in rows]
    assert not any(p.startswith("qwor") and p in ("qwor*", "qworse", "qwors*") for p in fit(docs_table(spark, mixed), known)[0])


def test_equal_texts_count_once(spark):
    rng = random.Random(8)
    rows, labels = corpus(rng, 300)
    copies = [(1000 + k, "zebu zebra", "a") for k in range(60)]
    known = spark.createDataFrame(labels + [(k, 1, 1) for k, _, _ in copies], "doc_id long, quality int, toxic int")
    assert not any(p.startswith("zeb") for p in fit(docs_table(spark, rows + copies), known)[0])


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = awkward() + [(50, "you idiot, you worthless scum", "a")]
    got = {r["doc_id"]: r["predicted"] for r in toxicity(docs_table(spark, rows), none).collect()}
    assert got[50] == 1 and sum(got.values()) == 1
    assert toxicity(docs_table(spark, []), none).count() == 0


def test_held_out_accuracy(spark):
    labels = table(spark, SF, "labels")
    scored = toxicity(table(spark, SF, "documents"), labels).where("held_out").join(labels, "doc_id")
    right = scored.where("predicted = toxic").count() / scored.count()
    found = scored.where("predicted = 1 and toxic = 1").count() / scored.where("toxic = 1").count()
    assert right >= 0.98 and found >= 0.85
