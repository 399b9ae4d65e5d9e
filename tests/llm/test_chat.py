"""Prefix-target expansion: every example written out by hand, and digests read back."""

import hashlib

import pytest
from pyspark.sql import functions as F

from waybill.llm import chat
from waybill.llm.base import stored
from waybill.llm.chat import conversation_stream, digests, example_texts, examples, parse_segment, unescape

STRANGE = "\\### Assistant: </turn> ok\\"


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 AS start", "'x' AS segment", "2 AS chars", "3 AS example"
    )


ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello 🙂"), (1, 3, "user", STRANGE),
    (1, 4, "assistant", STRANGE), (1, 5, "user", "bye"), (2, 0, "user", None), (2, 1, "assistant", ""),
    (3, 7, "user", "no reply"), (None, 1, "user", "lost"), (None, None, "assistant", "first"), (4, 0, None, "x: y\n"),
    (4, 1, "a: b#/\\", "odd role"), (4, 2, "assistant", "a"), (4, 2, "assistant", "a"), (4, 2, "assistant", "A" * 70_000),
]


def ordered():
    convs = {}
    for c, t, r, x in ROWS:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}


def test_digests(spark):
    got = {r["conv_id"]: r for r in digests(conversation_stream(turns(spark, ROWS))).collect()}
    assert set(got) == set(ordered())
    for conv, rows in ordered().items():
        replies = "".join(x for r, x in rows if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(rows)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in rows).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(replies), hashlib.sha256(replies.encode()).hexdigest())


def test_examples(spark):
    stream = conversation_stream(turns(spark, ROWS))
    segments = {}
    for r in stream.collect():
        segments.setdefault(r["conv_id"], []).append((r["position"], r["segment"]))
    texts = {(r["conv_id"], r["example"]): r["text"] for r in example_texts(stream).collect()}
    spans = examples(stream).collect()
    assert len(spans) == len(texts) == sum(r == "assistant" for c in ordered().values() for r, _ in c)
    sizes = {}
    for r in spans:
        whole = "".join(s for _, s in sorted(segments[r["conv_id"]]))
        text = texts[r["conv_id"], r["example"]]
        assert text == whole[: r["example_end"]]
        rows = ordered()[r["conv_id"]]
        replies = [x for role, x in rows if role == "assistant"]
        assert unescape(whole[r["loss_start"] : r["loss_end"]]) == replies[r["example"]]
        before = [parse_segment(p + " </turn>\n") for p in text[: r["context_end"]].split(" </turn>\n")[:-1]]
        assert before == rows[: len(before)] and rows[len(before)] == ("assistant", replies[r["example"]])
        sizes[r["conv_id"]] = sizes.get(r["conv_id"], 0) + len(text)
    got = {r["conv_id"]: r["formatted_chars"] for r in digests(stream).collect()}
    assert got[2] == sizes[2] and got[1] == sizes[1] + len(segments[1][5][1])


def test_a_conversation_over_many_ranges(spark, monkeypatch):
    """A third of all rows in one conversation, and repeated and null turns: places and digests are as counted by hand."""
    rows = [(9, k if k % 11 else None, ("user", "assistant")[k % 2], f"text {k} #" * (k % 5)) for k in range(1500)]
    rows += [(100 + k % 300, k // 300, ("user", "assistant")[k // 300 % 2], f"t{k}") for k in range(2400)] + [(9, 7, "user", "same")] * 300
    pieces = []
    monkeypatch.setattr(chat, "stored", lambda df, purpose: pieces.append(stored(df, purpose)) or pieces[-1])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        stream = conversation_stream(turns(spark, rows))
        hot = stream.where("conv_id = 9").sort("position").collect()
        spread = pieces[0].where("conv_id = '9'").select("part").distinct().count()
        got = {r["conv_id"]: r for r in digests(stream, examples(stream)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    wanted = sorted((t is not None, t or 0, r, x) for c, t, r, x in rows if c == 9)
    assert spread > 3 and [r["position"] for r in hot] == list(range(1800))
    assert [parse_segment(r["segment"]) for r in hot] == [(r, x) for _, _, r, x in wanted]
    starts = [0]
    for r in hot:
        assert r["start"] == starts[-1] and r["chars"] == len(r["segment"])
        starts.append(r["start"] + r["chars"])
    assert [r["example"] for r in hot if r["role"] == "assistant"] == list(range(750))
    ends = [r["start"] + r["chars"] for r in hot if r["role"] == "assistant"]
    replies = "".join(x for _, _, r, x in wanted if r == "assistant")
    assert got[9]["formatted_chars"] == sum(ends) + starts[-1] - ends[-1] and got[9]["n_turns"] == 1800 and len(got) == 301
    assert (got[9]["loss_chars"], got[9]["loss_sha256"]) == (len(replies), hashlib.sha256(replies.encode()).hexdigest())


def test_digests_come_from_the_examples(spark):
    """Fewer examples, less loss text; an example that ends elsewhere is an error."""
    stream = conversation_stream(turns(spark, ROWS))
    kept = examples(stream).where("example > 0")
    got = {r["conv_id"]: r["loss_chars"] for r in digests(stream, kept).collect()}
    assert (got[1], got[2], got[4]) == (len(STRANGE), 0, 2)  # of equal turns A comes before a
    with pytest.raises(Exception, match="an example ends at"):
        digests(stream, examples(stream).withColumn("example_end", F.col("example_end") - 1)).collect()


def test_control_strings_are_escaped(spark):
    for r in conversation_stream(turns(spark, ROWS)).collect():
        assert r["segment"].count("</turn>") == 1 and r["segment"].count("###") == 1


def test_empty(spark):
    stream = conversation_stream(turns(spark, []))
    assert stream.count() == digests(stream).count() == examples(stream).count() == example_texts(stream).count() == 0
