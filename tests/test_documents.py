"""Masking of nested documents against a recursive walk in Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from waybill.functions.privacy import SENSITIVE_KEYS
from waybill.operators.documents import masked_documents, nesting


def slow(value):
    if isinstance(value, dict):
        hidden = [k for k in sorted(value) if any(w in k.lower() for w in SENSITIVE_KEYS)]
        names = {k: "[SENSITIVE_KEY]" + (f"_{i}" if i > 1 else "") for i, k in enumerate(hidden, 1)}
        return {names.get(k, k): slow(v) for k, v in value.items()}
    if isinstance(value, list):
        return [slow(v) for v in value]
    return "[REDACTED]" if isinstance(value, str) and "@" in value else value


def made(rng, depth):
    kind = rng.randrange(8)
    if depth and kind < 3:
        keys = ["token", "Password", "ssn", "name", "[SENSITIVE_KEY]", "[SENSITIVE_KEY]_2", "é", 'q"\\', "", "a.b"]
        return {k: made(rng, depth - 1) for k in rng.sample(keys, rng.randrange(6))}
    if depth and kind < 5:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice([1, -2.5, True, None, "plain", "me@here.org", "", "[{", 'say "hi" \\ é 🙂', "10" * 20])


def masked(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, doc string").withColumn("at", F.lit("x"))
    return [r["doc"] for r in masked_documents(df, "doc", **how).orderBy("id").collect()]


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_against_a_recursive_walk(spark, depth):
    rng = random.Random(depth)
    docs = [made(rng, depth) for _ in range(150)]
    got = masked(spark, [json.dumps(d) for d in docs])
    assert [json.loads(g) for g in got] == [slow(d) for d in docs]


def test_edges(spark):
    texts = [None, "", "no json, me@here.org", '{"a":1,"a":"me@here.org"}', "{}", "[]", '"me@here.org"', "null", '{"a":' * 3 + "1" + "}" * 3]
    got = masked(spark, texts)
    assert got[0] is None and got[1] in ("", None)
    assert got[2:] == ["no json, [REDACTED]", '{"a":1,"a":"[REDACTED]"}', "{}", "[]", '"[REDACTED]"', "null", '{"a":{"a":{"a":1}}}']


def test_many_levels(spark):
    """Deeper than the analyzer's usual rounds."""
    text = '{"k":[' * 15 + '{"ssn":"me@here.org"}' + "]}" * 15
    (got,) = masked(spark, [text])
    assert json.loads(got) == slow(json.loads(text))
    assert spark.conf.get("spark.sql.analyzer.maxIterations") == "100"


def test_nesting(spark):
    texts = ["1", "[]", '{"a":[{}]}', '["[[[[", "\\"[["]', '{"a":{},"b":[[1],[2]]}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, doc string")
    assert [r[0] for r in df.orderBy("id").select(nesting(F.col("doc"))).collect()] == [0, 1, 3, 1, 3, None]


def test_empty_table(spark):
    assert masked_documents(spark.createDataFrame([], "doc string"), "doc").count() == 0
