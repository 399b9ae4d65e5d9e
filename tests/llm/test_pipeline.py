"""The pipeline's stages on the smallest tables: each works on what the one before kept, and its decisions take effect."""

from collections import Counter

import corpus_pipeline
from common import docs_table
from waybill.llm.base import table
from waybill.llm.decontaminate import contaminated
from waybill.llm.simhash import near_duplicates

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash near-dedup", "benchmark decontamination", "mixing", "sharding",
    ]
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], SF).cache())
    assert all(k.columns == columns for k in kept[:-1])
    raw, clean, single, safe, mixed, placed = (Counter(r["doc_id"] for r in k.select("doc_id").collect()) for k in kept)
    assert clean <= raw and single <= clean and safe <= single and set(mixed) <= set(safe) and mixed == placed
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    assert not any(labels.get(i) == 0 for i in raw - clean)
    classes = near_duplicates(kept[1]).select("component_id").distinct()
    assert set(single) == {r["component_id"] for r in classes.collect()}
    leaks = {r["doc_id"] for r in contaminated(kept[2], table(spark, SF, "benchmark")).collect()}
    assert leaks and set(single) - set(safe) == leaks
    assert max(mixed.values()) <= 2


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "shard", "slot"} <= set(got.columns) and got.count() > 0


def test_stages_keep_extra_columns_and_take_empty_tables(spark):
    none, some = docs_table(spark, []), docs_table(spark, [(1, "some clean words here", "a"), (2, None, None)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, SF).count() == 0
        assert stage(spark, some, SF).columns == some.columns
