"""The pipeline stage by stage against brute force, and its registered queries."""

import collections
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline as pipeline  # noqa: E402
from test_text_operators import contaminated, linked  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, function in pipeline.STAGES:
        before = docs
        docs = pipeline.stage(function(spark, docs, SF), name)
        seen[name] = before.collect(), docs.collect()
        assert name == "sharding" or docs.columns == before.columns
    before, after = seen["toxicity"]
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert all(marks.get(i, 1) for i in gone) and len(gone) < len(before) / 5
    before, after = seen["ngram_jaccard_join"]
    want = linked([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted(i for i, (_, c) in want.items() if c == i)
    before, after = seen["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in after) == sorted(x[0] for x in contaminated([(r.doc_id, r.text) for r in before], items) if not x[-1])
    before, after = seen["mixing"]
    size = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert abs(size(after) - 1.5 * size(before)) < 0.2 * size(before) and max(collections.Counter(r.doc_id for r in after).values()) <= 2
    before, after = seen["sharding"]
    assert collections.Counter(r.doc_id for r in before) == collections.Counter(r.doc_id for r in after)


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
