"""Whole benchmark items of five to seven words are leaks too; shorter ones don't count in the pipeline."""

import corpus_pipeline
from test_contracts import frame


def test_whole_short_items_are_leaks(spark, tmp_path):
    items = [(1, "Who wrote the first novel?"), (2, "what is the capital of old France"), (3, "how are you today"), (4, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, "they asked: who wrote the FIRST novel, and why"), (2, "what is the capital of old France"), (3, "hello, how are you today"), (4, "who wrote the first"), (5, None)]
    assert sorted(r.doc_id for r in corpus_pipeline.benchmark_leaks(spark, frame(spark, docs), str(tmp_path)).collect()) == [3, 4, 5]
