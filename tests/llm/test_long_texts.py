"""Very long texts, and the pipeline on an empty table."""

import numpy as np

import corpus_pipeline
from ledgerlens.llm import cdc, chosen_path, decontaminate

from .test_small_operators import words_of


def test_a_benchmark_passage_at_the_end_of_a_long_text(spark, documents):
    passage = words_of(14, 1, kinds=10**6)
    long = words_of(400_000, 2, kinds=10**6) + " " + passage
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    out = decontaminate.hits(documents([(1, long), (2, long[: len(long) // 2])]), bench).withColumn("n_hit", decontaminate.n_hit("_spans"))
    assert {r.doc_id: (r._n_words, r.n_hit) for r in out.collect()}[1] == (400_014, 14)
    assert {r.doc_id: r.n_hit for r in out.collect()}[2] == 0


def test_chunks_of_long_copies_go(spark, documents):
    long = np.random.default_rng(3).integers(97, 123, 5 << 20).astype(np.uint8).tobytes().decode()
    out = {r.doc_id: (r.n_bytes, r.n_removed) for r in cdc.dedup_chunks(documents([(1, long), (2, long), (3, "x" + long)])).collect()}
    assert out[1] == (5 << 20, 0) and out[2][1] > (5 << 20) - cdc.SMALLEST  # a last piece below a chunk stays
    assert out[3][0] == (5 << 20) + 1 and out[3][1] > 5 * (1 << 20) - 2000  # an inserted byte costs a chunk or two


def test_long_near_copies_are_linked(spark, documents):
    long = words_of(150_000, 5, kinds=10**6)
    other = long.replace(long.split()[70_000], "changed", 1)
    out = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.classes(documents([(1, long), (2, other), (3, words_of(150_000, 6, kinds=10**6))])).collect()}
    assert out[1] == out[2] == (1, 1) and out[3][1] == 0


def test_pipeline_on_an_empty_table(spark, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, words_of(12, 1))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
