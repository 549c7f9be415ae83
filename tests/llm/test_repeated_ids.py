"""Texts that share a doc_id and do not link."""

import corpus_pipeline as P

from drawlake.llm import ngram_join as J

BASE = [f"word{i}" for i in range(60)]
NEAR = " ".join(["other", *BASE[1:]])
ROWS = [(1, " ".join(BASE)), (2, NEAR), (2, " ".join(f"clean{i}" for i in range(50))), (3, " ".join(["new", *(f"clean{i}" for i in range(1, 50))])), (4, "alone")]


def test_near_stage_keeps_a_clean_text_of_a_repeated_id(spark, sf_dir):
    docs = spark.createDataFrame(ROWS, "doc_id BIGINT, text STRING")
    got = sorted(tuple(r) for r in P.drop_near_copies(spark, docs, sf_dir).collect())
    assert got == sorted([ROWS[0], ROWS[2], ROWS[4]])


def test_components_by_text(spark):
    docs = spark.createDataFrame(ROWS, "doc_id BIGINT, text STRING")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.similar_components(docs, J.JoinOptions(5, 80)).collect())
    assert got == [(1, 56, 1), (2, 46, 2), (2, 56, 1), (3, 46, 2), (4, 1, 4)]
