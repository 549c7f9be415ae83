"""Cleaning a corpus in five stages, from raw documents to packed training sequences.

Each stage is given all rows that the stage before it has kept, as a Parquet table, and its
decisions take effect on what the next one reads. All stages but the last return the columns
of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.common import shared_dir, table, written
from drawlake.llm.exact_dedup import DigestIndex, exact_dedup, normalised_digest
from drawlake.llm.mixing import MixOptions, whole_documents
from drawlake.llm.ngram_join import JoinOptions, similar_components
from drawlake.llm.packing import PackOptions, pack, token_pieces
from drawlake.llm.quality_rules import fit_rules, keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned decision list rejects go. Rules learn from the labelled
    documents of this stage's input.

    Null, empty and blank texts have too few words and go. Repeated rows are judged alike, a
    null doc_id like any other. Extra columns may have any name. An empty table stays empty.
    """
    return keep_good(docs, fit_rules(docs, table(spark, sf_dir, "labels")))


def _row(docs: DataFrame) -> Column:
    """All columns as one, so that no name of theirs can clash with a stage's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def _rows(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (up to white space) one row stays: the longest, then the one of the
    smallest doc_id, a null doc_id last, then by a hash of all columns, so that reruns agree.

    Null, empty and blank texts are equal. Repeated rows leave one. Any column may be null and
    extra columns may have any name. An empty table stays empty.
    """
    judged = exact_dedup(docs, DigestIndex(spark, shared_dir(spark, "pipeline_index"))).filter("kept")
    name = lambda c: (F.coalesce(c, F.lit(0)).alias("id"), F.isnull(c).alias("no_id"))
    keep = judged.select(*name(F.col("doc_id")), F.col("text_sha256").alias("digest")).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.struct(F.length(F.coalesce("text", F.lit(""))), F.xxhash64(*columns)).alias("order")
    rows = docs.select(_row(docs), *name(F.col("doc_id")), normalised_digest(F.col("text")).alias("digest"), order)
    # A kept digest has one doc_id, so rows that share both are copies of one another.
    keys = ["id", "no_id", "digest"]
    return _rows(rows.join(keep, keys).groupBy(*keys).agg(F.max_by("row", "order").alias("row")), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that is linked at a similarity of 0.8 on five-word shingles, the
    document with the smallest doc_id stays.

    Rows without a doc_id stay, and so do null, empty and blank texts. Of rows that repeat a
    doc_id only those go whose own text is linked to a smaller one. Extra columns may have
    any name. An empty table stays empty.
    """
    grouped = similar_components(docs, JoinOptions(words=5, least=80))
    gone = grouped.filter("doc_id != component_id").select(F.col("doc_id").alias("id"), "text_hash").distinct()
    rows = docs.select(_row(docs), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"))
    return _rows(rows.join(gone, ["id", "text_hash"], "left_anti"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix and as often as it takes them. They stay whole, as the
    next stage packs documents. Nulls, empty texts, repeated rows and empty tables: see
    whole_documents."""
    return whole_documents(docs, MixOptions())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most 4096 tokens.

    Null and empty texts are a piece of the end id alone. Repeated rows and rows without a
    doc_id are packed each for itself. Texts of more than 4096 tokens are cut. Extra columns
    are left out. An empty table gives no rows.
    """
    import public_tokenizers

    opt = PackOptions()
    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 1, opt.tokens), opt)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Learned rules and tokenizer ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage returns for the table of documents. Odd rows: see the
    stages. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
