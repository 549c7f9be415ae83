"""Exact duplicates by a persistent digest index.

The index is a table bucketed and sorted by the digest of the normalised text. A batch is
reduced to one row per digest with map-side combining, a sort-merge anti-join against the
bucketed index (which is neither shuffled nor sorted again) leaves the digests that are new,
and those are appended. Earlier batches win over later ones. The answer joins the batch with
the buckets again; the few digests that hold a large share of the batch are broadcast
instead, so that no task gets all copies of one text.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.common import BLANKS, frequent_keys, shared_dir, table, written

INDEX_SCHEMA = "text_sha256 STRING, keep_id BIGINT, keep_chars INT, group_size BIGINT, batch STRING"


def normalised_digest(text: Column) -> Column:
    """SHA-256 of the text without its white space; a null text counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANKS, "").cast("binary"), 256)


class DigestIndex:
    """A digest table under `path`, in `buckets` buckets. Opening the same path again, in
    this session or a later one, continues the same index."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.name = "digests_" + hashlib.md5(self.path.encode()).hexdigest()[:24]
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} ({INDEX_SCHEMA}) USING parquet "
                f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{self.path}'"
            )

    def bucketed(self) -> DataFrame:
        return self.spark.table(self.name)

    def append_new(self, best: DataFrame, batch: str) -> None:
        """Add the digests of a batch (a row each, from `best_of`) that the index lacks."""
        fresh = best.hint("merge").join(self.bucketed().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        (
            fresh.withColumn("batch", F.lit(batch)).repartition(self.buckets, "text_sha256")
            .write.mode("append").format("parquet").option("path", self.path)
            .bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.name)
        )


def best_of(digests: DataFrame) -> DataFrame:
    """For each digest the row that stays and the number of rows. `digests` has doc_id,
    n_chars_raw and text_sha256. Of equal texts the row with most code points stays, then the
    smallest doc_id; a null doc_id loses every tie."""
    first = F.min(F.struct((-F.col("n_chars_raw")).alias("short"), F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id")))
    best = digests.groupBy("text_sha256").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    return best.select("text_sha256", F.col("first.id").alias("keep_id"), (-F.col("first.short")).alias("keep_chars"), "group_size")


def digests_of(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars_raw"), normalised_digest(F.col("text")).alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, index: DigestIndex, batch: str = "0") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and all empty or blank texts are equal. Rows that repeat
    both a doc_id and a text are one document: they agree in every column. A text that an
    earlier batch has brought is not kept; group_size is that of the batch that brought it.
    An empty table gives no rows. Other columns of `docs` are ignored.
    """
    digests = written(digests_of(docs), "digests")
    best = written(best_of(digests), "digest-groups")
    index.append_new(best, batch)
    known = index.bucketed()
    often = F.broadcast(written(frequent_keys(best, "text_sha256", "group_size"), "frequent-digests"))
    answers = F.broadcast(known.join(often, "text_sha256", "left_semi"))
    found = digests.join(answers, "text_sha256").unionByName(
        digests.join(often, "text_sha256", "left_anti").hint("merge").join(known.hint("merge"), "text_sha256")
    )
    return found.select(
        "doc_id", "keep_id", "group_size",
        ((F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars_raw") == F.col("keep_chars"))).alias("kept"),
        "text_sha256",
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), DigestIndex(spark, shared_dir(spark, "digest_index")))


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER w AS keep_id,
        count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
