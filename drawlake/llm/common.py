"""Helpers that the corpus operators share: tables, the shared folder, held-out folds."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drawlake.storage import shared_dir, written

__all__ = ["BLANKS", "WORD_GAP", "fold", "frequent_keys", "frugal", "one_text_each", "raw_texts", "shared_dir", "small_batches", "split_join", "table", "within_total", "words_of", "written"]

#: The white space of the contracts: blank and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"
WORD_GAP = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get by bytes, at what the session allows or
    BATCH_BYTES, whichever is less: a task holds a batch several times over in two processes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    units = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = now.rstrip("bkmgBKMG")
    size = int(digits) * units[now[len(digits) :].lower().rstrip("b")] if digits.isdigit() else 0
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


Batches = Iterator[pa.RecordBatch]


def frugal(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function over batches that gives freed memory back when a task ends, as the worker
    stays for other stages. Only glibc can be asked to; elsewhere Arrow's pool alone is trimmed."""

    def trimmed(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass

    return trimmed


def raw_texts(column: pa.Array, at_once: int = 256) -> Iterator[bytes]:
    """The texts of an Arrow column in UTF-8, a null one as empty, without holding all of
    them a second time."""
    for begin in range(0, len(column), at_once):
        for t in column.slice(begin, at_once).cast(pa.binary()).to_pylist():
            yield t or b""


MOST_FREQUENT = 1000


def frequent_keys(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Keys that hold more than one row in MOST_FREQUENT of all, so fewer than that number of
    keys however large the table is; they may be broadcast. counts: a row for each key, with
    its number of rows in column n."""
    total = counts.agg(F.sum(n).alias("n")).first()["n"] or 0
    return counts.filter(F.col(n) * MOST_FREQUENT > total).select(key)


def split_join(rows: DataFrame, values: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined with values, which has one row for each key and in column n the number of
    rows with it: the few frequent keys by broadcast, so that no task gets all rows of one."""
    often = F.broadcast(written(frequent_keys(values, key, n), "frequent-keys"))
    answers = F.broadcast(values.join(often, key, "left_semi"))
    return rows.join(answers, key).unionByName(rows.join(often, key, "left_anti").join(values, key))


def one_text_each(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows that repeat the keys the one whose text has the least hash: keys and text. So a
    sample that is bounded by its ids is bounded by its rows."""
    return rows.groupBy(*keys).agg(F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text").alias("text"))).alias("_one")).select(*keys, F.col("_one.text").alias("text"))


def within_total(sample: DataFrame, size: Column, most: int) -> DataFrame:
    """Of a written sample with doc_id the first rows in the order of the id's hash whose sizes
    add up to `most` at most; a null size is 0. Ids and sizes go through one task, so the
    sample has to be bounded by its rows, and its ids be unique."""
    order = W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0)
    ids = sample.select("doc_id", F.coalesce(size, F.lit(0)).alias("_size")).withColumn("_upto", F.sum("_size").over(order))
    return sample.join(F.broadcast(ids.filter(F.col("_upto") <= most).select("doc_id")), "doc_id")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo the number of folds; null ids have no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")
