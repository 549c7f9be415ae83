"""Token files: ids of documents end to end, with Elias-Fano coded boundaries.

Documents are range-partitioned and sorted by doc_id. Each task encodes its texts and cuts
them into shards. A shard's payload is one file: a header, document ids, the boundaries in
Elias-Fano code with a select directory, and the id array in 2 or 4 bytes an id. Payloads go
through Spark's writer, so a lost executor's shards are written again and half-written ones
are never seen. Readers find a document's ids by select, without a table of 64-bit offsets.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.common import frugal, raw_texts, shared_dir, small_batches, table
from drawlake.llm.tokens import encoder

MAGIC = b"DLT1"
HEADER = struct.Struct("<4sBBxxQQQ")  # magic, bytes of an id, low bits, documents, ids, bytes of the select directory
SAMPLE = 128
SHARD_SCHEMA = "part INT, seq INT, first BIGINT, n_docs BIGINT, n_ids BIGINT, payload BINARY"


class EliasFano:
    """A non-decreasing sequence of n numbers up to `top`: `low` bits of each are stored
    plainly, the rest in unary. `directory` holds the place of every 128th number's bit."""

    def __init__(self, n: int, low: int, lows: bytes, highs: bytes, directory: np.ndarray):
        self.n, self.low, self.lows, self.highs, self.directory = n, low, lows, highs, directory

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = (v[:, None] >> np.arange(low, dtype=np.uint64)[None, :]) & np.uint64(1)
        lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        places = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        return cls(n, low, lows, np.packbits(high, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4"))

    def select(self, i: np.ndarray) -> np.ndarray:
        """The places of the i-th set bits, each found from the directory's nearest entry before
        it, a byte at a time for all that have not arrived."""
        highs = np.frombuffer(self.highs, np.uint8)
        at = self.directory[i // SAMPLE].astype(np.int64)
        left, byte = i % SAMPLE, at >> 3
        word = highs[byte] & (0xFF << (at & 7) & 0xFF).astype(np.uint8)
        ahead = np.flatnonzero(left >= _ONES[word])
        while len(ahead):
            left[ahead] -= _ONES[word[ahead]]
            byte[ahead] += 1
            word[ahead] = highs[byte[ahead]]
            ahead = ahead[left[ahead] >= _ONES[word[ahead]]]
        return byte * 8 + _NTH[word, left]

    def __getitem__(self, i: int | np.ndarray) -> int | np.ndarray:
        """The i-th number, or those of an array of places."""
        place = np.atleast_1d(np.asarray(i, np.int64))
        value = self.select(place) - place
        if self.low:
            lows = np.frombuffer(self.lows + b"\0" * 8, np.uint8)
            first = place * self.low
            # Eight bytes hold any lower part and the bits before it, as parts have 56 bits at most.
            chunk = np.ascontiguousarray(lows[(first >> 3)[:, None] + np.arange(8)]).view("<u8")[:, 0]
            part = chunk >> (first & 7).astype(np.uint64) & np.uint64((1 << self.low) - 1)
            value = value << self.low | part.astype(np.int64)
        return value if np.ndim(i) else int(value[0])

    def decode(self) -> np.ndarray:
        """All numbers at once, without the directory."""
        high = np.flatnonzero(np.unpackbits(np.frombuffer(self.highs, np.uint8), bitorder="little"))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(np.frombuffer(self.lows, np.uint8), bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
        return (high.astype(np.int64) << self.low) + bits.astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(axis=1).astype(np.int64)
#: By byte and n, the place of the n-th set bit; rows end with places of bits that are not set.
_NTH = np.argsort(1 - _BITS, axis=1, kind="stable")


def write_shard(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    n = len(doc_ids)
    ef = EliasFano.encode(np.concatenate([[0], np.cumsum(lengths)]).astype(np.uint64))
    given = np.packbits(np.array([d is not None for d in doc_ids], np.uint8), bitorder="little").tobytes()
    names = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    directory = ef.directory.tobytes()
    head = HEADER.pack(MAGIC, width, ef.low, n, len(ids) // width, len(directory))
    return b"".join([head, given, names, directory, struct.pack("<QQ", len(ef.lows), len(ef.highs)), ef.lows, ef.highs, ids])


class Shard:
    """A shard file opened for reading."""

    def __init__(self, data: bytes):
        magic, self.width, low, n, self.n_ids, n_dir = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEADER.size
        given = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), bitorder="little")[:n]
        at += (n + 7) // 8
        names = np.frombuffer(data, "<i8", n, at)
        self.doc_ids = [int(d) if g else None for d, g in zip(names, given, strict=True)]
        at += 8 * n
        directory = np.frombuffer(data, "<u4", n_dir // 4, at)
        at += n_dir
        n_low, n_high = struct.unpack_from("<QQ", data, at)
        at += 16
        self.bounds = EliasFano(n + 1, low, data[at : at + n_low], data[at + n_low : at + n_low + n_high], directory)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at + n_low + n_high)

    def tokens(self, i: int) -> np.ndarray:
        """Ids of the i-th document, found by select."""
        return self.ids[self.bounds[i] : self.bounds[i + 1]]


def write_token_shards(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, shard_ids: int = 4_000_000) -> DataFrame:
    """Encode whole texts in ascending doc_id order into shard files under `path`.

    Null texts are empty: they hold the end id alone. Null ids come first; rows that repeat
    a doc_id follow one another in the order of a hash of their texts, and may be many, as
    ranges part them too. Texts of any length are encoded whole. An empty table gives no
    shard; other columns are ignored. Returns the written table: part
    (number of the doc_id range), seq (within it), first (ids of the part before this shard),
    n_docs, n_ids, payload.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        part, seq = TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.dtype).tobytes()
        width = enc.dtype.itemsize
        docs_in, lengths, ids, size, first = [], [], [], 0, 0

        def shard() -> pa.RecordBatch:
            payload = write_shard(docs_in, lengths, b"".join(ids), width)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()), pa.array([len(docs_in)], pa.int64()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())],
                names=["part", "seq", "first", "n_docs", "n_ids", "payload"],
            )

        for batch in batches:
            texts = list(raw_texts(batch.column(1)))
            for doc_id, got in zip(batch.column(0).to_pylist(), enc.encode_many(texts), strict=True):
                got += end
                docs_in.append(doc_id)
                lengths.append(len(got) // width)
                ids.append(got)
                size += lengths[-1]
                if size >= shard_ids:
                    yield shard()
                    first += size
                    docs_in, lengths, ids, size, seq = [], [], [], 0, seq + 1
        if docs_in:
            yield shard()

    small_batches(docs.sparkSession)
    # The row's number splits equal rows too, such as empty texts without ids.
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(encode, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(SHARD_SCHEMA).parquet(path)


def read_token_shards(shards: DataFrame) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32. Only a total for each doc_id range goes to the driver."""
    spark = shards.sparkSession
    sums = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    bases, at = [], 0
    for part in sorted(sums):
        bases.append((part, at))
        at += sums[part]
    # A row for each doc_id range: as many as the writer had tasks.
    base = F.broadcast(spark.createDataFrame(bases, "part INT, base BIGINT"))
    placed = shards.join(base, "part").withColumn("first", F.col("first") + F.col("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(payload.as_py())
                bounds = shard.bounds[np.arange(len(shard.doc_ids) + 1)]
                wide = shard.ids.astype("<u4")
                crcs = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(bounds[:-1] + first, pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.select("first", "payload").mapInArrow(frugal(decode), "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return read_token_shards(write_token_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, shared_dir(spark, "token_shards")))
