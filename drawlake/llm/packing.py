"""Packing documents into sequences by vector best-fit.

A sequence has capacities for tokens, documents and attention cost (the sum of squared
piece lengths). Pieces are dealt by a hash into groups of bounded size; within a group they
are placed in descending length into the open sequence that satisfies every capacity and
scores best, by the weighted norm of what would be left or by the weighted dot product of
piece and remainder. Each group leaves at most a few sequences that are not full; their
pieces are dealt to fewer groups and packed again, until one group holds them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.common import frugal, raw_texts, small_batches, table, written
from drawlake.llm.tokens import encoder

PIECES = "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT"
PLACED = PIECES + ", sequence_id BIGINT, offset BIGINT"


@dataclass(frozen=True)
class PackOptions:
    """Limits of a sequence; None for no limit. weights: of tokens, documents, attention. By default a sequence
    may hold as many documents as tokens and the attention cost of one piece that fills it,
    the tightest limits that no sequence of at most `tokens` tokens can break; what is left of
    them still tells sequences with equal room apart."""

    tokens: int = 4096
    documents: int | None = 4096
    attention: int | None = 4096**2
    rule: str = "norm"  # or "dot"
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    group: int = 8192  # pieces that one task packs together
    full: float = 0.98  # of the tokens; sequences below it are packed again across groups


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, most: int) -> DataFrame:
    """Token counts of whole texts, each ended by end_id and cut where it is longer than
    `most`: doc_id, piece, start, length, ids_crc32. Null texts are empty."""

    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            texts = list(raw_texts(batch.column(1)))
            for doc_id, got in zip(batch.column(0).to_pylist(), enc.encode_many(texts), strict=True):
                ids = np.frombuffer(got + end, enc.dtype).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), most)):
                    part = ids[start : start + most]
                    for column, value in zip(out, (doc_id, piece, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(frugal(cut), PIECES)


def best_fit(lengths: np.ndarray, opt: PackOptions) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece. A piece that breaks a limit even alone gets
    a sequence of its own. Ties go to the sequence opened first; equal pieces keep their order."""
    n = len(lengths)
    caps = np.array([opt.tokens, opt.documents or n, opt.attention or float(opt.tokens) ** 2], float)
    w = np.array(opt.weights)
    left = np.empty((max(n, 1), 3))
    slot = np.empty(max(n, 1), np.int64)  # number of the sequence in each row of `left`
    n_open, made = 0, 0
    seq, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    smallest = lengths.min() if n else 0
    for i in order:
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        room = left[:n_open]
        fits = np.flatnonzero((room >= need).all(axis=1)) if n_open else np.empty(0, np.int64)
        if len(fits):
            share = room[fits] / caps
            if opt.rule == "dot":
                score = -((need / caps) * share * w).sum(axis=1)
            else:
                score = ((share - need / caps) ** 2 * w).sum(axis=1)
            k = fits[int(np.argmin(score))]
            seq[i], offset[i] = slot[k], opt.tokens - int(left[k, 0])
            left[k] -= need
        else:
            seq[i], offset[i] = made, 0
            k, made = n_open, made + 1
            left[k], slot[k] = caps - need, seq[i]
            n_open += 1
        if left[k, 0] < smallest or left[k, 1] < 1:  # full: close it, keeping the others in order
            left[k : n_open - 1] = left[k + 1 : n_open]
            slot[k : n_open - 1] = slot[k + 1 : n_open]
            n_open -= 1
    return seq, offset


def pack(pieces: DataFrame, opt: PackOptions = PackOptions()) -> DataFrame:
    """Place the pieces of `token_pieces`: adds sequence_id and offset.

    Rows that repeat doc_id and piece are packed each for itself; ties in length keep the
    order of doc_id, piece and checksum, so reruns over the same files agree. A null doc_id is
    a value like any other. An empty table gives no rows.
    """
    kept = written(pieces, "pieces")
    n = kept.count()
    groups, used = max(1, -(-n // opt.group)), 0
    # Dealt by row, so that equal rows spread over the groups.
    dealt = kept.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    done: list[DataFrame] = []
    while True:
        placed = dealt.groupBy("_group").applyInArrow(_placer(opt, used), PLACED + ", open BOOLEAN")
        used += groups
        if groups == 1:
            break
        placed = written(placed, "packed")
        rest = placed.filter("open")
        left = rest.count()
        # Where most pieces stay in open sequences, gaps are too small for them in any group.
        if left == 0 or (done and 10 * left > 9 * n):
            break
        done.append(placed.filter("NOT open"))
        n, groups = left, -(-left // opt.group)
        # Sequences stay together, so that a group can keep them if packing again gains nothing.
        dealt = rest.drop("open").withColumn("_group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
    for part in done:
        placed = placed.unionByName(part)
    return placed.drop("open")


def _placer(opt: PackOptions, used: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Packs a group. used: groups of earlier rounds, whose numbers are taken. Ids stay in
    Arrow, where a null beside them does not turn them into floating point."""

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        keys = [(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start"))
        length = rows.column("length").to_numpy()
        seq, offset = best_fit(length, opt)
        if "sequence_id" in rows.column_names:
            earlier = rows.column("sequence_id").to_numpy()
            if seq.max() + 1 >= len(np.unique(earlier)):  # packing again gains nothing
                seq, offset = earlier, rows.column("offset").to_numpy()
            else:
                seq = seq + (used + key[0].as_py() << 32)
        else:
            seq = seq + (used + key[0].as_py() << 32)
        _, of = np.unique(seq, return_inverse=True)
        open_ = np.bincount(of, weights=length) < opt.full * opt.tokens
        if opt.documents:
            open_ &= np.bincount(of) < opt.documents
        rows = rows.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        for name, column in (("sequence_id", pa.array(seq, pa.int64())), ("offset", pa.array(offset, pa.int64())), ("open", pa.array(open_[of]))):
            rows = rows.append_column(name, column)
        return rows

    return place


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    opt = PackOptions()
    docs = table(spark, sf_dir, "documents")
    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 1, opt.tokens), opt)
