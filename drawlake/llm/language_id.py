"""Language proportions of documents by mixture inference.

Each learned language has a distribution over hashed character trigrams, counted over all
learning documents. A document's words are draws from a mixture of the languages, whose
proportions expectation-maximisation estimates. Mixtures of the strongest language, the two
strongest and so on are fitted in turn and the set of highest penalised likelihood is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.common import fold, frugal, raw_texts, small_batches, table

BUCKETS = 1 << 15
CHUNK = 1 << 20  # bytes of text that are worked on at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_p: np.ndarray  # buckets x languages


@dataclass(frozen=True)
class MixtureOptions:
    rounds: int = 10
    refits: int = 4
    penalty: float = 2.0  # for each language, times the logarithm of the number of words
    floor: float = 1e-6  # least likelihood of a word relative to its best language


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in lower case with blanks around them, and where each of them ends."""
    raw = _LOWER[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    return raw, np.cumsum([len(t) + 1 for t in texts])


def _trigrams(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram around each byte of a word, and the places of those bytes."""
    x = a.astype(np.uint32)
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    at = np.flatnonzero(a[1:-1] != 32)
    return (h[at] & np.uint32(BUCKETS - 1)).astype(np.int64), at + 1


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes; a longer text is a range of its own."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def fit_languages(docs: DataFrame, learn: Column) -> LanguageModel:
    """Count trigrams by language over all rows for which `learn` holds and lang and text
    are given. The driver gets BUCKETS numbers per language, however large the table is. Rows
    without lang or text are left out, empty texts add nothing, repeated rows count each; an
    empty table learns no language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = raw_texts(batch.column(1))
            by: dict[str, list[bytes]] = {}
            for lang, t in zip(langs, texts, strict=True):
                by.setdefault(lang, []).append(t)
            for lang, ts in by.items():
                total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for i, j in _chunks(ts):
                    total += np.bincount(_trigrams(_joined(ts[i:j])[0])[0], minlength=BUCKETS)
        for lang, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])

    small_batches(docs.sparkSession)
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sums = rows.mapInArrow(frugal(count), "lang STRING, bucket INT, n BIGINT").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    n = np.zeros((BUCKETS, len(langs)))
    if langs:
        which = {x: i for i, x in enumerate(langs)}
        n[sums.column("bucket").to_numpy(), [which[x] for x in sums.column("lang").to_pylist()]] = sums.column("n").to_numpy()
    smooth = n + 0.5
    return LanguageModel(tuple(langs), np.log(smooth / smooth.sum(axis=0)).astype(np.float32) if langs else n.astype(np.float32))


def _mix(q: np.ndarray, doc: np.ndarray, first: np.ndarray, count: np.ndarray, pi: np.ndarray, rounds: int) -> np.ndarray:
    """EM for all documents of a chunk at once. q: words x languages; first: each document's
    first word."""
    for _ in range(rounds):
        r = pi[doc] * q
        r /= r.sum(axis=1, keepdims=True)
        pi = np.add.reduceat(r, first, axis=0) / count
    return pi


def proportions(texts: list[bytes], model: LanguageModel, opt: MixtureOptions = MixtureOptions()) -> np.ndarray:
    """Proportions of the chosen languages (rows: texts), all 0 for texts without a word."""
    out = np.zeros((len(texts), len(model.languages)), np.float32)
    if not model.languages:
        return out
    a, ends = _joined(texts)
    h, at = _trigrams(a)
    if not len(at):
        return out
    words = np.flatnonzero(np.diff(at, prepend=-9) > 1)
    ll = np.add.reduceat(model.log_p[h], words, axis=0)
    q = np.maximum(np.exp(ll - ll.max(axis=1, keepdims=True)), opt.floor)
    owner = np.searchsorted(ends, at[words], side="right")
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    has = owner[first]
    count = np.diff(np.append(first, len(owner)))[:, None].astype(np.float32)
    doc = np.repeat(np.arange(len(first)), count[:, 0].astype(np.int64))
    n_lang = q.shape[1]
    pi = _mix(q, doc, first, count, np.full((len(first), n_lang), 1 / n_lang, np.float32), opt.rounds)
    rank = np.argsort(np.argsort(-pi, axis=1, kind="stable"), axis=1)
    best, best_pi = np.full(len(first), -np.inf), pi
    for k in range(1, n_lang + 1):
        # No word's likelihood exceeds 1, so the penalty bounds what k languages can reach.
        if (-opt.penalty * k * np.log(count[:, 0] + 1) <= best).all():
            break
        p = np.where(rank < k, np.maximum(pi, 1e-9), 0).astype(np.float32)
        p /= p.sum(axis=1, keepdims=True)
        if k > 1:
            p = _mix(q, doc, first, count, p, opt.refits)
        fit = np.add.reduceat(np.log((p[doc] * q).sum(axis=1)), first) - opt.penalty * k * np.log(count[:, 0] + 1)
        better = fit > best
        best = np.where(better, fit, best)
        best_pi = np.where(better[:, None], p, best_pi)
    out[has] = best_pi
    return out


def _has_letter(text: bytes) -> bool:
    if not text:
        return False
    if text.isascii():
        return bool(_ASCII_LETTER[np.frombuffer(text, np.uint8)].any())
    return any(c.isalpha() for c in text.decode("utf8"))


def identify(docs: DataFrame, model: LanguageModel, opt: MixtureOptions = MixtureOptions()) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (its proportion), languages (array of
    lang and share of the chosen set).

    Null texts and texts without a letter, and every text if nothing was learned, are `und`
    with score 0. Equal proportions go to the language that comes first by name. An empty
    table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    # Languages times BUCKETS numbers: bounded by the number of learned languages.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            texts = list(raw_texts(batch.column(1)))
            pred, score, sets = [], [], []
            for i, j in _chunks(texts):
                part = texts[i:j]
                for t, p in zip(part, proportions(part, m, opt), strict=True):
                    if not len(p) or not p.any() or not _has_letter(t):
                        pred.append("und")
                        score.append(0.0)
                        sets.append([])
                        continue
                    k = int(p.argmax())
                    pred.append(m.languages[k])
                    score.append(min(1.0, float(p[k])))
                    sets.append([{"lang": m.languages[x], "share": float(p[x])} for x in np.flatnonzero(p)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, kind)],
                names=["doc_id", "lang_pred", "score", "languages"],
            )

    return docs.select("doc_id", "text").mapInArrow(frugal(predict), "doc_id BIGINT, lang_pred STRING, score DOUBLE, languages ARRAY<STRUCT<lang:STRING,share:DOUBLE>>")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = fold(F.col("doc_id"), 4)
    found = identify(docs, fit_languages(docs, part != 2))
    return found.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
