"""Toxicity by multiple-instance learning.

Only documents have labels. A sentence is toxic with probability sigmoid(b + sum of word
weights) and a document is toxic if any sentence is (noisy-or). Training maximises the
likelihood of the document labels, so the weights learn which sentences are to blame; the
same sentence scores then locate offending sentences. A word counts through itself and
through its beginnings, so that unseen forms of an insult still weigh.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.common import fold, frugal, one_text_each, raw_texts, small_batches, table, within_total, written

_MARKS = bytearray(range(256))
for _c in range(128):
    _MARKS[_c] = ord(chr(_c).lower()) if chr(_c).isalnum() else 10 if chr(_c) in ".!?\n\r" else 32
_MARKS = bytes(_MARKS)


@dataclass(frozen=True)
class ToxicityOptions:
    most_labelled: int = 16_000  # documents to learn from, those with the smallest hash of the id
    most_sentences: int = 50_000  # of a document to learn from; longer ones are left out of learning
    all_sentences: int = 1_000_000  # of all documents to learn from, in the order of the id's hash
    most_words: int = 2_000
    least_count: int = 6  # toxic documents that a word must occur in
    rounds: int = 400
    step: float = 0.1
    decay: float = 2e-4
    locate: float = 0.5


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[bytes, float]  # of words, and of beginnings of words after a mark
    bias: float


BEGINNINGS = range(4, 10)  # lengths, in bytes, of the beginnings that count


def features(word: bytes) -> list[bytes]:
    return [word, *[b"^" + word[:k] for k in BEGINNINGS if k <= len(word)]]


class WordScores(dict):
    """Summed weights by word, computed once a word and bounded in size."""

    def __init__(self, weights: dict[bytes, float], most: int = 250_000):
        self.weights, self.most = weights, most

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        self[word] = score = sum(self.weights.get(f, 0.0) for f in features(word))
        return score


def sentences(text: bytes) -> list[bytes]:
    """Lower-cased sentences with marks as blanks, in place: joined by a byte they are as
    long as the text."""
    return text.translate(_MARKS).split(b"\n")


def _labelled(docs: DataFrame, labels: DataFrame, opt: ToxicityOptions) -> DataFrame:
    ids = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(opt.most_labelled)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    sample = written(one_text_each(rows, "doc_id", "toxic"), "toxicity-sample")  # read several times
    # Sentences end in one of these marks; documents that are left out for their length do not count.
    ends = F.length(F.regexp_replace("text", r"[^.!?\n]", "")) + 1
    return within_total(sample.filter(F.coalesce(ends, F.lit(0)) <= opt.most_sentences), ends, opt.all_sentences).select("toxic", "text")


def vocabulary(sample: DataFrame, opt: ToxicityOptions) -> list[bytes]:
    """Words that toxic documents of the sample hold more often than others, by chi-square.
    Words above 64 bytes count through their beginnings only. Counts leave a task in parts of
    bounded size and are summed in the shuffle."""

    def counted(n: dict[bytes, int], t: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(n, pa.binary()), pa.array(n.values(), pa.int64()), pa.array([t.get(f, 0) for f in n], pa.int64())], names=["word", "n", "t"]
        )

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[bytes, int] = {}
        t: dict[bytes, int] = {}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                for f in {f for w in set(text.translate(_MARKS).split()) for f in features(w) if len(f) <= 64}:
                    n[f] = n.get(f, 0) + 1
                    if toxic == 1:
                        t[f] = t.get(f, 0) + 1
                if len(n) > 200_000:
                    yield counted(n, t)
                    n, t = {}, {}
        yield counted(n, t)

    size = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0)).alias("t")).first()
    if not size["n"] or not size["t"]:
        return []
    rate = size["t"] / size["n"]
    counts = sample.mapInArrow(frugal(words), "word BINARY, n BIGINT, t BIGINT").groupBy("word").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    lift = F.col("t") - F.col("n") * rate
    best = counts.filter((F.col("t") >= opt.least_count) & (lift > 0)).orderBy((lift * lift / F.col("n")).desc(), "word").limit(opt.most_words)
    return [bytes(r["word"]) for r in best.select("word").collect()]


def noisy_or_loss(
    params: np.ndarray, y: np.ndarray, bare: np.ndarray, doc: np.ndarray, sent: np.ndarray, word: np.ndarray, decay: float
) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the documents' labels y with its decay, and its gradient.
    params: weights of words and the bias. bare: for each document its sentences without a
    known word. doc: the document of each other sentence; sent and word: pairs of sentence
    and word."""
    w, b = params[:-1], params[-1]
    z = b + np.bincount(sent, w[word], minlength=len(doc))
    a = np.bincount(doc, np.logaddexp(0, z), minlength=len(y)) + bare * np.logaddexp(0, b)
    a = np.maximum(a, 1e-9)  # minus the logarithm of the probability that no sentence is toxic
    gone = np.exp(-a)
    loss = np.where(y > 0, -np.log(-np.expm1(-a)), a).sum() / len(y) + 0.5 * decay * (w * w).sum()
    da = np.where(y > 0, -gone / -np.expm1(-a), 1.0) / len(y)
    dz = da[doc] / (1 + np.exp(-z))
    return loss, np.append(np.bincount(word, dz[sent], minlength=len(w)) + decay * w, dz.sum() + (da * bare).sum() / (1 + np.exp(-b)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, opt: ToxicityOptions = ToxicityOptions()) -> ToxicityModel:
    """Learn from at most opt.most_labelled documents, and as many of them as have about
    opt.all_sentences sentences together. The driver gets their sentences'
    words of the vocabulary only. Null labels and null ids are left out, a null or empty text
    has no sentence; of labels that repeat an id the greatest counts, of texts the one of least
    hash. Without toxic examples,
    as with empty tables, every score is near 0."""
    small_batches(docs.sparkSession)
    sample = _labelled(docs, labels, opt)
    words = vocabulary(sample, opt)
    if not words:
        return ToxicityModel({}, -12.0)
    index = {w: i for i, w in enumerate(words)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, found = [], [], []
            for i, text in enumerate(raw_texts(batch.column(1))):
                parts = [s for s in (x.split() for x in sentences(text)) if s]
                if len(parts) > opt.most_sentences:
                    continue
                kept.append(i)
                hits = [sorted(index[f] for w in set(s) for f in features(w) if f in index) for s in parts]
                total.append(len(parts))
                found.append([h for h in hits if h])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(total, pa.int64()), pa.array(found, pa.list_(pa.list_(pa.int32())))], names=["toxic", "n", "found"])

    rows = sample.mapInArrow(frugal(bags), "toxic INT, n BIGINT, found ARRAY<ARRAY<INT>>").collect()
    rows.sort(key=lambda r: (r["toxic"], r["n"], r["found"]))
    y = np.array([r["toxic"] == 1 for r in rows], float)
    bare = np.array([r["n"] - len(r["found"]) for r in rows], float)
    doc = np.array([d for d, r in enumerate(rows) for _ in r["found"]], np.int64)
    sent = np.array([i for i, s in enumerate(s for r in rows for s in r["found"]) for _ in s], np.int64)
    word = np.array([w for r in rows for s in r["found"] for w in s], np.int64)
    params = np.zeros(len(words) + 1)
    params[-1] = -5.0
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, opt.rounds + 1):
        g = noisy_or_loss(params, y, bare, doc, sent, word, opt.decay)[1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params -= opt.step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return ToxicityModel({x: float(k) for x, k in zip(words, params, strict=False) if abs(k) > 1e-3}, float(params[-1]))


def score_text(text: bytes, model: ToxicityModel, locate: float, scores: WordScores) -> tuple[float, list[tuple[int, int, float]]]:
    """The document's score and its offending sentences as code point spans with scores."""
    bias, word_score = model.bias, scores.__getitem__
    total, n, at, spots = 0.0, 0, 0, []
    for s in sentences(text):
        ws = s.split()
        if ws:
            lift = sum(map(word_score, set(ws)))
            if lift:
                z = bias + lift
                total += np.logaddexp(0, z)
                if z >= 0 and (p := 1 / (1 + np.exp(-z))) >= locate:
                    begin = at + len(s) - len(s.lstrip())
                    start = len(text[:begin].decode("utf8", "ignore"))
                    spots.append((start, start + len(text[begin : at + len(s.rstrip())].decode("utf8", "ignore")), float(p)))
            else:
                n += 1
        at += len(s) + 1
    return float(-np.expm1(-(total + n * np.logaddexp(0, bias)))), spots


def toxicity(docs: DataFrame, model: ToxicityModel, opt: ToxicityOptions = ToxicityOptions()) -> DataFrame:
    """One row per input row: doc_id, score, sentences (array of start, end, score of those
    that offend).

    Null, empty and blank texts have no sentence and score 0. Repeated rows score alike. An
    empty table gives no rows; other columns are ignored.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(model.weights)
        for batch in batches:
            got, ends, spots = [], [0], []
            for text in raw_texts(batch.column(1)):
                score, found = score_text(text, model, opt.locate, scores)
                got.append(score)
                spots += found
                ends.append(len(spots))
            parts = list(zip(*spots, strict=True)) or [(), (), ()]
            flat = pa.StructArray.from_arrays([pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int64()), pa.array(parts[2], pa.float64())], names=["start", "end", "score"])
            spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64()), spans], names=["doc_id", "score", "sentences"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), "doc_id BIGINT, score DOUBLE, sentences ARRAY<STRUCT<start:BIGINT,end:BIGINT,score:DOUBLE>>")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
