"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is good or bad. Its features are shape statistics of the line and of
its neighbours; transitions carry the label along. Only documents have labels: those of lines
are latent, and a document's label is evidence on each of its lines, which bear another one
with some probability. Expectation-maximisation starts from lines without transitions; then
forward-backward with the evidence gives each line and each pair of neighbours its expected
labels, and the chain is fitted to these. So labels may change within a document, and the
transitions learn how often they do. Forward-backward marginals, weighted by line length,
aggregate into the document's score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.common import fold, frugal, one_text_each, raw_texts, small_batches, table, within_total, written

CHUNK = 1 << 20


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


#: Byte classes whose share of a line is a feature.
CLASSES = {
    "upper": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "lower": _class("abcdefghijklmnopqrstuvwxyz"),
    "digit": _class("0123456789"),
    "symbol": _class("#*$%&<>@^~=+\\/{}[]_"),
    "call": _class("!?"),
    "bar": _class("|"),
    "stop": _class(".,;:"),
}
OWN = (*CLASSES, "length", "words", "word_length", "distinct", "seen", "ends")
N_OWN = len(OWN)
N_FEATURES = 3 * N_OWN + 3  # own, previous, next; no previous, no next, constant


@dataclass(frozen=True)
class CrfOptions:
    most_labelled: int = 6_000
    most_lines: int = 5_000  # of a document to learn from; longer ones are left out of learning
    all_lines: int = 400_000  # of all documents to learn from, in the order of the id's hash
    rounds: int = 100  # gradient steps of a fit
    passes: int = 2  # of expectation and maximisation, after the fit without transitions
    step: float = 0.05
    decay: float = 1e-3
    stray: float = 0.3  # probability that a line's label is not its document's


@dataclass(frozen=True)
class CrfModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # for the label good, by feature
    transitions: np.ndarray  # 2 x 2, from and to; 1 is good


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x N_FEATURES), length in bytes and text number of all lines with a
    word, for a chunk of texts. Lines are parted by newlines."""
    rows, size, owner = [], [], []
    spans: list[tuple[int, int]] = []
    base = 0
    for d, t in enumerate(texts):
        seen: set[bytes] = set()
        at = base
        for line in t.split(b"\n"):
            words = line.split()
            if words:
                n = len(line)
                rows.append((np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / len(words), len(set(words)) / len(words), line in seen, line.rstrip()[-1:] in (b".", b"!", b"?")))
                seen.add(line)
                size.append(n)
                owner.append(d)
                spans.append((at, at + n))
            at += len(line) + 1
        base += len(t) + 1
    if not rows:
        return np.zeros((0, N_FEATURES)), np.zeros(0), np.zeros(0, np.int64)
    raw = np.frombuffer(b"\n".join(texts) + b"\n\n", np.uint8)
    cuts = np.array(spans, np.int64).ravel()
    n_bytes = np.array(size, float)
    own = np.empty((len(rows), N_OWN))
    for k, members in enumerate(CLASSES.values()):
        own[:, k] = np.add.reduceat(members[raw].astype(np.int64), cuts)[::2] / n_bytes
    own[:, len(CLASSES) :] = rows
    owner = np.array(owner, np.int64)
    same = owner[1:] == owner[:-1]
    x = np.zeros((len(rows), N_FEATURES))
    x[:, :N_OWN] = own
    x[1:, N_OWN : 2 * N_OWN][same] = own[:-1][same]
    x[:-1, 2 * N_OWN : 3 * N_OWN][same] = own[1:][same]
    x[:, -3] = np.append(True, ~same)
    x[:, -2] = np.append(~same, True)
    x[:, -1] = 1
    return x, n_bytes, owner


def _order(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of each chain, longest first."""
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    count = np.diff(np.append(first, len(owner)))
    by = np.argsort(-count, kind="stable")
    return first[by], count[by]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def forward_backward(node: np.ndarray, transitions: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log marginals of the lines (lines x 2), expected transitions and log partition by
    chain. node: log potentials (lines x 2). All chains step together; those that have ended
    drop out, since the longest come first."""
    alpha, beta = node.copy(), np.zeros_like(node)
    steps = int(count[0]) if len(count) else 0
    live = [int(np.searchsorted(-count, -t, side="left")) for t in range(steps + 1)]  # chains longer than t
    for t in range(1, steps):
        at = first[: live[t]] + t
        alpha[at] = node[at] + _log_sum(alpha[at - 1][:, :, None] + transitions, 1)
    for t in range(steps - 1, 0, -1):
        at = first[: live[t]] + t
        beta[at - 1] = _log_sum(transitions + (node[at] + beta[at])[:, None, :], 2)
    z = _log_sum(alpha[first + count - 1], 1) if len(first) else np.zeros(0)
    line_z = np.empty(len(node))
    inner = np.ones(len(node), bool)
    for c, k, v in zip(first, count, z, strict=True):
        line_z[c : c + k] = v
    inner[first] = False
    to = np.flatnonzero(inner)
    pair = alpha[to - 1][:, :, None] + transitions + (node[to] + beta[to])[:, None, :] - line_z[to, None, None]
    return alpha + beta - line_z[:, None], np.exp(pair).sum(axis=0), z


def fit_chain(x: np.ndarray, owner: np.ndarray, good: np.ndarray, opt: CrfOptions = CrfOptions()) -> CrfModel:
    """Learn from the documents' labels (good: one for each line), which are evidence on the
    lines' latent ones."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    x = (x - mean) / scale
    first, count = _order(owner)
    p = np.zeros(x.shape[1] + 4)
    lines = np.append(np.ones(x.shape[1]), np.zeros(4))  # the transitions stay 0 at first
    p = _ascend(lambda q: lines * evidence_gradient(x, first, count, good, q, opt.stray)[1], p, len(x), opt)
    for _ in range(opt.passes):
        marginal, pairs, _ = forward_backward(_nodes(x, p) + _seen(good, opt.stray), p[-4:].reshape(2, 2), first, count)
        held = np.append(x.T @ np.exp(marginal[:, 1]), pairs.ravel())

        def gradient(q: np.ndarray, held: np.ndarray = held) -> np.ndarray:
            free, free_pairs, _ = forward_backward(_nodes(x, q), q[-4:].reshape(2, 2), first, count)
            return held - np.append(x.T @ np.exp(free[:, 1]), free_pairs.ravel())

        p = _ascend(gradient, p, len(x), opt)
    return CrfModel(mean, scale, p[:-4], p[-4:].reshape(2, 2))


def _ascend(gradient: Callable[[np.ndarray], np.ndarray], p: np.ndarray, n: int, opt: CrfOptions) -> np.ndarray:
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, opt.rounds + 1):
        g = opt.decay * p - gradient(p) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - opt.step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p


def _nodes(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    node = np.zeros((len(x), 2))
    node[:, 1] = x @ p[:-4]
    return node


def _seen(good: np.ndarray, stray: float) -> np.ndarray:
    """Log probability of the document's label given each label of the line."""
    return np.log(np.where(np.stack([good == 0, good == 1], axis=1), 1 - stray, max(stray, 1e-12)))


def evidence_gradient(x: np.ndarray, first: np.ndarray, count: np.ndarray, good: np.ndarray, p: np.ndarray, stray: float) -> tuple[float, np.ndarray]:
    """Log-likelihood of the evidence and its gradient: expected features given the evidence,
    less those without it. p: weights and transitions."""
    transitions, node = p[-4:].reshape(2, 2), _nodes(x, p)
    free, free_pairs, z = forward_backward(node, transitions, first, count)
    held, held_pairs, z_held = forward_backward(node + _seen(good, stray), transitions, first, count)
    grad = np.append(x.T @ (np.exp(held[:, 1]) - np.exp(free[:, 1])), (held_pairs - free_pairs).ravel())
    return float((z_held - z).sum()), grad


def line_marginals(texts: list[bytes], model: CrfModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of good, length and text number of every line with a word."""
    x, size, owner = line_features(texts)
    if not len(x):
        return np.zeros(0), size, owner
    node = np.zeros((len(x), 2))
    node[:, 1] = (x - model.mean) / model.scale @ model.weights
    first, count = _order(owner)
    return np.minimum(1.0, np.exp(forward_backward(node, model.transitions, first, count)[0][:, 1])), size, owner


def fit_quality(docs: DataFrame, labels: DataFrame, opt: CrfOptions = CrfOptions()) -> CrfModel | None:
    """Learn from at most opt.most_labelled documents, those with the smallest hash of the
    id, and as many of them as have opt.all_lines lines together: that many rows of features reach the driver. Null labels and null ids are left out, null and empty texts have no line; of labels
    that repeat an id the least counts, of texts the one of least hash. None if that leaves no example, as with empty tables."""
    small_batches(docs.sparkSession)
    ids = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(opt.most_labelled)
    )
    sample = written(one_text_each(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "doc_id", "quality"), "quality-sample")
    # Documents that are left out for their length do not count.
    lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    sample = within_total(sample.filter(F.coalesce(lines, F.lit(0)) <= opt.most_lines), lines, opt.all_lines)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = (line_features([t])[0] for t in raw_texts(batch.column(2)))
            blobs = [x.astype("<f4").tobytes() for x in features]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["doc_id", "quality", "x"])

    rows = [r for r in sample.mapInArrow(extract, "doc_id BIGINT, quality INT, x BINARY").collect() if r["x"]]
    if not rows:
        return None
    rows.sort(key=lambda r: r["doc_id"])
    parts = [np.frombuffer(bytes(r["x"]), "<f4").reshape(-1, N_FEATURES).astype(float) for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(p) for p in parts])
    good = np.repeat([float(r["quality"] == 1) for r in rows], [len(p) for p in parts])
    return fit_chain(np.concatenate(parts), owner, good, opt)


def quality(docs: DataFrame, model: CrfModel | None) -> DataFrame:
    """One row per input row: doc_id, score, lines (array of the probability of good, for
    every line with a word).

    Null, empty and blank texts have no line and score 0, as does everything if there was
    nothing to learn from. Repeated rows score alike. An empty table gives no rows; other
    columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(raw_texts(batch.column(1)))
            score, lines = np.zeros(len(texts)), [[] for _ in texts]
            begin, size = 0, 0
            for i in range(len(texts) + 1):
                if model is not None and i > begin and (i == len(texts) or size + len(texts[i]) > CHUNK):
                    p, n, owner = line_marginals(texts[begin:i], model)
                    total = np.bincount(owner, n, minlength=i - begin)
                    score[begin:i] = np.bincount(owner, p * n, minlength=i - begin) / np.maximum(total, 1)
                    ends = np.searchsorted(owner, np.arange(i - begin + 1))
                    for d in range(i - begin):
                        lines[begin + d] = p[ends[d] : ends[d + 1]]
                    begin, size = i, 0
                if i < len(texts):
                    size += len(texts[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.clip(score, 0, 1), pa.float64()), pa.array(lines, pa.list_(pa.float64()))], names=["doc_id", "score", "lines"]
            )

    return docs.select("doc_id", "text").mapInArrow(frugal(run), "doc_id BIGINT, score DOUBLE, lines ARRAY<DOUBLE>")


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
