"""Exact ranked lexical search over inverted treaps.

Documents are dealt into segments. In a segment every query term has a treap of its postings:
a binary search tree by document number and at the same time a heap by impact, the weight of the
term times its saturated frequency in the document. All items walk the treaps of their terms
together. A step holds intervals of document numbers with, for each term, the topmost posting
inside; the sum of those impacts bounds every score in the interval, which goes once it can't
enter the top k. What is left is split at the document of the largest impact, whose score is
then known exactly. Steps are taken for all intervals of many items at once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawlake.llm.common import frugal, raw_texts, small_batches, table, written

SLICE = 1 << 20  # bytes of a text that are split at once

#: Every byte as itself, capitals as small letters and what is in no term as a blank. All bytes of
#: characters beyond ASCII are from 128, so UTF-8 need not be decoded.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class SearchOptions:
    top: int = 10
    segment: int = 8192  # documents whose treaps a task holds at once
    segment_postings: int = 1 << 21  # and their postings; one document may hold more
    block: int = 4096  # items that are searched in one pass over the documents
    block_bytes: int = 4 << 20  # and their texts; one item may be longer
    walk: int = 1 << 19  # postings of one walk's items


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, slice by slice, so that a long text is never held as a
    whole list of terms."""
    if len(text) <= SLICE:
        yield text.translate(_TERM).split()
        return
    rest = b""
    for begin in range(0, len(text), SLICE):
        part = rest + text[begin : begin + SLICE].translate(_TERM)
        cut = part.rfind(b" ") + 1
        yield part[:cut].split()
        rest = part[cut:]
    yield rest.split()


def frequencies(text: bytes, number: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """Number of terms of a text, and how often it holds each of the numbered ones."""
    n, found = 0, {}
    for part in terms_of(text):
        n += len(part)
        for term, tf in Counter(part).items():
            k = number.get(term)
            if k is not None:
                found[k] = found.get(k, 0) + tf
    return n, found


FREQUENCIES = "doc_id BIGINT, n BIGINT, terms ARRAY<INT>, tfs ARRAY<BIGINT>"


def term_frequencies(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """A row for each document: its number of terms n, and its numbered terms with their
    frequencies. A null text has no term."""
    shared = docs.sparkSession.sparkContext.broadcast(number)
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            got = [frequencies(t, known) for t in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([n for n, _ in got], pa.int64()),
                    pa.array([list(f) for _, f in got], pa.list_(pa.int32())),
                    pa.array([list(f.values()) for _, f in got], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return docs.select("doc_id", "text").mapInArrow(frugal(count), FREQUENCIES)


@dataclass(frozen=True)
class Statistics:
    """Of all documents: those with a term, all terms, and the weight of each numbered term."""

    documents: int
    terms: int
    weight: np.ndarray

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """The length factor of documents of n terms, in hundredths."""
        # In Python's integers where 75 * n * N could leave 64 bits.
        if len(n) and 75 * int(n.max()) * max(self.documents, 1) >= 1 << 63:
            return np.array([25 + 75 * int(x) * self.documents // max(self.terms, 1) for x in n], np.int64)
        return 25 + 75 * n * self.documents // max(self.terms, 1)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def statistics(rows: DataFrame, n_numbered: int) -> Statistics:
    """From all rows of `term_frequencies`. The driver gets a number for each term of the items."""
    total = rows.filter("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    docs, terms = total["docs"], total["terms"] or 0
    df = np.zeros(n_numbered, np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[r["term"]] = r["count"]
    return Statistics(docs, terms, np.array([weight(docs, int(x)) for x in df], np.int64))


@dataclass(frozen=True)
class Treaps:
    """The treaps of a segment, side by side: postings sorted by term and document number."""

    key: np.ndarray  # term * documents + document, ascending
    doc: np.ndarray
    impact: np.ndarray
    left: np.ndarray  # child of the smaller documents, or -1
    right: np.ndarray
    root: np.ndarray  # by term, or -1
    size: np.ndarray  # postings by term
    documents: int


def treaps(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, tie: np.ndarray, documents: int, n_terms: int) -> Treaps:
    """Build the treaps level by level: of each range of postings the one with the largest
    impact is on top, of equal ones that with the largest tie, and what is left and right of it
    are ranges of the next level."""
    key = term * documents + doc
    order = np.argsort(key)
    key, doc, term, impact = key[order], doc[order], term[order], impact[order]
    n = len(key)
    at = np.lexsort((tie[order], impact))
    rank = np.full(n + 1, -1, np.int64)
    rank[at] = np.arange(n)
    left, right, root = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n_terms, -1, np.int64)
    size = np.bincount(term, minlength=n_terms)
    ends = np.cumsum(size)
    some = np.flatnonzero(size)
    begin, end = (ends - size)[some], ends[some]
    above = None
    while len(begin):
        top = at[np.maximum.reduceat(rank, np.stack([begin, end], 1).ravel())[::2]]
        if above is None:
            root[some] = top
        else:
            low = top < above
            left[above[low]] = top[low]
            right[above[~low]] = top[~low]
        both = np.stack([begin, top, top + 1, end], 1).reshape(-1, 2)
        above = np.repeat(top, 2)
        full = both[:, 0] < both[:, 1]
        begin, end, above = both[full, 0], both[full, 1], above[full]
    return Treaps(key, doc, impact, left, right, root, size, documents)


class Best:
    """The best documents of each item so far: scores and ids, and the score to reach."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.item, self.score = np.empty(0, np.int64), np.empty(0, np.int64)
        self.id, self.null = np.empty(0, np.int64), np.empty(0, bool)
        self.least = np.ones(n_items, np.int64)

    def offer(self, item: np.ndarray, score: np.ndarray, doc_id: np.ndarray, null: np.ndarray) -> None:
        """Equal scores go by ascending id, null ids last."""
        some = score >= self.least[item]
        if not some.any():
            return
        item, score = np.append(self.item, item[some]), np.append(self.score, score[some])
        doc_id, null = np.append(self.id, doc_id[some]), np.append(self.null, null[some])
        order = np.lexsort((doc_id, null, -score, item))
        item = item[order]
        first = np.flatnonzero(np.diff(item, prepend=-1))
        place = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        kept = order[place < self.top]
        last = place == self.top - 1
        self.least[item[last]] = np.maximum(score[order[last]], 1)
        self.item, self.score = item[place < self.top], score[kept]
        self.id, self.null = doc_id[kept], null[kept]


def walk(trees: Treaps, items: np.ndarray, terms: np.ndarray, times: np.ndarray, best: Best, doc_id: np.ndarray, null: np.ndarray) -> None:
    """One walk of some items: entry i says that an item holds a term so many times. Entries
    are sorted by item. Offers every document that may enter an item's best ones."""
    node = trees.root[terms]
    there = node >= 0
    items, node, times = items[there], node[there], times[there]
    if not len(node):
        return
    # An interval holds the documents strictly between low and high; `of` is an entry's interval.
    first = np.flatnonzero(np.diff(items, prepend=-1))
    item = items[first]
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(items))))
    low, high = np.full(len(first), -1, np.int64), np.full(len(first), trees.documents, np.int64)
    while len(node):
        first = np.flatnonzero(np.diff(of, prepend=-1))
        share = times * trees.impact[node]
        going = np.add.reduceat(share, first) >= best.least[item]
        kept = going[of]
        of = (np.cumsum(going) - 1)[of[kept]]
        node, times, share = node[kept], times[kept], share[kept]
        item, low, high = item[going], low[going], high[going]
        if not len(node):
            return
        first = np.flatnonzero(np.diff(of, prepend=-1))
        largest = np.flatnonzero(share == np.maximum.reduceat(share, first)[of])
        split = trees.doc[node[largest[np.flatnonzero(np.diff(of[largest], prepend=-1))]]]
        here = trees.doc[node]
        at = split[of]
        score = np.zeros(len(item), np.int64)
        same = here == at
        np.add.at(score, of[same], share[same])
        other = np.flatnonzero(~same)
        wanted = trees.key[node[other]] - here[other] + at[other]
        found = np.minimum(np.searchsorted(trees.key, wanted), len(trees.key) - 1)
        hit = trees.key[found] == wanted
        np.add.at(score, of[other[hit]], times[other[hit]] * trees.impact[found[hit]])
        best.offer(item, score, doc_id[split], null[split])
        # Both sides of the split: an entry's own posting is on top on its side, the other
        # side's topmost is below it.
        n = len(item)
        node = np.concatenate([np.where(here < at, node, trees.left[node]), np.where(here > at, node, trees.right[node])])
        of = np.concatenate([of, of + n])
        low, high, item = np.concatenate([low, split]), np.concatenate([split, high]), np.concatenate([item, item])
        times = np.concatenate([times, times])
        moving = np.flatnonzero(node >= 0)
        while len(moving):
            x, i = node[moving], of[moving]
            d = trees.doc[x]
            under, over = d <= low[i], d >= high[i]
            out = under | over
            moving = moving[out]
            node[moving] = np.where(under[out], trees.right[x[out]], trees.left[x[out]])
            moving = moving[node[moving] >= 0]
        kept = node >= 0
        node, of, times = node[kept], of[kept], times[kept]
        used = np.zeros(2 * n, bool)
        used[of] = True
        of = (np.cumsum(used) - 1)[of]
        item, low, high = item[used], low[used], high[used]


def search_segment(ids: pa.Array, n: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, stats: Statistics, items: np.ndarray, terms: np.ndarray, times: np.ndarray, best: Best, opt: SearchOptions) -> None:
    """Offer the best documents of a segment. Documents are numbered in an order that has
    nothing to do with their lengths, so treaps are balanced whatever order the table has."""
    number = np.random.default_rng(len(ids)).permutation(len(ids))
    m = stats.lengths(n)
    impact = stats.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[owner]))
    trees = treaps(number[owner], term, impact, owner, len(ids), len(stats.weight))
    null = np.empty(len(ids), bool)
    doc_id = np.empty(len(ids), np.int64)
    null[number] = np.asarray(ids.is_null())
    doc_id[number] = np.asarray(ids.fill_null(0))
    # Items whose postings together fill a walk.
    cost = np.zeros(len(best.least), np.int64)
    np.add.at(cost, items, trees.size[terms])
    part = (np.cumsum(cost) // opt.walk)[items]
    edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(items))
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        walk(trees, items[i:j], terms[i:j], times[i:j], best, doc_id, null)


def _segments(batches: Iterator[pa.RecordBatch], opt: SearchOptions) -> Iterator[pa.Table]:
    parts: list[pa.RecordBatch] = []
    rows = postings = 0
    for batch in batches:
        for begin in range(0, len(batch), 512):
            part = batch.slice(begin, 512)
            parts.append(part)
            rows += len(part)
            postings += len(part.column(2).flatten())
            if rows >= opt.segment or postings >= opt.segment_postings:
                yield pa.Table.from_batches(parts)
                parts, rows, postings = [], 0, 0
    if rows:
        yield pa.Table.from_batches(parts)


def _ranked_block(docs: DataFrame, texts: list[tuple[int, bytes]], opt: SearchOptions) -> DataFrame:
    """_item, doc_id, score: of each part of the documents the best ones for each item."""
    number: dict[bytes, int] = {}
    held: list[tuple[int, int, int]] = []  # place of the item, term, times
    for place, (_, text) in enumerate(texts):
        counts: Counter[bytes] = Counter()
        for part in terms_of(text):
            counts.update(part)
        held += [(place, number.setdefault(t, len(number)), c) for t, c in counts.items()]
    rows = written(term_frequencies(docs, number), "frequencies")
    stats = statistics(rows, len(number))
    entries = np.array(held, np.int64).reshape(-1, 3)
    names = np.array([k for k, _ in texts], np.int64)
    # Bounded by the block: its items' terms and their weights.
    shared = docs.sparkSession.sparkContext.broadcast((stats, entries, names))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, entries, names = shared.value
        items, terms, times = entries.T
        best = Best(len(names), opt.top)
        for part in _segments(batches, opt):
            part = part.combine_chunks()
            lists = part.column("terms").combine_chunks()
            owner = np.repeat(np.arange(len(part)), np.diff(np.asarray(lists.offsets)))
            term = np.asarray(lists.flatten()).astype(np.int64)
            tf = np.asarray(part.column("tfs").combine_chunks().flatten()).astype(np.int64)
            ids = part.column("doc_id").combine_chunks()
            search_segment(ids, np.asarray(part.column("n")), owner, term, tf, stats, items, terms, times, best, opt)
        ids = pa.array(best.id, pa.int64(), mask=best.null)
        yield pa.RecordBatch.from_arrays([pa.array(names[best.item]), ids, pa.array(best.score)], names=["_item", "doc_id", "score"])

    return rows.mapInArrow(frugal(search), "_item BIGINT, doc_id BIGINT, score BIGINT")


def rank_documents(items: DataFrame, docs: DataFrame, opt: SearchOptions = SearchOptions()) -> DataFrame:
    """The `top` highest-scoring documents of each item: item_id, rank, doc_id, score.

    items: item_id, text; docs: doc_id, text; other columns are ignored, whatever their names.
    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Null, empty
    and blank texts have no term: such a document is found by no item and not counted, such an
    item finds none. Equal scores go by ascending doc_id, null ids last. Rows that repeat a
    doc_id are documents of their own; rows that repeat item_id and text are one item, rows that
    repeat an item_id with other texts are ranked each for itself. Texts of any length count
    whole. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    asked = items.select("item_id", "text").distinct().withColumn("_item", F.monotonically_increasing_id())
    asked = written(asked, "items")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // opt.block), -(-(size["bytes"] or 0) // opt.block_bytes))
    found = []
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == b).select("_item", "text").collect()
        if own:
            found.append(_ranked_block(docs, [(r["_item"], (r["text"] or "").encode()) for r in own], opt))
    if not found:
        return spark.createDataFrame([], "item_id BIGINT, rank INT, doc_id BIGINT, score BIGINT")
    union = found[0]
    for x in found[1:]:
        union = union.unionByName(x)
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = union.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= opt.top)
    return ranked.join(asked.select("_item", "item_id"), "_item").select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


_TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS terms FROM documents WHERE text IS NOT NULL
), item AS (
  SELECT row_number() OVER () AS q, item_id, {_TERMS_SQL} AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark) WHERE text IS NOT NULL
), asked AS (
  SELECT q, term, count(*) AS times FROM (SELECT q, unnest(terms) AS term FROM item) GROUP BY q, term
), posting AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM doc) GROUP BY r, term
), total AS (
  SELECT count(*) AS big_n, sum(len(terms))::BIGINT AS big_l FROM doc WHERE len(terms) > 0
), weighed AS (
  SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM posting, total GROUP BY term
), sized AS (
  SELECT r, doc_id, 25 + (75 * len(terms) * big_n) // big_l AS m FROM doc, total WHERE len(terms) > 0
), scored AS (
  SELECT q, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN posting USING (term) JOIN weighed USING (term) JOIN sized USING (r) GROUP BY q, r
), ranked AS (
  SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored JOIN sized USING (r) WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked JOIN item USING (q) WHERE rank <= 10
"""
