"""N-gram Jaccard self-join of documents by a prefix tree.

Every document is a set of hashed word n-grams in one global order: elements that are rare in
the corpus first (by a count sketch over all documents), by hash within either kind. Sets that
might link share a block; within a block they form a prefix tree. A probe finds the subtrees
that hold one of its own leading elements, walks them depth first, carries the overlap of a
shared prefix along, and leaves a subtree as soon as the mismatches on its prefix, with all
that remains matching, rule out the required similarity.

Blocks lose no link. Two sets of similarity t differ in at most d elements. If hashes deal the
elements to more than d parts, each difference breaks one part, so of more than d parts with
elements at least one is equal in both sets. Equal parts have equal signatures. Elements that
are frequent in the corpus are left out of the parts, so that a passage of many documents does
not tie them together; a set that then has too few parts with elements is signed with all its
elements as well, and one that has too few even so with its leading elements one by one. Which
elements are left out is the same for all documents, so this too loses no link. A set with f
parts shares at least f - d signatures with each set linked to it, so a set whose signatures are
shared less often, with whatever sets, has no link and goes.

Documents with equal sets are one class throughout. Classes that share signatures are compared
in two steps. First a few rounds put the classes of frequent signatures, once each, into the
block of one of these; links found there join near copies into components, and in later rounds
one class speaks for all of its component that share a block. Then every signature that still ties
different components is followed: the classes that share such signatures, in chains, are a
cluster and all its pairs of different components are compared. A cluster above the size of a
block is cut into chunks and each pair of chunks is a block, which is quadratic in what the
first step has left of a cluster. Blocks are bounded by the number of elements.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.common import frugal, raw_texts, small_batches, split_join, table, written
from drawlake.llm.components import components
from drawlake.storage import drop_written

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
FREQUENT = np.uint64(1 << 63)  # marks the key of an element that is frequent in the corpus
ONE = np.uint64(1)
FILTER_BITS = 1 << 18


@dataclass(frozen=True)
class JoinOptions:
    words: int = 5
    least: int = 80  # similarity, in hundredths
    block: int = 1_000_000  # elements of the sets that one task compares
    class_ratio: float = 0.75  # sizes of one size class, least over most
    rounds: int = 2  # that put classes into one block each, before all signatures are followed
    crowd: int = 8  # classes of such a block, at least

    def links(self, inter: int, union: int) -> bool:
        return 100 * inter >= self.least * union

    def most_apart(self, total: int) -> int:
        """Most elements in which two linked sets differ whose sizes add up to `total`."""
        return total * (100 - self.least) // (100 + self.least)

    def leading(self, n: int) -> int:
        """How many of the first elements of a set, in any global order, hold one that it
        shares with each set linked to it."""
        return n - -(-n * self.least // 100) + 1


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K[3]
    x = (x ^ (x >> np.uint64(29))) * _K[4]
    return x ^ (x >> np.uint64(32))


def shingle_set(raw: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text: lower-cased A-Z, words
    parted by U+0020 and U+0009 to U+000D. Fewer words than n count as one n-gram."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    x = np.full(len(words) - size + 1, (size * 0x9E3779B97F4A7C15) & (2**64 - 1), np.uint64)
    for k in range(size):
        x = _mixed(x * _K[0] + h[k : len(h) - size + 1 + k] + _K[2])
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])]


class Frequent:
    """Which elements are frequent: by the leading bits of the hash."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.shift = np.uint64(64 - (len(marks).bit_length() - 1))

    def keys(self, h: np.ndarray) -> np.ndarray:
        """The elements in the global order: sorted keys, the rare ones first."""
        x = h >> ONE
        x |= np.where(self.marks[(h >> self.shift).astype(np.int64)], FREQUENT, np.uint64(0))
        x.sort()
        return x


class SizeClasses:
    """Size classes and, for each, the number of parts."""

    def __init__(self, opt: JoinOptions):
        self.opt = opt
        first = 1
        while opt.least < 100 and opt.most_apart(2 * first + 1) < 1:  # smaller sets link only if equal
            first += 1
        self.bounds = [first]

    def of(self, n: int) -> int:
        """The class of size n, -1 if such a set can link to equal sets only."""
        while self.bounds[-1] <= n:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] / self.opt.class_ratio)))
        return int(np.searchsorted(self.bounds, n, side="right")) - 1

    def keys(self, n: int) -> range:
        """Classes under which a set of size n is signed: its own, and those above it where a
        larger set that links to it can lie. The larger of two sets names the class they share."""
        if self.opt.least >= 100:
            return range(0)
        top = self.of(n * 100 // self.opt.least)
        return range(max(self.of(n), 0), top + 1)

    def parts(self, c: int) -> tuple[int, int]:
        """Number of parts of class c, and the most differences of a linked pair."""
        while c + 1 >= len(self.bounds):
            self.of(self.bounds[-1])
        apart = self.opt.most_apart(2 * (self.bounds[c + 1] - 1))
        return apart + 2 + apart // 4, apart


def _part_signatures(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Signatures of those of k parts that have elements. Parts are ranges of the 63 bits."""
    sums = np.append(np.uint64(0), np.cumsum(_mixed(x * _K[0] + _K[1]), dtype=np.uint64))
    edges = np.arange(1, k, dtype=np.uint64) * np.uint64((2**63 - 1) // k)
    at = np.concatenate([[0], np.searchsorted(x, edges), [len(x)]])
    count = np.diff(at)
    sig = sums[at[1:]] - sums[at[:-1]] + count.astype(np.uint64) * _K[2]
    sig = _mixed(sig + np.arange(k, dtype=np.uint64) * _K[3] + np.array([seed], np.uint64) * _K[4])
    return sig[count > 0]


KINDS = np.uint64(63)  # the trailing bits of a signature name its size class


def signatures(keys: np.ndarray, classes: SizeClasses) -> tuple[np.ndarray, list[int], list[int]]:
    """Signatures of a set, for its size classes: the signatures, the classes by the trailing
    bits, and for each the least number that the set shares with a set linked to it. If either
    of two linked sets has more parts with rare elements than the pair has differences, they
    share the signature of such a part. Otherwise both sign all their elements too, and if
    that gives too few parts as well, as for very small sets, each of their leading elements:
    these hold a common one."""
    out, kinds, least = [], [], []
    n_rare = int(np.searchsorted(keys, FREQUENT))
    rare, every = keys[:n_rare], None
    for c in classes.keys(len(keys)):
        k, apart = classes.parts(c)
        sigs = _part_signatures(rare, k, 3 * c + 1)
        kinds.append(c & int(KINDS))
        least.append(max(1, len(sigs) - apart))
        if len(sigs) <= apart:
            every = np.sort(keys & ~FREQUENT) if every is None else every
            more = _part_signatures(every, k, 3 * c + 2)
            sigs = np.append(sigs, more)
            if len(more) <= apart:
                sigs = np.append(sigs, _mixed(keys[: classes.opt.leading(len(keys))] * _K[2] + np.array([3 * c + 3], np.uint64) * _K[1]))
        out.append(sigs & ~KINDS | np.uint64(kinds[-1]))
    return np.concatenate(out) if out else np.empty(0, np.uint64), kinds, least


def frequent_elements(docs: DataFrame, opt: JoinOptions) -> Frequent:
    """Counts the documents of all elements in buckets of their hash and marks the buckets
    that stand well above the middle one, at most one in sixteen of them. There are 2^16 to
    2^22 buckets, growing with the cube root of the number of documents, so that a task's
    counts stay small beside its texts; the driver gets a number for each bucket."""
    n_docs = docs.count()
    bits = min(22, 16 + max(0, math.ceil((math.log2(n_docs + 1) - 16) / 3)))
    shift = np.uint64(64 - bits)
    slices, parts = 16, max(1, math.isqrt(n_docs // 5000))
    width = (1 << bits) // slices

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, "<i8")
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                h = (shingle_set(raw, opt.words) >> shift).astype(np.int64)
                if len(h):  # sorted, so that equal buckets are next to one another
                    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                    total[h[first]] += np.diff(np.append(first, len(h)))
        yield packed({i: total[i * width : (i + 1) * width] for i in range(slices)})

    def packed(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(counts.as_py(), "<i8")
                sums[i] = sums[i] + x if i in sums else x
        if sums:
            yield packed(sums)

    schema = "slice INT, counts BINARY"
    counts = docs.select("text").mapInArrow(frugal(count), schema)
    # Vectors of counts are added up in two steps, of which each holds one vector at a time.
    counts = counts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(parts))).repartition("slice", "part").mapInArrow(add, schema)
    counts = counts.repartition("slice").mapInArrow(add, schema).toArrow()
    total = np.zeros(1 << bits)
    for i, x in zip(counts.column("slice").to_pylist(), counts.column("counts").to_pylist(), strict=True):
        total[i * width : (i + 1) * width] += np.frombuffer(x, "<i8")
    middle = float(np.median(total))
    return Frequent(total > max(middle + 8 * middle**0.5 + 16, float(np.quantile(total, 15 / 16))))


def set_identity(h: np.ndarray) -> tuple[int, int]:
    """h1 and h2, the two halves of a hash of the set, unsigned."""
    whole = xxhash.xxh3_128_intdigest(h.tobytes())
    return whole >> 64, whole & (2**64 - 1)


def signed_sets(docs: DataFrame, opt: JoinOptions, frequent: Broadcast) -> DataFrame:
    """doc_id, n (set size), h1 and h2 (identity of the set), text_hash, sigs, kinds and least
    (see signatures). Of rows with equal sets in one batch only the first one carries
    signatures."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, marks = SizeClasses(opt), frequent.value
        none = np.empty(0, np.uint64)
        for batch in batches:
            n, ids, seen = [], [], set()
            sigs, kinds, least = [], [], []
            for named, raw in zip(batch.column(0).is_valid().to_pylist(), raw_texts(batch.column(1)), strict=True):
                h = shingle_set(raw, opt.words)
                n.append(len(h))
                ids.append(set_identity(h))
                once = named and len(h) and ids[-1] not in seen
                found = signatures(marks.keys(h), classes) if once else (none, [], [])
                seen.add(ids[-1]) if once else None
                for column, values in zip((sigs, kinds, least), found, strict=True):
                    column.append(values)
            offsets = np.cumsum([0] + [len(s) for s in sigs]).astype(np.int32)
            values = pa.array(np.concatenate(sigs).view(np.int64) if sigs else none.view(np.int64))
            pair = np.array(ids, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), batch.column(2),
                    pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(kinds, pa.list_(pa.int32())), pa.array(least, pa.list_(pa.int32())),
                ],
                names=["doc_id", "n", "h1", "h2", "text_hash", "sigs", "kinds", "least"],
            )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(frugal(sign), "doc_id BIGINT, n BIGINT, h1 BIGINT, h2 BIGINT, text_hash BIGINT, sigs ARRAY<BIGINT>, kinds ARRAY<INT>, least ARRAY<INT>")


class PrefixTree:
    """Sets of one block, in the global order of their elements, as a prefix tree. Sorted sets
    with the lengths of their common prefixes stand for the tree: a subtree is a run of
    neighbours with a long enough common prefix."""

    def __init__(self, sets: list[np.ndarray], opt: JoinOptions):
        values, coded = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum([0] + [len(s) for s in sets])
        paths = [coded[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.width = len(values)
        self.order = sorted(range(len(sets)), key=lambda i: paths[i].astype(">u4").tobytes())
        self.paths = [paths[i] for i in self.order]
        n = len(sets)
        self.common = np.zeros(n + 1, np.int64)  # of each path and the one before; 0 after the last
        for i in range(1, n):
            a, b = self.paths[i - 1], self.paths[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.common[i] = int(differ[0]) if len(differ) else m
        self.shorter = np.full(n + 1, n, np.int64)  # the next place with a shorter common prefix
        stack: list[int] = []
        for i in range(n + 1):
            while stack and self.common[stack[-1]] > self.common[i]:
                self.shorter[stack.pop()] = i
            stack.append(i)
        leading = [p[: opt.leading(len(p))] for p in self.paths]
        owner = np.repeat(np.arange(n), [len(p) for p in leading])
        flat = np.concatenate(leading)
        by = np.argsort(flat, kind="stable")
        self.owners = owner[by]  # places of the sets that lead with an element, by element
        self.starts = np.searchsorted(flat[by], np.arange(self.width + 1))
        self.leading = leading

    def sharing(self, a: int) -> np.ndarray:
        """Places after a of the sets that lead with one of its leading elements, in order."""
        spans = zip(self.starts[self.leading[a]].tolist(), self.starts[self.leading[a] + 1].tolist(), strict=True)
        parts = [self.owners[i:j] for i, j in spans if j - i > 1]
        if not parts:
            return np.empty(0, np.int64)
        found = np.unique(np.concatenate(parts))
        return found[np.searchsorted(found, a, side="right") :]

    def leave(self, b: int, depth: int) -> int:
        """The first place after the subtree of b at that depth."""
        b += 1
        while self.common[b] >= depth and b < len(self.paths):
            b = int(self.shorter[b])
        return b


def tree_join(
    names: list, sets: list[np.ndarray], opt: JoinOptions, group: list | None = None, side: list[int] | None = None, spanning: bool = True
) -> Iterator[tuple]:
    """Yield (name, name, intersection, union) of linked sets, each given as sorted keys of the
    global order. side: only sets of different sides are compared, if given. group: sets of
    one group are connected already. spanning: pairs that are connected, by groups or by links
    found so far, are passed over, so the links span the components without listing every pair."""
    if len(sets) < 2:
        return
    tree = PrefixTree(sets, opt)
    paths, common, n = tree.paths, tree.common, len(sets)
    label = np.array([group[i] for i in tree.order], np.int64) if group else np.arange(n)
    sides = np.array([side[i] for i in tree.order]) if side else None
    left = len(np.unique(label))
    sizes = np.array([len(p) for p in paths])
    member = np.zeros(tree.width, bool)
    steps = np.arange(int(sizes.max()) + 1)
    for a in range(n - 1):
        if spanning and left == 1:
            return
        x = paths[a]
        nx = len(x)
        found = tree.sharing(a)
        low, top = -(-nx * opt.least // 100), nx * 100 // opt.least
        found = found[(sizes[found] >= low) & (sizes[found] <= top)]
        if spanning:
            found = found[label[found] != label[a]]
        if sides is not None:
            found = found[sides[found] != sides[a]]
        if not len(found):
            continue
        # What each candidate shares with the one before: the least common prefix in between.
        prefix = np.minimum.reduceat(common, found + 1)[:-1] if len(found) > 1 else None
        member[x] = True
        apart = opt.most_apart(nx + top)
        over = np.zeros(1, np.int64)  # overlap of x with each prefix of the path walked last
        shared, at, walked = 0, 0, -1
        while at < len(found):
            b = int(found[at])
            if walked >= 0:
                shared = min(shared, int(prefix[walked:at].min()))
            if spanning and label[b] == label[a]:
                if walked >= 0:  # the path walked last stays, with what is shared up to here
                    walked = at
                at += 1
                continue
            y = paths[b]
            ny = len(y)
            over = np.concatenate([over[: shared + 1], over[shared] + np.cumsum(member[y[shared:]])])
            walked, shared = at, ny
            # After t elements of y: those of y that x lacks, and those of x up to there that y lacks.
            gone = steps[1 : ny + 1] + np.searchsorted(x, y, side="right") - 2 * over[1:]
            bad = np.flatnonzero(gone > apart)
            if len(bad):
                at = int(np.searchsorted(found, tree.leave(b, int(bad[0]) + 1)))
                continue
            inter = int(over[-1])
            if opt.links(inter, nx + ny - inter):
                yield names[tree.order[a]], names[tree.order[b]], inter, nx + ny - inter
                if spanning:
                    label[label == label[b]] = label[a]
                    left -= 1
            at += 1
        member[x] = False


def shared_signatures(signed: DataFrame) -> DataFrame:
    """sig, h1 of the signatures that sets of different identity share; a few rows come twice.
    Rows are dealt by range of signature and identity, so the rows of a frequent signature
    spread over many tasks; the first and last signature of a task, which may go on in another
    one, are kept unseen."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_sig, kept_h = np.empty(0, np.int64), np.empty(0, np.int64)
        opening = True
        first = None

        def out(sig: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(h)], names=["sig", "h1"])

        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.concatenate([kept_sig, batch.column(0).to_numpy()])
            h = np.concatenate([kept_h, batch.column(1).to_numpy()])
            if opening:
                first, opening = sig[0], False
            alike = sig[1:] == sig[:-1]
            new = np.append(True, ~(alike & (h[1:] == h[:-1])))  # repeats of a row go
            sig, h = sig[new], h[new]
            alike = sig[1:] == sig[:-1]
            tied = np.append(alike, False) | np.append(False, alike) | (sig == first)
            # The last row waits: the next batch may go on with its signature.
            if len(sig) > 1:
                keep = tied[:-1]
                yield out(sig[:-1][keep], h[:-1][keep])
            if tied[-1]:
                yield out(sig[-1:], h[-1:])
            kept_sig, kept_h = sig[-1:], h[-1:]
        if len(kept_sig):
            yield out(kept_sig, kept_h)

    rows = signed.select(F.explode("sigs").alias("sig"), "h1")
    ordered = rows.repartitionByRange("sig", "h1").sortWithinPartitions("sig", "h1")
    return ordered.mapInArrow(frugal(shared), "sig BIGINT, h1 BIGINT")


def likely(shared: DataFrame, needs: DataFrame) -> DataFrame:
    """The rows of shared signatures of sets that share enough of them to be linked. needs: h1,
    kind, least."""
    kind = F.col("sig").bitwiseAND(F.lit(int(KINDS))).cast("int").alias("kind")
    rows = shared.select("sig", "h1", kind)
    enough = rows.groupBy("h1", "kind").agg(F.count(F.lit(1)).alias("m")).join(needs, ["h1", "kind"]).filter("m >= least").select("h1", "kind")
    rows = rows.join(enough, ["h1", "kind"])
    ties = rows.groupBy("sig").agg(F.min("h1").alias("_a"), F.max("h1").alias("_b")).filter("_a != _b").select("sig")
    return rows.join(ties, "sig").select("sig", "h1")


def join_blocks(blocks: DataFrame, opt: JoinOptions, frequent: Broadcast, spanning: bool) -> DataFrame:
    """Links found by the trees of all blocks: u, v (names of sets), inter, total. blocks:
    block, i, j (chunks), h1, comp (component so far), chunk, text. Sets of the block's two
    chunks are compared with one another, and within a block of one chunk."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("h1").sort_values("h1")
        sets = [frequent.value.keys(shingle_set(t.encode(), opt.words)) for t in rows["text"]]
        side = rows["chunk"].tolist() if key[1] != key[2] else None
        found = list(tree_join(rows["h1"].tolist(), sets, opt, rows["comp"].tolist(), side, spanning))
        return pd.DataFrame(found, columns=["u", "v", "inter", "total"]).astype("int64")

    return blocks.groupBy("block", "i", "j").applyInPandas(run, "u BIGINT, v BIGINT, inter BIGINT, total BIGINT")


def _chunked(members: DataFrame, opt: JoinOptions, across: bool) -> DataFrame:
    """Cut the members (block, h1, n, ...) of each block into chunks of bounded size: adds chunk,
    i and j. across: every pair of chunks is a block too, so a member comes once for each chunk."""
    sizes = members.groupBy("block").agg(F.ceil(F.sum("n") / opt.block).cast("int").alias("q"))
    rows = members.join(sizes, "block").withColumn("chunk", F.pmod(F.xxhash64("h1"), F.col("q")).cast("int"))
    if not across:
        return rows.select("*", F.col("chunk").alias("i"), F.col("chunk").alias("j")).drop("q")
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    return rows.select("*", F.least("chunk", "_other").alias("i"), F.greatest("chunk", "_other").alias("j")).drop("q", "_other")


class _Candidates:
    """Classes that share signatures, with the text of one document of each."""

    def __init__(self, docs: DataFrame, opt: JoinOptions):
        spark = docs.sparkSession
        small_batches(spark)
        self.opt, self.docs = opt, docs
        # 2^22 marks at most.
        self.frequent = spark.sparkContext.broadcast(frequent_elements(docs, opt))
        signed = written(signed_sets(docs, opt, self.frequent), "signed-sets")
        self.signed = written(signed.select("doc_id", "n", "h1", "h2", "text_hash"), "sets")
        named = self.signed.filter("n > 0 AND doc_id IS NOT NULL")
        self.classes = written(
            named.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
            .select("h1", "h2", "n", "copies", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("text_hash")), "set-classes"
        )
        needs = signed.select("h1", F.explode(F.arrays_zip("kinds", "least")).alias("x")).groupBy("h1", F.col("x.kinds").alias("kind")).agg(F.min("x.least").alias("least"))
        needs = written(needs, "signature-needs")
        self.shared = written(shared_signatures(signed), "shared-signatures")
        drop_written(signed)
        for _ in range(opt.rounds):
            before, self.shared = self.shared, written(likely(self.shared, needs), "shared-signatures")
            drop_written(before)
        # For each round, the least of a class's shared signatures in an order of its own.
        picks = [F.min(F.xxhash64("sig", F.lit(r))).alias(f"pick{r}") for r in range(opt.rounds)]
        tied = self.shared.groupBy("h1").agg(F.count(F.lit(1)).alias("_sigs"), *picks)
        self.members = written(self.classes.join(tied, "h1").drop("_sigs"), "tied-classes")
        self.texts = written(self._texts(), "class-texts")

    def _texts(self) -> DataFrame:
        """h1 and text of one document of each class that shares a signature."""
        wanted = self.members.select("h1", F.col("first_id").alias("doc_id"), "text_hash")
        # A filter of fixed size (FILTER_BITS numbers at most) drops most texts before the shuffle.
        bit = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(FILTER_BITS)).alias("bit")
        rows = self.docs.filter("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("text_hash")).withColumn("bit", bit)
        found = rows.join(F.broadcast(wanted.select(bit).distinct()), "bit", "left_semi")
        once = found.groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"))
        return wanted.join(once, ["doc_id", "text_hash"]).select("h1", "text")

    def links(self, members: DataFrame, spanning: bool) -> DataFrame:
        rows = members.select("block", "i", "j", "h1", "comp", "chunk").join(self.texts, "h1")
        return join_blocks(rows, self.opt, self.frequent, spanning)

    def clusters(self, comps: DataFrame | None) -> DataFrame:
        """Classes in clusters that signatures tie together: block, h1, comp, n. comps: h1 and
        comp; signatures within one component tie nothing."""
        rows = self.members.select("h1", "n") if comps is None else self.members.select("h1", "n").join(comps, "h1", "left")
        comp = F.col("h1") if comps is None else F.coalesce("comp", "h1")
        rows = written(self.shared.join(rows.withColumn("comp", comp), "h1"), "signed-components")
        ties = rows.groupBy("sig").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b"), F.min("h1").alias("hub")).filter("_a != _b")
        tied = written(rows.join(ties.select("sig", "hub"), "sig").select("h1", "hub", "comp", "n").distinct(), "ties")
        found = written(components(tied.select(F.col("h1").alias("u"), F.col("hub").alias("v"))), "clusters")
        return tied.select("h1", "comp", "n").distinct().join(found, F.col("h1") == F.col("node")).select(F.col("component").alias("block"), "h1", "comp", "n")

    def spanning_links(self) -> DataFrame:
        """Links that connect what is linked: u, v."""
        links, comps = None, None
        for r in range(self.opt.rounds):
            rows = self.members.select("h1", "n", F.col(f"pick{r}").alias("block"))
            if comps is None:
                rows = rows.withColumn("comp", F.col("h1"))
            else:
                # One class speaks for those of its component that are in the block.
                rows = rows.join(comps, "h1", "left").withColumn("comp", F.coalesce("comp", "h1"))
                rows = rows.groupBy("block", "comp").agg(F.min(F.struct("h1", "n")).alias("_one")).select("block", "comp", "_one.h1", "_one.n")
            # Small groups are compared at once with their clusters, where each class comes once too.
            several = rows.groupBy("block").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") >= self.opt.crowd).select("block")
            rows = written(_chunked(rows.join(several, "block"), self.opt, False), "block-members")
            new = written(self.links(rows, True).select("u", "v"), "links")
            links = new if links is None else links.unionByName(new)
            comps = written(components(links).select(F.col("node").alias("h1"), F.col("component").alias("comp")), "components")
        rest = written(_chunked(self.clusters(comps), self.opt, True), "cluster-members")
        new = written(self.links(rest, True).select("u", "v"), "links")
        return new if links is None else links.unionByName(new)


def similar_pairs(docs: DataFrame, opt: JoinOptions = JoinOptions()) -> DataFrame:
    """Every link between classes of equal sets: u, v (smallest doc_id of each class), inter, total.
    Rows are treated as by similar_components."""
    found = _Candidates(docs, opt)
    links = found.links(written(_chunked(found.clusters(None), opt, True), "cluster-members"), False).distinct()
    first = lambda side: found.classes.select(F.col("h1").alias(side), F.col("first_id").alias(f"{side}_id"))
    return links.join(first("u"), "u").join(first("v"), "v").select(F.col("u_id").alias("u"), F.col("v_id").alias("v"), "inter", "total")


def similar_components(docs: DataFrame, opt: JoinOptions = JoinOptions()) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by
    links, itself included), text_hash (xxhash64 of the text, which tells rows that repeat a
    doc_id apart).

    Null, empty and blank texts have an empty set and are alone. A row without a doc_id
    cannot be named by others: it is alone too and its component_id is null. Rows that repeat
    a doc_id are one document if their texts link, and each is answered. Very long texts are
    read whole. An empty table gives no rows; other columns are ignored.
    """
    found = _Candidates(docs, opt)
    # Sets are named by their hash, as texts that do not link can share a doc_id.
    comps = written(components(found.spanning_links()), "set-components")
    linked = written(found.classes.join(comps, F.col("h1") == F.col("node")).select("h1", "h2", "copies", "first_id", "component"), "linked-classes")
    least = written(linked.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("_n")), "component-ids")
    single = found.classes.join(comps, F.col("h1") == F.col("node"), "left_anti").select("h1", "h2", "copies", F.col("first_id").alias("component_id"))
    named = split_join(linked, least, "component", "_n").select("h1", "h2", "copies", "component_id").unionByName(single)
    named = written(named.select(F.struct("h1", "h2").alias("set"), "copies", "component_id"), "named-classes")
    rows = found.signed.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2", "text_hash")
    answer = ("doc_id", "n_shingles", "component_id", "text_hash")
    some = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").withColumn("set", F.struct("h1", "h2"))
    linked = split_join(some, named, "set", "copies").select(*answer)
    alone = rows.filter("n_shingles = 0 OR doc_id IS NULL").withColumn("component_id", F.col("doc_id")).select(*answer)
    return linked.unionByName(alone)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), JoinOptions(words=3, least=90)).drop("text_hash")
