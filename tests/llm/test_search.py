"""Lexical search, the k nearest neighbour join and k-means against plain Python loops."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from drawlake.llm import kmeans as K
from drawlake.llm import knn_join as J
from drawlake.llm import lexical_search as L
from pyspark.sql import functions as F

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
CAPITALS = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return [t.translate(CAPITALS) for t in TERM.findall(text or "")]


def ranked_by_hand(items, docs, top):
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n, total = len(held), sum(x for _, _, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c, size in held:
            m = 25 + 75 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("opt", [L.SearchOptions(), L.SearchOptions(top=3, segment=7, walk=20, block=2), L.SearchOptions(segment_postings=5, block_bytes=10)])
def test_search_equals_loops(spark, odd_docs, opt):
    rng = random.Random(1)
    words = [f"t{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 40, 300])))) for i in range(150)]
    docs += [(200, docs[3][1]), (5, docs[3][1]), (5, docs[3][1]), (None, docs[3][1]), (300, "Ünï-ÜNÏ x\x00y\x7fz [T1] t1_t2"), (301, "  \n"), (302, None)]
    docs += [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 30])))) for i in range(9)]
    items += [(20, "Word1 word2 w1x1 one ONE"), (20, "other text: one"), (21, None), (22, ""), (23, "nothinglikeit"), (None, "t1 t2 t2"), (24, docs[3][1]), (24, docs[3][1]), (25, "ünï z")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id BIGINT, text STRING, `score.rank` INT").repartition(3)
    q = spark.createDataFrame([(*x, "n") for x in items], "item_id BIGINT, text STRING, doc_id STRING")
    assert found(L.rank_documents(q, d, opt)) == ranked_by_hand(items, docs, opt.top)


def test_search_of_nothing(spark, no_docs, odd_docs):
    items = spark.createDataFrame([(1, "one two")], "item_id BIGINT, text STRING")
    assert L.rank_documents(items, no_docs).count() == 0
    assert L.rank_documents(items.limit(0), odd_docs).count() == 0


def test_long_texts_are_counted_whole(monkeypatch):
    text = ("Ab cd-" * 5000 + "é" * 70_000 + " ab").encode()
    whole = L.frequencies(text, {b"ab": 0, "é".encode() * 70_000: 1, b"cd": 2})
    monkeypatch.setattr(L, "SLICE", 1000)
    assert L.frequencies(text, {b"ab": 0, "é".encode() * 70_000: 1, b"cd": 2}) == whole == (10_002, {0: 5001, 2: 5000, 1: 1})


def test_treaps_are_search_trees_and_heaps():
    rng = np.random.default_rng(2)
    picked = np.flatnonzero(rng.random(20 * 300) < 0.3)
    term, doc = picked // 300, picked % 300
    impact = rng.integers(1, 5, len(picked))
    t = L.treaps(doc, term, impact, doc[::-1].copy(), 300, 21)
    seen = []

    def down(x, low, high, most):
        if x >= 0:
            assert low < t.doc[x] < high and t.impact[x] <= most
            seen.append(x)
            down(t.left[x], low, t.doc[x], t.impact[x])
            down(t.right[x], t.doc[x], high, t.impact[x])

    for r in t.root:
        down(r, -1, 300, 99)
    assert sorted(seen) == list(range(len(picked))) and t.root[20] == -1


def test_subtrees_are_pruned():
    """With a high score to reach, a walk looks at few documents only."""
    n = 4096
    doc = np.arange(n)
    impact = np.where(doc < 5, 1000, 1 + doc % 7)
    trees = L.treaps(doc, np.zeros(n, np.int64), impact, doc, n, 1)
    best, offered = L.Best(1, 5), []
    offer = best.offer
    best.offer = lambda item, score, *rest: (offered.append(len(item)), offer(item, score, *rest))
    L.walk(trees, np.array([0]), np.array([0]), np.array([1]), best, doc, np.zeros(n, bool))
    assert sorted(best.id) == [0, 1, 2, 3, 4] and sum(offered) < 60


def neighbours_by_hand(rows, is_query, top, scale=1024):
    def ints(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return tuple(math.floor(scale * x) for x in v)

    usable = [(i, v) for i, e in rows if (v := ints(e)) is not None]
    out = []
    for q, v in sorted({(i, v) for i, v in usable if i is not None and is_query(i)}):
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i is None, i or 0) for i, w in usable if i != q)
        out += [(q, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(scores[:top])]
    return sorted(out, key=repr)


def clustered(n, d, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    x = (centres[rng.integers(0, 6, n)] + 0.2 * rng.normal(size=(n, d))).astype(np.float32)
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


ODD_VECTORS = [(1000, None), (1001, [None, 1.0]), (1010, [float("nan"), 1.0]), (1020, [float("inf")]), (None, [3.0, -2.0, 1.0]), (1030, []), (1040, [1.0]), (1040, [2.0, 5.0]), (1040, [2.0, 5.0]), (1050, [0.0] * 12)]


@pytest.mark.parametrize("opt", [J.KnnOptions(), J.KnnOptions(top=3, pivots=8, sample=40, group=4, chunk_numbers=200), J.KnnOptions(sample=1, pivots=1)])
def test_neighbours_equal_loops(spark, opt):
    rows = clustered(240, 8) + [(2000 + i, clustered(240, 8)[7][1]) for i in range(30)] + ODD_VECTORS
    df = spark.createDataFrame([(i, v, None) for i, v in rows], "vec_id BIGINT, embedding ARRAY<FLOAT>, `group` STRING").repartition(4)
    got = J.top_products(df, F.col("vec_id") % 10 == 0, opt)
    assert sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()), key=repr) == neighbours_by_hand(rows, lambda i: i % 10 == 0, opt.top)


def test_far_cells_are_not_copied():
    """Vectors that the bounds rule out are not sent to a cell."""
    rng = np.random.default_rng(0)
    x = np.vstack([1000 * np.eye(4)[k] + rng.integers(-5, 6, (50, 4)) for k in range(4)]).astype(np.int64)
    reach = float((x * x).sum(axis=1).max()) + 1
    p = J.fit_pivots(x, reach, 4)
    far = p.distances(x[:50], data=False)
    assert len(set(far.argmin(axis=1))) == 1
    cell = far[0].argmin()
    kth = np.sort(x[:50] @ x.T, axis=1)[:, -10]
    bound = far[:, cell].max() + np.sqrt((x[:50] ** 2).sum(axis=1) + reach - 2 * kth).max()
    assert (p.distances(x, data=True)[:, cell] <= bound)[:50].all()


def test_groups_of_cells():
    at = np.arange(12.0).reshape(6, 2)
    first, parts, n = J.grouped(at, {0: 3, 1: 300, 2: 5, 4: 6, 5: 200}, 100)
    used = sorted(g for k in first for g in range(first[k], first[k] + parts[k]))
    assert set(used) == set(range(n)) and parts[1] == 3 and parts[5] == 2 and parts[0] == parts[2] == parts[4] == 1


def test_nothing_to_join(spark):
    none = spark.createDataFrame([], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    assert J.top_products(none, F.col("vec_id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(10, [1.0, 2.0])], none.schema)
    assert J.top_products(alone, F.col("vec_id") % 10 == 0).count() == 0
    with pytest.raises(Exception, match="too large"):
        J.top_products(spark.createDataFrame([(10, [1e9])], none.schema), F.lit(True)).collect()


def clusters_by_hand(rows, opt):
    kept = [(i, e, [math.floor(opt.scale * x) for x in e]) for i, e in rows if e is not None and len(e) == opt.dimensions and all(x is not None and math.isfinite(x) for x in e)]
    name = lambda i: hashlib.sha256(f"{opt.seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[: opt.clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(opt.rounds):
        own = [nearest(v)[1] for _, _, v in kept]
        for k in range(len(centroids)):
            members = [v for (_, _, v), o in zip(kept, own, strict=True) if o == k]
            if members:
                centroids[k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = [(i, *nearest(v)[::-1]) for i, _, v in kept]
    inertia = Counter()
    for _, k, d in out:
        inertia[k] += d
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), shas[k]) for i, k, d in out), key=repr)


@pytest.mark.parametrize("opt", [K.KMeansOptions(dimensions=8), K.KMeansOptions(clusters=5, rounds=6, dimensions=8, bounds=1, scale=3), K.KMeansOptions(clusters=9, dimensions=8, bounds=8, rounds=0), K.KMeansOptions(clusters=500, dimensions=8), K.KMeansOptions(clusters=6, dimensions=8, bounds=0)])
def test_clusters_equal_loops(spark, opt):
    rows = clustered(200, 8) + [(5000 + i, clustered(200, 8)[7][1]) for i in range(80)] + [(None, [0.5] * 8), (None, [0.5] * 8), (7, [-0.1] * 8), (7, [1e3] * 8)] + ODD_VECTORS
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id BIGINT, embedding ARRAY<DOUBLE>, cluster INT").repartition(4)
    got = K.cluster_vectors(df, opt).drop("looked").collect()
    assert sorted(map(tuple, got), key=repr) == clusters_by_hand(rows, opt)


def test_bounds_spare_distances(spark):
    """On separated clusters most vectors look at their own centroid at most, once it has settled."""
    df = spark.createDataFrame(clustered(600, 8), "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    looked = [r.looked for r in K.cluster_vectors(df, K.KMeansOptions(dimensions=8, clusters=6, rounds=8)).collect()]
    assert sum(looked) < 0.5 * 6 * len(looked)


def test_no_clusters(spark):
    none = spark.createDataFrame([], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    assert K.cluster_vectors(none).count() == 0
    assert K.cluster_vectors(spark.createDataFrame([(1, [1.0]), (2, None)], none.schema)).count() == 0
    with pytest.raises(Exception, match="too large"):
        K.cluster_vectors(spark.createDataFrame([(10, [1e9] * 64)], none.schema)).collect()
