"""The prefix-tree join against all pairs, and the components against a plain union-find."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from drawlake.llm import ngram_join as J
from drawlake.llm.components import components


def gram_sets(text, n):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def components_by_hand(docs, opt):
    sets = {d: gram_sets(t, opt.words) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and opt.links(len(x & y), len(x | y)):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {d: find(d) for d in sets}, {d: len(s) for d, s in sets.items()}


def near_copies(seed, groups=6, size=9):
    r = random.Random(seed)
    docs = []
    for g in range(groups):
        base = [f"g{g}w{r.randrange(40)}" for _ in range(r.choice([3, 8, 30, 120, 400]))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, len(w) // 15])):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
            docs.append((len(docs), " ".join(w)))
    shared = " ".join(f"p{i}" for i in range(60))
    docs += [(len(docs) + i, shared + " " + " ".join(f"u{i}x{k}" for k in range(10 * i + 1))) for i in range(8)]
    return docs


@pytest.mark.parametrize(("seed", "opt"), [(1, J.JoinOptions(3, 90, 900)), (2, J.JoinOptions(5, 80)), (3, J.JoinOptions(1, 80, 200))])
def test_components_equal_all_pairs(spark, seed, opt):
    docs = near_copies(seed)
    want, sizes = components_by_hand(docs, opt)
    got = J.similar_components(spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), opt).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes


def test_every_link_between_classes(spark):
    opt = J.JoinOptions(3, 80, 900)
    docs = near_copies(5)
    first = {}
    for d, t in docs:
        first.setdefault(gram_sets(t, 3), d)
    want = {(a, b) for (x, a), (y, b) in itertools.permutations(first.items(), 2) if a < b and x and y and opt.links(len(x & y), len(x | y))}
    got = {tuple(sorted((r.u, r.v))) for r in J.similar_pairs(spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), opt).collect()}
    assert got == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=25), min_size=2, max_size=10), st.sampled_from([50, 60, 80, 90, 100]))
def test_tree_finds_every_link(sets, least):
    opt = J.JoinOptions(1, least)
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    got = {(min(a, b), max(a, b), i, u) for a, b, i, u in J.tree_join(list(range(len(sets))), arrays, opt, spanning=False)}
    want = {(a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a, b in itertools.combinations(range(len(sets)), 2) if opt.links(len(sets[a] & sets[b]), len(sets[a] | sets[b]))}
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 150), st.integers(0, 40), st.integers(0, 40), st.integers(0, 10**6), st.sampled_from([50, 65, 80, 90, 95]))
def test_linked_sets_share_a_signature(size, drop, add, seed, least):
    opt = J.JoinOptions(1, least)
    r = np.random.RandomState(seed)
    x = np.unique(r.randint(0, 2**63, size).astype(np.uint64))
    y = np.unique(np.concatenate([r.permutation(x)[min(drop, len(x) - 1) :], r.randint(0, 2**63, add).astype(np.uint64)]))
    inter = len(np.intersect1d(x, y))
    if opt.links(inter, len(x) + len(y) - inter) and not np.array_equal(x, y):
        c = J.SizeClasses(opt)
        for share in (0, 0.3, 0.9):
            f = J.Frequent(r.rand(1 << 16) < share)
            (a, kinds, least), (b, _, _) = J.signatures(f.keys(x), c), J.signatures(f.keys(y), c)
            both = set(a.tolist()) & set(b.tolist())
            assert both and any(sum(s & 63 == k for s in both) >= m for k, m in zip(kinds, least, strict=True))


def test_odd_rows(spark, odd_docs, no_docs):
    opt = J.JoinOptions(3, 90)
    rows = odd_docs.collect()
    named = [(r.doc_id, r.text) for r in rows if r.doc_id is not None]
    want, sizes = components_by_hand(dict(named).items(), opt)
    got = J.similar_components(odd_docs, opt).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        if r.doc_id is not None:
            assert r.n_shingles == sizes[r.doc_id]
    assert J.similar_components(no_docs, opt).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i + 1, i) for i in range(60)] + [(100, 200), (300, 200), (7, 7)]
    random.Random(0).shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u BIGINT, v BIGINT")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "u BIGINT, v BIGINT")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 20), min_size=1, max_size=14), min_size=2, max_size=14), st.lists(st.integers(0, 3), min_size=14, max_size=14), st.booleans(), st.sampled_from([40, 60, 80]))
def test_spanning_links_connect_what_is_linked(sets, groups, sided, least):
    opt = J.JoinOptions(1, least)
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    n = len(sets)
    side = [g % 2 for g in groups[:n]] if sided else None
    found = list(J.tree_join(list(range(n)), arrays, opt, groups[:n], side))
    pairs = [(a, b) for a, b in itertools.combinations(range(n), 2) if opt.links(len(sets[a] & sets[b]), len(sets[a] | sets[b])) and (not sided or side[a] != side[b])]
    assert {tuple(sorted(p[:2])) for p in found} <= set(pairs)

    def joined(edges):
        root = {i: min(j for j in range(n) if groups[j] == groups[i]) for i in range(n)}
        for a, b in edges:
            p, q = root[a], root[b]
            root = {i: min(p, q) if r in (p, q) else r for i, r in root.items()}
        return root

    assert joined([p[:2] for p in found]) == joined(pairs)


def test_options_below_three_quarters_lose_no_link(spark):
    words = [f"w{i}" for i in range(100)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:52])), (3, " ".join(words[:40])), (4, "x y z")]
    got = J.similar_components(spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), J.JoinOptions(1, 50)).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_large_groups_and_chains_in_small_blocks(spark):
    """One group of near copies far above the size of a block, and a chain whose ends do not link."""
    r = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    docs = []
    for _ in range(120):
        w = list(base)
        w[r.randrange(60)] = f"n{r.randrange(10**6)}"
        docs.append((len(docs), " ".join(w)))
    for i in range(40):  # each shares 95 of 100 words with the next
        docs.append((len(docs), " ".join(f"c{k}" for k in range(5 * i, 5 * i + 100))))
    opt = J.JoinOptions(1, 90, 700, crowd=3)
    want, _ = components_by_hand(docs, opt)
    got = J.similar_components(spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(5), opt).collect()
    assert {x.doc_id: x.component_id for x in got} == want
    assert len(set(want.values())) == 2
