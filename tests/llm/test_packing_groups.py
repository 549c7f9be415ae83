"""Packing a table of many groups."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from drawlake.llm import packing as K


@pytest.mark.parametrize("documents", [None, 12])
def test_groups_share_what_they_leave(spark, documents):
    lengths = np.minimum(np.random.RandomState(3).lognormal(5.5, 1.2, 3000).astype(int) + 1, 4096)
    rows = [(i // 2 if i % 50 else None, i % 2, 0, int(n), i) for i, n in enumerate(lengths)]
    opt = K.PackOptions(group=64, documents=documents)
    got = K.pack(spark.createDataFrame(rows, K.PIECES), opt).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(rows)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0] + [n for _, n in s])[:-1].tolist()
        assert sum(n for _, n in s) <= 4096 and (documents is None or len(s) <= documents)
    one, _ = K.best_fit(lengths, opt)
    assert len(by) <= 1.01 * (one.max() + 1) + 1


def test_pieces_that_never_share_end(spark):
    rows = [(i, 0, 0, 2500, i) for i in range(400)]
    got = K.pack(spark.createDataFrame(rows, K.PIECES), K.PackOptions(group=64)).collect()
    assert len({r.sequence_id for r in got}) == len(got) == 400


def test_large_ids_stay_exact_beside_nulls(spark):
    ids = [(1 << 53) + 1, (1 << 53) + 3, None, (1 << 63) - 1, -(1 << 63), None]
    rows = [(d, 0, 0, 10 + i, i) for i, d in enumerate(ids)]
    for opt in (K.PackOptions(), K.PackOptions(group=2)):
        got = K.pack(spark.createDataFrame(rows, K.PIECES), opt).collect()
        assert Counter(r.doc_id for r in got) == Counter(ids)
