"""Token ids, token files and packing: equality with the library and exact round trips."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from drawlake.llm import packing as K
from drawlake.llm import token_files as T
from drawlake.llm.common import shared_dir
from drawlake.llm.tokens import PieceEncoder

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
ENCODERS = {f: PieceEncoder(public_tokenizers.path(f)) for f in FILES}
ODD = [
    "", " ", "  a  b\n\nc ", "it's o'clock!! don't, 'tis", "x \n\ny   z", "<|endoftext|> a<|endoftext|>  b <|ENDOFTEXT|>", "Ünïcode… ΣΑΣ Σ, é! É", "a\x1cb \x1d c",
    "foo, bar.. *** a|b|c --- 12.5% 2024!!\t\t tab", "x" * 600 + " y, y, y,", "😀😀! hi😀, 中文。字,", "a  　b \n\nc", "İstanbul İ, é, ́x", "trail \n", "ﬁ ǅ ß",
]


def library(file, text):
    return ENCODERS[file].tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("file", FILES)
def test_odd_texts(file):
    e = ENCODERS[file]
    got = e.encode_many([t.encode() for t in ODD], 64)
    assert [np.frombuffer(g, e.dtype).tolist() for g in got] == [library(file, t) for t in ODD]


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab éΣ'’.,!<|>\n\t 0½̈ İ中")), max_size=40))
def test_any_text(file, text):
    e = ENCODERS[file]
    assert np.frombuffer(e.encode(text.encode()), e.dtype).tolist() == library(file, text)


def test_small_cache_changes_nothing():
    e = PieceEncoder(public_tokenizers.path(FILES[0]), most_cached=5)
    texts = [f"word{i} and more, {i}" for i in range(50)]
    assert [np.frombuffer(g, e.dtype).tolist() for g in e.encode_many([t.encode() for t in texts], 40)] == [library(FILES[0], t) for t in texts]


@given(st.lists(st.integers(0, 5000), max_size=400))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values):
    values = sorted(values)
    x = T.EliasFano.encode(np.array(values, np.uint64))
    assert x.decode().tolist() == values and [x[i] for i in range(len(values))] == values


def test_elias_fano_is_small():
    bounds = np.cumsum(np.random.RandomState(0).randint(1, 1000, 10_000))
    x = T.EliasFano.encode(bounds)
    assert len(x.lows) + len(x.highs) + x.directory.nbytes < 10_000 * 12 / 8 + 500


def test_token_files(spark, odd_docs, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    shards = T.write_token_shards(odd_docs, path, 2, shared_dir(spark, "t"), 2000)
    rows = sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    got = sorted(T.read_token_shards(shards).collect(), key=lambda r: r.start)
    at = 0
    for r, g in zip(rows, got, strict=True):
        ids = np.array(library(FILES[1], r.text or "") + [2], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    shard = T.Shard(bytes(shards.orderBy("part", "seq").first()["payload"]))
    assert shard.tokens(0).tolist() == library(FILES[1], rows[0].text or "") + [2]
    assert T.read_token_shards(T.write_token_shards(no_docs, path, 2, shared_dir(spark, "t"))).count() == 0


def test_pieces_and_packing(spark, odd_docs, no_docs):
    path, opt = public_tokenizers.path("word_bpe_49k.json"), K.PackOptions()
    got = K.pack(K.token_pieces(odd_docs, path, 1, opt.tokens), opt).collect()
    want = []
    for r in odd_docs.collect():
        ids = np.array(library(FILES[0], r.text or "") + [1], "<u4")
        want += [(r.doc_id, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted([tuple(g)[:5] for g in got], key=str) == sorted(want, key=str)
    for _, g in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in g:
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert K.pack(K.token_pieces(no_docs, path, 1, opt.tokens), opt).count() == 0


def fewest(lengths, cap):
    """Optimal number of bins by search."""
    best = [len(lengths)]

    def go(rest, bins):
        if len(bins) >= best[0]:
            return
        if not rest:
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] >= rest[0]:
                go(rest[1:], bins[:i] + [bins[i] - rest[0]] + bins[i + 1 :])
        go(rest[1:], [*bins, cap - rest[0]])

    go(sorted(lengths, reverse=True), [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9), st.sampled_from(["norm", "dot"]))
def test_best_fit(lengths, rule):
    opt = K.PackOptions(tokens=20, documents=4, attention=300, rule=rule)
    seq, offset = K.best_fit(np.array(lengths), opt)
    for s in set(seq):
        mine = np.array(lengths)[seq == s]
        assert mine.sum() <= 20 and len(mine) <= 4 and ((mine**2).sum() <= 300 or len(mine) == 1)
        order = np.argsort(offset[seq == s])
        assert offset[seq == s][order].tolist() == np.cumsum([0, *mine[order]])[:-1].tolist()
    plain, _ = K.best_fit(np.array(lengths), K.PackOptions(tokens=20, rule=rule))
    assert plain.max() + 1 <= fewest(lengths, 20) * 11 / 9 + 1


def test_what_is_left_of_every_capacity_chooses_the_bin():
    """With no weight on documents and attention cost, other sequences take some pieces, and
    tight limits on them take more sequences."""
    moved, more = 0, 0
    for seed in range(40):
        lengths = np.random.RandomState(seed).randint(1, 40, 60)
        all_three, _ = K.best_fit(lengths, K.PackOptions(tokens=100, documents=20, attention=5000, weights=(1.0, 0.5, 0.5)))
        only_tokens, _ = K.best_fit(lengths, K.PackOptions(tokens=100, documents=20, attention=5000, weights=(1.0, 0.0, 0.0)))
        tight, _ = K.best_fit(lengths, K.PackOptions(tokens=100, documents=4, attention=3000))
        moved += not np.array_equal(all_three, only_tokens)
        more += tight.max() > only_tokens.max()
        for s in range(tight.max() + 1):
            assert (tight == s).sum() <= 4 and (lengths[tight == s] ** 2).sum() <= 3000 and lengths[tight == s].sum() <= 100
    assert moved > 10 and more > 10


def test_rows_that_repeat_spread_over_groups(spark):
    rows = [(None, 0, 0, 1, 5)] * 500 + [(i, 0, 0, 30, i) for i in range(100)]
    got = K.pack(spark.createDataFrame(rows, K.PIECES).repartition(3), K.PackOptions(tokens=100, documents=100, attention=10_000, group=64)).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    assert len(got) == 600
    for g in by.values():
        at = 0
        for r in sorted(g, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 100


def test_select_of_many_equals_select_of_one():
    r = np.random.RandomState(2)
    for top in (5, 300, 10**6, 10**12):
        values = np.sort(r.randint(0, top, 1000)).astype(np.uint64)
        x = T.EliasFano.encode(values)
        places = r.randint(0, 1000, 400)
        assert x[places].tolist() == values[places].tolist() == [x[int(i)] for i in places]


def test_readers_need_the_select_directory(spark, odd_docs):
    """The reader finds documents by the directory: a wrong one gives wrong places."""
    import public_tokenizers

    path = shared_dir(spark, "shards")
    shards = T.write_token_shards(odd_docs, public_tokenizers.path("byte_bpe_50k.json"), 2, path)
    shard = T.Shard(shards.first().payload)
    n = len(shard.doc_ids)
    right = shard.bounds[np.arange(n + 1)].tolist()
    assert right == shard.bounds.decode().tolist()
    shard.bounds.directory = shard.bounds.directory + 1
    with pytest.raises((IndexError, AssertionError)):
        assert shard.bounds[np.arange(n + 1)].tolist() == right
