"""The mix itself against a plain join of slots and blocks."""

import hashlib
from collections import defaultdict

import corpus_pipeline as P
import pytest

from drawlake.llm import mixing as M

OPT = M.MixOptions(block=16)


@pytest.fixture(scope="module")
def few_docs(spark):
    sizes = [(f"s{i % 3}", 1 + i * 7 % 61) for i in range(90)] + [("s0", 0), (None, 300), ("tiny", 5)]
    return spark.createDataFrame([(i, s, " ".join(f"d{i}w{k}" for k in range(n))) for i, (s, n) in enumerate(sizes)], "doc_id BIGINT, source STRING, text STRING")


def tapes(rows):
    """Words of each source, documents in the order of the tape."""
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: hashlib.md5(str(r.doc_id).encode()).hexdigest()):
        out[r.source] += r.text.split()
    return out


def test_mixture_joins_slots_to_blocks(spark, few_docs):
    rows = few_docs.collect()
    tape, words = tapes(rows), {r.doc_id: r.text.split() for r in rows}
    targets = {r["rank"]: r for r in M.source_targets(M.mix(few_docs, OPT).select("source", "size"), OPT).collect()}
    want = {}
    for s in M.schedule(spark, list(targets.values()), OPT).collect():
        t, at = targets[s["rank"]], s["turn"] * OPT.block
        part = [tape[t.source][k % t.source_size] for k in range(at, min(at + OPT.block, int(t.target)))]
        if part:
            want[s["slot"]] = (t.source, s["turn"], part)
    got = defaultdict(list)
    for r in sorted(M.mixture(few_docs, OPT).collect(), key=lambda r: (r.slot, r.offset)):
        assert r.offset == sum(len(p) for _, _, p in got[r.slot])
        got[r.slot].append((r.source, r.block, words[r.doc_id][r.start : r.end]))
    assert {k: (g[0][0], g[0][1], sum((p for _, _, p in g), [])) for k, g in got.items()} == want
    assert all(len({(s, b) for s, b, _ in g}) == 1 for g in got.values())


def test_taken_comes_from_the_mixture(few_docs):
    taken = defaultdict(int)
    for r in M.mixture(few_docs, OPT).collect():
        taken[r.doc_id] += r.end - r.start
    assert {r.doc_id: r.taken for r in M.mix(few_docs, OPT).collect()} == {r.doc_id: taken[r.doc_id] for r in few_docs.collect()}


def test_mix_stage_follows_the_mix(spark, few_docs, sf_dir):
    rounds = defaultdict(lambda: [0, (1 << 60, 0)])
    for r in M.mixture(few_docs).collect():
        x = rounds[r.doc_id, r.round, r.size]
        rounds[r.doc_id, r.round, r.size] = [x[0] + r.end - r.start, min(x[1], (r.slot, r.offset))]
    want = [d for (d, _, size), (n, _) in sorted(rounds.items(), key=lambda x: x[1][1]) if 2 * n >= size]
    assert [r.doc_id for r in P.mix_sources(spark, few_docs, sf_dir).collect()] == want


def test_no_source_falls_short(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by = defaultdict(int)
    for r in M.mix(docs).collect():
        by[r.source, int(r.target)] += r.taken
    assert by and all(taken == target for (_, target), taken in by.items())


def test_missing_turns_are_made_up(spark):
    targets = [{"rank": i, "target": t} for i, t in enumerate([5e6, 160.0, 80.0, 2e6, 700.0, 1437.0] * 5, 1)]
    turns = defaultdict(set)
    slots = M.schedule(spark, targets, M.MixOptions()).collect()
    for r in slots:
        turns[r["rank"]].add(r["turn"])
    assert len({r["slot"] for r in slots}) == len(slots) == sum(map(len, turns.values()))
    assert all(set(range(-(-int(t["target"]) // 256))) <= turns[t["rank"]] for t in targets)


def test_rows_of_one_id_spread_over_the_tape(spark):
    """A third of all rows without an id, a third with one id, equal rows among them."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "s", f"a{i % 40} b c d"[: 4 + i % 9]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, source STRING, text STRING")
    opt = M.MixOptions(block=16, chunk=50)
    sized = df.select("doc_id", "source", M.F.size(M.words_of(M.F.col("text"))).cast("bigint").alias("size"), M.F.xxhash64("text").alias("_text"))
    keyed = M._order_keys(sized, opt).collect()
    assert len(keyed) == 600 and len({r.key for r in keyed}) == 600
    placed = M.tape(sized, M.source_targets(sized, opt), opt).collect()
    at = 0
    for r in sorted(placed, key=lambda r: (r["at"], r["size"] > 0)):
        assert r["at"] == at
        at += r["size"]
    once = sorted(((r.doc_id, r["size"], r.taken) for r in M.mix(df, opt).collect()), key=str)
    assert once == sorted(((r.doc_id, r["size"], r.taken) for r in M.mix(df.repartition(7), opt).collect()), key=str)
    assert len(once) == 600 and all(t <= 3 * n for _, n, t in once)
