"""Each stage of the pipeline against what it should decide."""

import corpus_pipeline as P
import pytest

from drawlake.llm import ngram_join as J
from drawlake.llm import quality_rules as Q
from tests.llm.test_ngram_join import components_by_hand


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_rules_stage_keeps_good_documents(spark, sf_dir, docs):
    kept = {r.doc_id for r in P.quality_rules(spark, docs, sf_dir).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    failed = {r.doc_id for r in Q.apply_rules(docs, []).collect() if r.base_failed}
    good = {d for d, q in labels.items() if q == 1} - failed
    assert not kept & failed and len(good & kept) >= 0.97 * len(good)


def test_exact_stage(spark, sf_dir, odd_docs, no_docs):
    got = P.drop_exact_copies(spark, odd_docs, sf_dir)
    assert got.columns == odd_docs.columns
    plain = lambda t: "".join((t or "").split(" ")).replace("\n", "").replace("\t", "")
    kept = [plain(r.text) for r in got.collect()]
    assert len(kept) == len(set(kept)) and set(kept) == {plain(r.text) for r in odd_docs.collect()}
    assert P.drop_exact_copies(spark, no_docs, sf_dir).count() == 0


def test_near_stage(spark, sf_dir, odd_docs):
    got = P.drop_near_copies(spark, odd_docs, sf_dir)
    rows = odd_docs.collect()
    want, _ = components_by_hand(dict((r.doc_id, r.text) for r in rows if r.doc_id is not None).items(), J.JoinOptions(5, 80))
    assert got.columns == odd_docs.columns
    assert {r.doc_id for r in got.collect()} == {d for d, c in want.items() if d == c} | {None}


def test_mix_stage(spark, sf_dir, docs, odd_docs):
    got = P.mix_sources(spark, docs, sf_dir)
    assert got.columns == docs.columns
    n = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert max(n.values()) <= 3 and abs(got.count() - docs.count()) < 0.25 * docs.count()
    assert P.mix_sources(spark, odd_docs, sf_dir).columns == odd_docs.columns


def test_stages_hold_the_contract():
    assert [n for n, _ in P.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_run(spark, sf_dir):
    got = P.run(spark, sf_dir)
    assert got.columns[:2] == ["doc_id", "piece"] and got.count() > 100
    assert got.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").count() == 0


def rules_by_hand(text, rules):
    """The verdict of a decision list from statistics counted in plain Python."""
    import re

    from tests.llm.test_native import stats_by_hand

    t = text or ""
    n, chars, symbols, dup_lines, repeated = stats_by_hand(t)
    if n < 10 or 100 * repeated > 20 * n:
        return False
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in t.split("\n"))
    x = {
        "n_words": n, "mean_word": chars / max(n, 1), "symbols_per_word": symbols / max(n, 1), "capitals_per_char": len(re.findall("[A-Z]", t)) / max(chars, 1),
        "calls_per_word": len(re.findall("[!?]", t)) / max(n, 1), "dup_lines_share": dup_lines / max(lines, 1), "repeat_share": repeated / max(n, 1),
    }
    return not any(all((x[c.feature] >= c.threshold) == c.above for c in rule) for rule in rules)


def test_rules_stage_equals_plain_python(spark, sf_dir, docs, odd_docs, no_docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for rows in (docs, odd_docs):
        rules = Q.fit_rules(rows, labels)
        got = sorted(((r.doc_id, r.text) for r in P.quality_rules(spark, rows, sf_dir).collect()), key=str)
        assert got == sorted(((r.doc_id, r.text) for r in rows.collect() if rules_by_hand(r.text, rules)), key=str)
    assert P.quality_rules(spark, odd_docs, sf_dir).columns == odd_docs.columns
    assert P.quality_rules(spark, no_docs, sf_dir).count() == 0


def pieces_by_hand(rows):
    """Whole texts through the tokenizer library, cut after 4096 ids."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for r in rows:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            out.append((r.doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=str)


def assert_packed(got, rows):
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == pieces_by_hand(rows)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096


def test_packing_stage_equals_the_library(spark, sf_dir, odd_docs, no_docs):
    assert_packed(P.pack_sequences(spark, odd_docs, sf_dir).collect(), odd_docs.collect())
    assert P.pack_sequences(spark, no_docs, sf_dir).count() == 0


def test_every_stage_takes_an_empty_table(spark, sf_dir, no_docs):
    for _, stage in P.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0


def test_stages_take_odd_rows_one_after_the_other(spark, sf_dir, odd_docs):
    now = odd_docs
    for _, stage in P.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.columns == odd_docs.columns


def test_mix_stage_counts_rows_without_an_id_apart(spark, sf_dir):
    rows = [(None, "a b c d e f g h", "s1"), (None, "", "s1"), (None, "i j k l m n o p", "s2"), (7, "q r s t u v w x", "s2"), (None, "x y z", None)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    got = [tuple(r) for r in P.mix_sources(spark, df, sf_dir).collect()]
    assert (None, "", "s1") not in got and all(got.count(r) <= 3 for r in rows) and set(got) <= set(rows)


def test_run_equals_plain_stages(spark, sf_dir, docs):
    """Rules, exact and near copies by hand, the mix by its own table, pieces by the library."""
    from collections import Counter

    from drawlake.llm import mixing as M

    rules = Q.fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = [r for r in docs.collect() if rules_by_hand(r.text, rules)]
    best = {}
    for r in sorted(good, key=lambda r: (-len(r.text), r.doc_id)):
        best.setdefault("".join(r.text.split(" ")).translate({i: None for i in range(9, 14)}), r)
    component, _ = components_by_hand([(r.doc_id, r.text) for r in best.values()], J.JoinOptions(5, 80))
    left = [r for r in best.values() if component[r.doc_id] == r.doc_id]
    table = spark.createDataFrame(left, docs.schema)
    rounds = Counter()
    sizes = {}
    for r in M.mixture(table).collect():
        rounds[r.doc_id, r.round] += r.end - r.start
        sizes[r.doc_id] = r.size
    copies = Counter(d for (d, _), n in rounds.items() if 2 * n >= sizes[d])
    mixed = [r for r in left for _ in range(copies[r.doc_id])]
    assert_packed(P.run(spark, sf_dir).collect(), mixed)


def test_stages_take_columns_of_any_name(spark, sf_dir):
    names = ["a.b", "_row", "row", "kept", "_kept", "n_words", "size", "key", "at"]
    texts = [" ".join(f"word{i}x{k}" for k in range(40)) for i in range(6)]
    docs = spark.createDataFrame([(i, t, "s", *([i] * len(names))) for i, t in enumerate([*texts, texts[0]])], ["doc_id", "text", "source", *names])
    docs = docs.withColumn("doc_id", docs.doc_id.cast("bigint"))
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and all(r["a.b"] == r["at"] for r in out.collect())
