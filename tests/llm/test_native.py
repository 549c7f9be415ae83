"""Exact dedup, secret scan, quality rules and mixing against plain Python versions."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from drawlake.llm import exact_dedup as X
from drawlake.llm import mixing as M
from drawlake.llm import quality_rules as Q
from drawlake.llm import secret_scan as S
from drawlake.llm.common import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_dedup_on_odd_rows(spark, odd_docs):
    rows = odd_docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r.text or "").encode()).hexdigest()].append(r)
    got = X.exact_dedup(odd_docs, X.DigestIndex(spark, shared_dir(spark, "i"), 8)).collect()
    assert len(got) == len(rows)
    for r in got:
        g = groups[r.text_sha256]
        best = min(g, key=lambda x: (-len(x.text or ""), x.doc_id is None, x.doc_id or 0))
        assert (r.keep_id, r.group_size) == (best.doc_id, len(g))
    for g in groups.values():
        kept = {r.doc_id for r in got if r.kept} & {r.doc_id for r in g}
        assert len(kept) == 1


def test_dedup_later_batches_lose(spark, odd_docs):
    index = X.DigestIndex(spark, shared_dir(spark, "i"), 8)
    first = X.exact_dedup(odd_docs.filter("doc_id = 2"), index, "one").collect()
    assert [r.kept for r in first] == [True]
    second = {r.doc_id: r for r in X.exact_dedup(odd_docs.filter("doc_id IN (1, 3)"), index, "two").collect()}
    assert (second[1].kept, second[1].keep_id, second[3].kept) == (False, 2, True)
    assert index.bucketed().count() == 2


def test_dedup_of_nothing(spark, no_docs):
    assert X.exact_dedup(no_docs, X.DigestIndex(spark, shared_dir(spark, "i"), 8)).count() == 0


def spans_by_hand(text):
    out = []
    for rank, (kind, (pattern, group, least)) in enumerate(S.RULES.items()):
        flags = re.I if kind == "assign" else 0
        p = pattern.replace("(?i:", "(?:")
        for m in re.finditer(p, text, flags | re.A):
            if len(m.group(group)) >= least:
                out.append((m.start(), rank, m.end(), kind))
    return [(k, a, b) for a, _, b, k in sorted(out)]


SECRETS = [
    "token=secret: abcdefgh", "secret: token: abcdefgh", "PassWord \"= 'hunter22'", "é token = abcdef", "AKIA" + "A" * 16 + "x", "AKIA" + "B" * 15,
    "a" * 23 + " " + "b" * 24, "key 0123456789abcdef0123456789ABCDEF", "api_key:abc", "apikey='abcdefg' token=abcdefg", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 15,
    "", "😀 passwd : xxxxxx 😀", "eyJhbGciOi.eyJzdWIiOiIx.abcdefghijklmnop",
]


def test_spans_equal_python(spark):
    df = spark.createDataFrame(list(enumerate(SECRETS)), "doc_id BIGINT, text STRING")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in S.find_secrets(df, S.BlobLedger(spark, shared_dir(spark, "l"))).collect()}
    assert got == {i: spans_by_hand(t) for i, t in enumerate(SECRETS)}


def test_ledger_scans_a_blob_once(spark, odd_docs):
    ledger = S.BlobLedger(spark, shared_dir(spark, "l"))
    one = S.find_secrets(odd_docs, ledger)
    assert one.count() == odd_docs.count()
    n = ledger.rows().select("blob", "rule_version").distinct().count()
    assert n == odd_docs.selectExpr("coalesce(text, '') AS t").distinct().count()
    written = ledger.rows().count()
    again = S.find_secrets(odd_docs.limit(3), ledger)
    assert again.count() == 3 and ledger.rows().count() == written
    S.find_secrets(odd_docs.filter("doc_id = 1"), ledger, "next").count()
    assert ledger.rows().count() == written + 1


def test_secrets_of_nothing(spark, no_docs):
    assert S.find_secrets(no_docs, S.BlobLedger(spark, shared_dir(spark, "l"))).count() == 0


def stats_by_hand(text):
    w = WORD.findall(text or "")
    c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {k + j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_statistics(spark, odd_docs):
    extra = [(90, "a b c d e f a b c d e g"), (91, "x " * 40), (92, "l 1\nl 1\n\nl 1 \nl 2"), (93, "#*$%&|<>"), (94, "a b c d e a b c d e")]
    df = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id BIGINT, text STRING"))
    got = Q.apply_rules(df, []).collect()
    assert len(got) == df.count()
    for r in got:
        want = stats_by_hand(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r.kept == (not r.base_failed)


def test_rules_recover_a_threshold():
    r = np.random.RandomState(0)
    x = {"symbols_per_word": r.rand(900), "mean_word": r.rand(900)}
    bad = x["symbols_per_word"] > 0.7
    rules = Q.learn_rules(x, bad, np.arange(900) % 3 != 0)
    assert rules and (Q.covers(rules[0], x) == bad).mean() > 0.98


def test_rules_keep_everything_without_signal():
    r = np.random.RandomState(1)
    assert Q.learn_rules({"n_words": r.rand(600)}, r.rand(600) < 0.1, np.arange(600) % 3 != 0) == []


def test_one_rule_equals_trying_every_condition():
    """Growing picks the condition of greatest gain of all; pruning drops what does not help."""
    r = np.random.RandomState(7)
    x = {k: r.randint(0, 12, 120).astype(float) for k in ("a", "b")}
    bad = (x["a"] > 7) & (x["b"] < 6) | (r.rand(120) < 0.05)

    def gain(hit, live):
        p, n = (live & bad).sum(), (live & ~bad).sum()
        p1, n1 = (hit & bad).sum(), (hit & ~bad).sum()
        return p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n))) if p1 else -1.0

    live, rule = np.ones(120, bool), Q.grow(x, bad)
    for c in rule:
        values = {k: np.unique(v[live]) for k, v in x.items()}
        tried = [gain(live & (v >= t if up else v < t), live) for k, v in x.items() for t in (values[k][1:] + values[k][:-1]) / 2 for up in (True, False)]
        assert np.isclose(gain(live & c.holds(x), live), max(tried)) and max(tried) > 0
        live = live & c.holds(x)
    assert len(rule) == 4 or not (live & ~bad).any() or max(tried) <= 1e-9 or rule

    def worth(part):
        hit = np.all([c.holds(x) for c in part], axis=0)
        return ((hit & bad).sum() - (hit & ~bad).sum()) / max(1, hit.sum()) if hit.any() else -1.0

    cut = Q.prune(rule, x, bad)
    assert cut == rule[: len(cut)] and all(worth(rule[:k]) >= worth(rule[: k + 1]) for k in range(len(cut), len(rule)))
    assert len(cut) == 1 or worth(cut[:-1]) < worth(cut)


def test_keep_good_keeps_columns(spark, odd_docs, no_docs):
    rule = [(Q.Condition("capitals_per_char", True, 0.5),)]
    kept = Q.keep_good(odd_docs, rule)
    assert kept.columns == odd_docs.columns
    judged = {(r.doc_id, r.text): r.kept for r in Q.apply_rules(odd_docs, rule).collect()}
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((r.doc_id, r.text) for r in odd_docs.collect() if judged[(r.doc_id, r.text)])
    assert (14, True) not in [(k[0], v) for k, v in judged.items()]
    assert Q.keep_good(no_docs, rule).count() == 0 and Q.fit_rules(no_docs, spark.createDataFrame([], "doc_id BIGINT, quality INT")) == []


def fill(sizes, weights):
    """Resharing the excess by weight until no source is above three times its size."""
    target, free, total = {}, set(sizes), float(sum(sizes.values()))
    while free:
        left = total - sum(target.values())
        w = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / w > 3 * sizes[s] + 1e-9]
        if not over:
            return target | {s: left * weights[s] / w for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            free.discard(s)
    return target


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 1000], [1, 1, 500, 2, 900, 3], [5], [0, 7]])
def test_targets(spark, sizes):
    rows = [(i, f"s{i:02d}", n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, source STRING, size BIGINT")
    got = {r.source: r.target for r in M.source_targets(df, M.MixOptions()).collect()}
    want = fill({s: n for _, s, n in rows}, {s: M.WEIGHTS[i % 3] for i, (_, s, _) in enumerate(rows)})
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}


def test_mix(spark, sf_dir, odd_docs, no_docs):
    for docs in (odd_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got = M.mix(docs).collect()
        assert len(got) == docs.count()
        by = defaultdict(list)
        for r in got:
            assert 0 <= r.taken <= 3 * r.size
            by[r.source].append(r)
        for g in by.values():
            assert abs(sum(r.taken for r in g) - g[0].target) <= 2 * M.MixOptions().block
            assert sum(r.size for r in g) == g[0].source_size
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, M.mix(docs).collect()), key=str)
    assert M.mix(no_docs).count() == 0


def test_schedule_turns_have_no_gaps(spark):
    targets = [{"rank": 1, "target": 51_200.0}, {"rank": 2, "target": 12_800.0}]
    by = defaultdict(list)
    for r in M.schedule(spark, targets, M.MixOptions(chunk=64)).collect():
        by[r["rank"]].append((r["slot"], r["turn"]))
    for got in by.values():
        assert [t for _, t in sorted(got)] == list(range(len(got)))
    assert abs(len(by[1]) - 200) <= 2


def test_dedup_of_extreme_ids_and_indexes_of_one_name(spark):
    rows = [(-(2**63), "a b"), (2**63 - 1, "ab"), (0, "a  b"), (None, "a   b"), (5, "c"), (-(2**63), "c")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    base = shared_dir(spark, "i")
    for folder in ("one", "two"):
        got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in X.exact_dedup(df, X.DigestIndex(spark, f"{base}/{folder}/idx", 4)).collect()}
        by_text = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert got[None, by_text("ab")] == (None, 4, True) and got[-(2**63), by_text("ab")] == (None, 4, False)
        assert got[-(2**63), by_text("c")] == (-(2**63), 2, True) and got[5, by_text("c")] == (-(2**63), 2, False)


def test_a_third_of_all_rows_are_copies(spark):
    rows = [(i, "the same text, token=abcdefgh" if i % 3 == 0 else f"text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = X.exact_dedup(df, X.DigestIndex(spark, shared_dir(spark, "i"), 4)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(i, 0 if i % 3 == 0 else i, 100 if i % 3 == 0 else 1) for i in range(300)]
    found = S.find_secrets(df, S.BlobLedger(spark, shared_dir(spark, "l"), 4)).collect()
    assert sorted((r.doc_id, len(r.spans)) for r in found) == [(i, int(i % 3 == 0)) for i in range(300)]


def test_findings_of_changed_rules_are_not_served(spark, monkeypatch):
    import importlib

    before = S.RULE_VERSION
    monkeypatch.setitem(S.RULES, "hex", ("[0-9a-f]+", 0, 30))
    again = S.hashlib.sha256(repr([sorted(S.RULES.items()), list(S.RULES), sorted(S.NEEDED.items())]).encode()).hexdigest()[:16]
    assert again != before and importlib.reload(S).RULE_VERSION == before


def test_texts_of_many_secrets_are_scanned_in_one_pass(spark):
    """Work grows little more than the matches of a text: 16,000 in a few seconds."""
    import time

    text = " ".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(16_000))
    df = spark.createDataFrame([(1, text), (2, "token=abcdef1 token=abc token=ghijkl2")], "doc_id BIGINT, text STRING")
    began = time.time()
    got = df.select("doc_id", S.scan(S.F.col("text")).alias("spans")).collect()
    assert time.time() - began < 8
    for r, t in zip(sorted(got), (text, "token=abcdef1 token=abc token=ghijkl2"), strict=True):
        assert [tuple(s) for s in r.spans] == spans_by_hand(t)
