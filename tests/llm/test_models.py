"""Language mixtures, toxicity and line quality: brute force, gradients and held-out accuracy."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from drawlake.llm import language_id as L
from drawlake.llm import line_crf as C
from drawlake.llm import toxicity as T
from drawlake.llm.common import fold, table

D = "/root/testdata/sf0.01"


def test_folds(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in (0, 1, 17, 123456789)] + [(None,)], "doc_id BIGINT").select("doc_id", fold(F.col("doc_id"), 5).alias("f"))
    for r in df.collect():
        assert r.f == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5)


def test_language_held_out(spark):
    got = L.op10_language_id(spark, D).join(table(spark, D, "documents").select("doc_id", "lang", "n_chars"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 150 and (got.lang_pred == got.lang).mean() > 0.99 and got.score.between(0, 1).all()


def model():
    r = np.random.RandomState(0)
    p = r.dirichlet(np.full(L.BUCKETS, 0.05), 3).T + 1e-12
    return L.LanguageModel(("aa", "bb", "cc"), np.log(p / p.sum(axis=0)).astype(np.float32))


def test_mixture_does_not_depend_on_the_batch():
    texts = [b"some words here", b"", b"other words", b"  \n ", b"last one of them is here now"]
    m = model()
    together = L.proportions(texts, m)
    for t, p in zip(texts, together, strict=True):
        assert np.allclose(L.proportions([t], m)[0], p, atol=1e-4)
    assert not together[1].any() and not together[3].any()


def test_mixture_of_two_languages(spark):
    docs = table(spark, D, "documents").filter("n_chars > 600")
    m = L.fit_languages(docs, F.lit(True))
    pick = lambda lang: docs.filter(F.col("lang") == lang).orderBy("doc_id").first()["text"][:600]
    both = (pick("en") + " " + pick("de")).encode()
    p = dict(zip(m.languages, L.proportions([both], m)[0], strict=True))
    assert p["en"] > 0.25 and p["de"] > 0.25 and p["en"] + p["de"] > 0.95


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    got = L.identify(odd_docs, model()).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        if r.doc_id in (4, 5, 6):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert L.identify(no_docs, model()).count() == 0
    none = L.fit_languages(no_docs, F.lit(True))
    assert {r.lang_pred for r in L.identify(odd_docs, none).collect()} == {"und"}


def test_no_letters_is_und(spark):
    df = spark.createDataFrame([(1, "123 456 ..."), (2, "中文"), (3, "12 é")], "doc_id BIGINT, text STRING")
    got = {r.doc_id: r.lang_pred for r in L.identify(df, model()).collect()}
    assert got[1] == "und" and got[2] != "und" and got[3] != "und"


def test_noisy_or_by_hand():
    m = T.ToxicityModel({b"idiot": 4.0, b"^idio": 1.0}, -4.0)
    text = "Fine one. You idiot! Idiots, all é.\n\nEnd".encode()
    score, spots = T.score_text(text, m, 0.5, T.WordScores(m.weights))
    z = [-4.0, 1.0, -3.0, -4.0]
    assert abs(score - (1 - np.prod([1 - 1 / (1 + np.exp(-v)) for v in z]))) < 1e-9
    assert [(a, b) for a, b, _ in spots] == [(10, 19)] and text.decode()[10:19] == "You idiot"


def test_toxicity_held_out(spark):
    got = T.op4_toxicity(spark, "/root/testdata/sf0.1").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").filter("held_out").toPandas()
    bad, fine = got[got.toxic == 1], got[got.toxic == 0]
    assert bad.predicted.mean() > 0.7 and fine.predicted.mean() < 0.01
    assert (np.subtract.outer(bad.score.to_numpy(), fine.score.to_numpy()) > 0).mean() > 0.95


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    m = T.ToxicityModel({b"other": 9.0}, -5.0)
    got = {r.doc_id: r.score for r in T.toxicity(odd_docs, m).collect()}
    assert got[4] == got[5] == got[6] == 0.0 and got[3] > 0.9 and got[1] < 0.1
    assert T.toxicity(no_docs, m).count() == 0
    assert T.fit_toxicity(no_docs, spark.createDataFrame([], "doc_id BIGINT, toxic INT")).weights == {}


def test_forward_backward_equals_enumeration():
    r = np.random.RandomState(3)
    owner = np.array([0, 0, 0, 1, 2, 2])
    node, trans = r.randn(6, 2), r.randn(2, 2)
    first, count = C._order(owner)
    marginal, pairs, z = C.forward_backward(node, trans, first, count)
    want_pairs = np.zeros((2, 2))
    for d in range(3):
        lines = np.flatnonzero(owner == d)
        weight = {}
        for y in itertools.product((0, 1), repeat=len(lines)):
            weight[y] = np.exp(sum(node[i, k] for i, k in zip(lines, y, strict=True)) + sum(trans[a, b] for a, b in itertools.pairwise(y)))
        total = sum(weight.values())
        assert np.isclose(np.log(total), z[list(first).index(lines[0])])
        for at, i in enumerate(lines):
            assert np.isclose(np.exp(marginal[i, 1]), sum(v for y, v in weight.items() if y[at]) / total)
        for y, v in weight.items():
            for a, b in itertools.pairwise(y):
                want_pairs[a, b] += v / total
    assert np.allclose(pairs, want_pairs)


def test_line_scores_do_not_depend_on_the_batch():
    r = np.random.RandomState(0)
    m = C.CrfModel(np.zeros(C.N_FEATURES), np.ones(C.N_FEATURES), r.randn(C.N_FEATURES), r.randn(2, 2))
    texts = [b"One line.\nTwo ***\n\nThree", b"", b"A\nA\nB", b"\n \n"]
    p, n, owner = C.line_marginals(texts, m)
    assert owner.tolist() == [0, 0, 0, 2, 2, 2]
    at = 0
    for t in texts:
        alone, _, _ = C.line_marginals([t], m)
        assert np.allclose(alone, p[at : at + len(alone)])
        at += len(alone)


def test_quality_held_out(spark):
    got = C.op5_line_quality(spark, D).join(table(spark, D, "labels"), "doc_id").filter("held_out").toPandas()
    assert got[got.quality == 1].predicted.mean() > 0.95 and got[got.quality == 0].predicted.mean() < 0.2


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    m = C.CrfModel(np.zeros(C.N_FEATURES), np.ones(C.N_FEATURES), np.zeros(C.N_FEATURES), np.zeros((2, 2)))
    got = {r.doc_id: r for r in C.quality(odd_docs, m).collect()}
    assert got[4].score == got[5].score == got[6].score == 0.0 and abs(got[1].score - 0.5) < 1e-9 and len(got[15].lines) == 2
    assert C.quality(no_docs, m).count() == 0
    none = C.fit_quality(no_docs, spark.createDataFrame([], "doc_id BIGINT, quality INT"))
    assert none is None and {r.score for r in C.quality(odd_docs, none).collect()} == {0.0}


def numeric(f, p, step=1e-5):
    return np.array([(f(p + step * e) - f(p - step * e)) / (2 * step) for e in np.eye(len(p))])


def test_noisy_or_gradient_and_loss_by_hand():
    r = np.random.RandomState(1)
    docs = [([[0, 1], [2]], 1, 1), ([[1]], 0, 0), ([], 2, 0), ([[0, 2], [0], [1, 2]], 0, 1)]  # sentences' words, other sentences, label
    y, bare = np.array([d[2] for d in docs], float), np.array([d[1] for d in docs], float)
    doc = np.array([i for i, d in enumerate(docs) for _ in d[0]])
    flat = [s for d in docs for s in d[0]]
    sent, word = np.array([i for i, s in enumerate(flat) for _ in s]), np.array([w for s in flat for w in s])

    def by_hand(p):
        total = 0.0
        for sentences, others, label in docs:
            none = 1.0
            for s in [*sentences, *[[]] * others]:
                none *= 1 - 1 / (1 + np.exp(-(p[-1] + sum(p[w] for w in s))))
            total -= np.log(1 - none if label else none)
        return total / len(docs) + 0.05 * (p[:-1] ** 2).sum()

    p = r.randn(4)
    loss, g = T.noisy_or_loss(p, y, bare, doc, sent, word, 0.1)
    assert np.isclose(loss, by_hand(p)) and np.allclose(g, numeric(by_hand, p), atol=1e-6)


def test_evidence_gradient_equals_enumeration():
    r = np.random.RandomState(4)
    owner, good = np.array([0, 0, 0, 1, 2, 2]), np.array([1, 1, 1, 0, 0, 0.0])
    x, p, stray = r.randn(6, 3), r.randn(7), 0.2
    first, count = C._order(owner)

    def by_hand(p):
        trans, total = p[-4:].reshape(2, 2), 0.0
        for d in range(3):
            lines = np.flatnonzero(owner == d)
            held = free = 0.0
            for y in itertools.product((0, 1), repeat=len(lines)):
                w = np.exp(sum(k * (x[i] @ p[:-4]) for i, k in zip(lines, y, strict=True)) + sum(trans[a, b] for a, b in itertools.pairwise(y)))
                free += w
                held += w * np.prod([1 - stray if k == good[i] else stray for i, k in zip(lines, y, strict=True)])
            total += np.log(held / free)
        return total

    value, g = C.evidence_gradient(x, first, count, good, p, stray)
    assert np.isclose(value, by_hand(p)) and np.allclose(g, numeric(by_hand, p), atol=1e-5)


def test_lines_may_differ_from_their_document():
    """Bad documents hold some lines like those of good ones: these are found good, and the
    chain learns that labels change."""
    r = np.random.RandomState(5)
    x, owner, good, truth = [], [], [], []
    for d in range(200):
        bad = d % 2
        for k in range(10):
            fine = not bad or k < 2
            x.append([(2.0 if fine else -2.0) + 0.5 * r.randn(), 1.0])
            owner.append(d)
            good.append(float(not bad))
            truth.append(fine)
    x, owner, good, truth = np.array(x), np.array(owner), np.array(good), np.array(truth)
    m = C.fit_chain(x, owner, good)
    node = np.zeros((len(x), 2))
    node[:, 1] = (x - m.mean) / m.scale @ m.weights
    first, count = C._order(owner)
    marginal = np.exp(C.forward_backward(node, m.transitions, first, count)[0][:, 1])
    assert ((marginal > 0.5) == truth).mean() > 0.98
    assert marginal[truth & (good == 0)].mean() > 0.5


def languages_by_hand(text, m, opt):
    """Words' likelihoods by trigrams, expectation-maximisation and the penalised choice, in loops."""
    raw = b" " + bytes(32 if c in b"\t\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in text) + b" "
    words, at = [], None
    for i in range(1, len(raw) - 1):
        if raw[i] == 32:
            at = None
            continue
        h = (raw[i - 1] * 0x9E3779B1 + raw[i] * 0x85EBCA77 + raw[i + 1] * 0xC2B2AE3D) % 2**32
        h ^= h >> 15
        h = h * 0x2C1B3C6D % 2**32
        h ^= h >> 13
        if at is None:
            words.append(np.zeros(len(m.languages)))
            at = True
        words[-1] = words[-1] + m.log_p[h % L.BUCKETS]
    if not words:
        return np.zeros(len(m.languages))
    q = [np.maximum(np.exp(w - w.max()), opt.floor) for w in words]

    def em(pi, rounds):
        for _ in range(rounds):
            pi = sum(pi * w / (pi * w).sum() for w in q) / len(q)
        return pi

    n = len(m.languages)
    pi = em(np.full(n, 1 / n), opt.rounds)
    order = sorted(range(n), key=lambda k: -pi[k])
    best, chosen = -np.inf, None
    for k in range(1, n + 1):
        p = np.array([max(pi[j], 1e-9) if j in order[:k] else 0.0 for j in range(n)])
        p = p / p.sum()
        if k > 1:
            p = em(p, opt.refits)
        fit = sum(np.log((p * w).sum()) for w in q) - opt.penalty * k * np.log(len(q) + 1)
        if fit > best:
            best, chosen = fit, p
    return chosen


def test_languages_equal_plain_loops():
    r = np.random.RandomState(6)
    m, opt = model(), L.MixtureOptions()
    alphabet = b"abcdefghij  \n\tXYZ\xc3\xa9"
    texts = [bytes(r.choice(list(alphabet), n)) for n in (0, 1, 5, 40, 200, 700)] + [b"  ", b"a", b"AbC dEf " * 30]
    for t, p in zip(texts, L.proportions(texts, m, opt), strict=True):
        assert np.allclose(p, languages_by_hand(t, m, opt), atol=2e-3)


def test_learned_languages_equal_plain_counts(spark):
    rows = [(1, "ab AB", "x"), (2, "abc", "y"), (3, None, "x"), (4, "zz", None), (5, "ba", "x")]
    m = L.fit_languages(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING"), F.col("doc_id") != 5)
    counts = {"x": np.zeros(L.BUCKETS), "y": np.zeros(L.BUCKETS)}
    for _, t, lang in rows[:2]:
        counts[lang] += np.bincount(L._trigrams(L._joined([t.encode()])[0])[0], minlength=L.BUCKETS)
    assert m.languages == ("x", "y")
    for k, lang in enumerate(m.languages):
        want = counts[lang] + 0.5
        assert np.allclose(m.log_p[:, k], np.log(want / want.sum()), atol=1e-5)


def test_samples_are_bounded_by_ids(spark):
    """A labelled id that many rows repeat teaches once, and very long documents teach nothing."""
    from drawlake.llm import quality_rules as Q

    rows = [(1, f"line {k}\nof text {k}.") for k in range(50)] + [(2, "\n".join(["x y"] * 30)), (3, "all good here.\nYes.")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    ids = [i for i in (1, 2, 3) if docs.filter(F.col("doc_id") == i).select(fold(F.col("doc_id"), 5)).first()[0] != 0]
    labels = spark.createDataFrame([(i, int(i != 2), int(i == 2)) for i in (1, 2, 3)], "doc_id BIGINT, quality INT, toxic INT")
    assert Q.labelled_sample(docs, labels, 10).count() == len(ids)
    short = C.fit_quality(docs.filter("doc_id = 2"), labels, C.CrfOptions(most_lines=10, rounds=2))
    assert short is None
    assert T._labelled(docs, labels, T.ToxicityOptions(most_labelled=10)).count() == len(ids)
    assert T.fit_toxicity(docs, labels, T.ToxicityOptions(most_sentences=5, least_count=1, rounds=2)) is not None


def test_samples_are_bounded_by_the_sum_of_their_parts(spark):
    """In the order of the id's hash, until the sum is full; a null size counts nothing."""
    from drawlake.llm.common import within_total, written

    rows = [(i, i % 7 if i % 5 else None) for i in range(60)]
    sample = written(spark.createDataFrame(rows, "doc_id BIGINT, n BIGINT"), "sample")
    order = [r.doc_id for r in sample.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    for most in (0, 40, 10**6):
        want, total = [], 0
        for i in order:
            total += dict(rows)[i] or 0
            if total <= most:
                want.append(i)
        assert sorted(r.doc_id for r in within_total(sample, F.col("n"), most).collect()) == sorted(want)
    assert within_total(sample.limit(0), F.col("n"), 5).count() == 0
    docs = spark.createDataFrame([(i, "one. two. three.\nfour") for i in range(40)], "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(40)], "doc_id BIGINT, quality INT, toxic INT")
    assert T._labelled(docs, labels, T.ToxicityOptions(all_sentences=26)).count() == 26 // 5
    assert C.fit_quality(docs, labels, C.CrfOptions(all_lines=1, rounds=2)) is None
    assert C.fit_quality(docs, labels, C.CrfOptions(all_lines=8, rounds=2)) is not None
