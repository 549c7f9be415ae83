"""Documents of many languages."""

import numpy as np
import pytest

from drawlake.llm import language_id as L


def documents(n_lang, words):
    """A model of n_lang alphabets of their own, and a text that mixes all of them equally."""
    rng = np.random.RandomState(5)
    alphabets = ["".join(chr(97 + (5 * i + k) % 26) for k in range(5)) for i in range(n_lang)]
    make = lambda i, n: [" ".join("".join(rng.choice(list(alphabets[i]), 6)) for _ in range(n))]
    counts = np.zeros((L.BUCKETS, n_lang))
    for i in range(n_lang):
        h, _ = L._trigrams(L._joined([make(i, 3000)[0].encode()])[0])
        counts[:, i] = np.bincount(h, minlength=L.BUCKETS) + 0.5
    model = L.LanguageModel(tuple(f"l{i}" for i in range(n_lang)), np.log(counts / counts.sum(axis=0)).astype(np.float32))
    return model, [make(i, words)[0].encode() for i in range(n_lang)]


@pytest.mark.parametrize("n_lang", [4, 5])
def test_every_language_of_a_mixture_is_found(n_lang):
    model, parts = documents(n_lang, 60)
    mixed, single = L.proportions([b" ".join(parts), parts[1]], model)
    assert (np.abs(mixed - 1 / n_lang) < 0.05).all()
    assert np.flatnonzero(single).tolist() == [1]


def test_mixture_of_the_test_data(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = L.fit_languages(docs, docs["lang"].isNotNull())
    assert len(model.languages) == 4
    texts = {r.lang: r.text.split()[:150] for r in docs.filter("lang IS NOT NULL AND length(text) > 1500").collect()}
    mixed = L.proportions([" ".join(w for lang in sorted(texts) for w in texts[lang]).encode()], model)[0]
    assert len(texts) == 4 and (mixed > 0.1).all()
