import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import langid


def brute_ngrams(text):
    found = {}
    for n in range(1, langid.ORDERS + 1):
        for i in range(len(text) - n + 1):
            h = 0
            for c in text[i : i + n]:
                h = (h * 0x01000193 + ord(c) + 1) & 0xFFFFFFFF
            h = ((h ^ (h >> 15)) * 0x9E3779B1 + n * 0x85EBCA6B) & 0xFFFFFFFF
            found[h >> (32 - langid.BITS)] = found.get(h >> (32 - langid.BITS), 0) + 1
    return found


@pytest.mark.parametrize("text", ["", "a", "ab", "Überaus schöne 漢字 \U0001f600 words words"])
def test_ngrams(text):
    at, n = langid.ngrams(text)
    assert dict(zip(at.tolist(), n.tolist())) == brute_ngrams(text.lower())


def test_frequencies_cover_all_texts(docs):
    texts = [r.text for r in docs.collect()]
    df = np.zeros(1 << langid.BITS)
    for t in texts:
        df[langid.ngrams(t)[0]] += 1
    assert np.allclose(langid.inverse_frequencies(docs), np.log((1 + len(texts)) / (1 + df)) + 1)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = langid.train(train, 60)
    got = {r.doc_id: r for r in langid.identify(test, model).collect()}
    truth = {r.doc_id: r.lang for r in test.collect()}
    right = np.array([got[i].lang == truth[i] for i in truth])
    assert right.mean() > 0.97
    # calibrated: the mean confidence is near the accuracy
    assert abs(np.mean([got[i].confidence for i in truth]) - right.mean()) < 0.03
    # the penalties leave most weights at zero
    assert (model.weights == 0).mean() > 0.5


def test_ftrl_step_by_step():
    """Against the update of one coordinate at a time."""
    rows = [("x", "aab"), ("y", "bbc"), ("x", "aaa"), ("y", "cbc")]
    idf = np.ones(1 << langid.BITS)
    model = langid.fit(rows, idf, epochs=2, l1=0.01, l2=0.1)
    z, n = np.zeros((1 << langid.BITS, 2)), np.zeros((1 << langid.BITS, 2))
    zb, nb = np.zeros(2), np.zeros(2)
    a, b, l1, l2 = langid.ALPHA, langid.BETA, 0.01, 0.1

    def w(i, c):
        return 0.0 if abs(z[i, c]) <= l1 else -(z[i, c] - np.sign(z[i, c]) * l1) / ((b + np.sqrt(n[i, c])) / a + l2)

    for epoch in range(2):
        for r in np.random.default_rng(1 + epoch).permutation(np.random.default_rng(0).permutation(4)):
            at, x = langid.weighted(rows[r][1], idf)
            bias = -zb / ((b + np.sqrt(nb)) / a)
            p = langid.softmax(np.array([sum(w(i, c) * v for i, v in zip(at, x)) + bias[c] for c in (0, 1)]))
            p[0 if rows[r][0] == "x" else 1] -= 1
            for i, v in zip(at, x):
                for c in (0, 1):
                    g, old = p[c] * v, w(i, c)
                    z[i, c] += g - (np.sqrt(n[i, c] + g * g) - np.sqrt(n[i, c])) / a * old
                    n[i, c] += g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / a * bias
            nb += p * p
    want = np.array([[w(i, c) for c in (0, 1)] for i in range(1 << langid.BITS)])
    assert np.allclose(model.weights, want, atol=1e-6)


def test_sample_is_bounded(docs):
    rows = langid.sample_of(docs, 5)
    counts = {k: sum(1 for x, _ in rows if x == k) for k, _ in rows}
    assert set(counts) == {r.lang for r in docs.select("lang").distinct().collect()} and max(counts.values()) <= 5


def test_odd_rows(odd, made, docs):
    got = langid.identify(odd.withColumn("confidence", F.lit(1)).withColumn("h", F.lit(2)).withColumn("bucket", F.lit(2)))
    rows = got.collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].lang is None and by[2].lang is None and by[3].lang is not None and 0 < by[5].confidence <= 1
    assert langid.identify(odd.limit(0)).count() == 0
    assert {r.lang for r in langid.identify(made([(1, "abc", None, "s"), (2, "", "en", "s")])).collect()} == {None}
    one = langid.identify(made([(1, "abc", "en", "s"), (2, "xyz", None, "s")])).collect()
    assert {(r.lang, r.confidence) for r in one} == {("en", 1.0)}


def test_whole_query_against_brute_force(docs):
    """Every document's language and confidence from n-grams, weights and temperature, step by step."""
    model = langid.train(docs)
    got = {r.doc_id: (r.lang, r.confidence) for r in langid.identify(docs).collect()}
    for r in docs.collect():
        if not r.text:
            assert got[r.doc_id] == (None, None)
            continue
        x = {k: n * model.idf[k] for k, n in brute_ngrams(r.text.lower()).items()}
        norm = np.sqrt(sum(v * v for v in x.values()))
        s = [(sum(v / norm * model.weights[k, c] for k, v in x.items()) + model.bias[c]) / model.temperature for c in range(len(model.languages))]
        p = np.exp(np.array(s) - max(s))
        p /= p.sum()
        lang, confidence = got[r.doc_id]
        assert lang == model.languages[int(np.argmax(p))] and abs(confidence - p.max()) < 1e-5


def test_temperature_is_the_best_on_held_out_rows(docs):
    rows = langid.sample_of(docs, 30)
    idf = langid.inverse_frequencies(docs)
    model = langid.fit(rows, idf)
    held = np.random.default_rng(0).permutation(len(rows))[: len(rows) // 5]

    def loss(t):
        out = []
        for i in held:
            at, x = langid.weighted(rows[i][1], idf)
            p = langid.softmax((x @ model.weights[at] + model.bias) / t)
            out.append(-np.log(p[model.languages.index(rows[i][0])] + 1e-300))
        return np.mean(out)

    assert all(loss(model.temperature) <= loss(t) + 1e-4 for t in np.exp(np.linspace(-3.9, 3.9, 60)))


def test_ties_go_to_the_first_language():
    none = langid.Model(["aa", "bb"], np.ones(1 << langid.BITS), np.zeros((1 << langid.BITS, 2), np.float32), np.zeros(2), 1.0)
    assert langid.predict("any text", none) == ("aa", 0.5)
