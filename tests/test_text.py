import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tenura.functions.columns import unigrams_and_bigrams, words
from tenura.operators import reduce, text


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(60)] + ["élan", "naïve", "a"]
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    docs = [" ".join(rng.choice(vocabulary, size=rng.integers(0, 40), p=weight / weight.sum())) for _ in range(120)]
    return docs


def by_hand(train, docs, max_terms):
    def terms(d):
        t = re.findall(r"\w\w+", d.lower())
        return t + [f"{a} {b}" for a, b in zip(t, t[1:])]

    tf, df = Counter(), Counter()
    for d in train:
        tf.update(terms(d))
        df.update(set(terms(d)))
    kept = [t for t in tf if 3 <= df[t] <= 0.95 * len(train)]
    kept = sorted(sorted(kept, key=lambda t: (-tf[t], t))[:max_terms])
    idf = np.array([math.log((1 + len(train)) / (1 + df[t])) + 1 for t in kept])
    out = np.zeros((len(docs), len(kept)))
    for i, d in enumerate(docs):
        c = Counter(terms(d))
        out[i] = [(1 + math.log(c[t])) * w if c[t] else 0 for t, w in zip(kept, idf)]
        if out[i].any():
            out[i] /= np.linalg.norm(out[i])
    return kept, out


def dense(rows, width):
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, r.tfidf.indices] = r.tfidf["values"]
    return out


def test_tfidf_and_svd(spark, corpus, monkeypatch):
    monkeypatch.setattr(reduce, "FAN_IN", 2)  # several levels of adding up
    docs = [*corpus, None, ""]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, review_text string").repartition(5)
    train = df.filter("id < 90")
    kept, expected = by_hand(docs[:90], [d or "" for d in docs], 70)
    model = text.fit_tfidf(train, max_terms=70)
    assert model.terms == kept
    weighted = model.transform(df)
    rows = weighted.orderBy("id").collect()
    np.testing.assert_allclose(dense(rows, 70), expected, atol=1e-12)

    svd = reduce.fit_truncated_svd(model.transform(train), "tfidf", 70, k=6)
    u, s, vt = np.linalg.svd(expected[:90], full_matrices=False)
    np.testing.assert_allclose(svd.strengths, s[:6], rtol=1e-6)
    projected = np.array([r.z for r in svd.transform(weighted, "tfidf", "z").orderBy("id").collect()])
    v = vt[:6].T * np.sign(vt[:6].T[np.abs(vt[:6].T).argmax(axis=0), range(6)])
    np.testing.assert_allclose(projected, expected @ v, atol=1e-4)
    wide = reduce.expand(svd.transform(weighted, "tfidf", "z"), "z", 6, "tfidf_c")
    assert set(reduce.numbered("tfidf_c", 6)) < set(wide.columns)


def test_one_partial_matrix_a_pass_reaches_the_driver(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i % 3}") for i in range(90)], "id int, review_text string").repartition(5)
    weighted = text.fit_tfidf(df).transform(df)
    frame, seen = type(df), []
    plain = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda self: (seen.append(plain(self)), seen[-1])[1])
    reduce.fit_truncated_svd(weighted, "tfidf", text.fit_tfidf(df).size, k=2)
    assert seen and {t.num_rows for t in seen} == {1}


def test_svd_at_its_defaults(spark, monkeypatch):
    """64 components of several hundred texts, without and with a subspace that must be cut back."""
    rng = np.random.default_rng(3)
    weight = 1 / np.arange(1, 901) ** 0.7
    docs = [" ".join(f"w{i}" for i in rng.choice(900, rng.integers(5, 60), p=weight / weight.sum())) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, review_text string").repartition(4)
    model = text.fit_tfidf(df)
    weighted = model.transform(df).select("tfidf").cache()
    x = dense(weighted.collect(), model.size)
    s, vt = np.linalg.svd(x, full_matrices=False)[1:]
    for basis in (reduce.BASIS, 1):
        monkeypatch.setattr(reduce, "BASIS", basis)
        svd = reduce.fit_truncated_svd(weighted, "tfidf", model.size)
        np.testing.assert_allclose(svd.strengths, s[:64], rtol=1e-6)
        assert (np.abs((svd.components * vt[:64].T).sum(axis=0)) > 0.9999).all()
    with pytest.raises(RuntimeError, match="settle"):
        reduce.fit_truncated_svd(weighted, "tfidf", model.size, passes=1)


def test_pca(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) @ rng.normal(size=(8, 8)) + 5
    df = spark.createDataFrame(pd.DataFrame({"id": range(300), "embedding": x.tolist()}))
    model = reduce.fit_pca(df.filter("id < 200"), "embedding", 3)
    centred = x - x[:200].mean(axis=0)
    _, s, vt = np.linalg.svd(centred[:200], full_matrices=False)
    v = vt[:3].T * np.sign(vt[:3].T[np.abs(vt[:3].T).argmax(axis=0), range(3)])
    got = np.array([r.z for r in model.transform(df, "embedding", "z").orderBy("id").collect()])
    np.testing.assert_allclose(got, centred @ v, atol=1e-8)
    np.testing.assert_allclose(model.strengths, (s**2 / (s**2).sum())[:3], rtol=1e-8)


def test_unit_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, embedding array<float>")
    rows = {r.id: r.embedding for r in reduce.unit_vectors(df, "embedding").collect()}
    assert rows == {1: [pytest.approx(0.6), pytest.approx(0.8)], 2: [0.0, 0.0]}


def test_words_are_found_once_for_unigrams_and_bigrams(spark):
    rows = [(0, "to be or not to be"), (1, "word"), (2, ""), (3, None)]
    df = spark.createDataFrame(rows, "id int, review_text string")
    found = df.select("id", unigrams_and_bigrams(words("review_text")).alias("terms"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    by_id = {r.id: r.terms for r in found.collect()}
    assert by_id[0] == ["to", "be", "or", "not", "to", "be", "to be", "be or", "or not", "not to", "to be"]
    assert (by_id[1], by_id[2], by_id[3]) == (["word"], [], [])
    given = spark.createDataFrame([(["a", None, "c"],), (None,)], "t array<string>").select(unigrams_and_bigrams(F.col("t")))
    assert [r[0] for r in given.collect()] == [["a", None, "c", "a", "c"], None]
    counts = {r.term: (r.tf, r.df) for r in text.term_statistics(df).collect()}
    assert counts["to be"] == (2, 1) and counts["word"] == (1, 1) and len(counts) == 9
