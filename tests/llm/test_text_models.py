import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tenura.llm import decision_list, subword_language, weak_toxicity

RNG = np.random.default_rng(4)
SYLLABLES = {"en": "the ing tion ea st er on wh ou".split(), "fr": "eau oi que ment é è aux tre".split()}


def prose(lang, n):
    return " ".join("".join(RNG.choice(SYLLABLES[lang], RNG.integers(1, 4))) for _ in range(n))


def test_statistics_equal_brute_force(docs_of, odd):
    rows = []
    for i in range(120):
        words = RNG.choice(["a", "bb", "c#", "é|", "D!", "7"], RNG.integers(0, 60))
        rows.append((i, "".join(w + RNG.choice([" ", "\n", "\t ", " "], p=[0.7, 0.15, 0.1, 0.05]) for w in words)))
    rows.append((500, "\n".join(["the same line of six words"] * 4000)))
    for r in decision_list.with_statistics(docs_of(rows)).collect():
        text = dict(rows)[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        times = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
    assert decision_list.with_statistics(odd).count() == 11


def test_learned_list(spark, docs_of, odd):
    rows = [(i, prose("en", 40)) for i in range(200)]
    rows += [(i, " ".join(w + "###" for w in prose("en", 40).split())) for i in range(200, 260)]
    rows += [(i, prose("en", 40).upper()) for i in range(260, 320)]
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    docs = docs_of(rows)
    kept = {r["doc_id"] for r in decision_list.keep_good(docs, labels).collect()}
    assert kept == set(range(200)) and decision_list.keep_good(docs, labels).columns == docs.columns
    none = labels.limit(0)
    assert decision_list.quality(docs, none).filter("kept").count() == 320  # nothing to learn from
    assert decision_list.quality(odd, labels).count() == 11
    assert decision_list.quality(odd.limit(0), labels).count() == 0
    rule = [("n_words", ">", 5.0), ("digit_share", "<=", 0.1)]
    assert decision_list.describe([rule]) == ["reject if n_words > 5 and digit_share <= 0.1", "else keep"]


def test_subwords_stay_inside_words():
    one, _ = subword_language.subwords(pa.array(["ab, CD 7"]))
    two, _ = subword_language.subwords(pa.array(["cd ab"]))
    assert set(one[one >= 0].tolist()) == set(two[two >= 0].tolist())
    parts, bounds = subword_language.subwords(pa.array(["ab", "", "cd"]))
    alone, _ = subword_language.subwords(pa.array(["cd"]))
    assert (parts[bounds[2] : bounds[3]] == alone).all()


def test_language(spark, docs_of, odd):
    rows = [(i, prose("en" if i % 2 else "fr", 30), "en" if i % 2 else "fr") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = subword_language.train(docs)
    found = {r["doc_id"]: r for r in subword_language.predict(docs, model, reject=False).collect()}
    held = [i for i, *_ in rows if found[i]["held_out"]]
    assert held and np.mean([found[i]["lang_pred"] == rows[i][2] for i in held]) > 0.98
    odd_rows = subword_language.predict(odd, model, reject=False).collect()
    assert len(odd_rows) == 11
    assert {r["lang_pred"] for r in odd_rows if r["doc_id"] in (1, 2, 3, 8)} == {"und"}
    strange = spark.createDataFrame([(1, "ζηθικλμ νξοπρσ")], "doc_id long, text string")
    model.threshold = 1.1
    assert subword_language.predict(strange, model).first()["lang_pred"] == "und"  # rejected
    assert subword_language.train(docs.limit(0)) is None
    assert subword_language.predict(odd, None).filter("lang_pred = 'und' and score = 0").count() == 11


def test_label_model_finds_rates():
    n = 4000
    truth = RNG.random(n) < 0.3
    fired = np.zeros((n, 4))
    for k, (yes, no) in enumerate([(0.7, 0.02), (0.5, 0.05), (0.3, 0.3)]):
        fired[:, k] = RNG.random(n) < np.where(truth, yes, no)
    fired[:, 3] = fired[:, 0]  # a voter that repeats another
    marks = np.where(RNG.random(n) < 0.03, ~truth, truth).astype(int)
    known = np.arange(n) < n // 4
    posterior, found = weak_toxicity.label_model(fired[~known], fired[known], marks[known])
    # the best that any rule can do with these voters
    seen = [tuple(r) for r in fired[~known].tolist()]
    share = {v: np.mean([t for s, t in zip(seen, truth[~known], strict=True) if s == v]) for v in set(seen)}
    best = np.mean([max(share[s], 1 - share[s]) for s in seen])
    assert np.mean((posterior > 0.5) == truth[~known]) > best - 0.01
    assert abs(found["toxic"][0] - 0.7) < 0.08 and abs(found["clean"][1] - 0.05) < 0.02
    assert found["correlations"][0, 3] > 0.8 and found["trust"][0] < 0.6 < found["trust"][1]


def test_posterior_of_three_voters_by_brute_force():
    """At the fixed point each posterior is Bayes' rule over both classes with the estimated rates."""
    truth = RNG.random(3000) < 0.4
    fired = np.column_stack([RNG.random(3000) < np.where(truth, y, n) for y, n in [(0.8, 0.1), (0.6, 0.2), (0.7, 0.05)]])
    fired = fired.astype(float)
    posterior, found = weak_toxicity.label_model(fired[1000:], fired[:1000], truth[:1000].astype(int), rounds=500)
    assert (found["trust"] == 1).all()  # independent within a class
    for row, value in list(zip(fired[1000:], posterior, strict=True))[:200]:
        joint = []
        for prior, rates in ((found["prior"], found["toxic"]), (1 - found["prior"], found["clean"])):
            joint.append(prior * np.prod([r if f else 1 - r for f, r in zip(row, rates, strict=True)]))
        assert abs(value - joint[0] / sum(joint)) < 1e-4


def test_a_row_does_not_vote_with_its_own_label(spark, docs_of):
    """Wrong labels of training rows are turned, in both directions."""
    rows, labels, wrong = [], [], 0
    for i in range(900):
        words, toxic = prose("en", 20).split(), i % 4 == 0
        if toxic:
            words[3:3], words[9:9] = ["idiot"], ["moron"]
        lie = i % 30 in (4, 5)
        wrong += lie and zlib.crc32(str(i).encode()) % 3 != 1
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic != lie)))
    model = weak_toxicity.train(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert wrong > 0 and model.turned >= 0.9 * wrong


def test_repeated_rows_of_a_doc_id_are_drawn_once(spark):
    docs = spark.range(3000).selectExpr("id % 3 AS doc_id", "'same text' AS text", "'x' AS toxic")
    labels = spark.createDataFrame([(0, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    drawn = weak_toxicity.labelled_sample(docs, labels, 100, 100)
    assert drawn.columns == ["text", "toxic", "part"] and drawn.count() <= 2


def test_toxicity(spark, docs_of, odd):
    rows, labels = [], []
    for i in range(400):
        words = prose("en", 30).split()
        if i % 5 == 0:
            words[7], words[15] = ("zorg" + RNG.choice(SYLLABLES["en"]), "you") if i % 2 else ("idiot", "moron,")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 5 == 0)))
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = docs_of(rows)
    model = weak_toxicity.train(docs, labelled)
    assert any(name.startswith("zor") for name in model.names)
    found = weak_toxicity.score(docs, model).toPandas()
    held = found[found["held_out"]]
    assert len(held) and (held["predicted"] == (held["doc_id"] % 5 == 0)).mean() > 0.97
    assert weak_toxicity.score(odd, model).filter("score between 0 and 1").count() == 11
    assert weak_toxicity.train(docs, labelled.limit(0)) is None
    assert weak_toxicity.score(odd, None).filter("score = 0 and predicted = 0").count() == 11


@pytest.mark.parametrize("module", [subword_language, weak_toxicity])
def test_held_out_rows_are_those_of_the_contract(spark, module):
    mod, value = (5, 0) if module is subword_language else (3, 1)
    rows = spark.range(50).withColumnRenamed("id", "doc_id").withColumn("held", module.held_out()).collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == value) for r in rows)
