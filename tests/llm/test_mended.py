"""Cases that once went wrong."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura.llm import bucket_pointers, common, paragraphs, pivot_simhash, virtual_slots


def test_keep_one_tells_rows_of_one_doc_id_apart(spark):
    rows = [(1, "one two three four", 0), (5, "one two three four", 0), (5, "wholly different words here now", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id long").withColumn("id", F.lit(3)).withColumn("a.b", F.lit(1))
    kept = pivot_simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(1, "one two three four"), (5, "wholly different words here now")}


def test_one_row_repeated_without_bound(spark):
    docs = spark.range(100_000_000).select(F.lit(7).alias("doc_id"), F.lit("the same row").alias("text"))
    placed = virtual_slots.shard_rows(docs, 40)
    facts = placed.agg(F.count("slot"), F.min("slot"), F.max("slot"), F.expr("bit_xor(slot)"), F.sum("slot")).first()
    n = 100_000_000
    assert tuple(facts) == (n, 0, n - 1, 0, n * (n - 1) // 2)  # 0 ^ 1 ^ ... ^ (n - 1) is 0 for such n


def test_the_stored_map_levels_bytes(spark, docs_of):
    docs = docs_of([(i, "x" * (4000 if i % 17 == 0 else 10)) for i in range(3000)])
    placed = virtual_slots.shard_rows(docs, 8, slots=256)
    held = lambda c: sorted(r["b"] for r in placed.groupBy(c).agg(F.sum("size").alias("b")).collect())
    before, after = held("shard"), held("level_shard")
    assert after[-1] - after[0] < before[-1] - before[0]
    total = placed.select("virtual_slot", "slot_bytes").distinct().agg(F.sum("slot_bytes")).first()[0]
    assert total == placed.agg(F.sum("size")).first()[0]


def test_ranks_over_65536():
    assert bucket_pointers.FIELDS["rank"].itemsize == bucket_pointers.SETTLED["rank"].itemsize == 4


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.mark.parametrize("large", [2, 8, 10**6])
def test_large_bands_are_split_without_loss(docs_of, monkeypatch, large):
    monkeypatch.setattr(paragraphs, "LARGE", large)
    rng = random.Random(11)
    lines = []
    for _ in range(6):
        base = words(rng, 50).split()
        for _ in range(25):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                w[rng.randrange(50)] = words(rng, 1)
            lines.append(" ".join(w))
    docs = common.texts(docs_of(list(enumerate(lines))))
    lines_ = paragraphs.lines_of(docs)
    found = {r["key"]: r["cluster"] for r in paragraphs.clusters(docs, lines_).collect()}
    monkeypatch.setattr(paragraphs, "LARGE", 10**6)
    whole = {r["key"]: r["cluster"] for r in paragraphs.clusters(docs, lines_).collect()}
    # no link of the bands is lost; lines of two bands may meet too, and link only if they are similar
    assert all(found[key] == found[cluster] for key, cluster in whole.items())
    assert len(set(found.values())) >= 5


def test_lines_of_one_template_part(spark):
    """Lines that share their template's shingles, hence bands, but are not similar: few of them ever meet."""
    rng = np.random.default_rng(4)
    common_, n = rng.integers(0, 2**62, 30), 2000
    rows = [(k, sorted({*common_.tolist(), *rng.integers(0, 2**62, 20).tolist()})) for k in range(n)]
    frame = spark.createDataFrame(rows, "key long, shingles array<long>")
    met = paragraphs._by_rare_shingles(frame)
    assert met.count() < n


def test_a_doc_id_of_many_texts(docs_of):
    """Rows that share a doc_id lose what an earlier document has, each by its own text."""
    rng = random.Random(3)
    one, two = words(rng, 40), words(rng, 40)
    rows = [(1, one), (9, f"{one}\n{words(rng, 30)}"), (9, two), (9, two), (9, f"{words(rng, 20)} {one}")]
    found = paragraphs.removals(docs_of(rows)).collect()
    assert sorted(r["n_words_removed"] for r in found) == [40, 40]
    kept = paragraphs.remove_repeats(docs_of(rows))
    assert sorted(len(r["text"].split()) for r in kept.collect()) == [20, 30, 40, 40, 40]


def test_lines_names_and_windows_are_no_rows(docs_of, monkeypatch):
    """A slice of texts has one row for all its lines, names or windows, however many texts it has."""
    rng = random.Random(5)
    passage = words(rng, 30)
    docs = common.texts(docs_of([(k, f"{words(rng, 20)} x{k} {passage} y{k} {words(rng, 20)}") for k in range(200)]).coalesce(1))
    marks = {r["kind"]: r for r in paragraphs.marks_of(docs).collect()}
    assert paragraphs.marks_of(docs).count() == 3 and marks[paragraphs.LINE]["n"] == 200
    assert marks[paragraphs.NAME]["n"] == len(marks[paragraphs.NAME]["hashes"]) > 200 * 5
    names = docs.select("doc_id", F.xxhash64("text").alias("row"), F.lit(marks[paragraphs.NAME]["hashes"]).alias("names"))
    details = paragraphs.details_of(docs, names.limit(0).withColumn("key", F.lit(1)), names)
    assert details.count() < 50 and details.agg(F.sum("n")).first()[0] == 200 * (72 - paragraphs.WINDOW + 1)
    monkeypatch.setattr(paragraphs, "PART", 100)  # many parts
    found = paragraphs.repeated(docs).filter("kind = 'window'").collect()
    assert {(r["doc_id"], r["begin"], r["keeper"]) for r in found} == {(k, at, 0) for k in range(1, 200) for at in range(21, 36)}
    assert len(found) == 199 * 15


@pytest.mark.parametrize("part", [7, 10**6])
def test_answers_equal_brute_force(spark, monkeypatch, part):
    """Several owners of a key; a very common key is asked once a slice."""
    monkeypatch.setattr(paragraphs, "PART", part)
    rng = np.random.default_rng(6)
    rows = [(s, [(1 << 62) - 1, *rng.integers(0, 60, 40).tolist()], [s, *rng.integers(-(2**62), 2**62, 3).tolist() * 13, 5]) for s in range(9)]
    slices = spark.createDataFrame(rows, "slice long, keys array<long>, owners array<long>")
    owners = {}
    for _, keys, whose in rows:
        for key, owner in zip(keys, whose, strict=True):
            owners.setdefault(key, set()).add(owner)
    for later in (False, True):
        asked = paragraphs.answers(
            slices, lambda one: (paragraphs._flat(one, "keys").view(np.uint64), paragraphs._flat(one, "owners")), 9 * 41, later
        )
        found = [(r["slice"], key, least) for r in asked.collect() for key, least in zip(r["keys"], r["least"], strict=True)]
        exact = {
            (s, key, min(owners[key]))
            for s, keys, whose in rows
            for key, owner in zip(keys, whose, strict=True)
            if (owner > min(owners[key]) if later else len(owners[key]) > 1)
        }
        assert exact and len(found) == len(exact) and set(found) == exact
