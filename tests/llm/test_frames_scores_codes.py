import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tenura.llm import bloom_lm, seekable_fim, vector_codes

PARTS = ["a", "é", "\n", "日", "<", "P>", "<P", "x\n", "\n\n", "😀", "word "]


def made(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def units(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


# --- seekable frames ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [4, 7, 16, 1000])
def test_cuts_of_frames(size):
    rng = random.Random(size)
    for text in made(size, 300):
        lines, chars, frames = seekable_fim.compress(text.encode(), size)
        assert b"".join(seekable_fim.stream(frames)).decode() == text and chars[-1] == len(text)
        own = units(text)
        a, b = sorted((rng.randint(0, len(own)), rng.randint(0, len(own))))
        parts, n_prefix, n_middle = seekable_fim.parts_of(a, b, len(own), lines, chars, frames)
        got = [b"".join(seekable_fim.stream(p)).decode() for p in parts]
        assert got == ["".join(own[:a]), "".join(own[a:b]), "".join(own[b:])]
        assert (n_prefix, n_middle) == (len(got[0]), len(got[1]))


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_markers_are_found_across_frames(form):
    for text in made(9, 200):
        if any(m in text for m in ("<P>", "<S>", "<M>")):
            continue
        own = units(text)
        a, b = len(own) // 3, len(own) // 2
        parts = ["".join(own[:a]), "".join(own[a:b]), "".join(own[b:])]
        out = "".join(m.decode() + parts[k] for m, k in seekable_fim.ORDERS[form])
        _, _, frames = seekable_fim.compress(out.encode(), 4)
        assert b"".join(seekable_fim.restored(frames, form)).decode() == text


def test_whole_frames_are_taken_over():
    text = "".join(f"line {i}\n" for i in range(500)).encode()
    lines, chars, frames = seekable_fim.compress(text, 64)
    parts, _, _ = seekable_fim.parts_of(100, 400, 500, lines, chars, frames)
    kept = sum(f is g for part in parts for f in part for g in frames)
    assert kept >= len(frames) - 2  # only the two cut frames are made anew


def fim_by_hand(doc_id, text):
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    own = units(text)
    n = len(own)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(own[:a]), "".join(own[a:b]), "".join(own[b:])
    spm = h4 % 100 < 50
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if spm else "psm", len(p), len(m), sha(out), sha(text)


@pytest.mark.parametrize("frame", [16, 1 << 16])
def test_transform_equals_brute_force(docs_of, odd, spark, frame):
    docs = docs_of(list(enumerate(made(4, 60)))).unionByName(odd)
    stored = seekable_fim.store(docs, frame)
    found = sorted(map(str, seekable_fim.digests(seekable_fim.transform(stored)).collect()))
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    names = "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256".split()
    expected = [(d, *fim_by_hand(d, t)) for d, t in rows]
    from pyspark.sql import Row

    assert found == sorted(str(Row(*names)(*e)) for e in expected)
    outputs = seekable_fim.transform(stored)
    back = seekable_fim.texts_of(outputs, original=True).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter(rows)
    assert seekable_fim.digests(seekable_fim.transform(seekable_fim.store(docs.limit(0)))).count() == 0


# --- log-frequency filter ----------------------------------------------------------------------------------


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def test_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 1 << 40, 20_000, np.uint64)
    counts = rng.zipf(1.7, len(keys)).clip(1, 10**6)
    bits, image = bloom_lm.filled(keys, counts)
    sieve = bloom_lm.joined([{"segment": 3, "bits": bits, "image": image}], 4, len(image))
    levels = sieve.levels(np.full(len(keys), 3), keys)
    true = np.floor(np.log2(counts)).astype(int) + 1
    assert (levels >= true).all() and (levels == true).mean() > 0.9
    assert (bloom_lm.MEAN[true] <= 1.5 * counts).all() and (bloom_lm.MEAN[true] >= 0.7 * counts).all()
    other = sieve.levels(np.full(20_000, 3), rng.integers(1 << 41, 1 << 42, 20_000, np.uint64))
    assert (other > 0).mean() < 0.05
    assert not sieve.levels(np.zeros(10, int), keys[:10]).any()  # a segment without a filter


def lm_by_hand(rows, prior):
    """Exact counts, quantised; what the filter gives if no probe errs."""
    learned = [t for d, t in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2]
    one, two = Counter(), Counter()
    for t in learned:
        own = ["\n", *tokens(t), "\n"]
        one.update(own[1:])
        two.update(zip(own[:-1], own[1:], strict=True))
    total, words = sum(one.values()), len(one)
    mean = lambda c: 0 if not c else (2 ** (c.bit_length() - 1) + 2 ** c.bit_length() - 1) / 2
    out = []
    for d, t in rows:
        own = ["\n", *tokens(t), "\n"]
        base = sum(math.log10((one[w] + 1) / (total + words + 1)) for w in own[1:])
        score = 0.0
        for h, w in zip(own[:-1], own[1:], strict=True):
            p = min((mean(one[w]) + 1) / (total + words + 1), 1)
            score += math.log10((mean(two[h, w]) + prior * p) / (mean(one[h]) + prior))
        held = zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
        out.append((d, held, len(own) - 1, sum(one[w] > 0 for w in own[1:]), total, round(base, 6), round(score, 2)))
    return Counter(out)


@pytest.mark.parametrize("bounds", [{}, {"filter_bytes": 0}, {"segment_bytes": 300, "hot": 8}, {"segment_bytes": 300, "hot": 8, "filter_bytes": 0}])
def test_scores_equal_brute_force(docs_of, odd, bounds):
    # with so many bits no probe errs, and every way must give the same
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["The", "the", "cat", "Élan", "of\n", f"w{rng.randint(0, 60)}"]) for _ in range(rng.randint(0, 40))) for _ in range(80)]
    docs = docs_of(list(enumerate(texts))).unionByName(odd).repartition(3)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    found = bloom_lm.score_all(docs, prior=4.0, per_event=64, **bounds).collect()
    assert Counter(
        (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 2))
        for r in found
    ) == lm_by_hand(rows, 4.0)


def test_scores_of_longer_grams_and_empty_tables(docs_of, odd):
    texts = list(enumerate(["a b c d a b c e"] * 30 + ["c b a"] * 5))
    both = [bloom_lm.score_all(docs_of(texts), order=3, prior=1.0, filter_bytes=b).collect() for b in (1 << 27, 0)]
    assert sorted(map(str, both[0])) == sorted(map(str, both[1]))
    score = {r["doc_id"]: r["score"] for r in both[0]}
    # repeated trigrams are likelier under the longer model than under the shorter
    shorter = {r["doc_id"]: r["score"] for r in bloom_lm.score_all(docs_of(texts), prior=1.0).collect()}
    assert score[0] > shorter[0] and all(s <= 0 for s in score.values())
    for bound in (1 << 27, 0):
        assert bloom_lm.score_all(odd.limit(0), filter_bytes=bound).count() == 0


# --- value dictionaries ------------------------------------------------------------------------------------


def codes_by_hand(rows, entries, rounds, parts=4):
    kept = [(v, e, lab) for v, e, lab in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0]))
    ints = np.array([[math.floor(1024 * x) for x in e] for _, e, _ in kept], object)
    cut = [ints[:, p * (ints.shape[1] // parts) : (p + 1) * (ints.shape[1] // parts)] for p in range(parts)]
    books = [c[:entries].copy() for c in cut]
    nearest = lambda c, b: [min((int(((x - e) ** 2).sum()), i) for i, e in enumerate(b)) for x in c]
    for _ in range(rounds):
        for c, b in zip(cut, books, strict=True):
            best = [i for _, i in nearest(c, b)]
            for i in set(best):
                own = [x for x, k in zip(c, best, strict=True) if k == i]
                b[i] = [s // len(own) for s in np.sum(own, axis=0)]
    found = [nearest(c, b) for c, b in zip(cut, books, strict=True)]
    errors = [sum(f[r][0] for f in found) for r in range(len(kept))]
    by_label = Counter()
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by_label[lab] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter(
        (v, "".join(f"{f[r][1]:02x}" for f in found), errors[r], by_label[lab], sha) for r, (v, _, lab) in enumerate(kept)
    )


def test_codes_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1.5, -0.01, 0.0, 0.3, 2.0, rng.uniform(-1, 1)]) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(90)]
    rows += [(500, None, 1), (501, [float("nan")] * 8, 1), (502, [1.0, None] * 4, None), (503, [float("inf")] * 8, 2), (None, [0.5] * 8, None)]
    rows += [rows[3], rows[4]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS code", "2 AS ints").repartition(4)
    found = vector_codes.compress(frame, entries=6, rounds=3, block=7).collect()
    assert Counter(tuple(r) for r in found) == codes_by_hand(rows, 6, 3)


def test_tables_are_exact_for_large_integers():
    rng = np.random.default_rng(1)
    for top in (100, vector_codes.LARGEST):
        ints, book = rng.integers(-top, top, (50, 5)), rng.integers(-top, top, (20, 5))
        dictionaries, codes = vector_codes.opened(*vector_codes.block_of(ints))
        best, error = vector_codes.nearest(dictionaries, codes, book)
        direct = ((ints[:, None].astype(object) - book[None].astype(object)) ** 2).sum(axis=2)
        assert best.tolist() == direct.argmin(axis=1).tolist() and error.tolist() == direct.min(axis=1).tolist()


def test_odd_vectors(spark):
    rows = [(1, None, 1), (2, [1.0] * 6, 1), (3, [2.0] * 6, None), (None, [1e300] * 6, 7), (4, [1.0] * 3, None), (6, [], 2), (2, [1.0] * 6, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {(r["vec_id"], r["code"], r["error"]) for r in vector_codes.compress(frame).collect()}
    assert found == {(2, "00000000", 0), (3, "02020200", 0), (None, "03030300", 0), (4, None, None), (6, None, None)}
    assert vector_codes.compress(frame.limit(0)).count() == 0
    assert [r["code"] for r in vector_codes.compress(frame.filter("vec_id = 6")).collect()] == ["00000000"]
    assert vector_codes.compress(frame.drop("label")).count() == 6
