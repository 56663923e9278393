import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tenura.llm import common, edit_matching, paragraphs, pivot_simhash


def groups_by_hand(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)]
    pairs += [(500, k) for k in range(501, 560)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    expected = groups_by_hand({x for p in pairs for x in p}, pairs)
    assert all(found.get(n, n) == c for n, c in expected.items())
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def by_hand(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> j & 1 for h in hashes) > len(hashes)) << j for j in range(64))


def test_fingerprints(odd):
    for text in ("", " ", "One", "one TWO", "a b c", "a b c a b c", "É é x \x0b y", "w " * 500):
        assert pivot_simhash.fingerprint(text) == by_hand(text)
    found = pivot_simhash.near_duplicates(odd).collect()
    assert len(found) == 11
    classes = {r["doc_id"]: r["component_id"] for r in found}
    assert classes[7] == 6 and classes[1] == classes[2] == classes[3] == 1
    assert pivot_simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = [r["doc_id"] for r in pivot_simhash.keep_one(odd).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 4, 5, 6, 8] and kept.count(None) == 2


def test_links_lose_nothing(spark):
    """Dense clusters: buckets over the limit are dealt again."""
    rng = np.random.default_rng(3)
    codes = set()
    for base in rng.integers(0, 2**63, 3, dtype=np.uint64).tolist():
        for _ in range(800):
            x = base
            for j in [*rng.integers(0, 12, 3), *rng.integers(0, 64, int(rng.integers(0, 3)))]:
                x ^= 1 << int(j)
            codes.add(x)
    values = np.array(sorted(codes), np.uint64)
    signed = values.view(np.int64).tolist()
    pairs = [(signed[a], signed[b]) for a in range(len(values)) for b in
             (np.flatnonzero(np.bitwise_count(values[a + 1 :] ^ values[a]) <= 2) + a + 1).tolist()]
    links = pivot_simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    exact = groups_by_hand(signed, pairs)
    assert groups_by_hand(signed, [(r["a"], r["b"]) for r in links]) == exact


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_paragraph_clusters_equal_brute_force(docs_of):
    rng = random.Random(5)
    bases = [words(rng, 60) for _ in range(12)]
    lines = []
    for base in bases:
        lines.append(base)
        for _ in range(rng.choice([1, 3, 45])):  # 45: a group over SMALL
            w = base.split()
            for _ in range(rng.choice([0, 1, 1, 4])):
                w[rng.randrange(60)] = words(rng, 1)
            lines.append(" ".join(w))
    lines += [words(rng, 30) for _ in range(30)]
    rows = list(enumerate(lines))
    docs = common.texts(docs_of(rows))
    occurrences = paragraphs.lines_of(docs)
    keys = {r["doc_id"]: r["key"] for r in occurrences.collect()}
    found = {r["key"]: r["cluster"] for r in paragraphs.clusters(docs, occurrences).collect()}
    pairs = [(a, b) for a in range(len(lines)) for b in range(a) if lines[a] == lines[b] or jaccard(lines[a], lines[b]) >= 0.8]
    exact = groups_by_hand(range(len(lines)), pairs)
    mine = {n: found.get(keys[n], keys[n]) for n in range(len(lines))}
    joined = sum(mine[a] == mine[b] for a, b in pairs)
    assert joined >= 0.99 * len(pairs)
    assert all(exact[a] == exact[b] for a in mine for b in mine if mine[a] == mine[b])


def test_paragraph_removal(docs_of, odd):
    rng = random.Random(6)
    one, two = words(rng, 60), ". ".join(words(rng, 12).capitalize() for _ in range(7)) + "."
    changed = one.split()
    changed[30] = "zzz"
    a, b, c = words(rng, 40), words(rng, 40), words(rng, 40)
    rows = [
        (1, f"{a}\n{one}"), (2, f"{' '.join(changed)}\n{b}"), (3, f"{c} and {two} {words(rng, 20)}"),
        (4, f"{words(rng, 15)} {two} {words(rng, 25)}"), (5, words(rng, 80)), (6, one), (7, "My motto is this one\n" + words(rng, 30)),
        (8, "My motto is this one\n" + words(rng, 30)), (9, f"{one}x\n{one}x"),
    ]
    docs = docs_of(rows)
    found = {r["doc_id"]: r["kept_text"] for r in paragraphs.removals(docs).collect()}
    assert set(found) == {2, 4, 6, 9} and found[2].strip() == b and found[6] == ""
    inner = two[two.index(".") + 1 :].strip()
    assert inner not in found[4] and len(found[4].split()) < 60
    kept = {r["doc_id"]: r for r in paragraphs.remove_repeats(docs).collect()}
    assert set(kept) == {1, 2, 3, 4, 5, 7, 8} and kept[2]["n_chars"] == len(kept[2]["text"])
    assert paragraphs.remove_repeats(docs).columns == docs.columns
    assert paragraphs.remove_repeats(odd).count() == 11 and paragraphs.removals(odd).count() == 0
    assert paragraphs.remove_repeats(odd.limit(0)).count() == 0


def test_passages_set_into_other_lines(docs_of):
    """A passage that starts and ends inside sentences of its hosts goes from its first to its last word."""
    rng = random.Random(8)
    long = [w.split() for w in (words(rng, 25), words(rng, 51), words(rng, 90))]
    long[1][20] += ".\n" + words(rng, 1).capitalize()  # the only line and sentence end
    short = words(rng, 24)
    rows, left = [], {}
    for k, passage in enumerate([" ".join(p) for p in long] + [short]):
        rows.append((k, f"{words(rng, 12)} {passage} {words(rng, 9)}"))
        hosts = words(rng, 14), words(rng, 11)
        rows.append((10 + k, f"{hosts[0]} {passage.replace(' ', '  ', 3)} {hosts[1]}"))
        left[10 + k] = " ".join(hosts).split()
    found = {r["doc_id"]: r for r in paragraphs.removals(docs_of(rows)).collect()}
    assert set(found) == {10, 11, 12}
    assert all(r["kept_text"].split() == left[k] for k, r in found.items())
    assert [found[10 + k]["n_words_removed"] for k in range(3)] == [25, 52, 90]


def test_windows_equal_brute_force(docs_of):
    rng = random.Random(9)
    texts = [words(rng, rng.choice([0, 5, 15, 16, 17, 200])).split() for _ in range(30)]
    for _ in range(40):
        a, b = rng.sample(range(30), 2)
        n = rng.randint(10, 40)
        at = rng.randint(0, len(texts[b]))
        texts[b][at:at] = texts[a][:n]
    docs = docs_of([(k, " ".join(t)) for k, t in enumerate(texts)])
    first = {}
    for k, t in enumerate(texts):
        for p in range(len(t) - 15):
            first.setdefault(tuple(t[p : p + 16]), k)
    exact = {(k, p) for k, t in enumerate(texts) for p in range(len(t) - 15) if first[tuple(t[p : p + 16])] < k}
    found = paragraphs.repeated(docs).filter("kind = 'window'").collect()
    assert exact and {(r["doc_id"], r["begin"]) for r in found} == exact


def test_bands_reach_the_recall():
    bands, rows = paragraphs.tune_bands(0.8, 0.98, 64)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.98 and bands * rows <= 64


def distance_by_hand(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row), row.index(min(row))


def test_bit_parallel_distance():
    rng = random.Random(2)
    for _ in range(300):
        pattern = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 80)))
        text = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 120)))
        bits = edit_matching.pattern_bits(pattern)
        assert edit_matching.least_distance(bits, len(pattern), text) == distance_by_hand(pattern, text)


def test_matches_equal_brute_force(spark, docs_of, odd):
    rng = random.Random(3)
    items = [(k, words(rng, 20)) for k in range(8)] + [(8, None), (9, ""), (10, "Tiny One")]
    rows = []
    for d in range(60):
        text = words(rng, 30)
        if d % 3:
            item = list(items[d % 8][1])
            for _ in range(rng.randint(0, 8)):
                k = rng.randrange(len(item))
                item[k] = rng.choice(["", "q", item[k] + "q"])
            text = f"{text}\n{''.join(item).upper() if d % 2 else ''.join(item)}  {words(rng, 10)}"
        rows.append((d, text))
    rows.append((70, "so tiny  ONE it is"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = set()
    for d, text in rows:
        for k, item in items:
            if item:
                item = edit_matching.normalized(item)
                least, _ = distance_by_hand(item, edit_matching.normalized(text))
                if least <= edit_matching.budget(len(item)):
                    expected.add((d, k, least))
    for block in (1, 10**6):
        found = edit_matching.matches(docs_of(rows), benchmark, block_bytes=block).collect()
        assert {(r["doc_id"], r["item_id"], r["distance"]) for r in found} == expected and (70, 10, 0) in expected
    clean = edit_matching.decontaminated(docs_of(rows), benchmark)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, *_ in expected}
    assert edit_matching.decontaminated(odd, benchmark).count() == 11
    assert edit_matching.matches(odd.limit(0), benchmark).count() == 0
    assert edit_matching.matches(odd, benchmark.limit(0)).count() == 0


def test_pipeline(spark, docs_of, tmp_path):
    rng = random.Random(9)
    good = [(i, words(rng, 120)) for i in range(40)]
    item = words(rng, 25)
    rows = good + [
        (50, " ".join(w + "###" for w in words(rng, 60).split())),  # junk
        (51, good[3][1]),  # a copy
        (52, f"{words(rng, 50)}\n{good[4][1]}"),  # a copied paragraph
        (53, f"{words(rng, 30)} {item} {words(rng, 30)}"),  # a test item
        (54, "too short"),
    ]
    junk = [(i, " ".join(w + "###" for w in words(rng, 60).split())) for i in range(60, 120)]
    docs = docs_of(rows + junk).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(i, 1, 0) for i in range(40)] + [(i, 0, 0) for i in range(60, 120)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    step = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = corpus_pipeline.staged(stage(spark, step, str(tmp_path)))
        assert step.columns == docs.columns
        seen[name] = {r["doc_id"] for r in step.collect()}
    clean = set(range(40))
    assert seen["quality_rules"] == clean | {51, 52, 53}
    assert seen["near_dedup"] == seen["substring_dedup"] == clean | {52, 53}
    assert seen["decontamination"] == clean | {52}
    texts = {r["doc_id"]: r["text"] for r in step.collect()}
    assert all(texts[i] == t for i, t in good) and len(texts[52].split()) == 50
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == clean | {52}
    assert packed.filter(F.col("offset") + F.col("length") > 1024).count() == 0


def test_word_hashes_tell_words_apart():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abé.!"), rng.integers(1, 9))) for _ in range(3000)]
    words += ["x" * n for n in range(1, 400)] + ["x" * 64 + "y" + "x" * n for n in range(200)] + ["y" + "x" * 64]
    words = list(dict.fromkeys(words))
    hashes, stops = paragraphs._hashed(pa.array(["skipped", *words]).slice(1))
    assert len(set(hashes.tolist())) == len(words)
    assert stops.tolist() == [w.endswith((".", "!", "?")) for w in words]
