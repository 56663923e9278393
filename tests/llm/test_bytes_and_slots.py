import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura.llm import bucket_pointers, virtual_slots


def by_hand(docs):
    first = {}
    for d, t in sorted(docs):
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], d)
    out = {}
    for d, t in docs:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                mask[i : i + 50] = True
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~mask])
        out[d] = (len(t), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def pasted(seed, n=60):
    """Texts of a small alphabet with pasted passages around the limit of 50 bytes, copies and cuts."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abé \n") for _ in range(n))
    shared = [word(rng.choice([30, 45, 49, 50, 51, 60, 120])) for _ in range(12)]
    texts = [
        "".join(rng.choice([word(rng.randint(0, 60)), rng.choice(shared)]) for _ in range(rng.randint(0, 8)))
        for _ in range(n)
    ]
    texts += [texts[3], texts[5][7:], "z" * 200, "z" * 120, "z" * 49]
    return list(enumerate(texts))


@pytest.mark.parametrize("hot_blocks", [1, 4096])
def test_repeats_equal_brute_force(spark, docs_of, monkeypatch, hot_blocks):
    for name in ("BLOCK", "LARGEST_BLOCK"):
        monkeypatch.setattr(bucket_pointers, name, 1500)  # several blocks
    rows = pasted(3)
    found = bucket_pointers.remove_repeats(docs_of(rows), keep_bytes=True, hot_blocks=hot_blocks).collect()
    expected = by_hand([(d, t.encode()) for d, t in rows])
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found} == expected
    assert all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in found)


def test_repeats_odd_rows(odd, docs_of, spark):
    found = bucket_pointers.remove_repeats(odd).collect()
    assert len(found) == 11 and all(r["n_removed"] == 0 for r in found)
    long = "a passage of well over fifty bytes that two rows without any id share"
    same = bucket_pointers.remove_repeats(docs_of([(None, long), (None, long), (1, long), (1, long)])).collect()
    assert all(r["n_removed"] == 0 for r in same)  # equal or missing doc_ids never remove
    assert bucket_pointers.remove_repeats(odd.limit(0)).count() == 0


def test_shards(odd, docs_of, spark):
    rows = [(i, "x" * (i % 7)) for i in range(3000)] + [(5, "x")] * 500
    placed = virtual_slots.shard_rows(docs_of(rows), 40).toPandas()
    assert len(placed) == len(rows)
    for _, own in placed.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    moved = placed[placed["grown_shard"] != placed["shard"]]
    assert set(moved["grown_shard"]) == {40} and 0 < len(moved) < 0.1 * len(placed)
    assert placed.groupby("doc_id")["shard"].nunique().max() == 1
    again = virtual_slots.shard_rows(docs_of(rows[:100]), 40).toPandas()
    assert again.merge(placed, on="doc_id").eval("shard_x == shard_y").all()  # other rows do not matter
    odd_rows = virtual_slots.shard_rows(odd, 40).collect()
    assert len(odd_rows) == 11
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in odd_rows}
    assert sizes[1] == (16, 0) and sizes[4] == (20, zlib.crc32(b"word"))
    assert virtual_slots.shard_rows(odd.limit(0), 40).count() == 0


def test_map_versions(spark, tmp_path):
    base = virtual_slots.first_map(spark, 4, 64)
    path = str(tmp_path / "map")
    virtual_slots.store_edits(base, path)
    virtual_slots.store_edits(virtual_slots.with_shard_added(virtual_slots.load_map(spark, path)), path)
    now = virtual_slots.load_map(spark, path).groupBy("shard").count().collect()
    assert {r["shard"]: r["count"] for r in now}[4] == 12 and max(r["count"] for r in now) == 13
    assert virtual_slots.load_map(spark, path, 1).filter("shard = 4").count() == 0
    weights = spark.range(64).select(F.col("id").cast("int").alias("slot"), F.when(F.col("id") % 4 == 0, 50).otherwise(10).alias("bytes"))
    edits = virtual_slots.levelling_edits(base, weights)
    level = virtual_slots.current(base.unionAll(edits)).join(weights, "slot").groupBy("shard").agg(F.sum("bytes").alias("b"))
    held = sorted(r["b"] for r in level.collect())
    assert held[-1] - held[0] <= 200 and edits.count() > 0  # 800 against 160 before
