import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tenura.llm import simple8b, two_fit  # noqa: E402
from tenura.llm.tokens import WordTokenizer  # noqa: E402

TEXTS = [
    "", " ", "  ", "a  b", "a   b", " x", "x ", "\n a", "a\n\n b\n", "it's don't we'll 'tis", "x\ny z!\n", "a.\nIt b\n\nc d\n",
    "<|endoftext|>x <|endoftext|>", "<|ENDOFTEXT|> A", "ÉCOLE ñandú ŞŻ İ", "a  b", "a\x1c\x1db !\x1c", "１２３ 45 a1b2",
    "日本語 テキスト", "é café", "ΑΣ Σ", "😀😀 x", "\t\tx \ty", "a_b-c@d #$%", " ́b", "The and thanedble the, anea. Eriner\nThen",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name):
    path = public_tokenizers.path(name)
    library, words = Tokenizer.from_file(path), WordTokenizer(path)
    for _ in range(2):  # the second time from memory
        ids, bounds = words.encode(pa.array(TEXTS))
        for k, text in enumerate(TEXTS):
            assert library.encode(text, add_special_tokens=False).ids == ids[bounds[k] : bounds[k + 1]].tolist(), text


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for k in range(200):
        n = int(rng.integers(0, 9000 if k % 20 == 0 else 300))
        wide = rng.integers(0, 2**64, n, dtype=np.uint64) >> rng.integers(0, 64, n).astype(np.uint64)
        values = wide if k % 2 else wide & np.uint64(0xFFFF)
        image = simple8b.write_file(np.array([4, 9]), np.array([n // 3, n - n // 3]), values)
        assert (simple8b.read_ids(image) == values).all()
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert (simple8b.read_ids(image, a, b) == values[a:b]).all()
    escapes = np.array([2**63, (15 << 60) + 1, 15 << 60, 1, 15 << 60], np.uint64)
    assert (simple8b.unpack_words(simple8b.pack_block(escapes)) == escapes).all()
    with pytest.raises(ValueError):
        simple8b.open_file(b"\0" * 64)


def test_files_hold_all_documents(docs_of, odd, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(simple8b, "FILE", 200)
    rows = [(i * 7 % 500, f"word{i} and more " * (i % 30)) for i in range(500)]
    found = simple8b.read_files(simple8b.write_files(docs_of(rows), path)).orderBy("doc_id").collect()
    library, start = Tokenizer.from_file(path), 0
    for (doc_id, text), r in zip(sorted(rows), found, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc_id, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    odd_rows = simple8b.read_files(simple8b.write_files(odd, path)).collect()
    assert len(odd_rows) == 11 and sum(r["doc_id"] is None for r in odd_rows) == 2
    assert min(odd_rows, key=lambda r: r["start"])["doc_id"] is None
    assert simple8b.read_files(simple8b.write_files(odd.limit(0), path)).count() == 0


def one_by_one(lengths, capacity):
    """The method without a histogram: one bin at a time from a sorted list."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        taken, gap = [], capacity
        for x in list(left):
            if x <= gap:
                taken.append(x)
                left.remove(x)
                gap -= x
        if gap and len(taken) > 1:
            s = taken[-1]
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if s < a + b <= gap + s]
            if pairs:
                _, a, b = max(pairs)
                taken.remove(s)
                left.append(s)
                for x in (a, b):
                    left.remove(x)
                    taken.append(x)
                left.sort(reverse=True)
        bins.append(sum(taken))
    return bins


def test_plan_equals_one_by_one():
    rng = np.random.default_rng(2)
    for k in range(60):
        lengths = rng.integers(1, 60, int(rng.integers(1, 200))).tolist()
        values, counts = np.unique(lengths, return_counts=True)
        patterns = two_fit.plan(dict(zip(values.tolist(), counts.tolist(), strict=True)), 64)
        filled = [sum(length * n for length, n in uses.items()) for _, repeats, uses in patterns for _ in range(repeats)]
        assert sum(filled) == sum(lengths) and max(filled) <= 64
        assert len(filled) <= len(one_by_one(lengths, 64)) + 1


def test_packing(docs_of, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, "token stream " * (i % 90)) for i in range(400)]
    for frame, n in ((docs_of(rows), 400), (odd, 11)):
        packed = two_fit.pack(frame, path, capacity=64, with_ids=True).toPandas()
        assert (packed["ids"].map(zlib.crc32) == packed["ids_crc32"]).all() and (packed["length"] <= 64).all()
        for _, own in packed.sort_values("offset").groupby("sequence_id"):
            assert (own["offset"] == own["length"].cumsum() - own["length"]).all() and own["length"].sum() <= 64
        assert len(packed[packed["piece"] == 0]) == n
    library = Tokenizer.from_file(path)
    packed = two_fit.pack(docs_of(rows), path, capacity=64, with_ids=True).toPandas()
    for doc_id, own in packed.sort_values("piece").groupby("doc_id"):
        ids = np.frombuffer(b"".join(own["ids"]), "<u4").tolist()
        assert ids == library.encode(rows[doc_id][1], add_special_tokens=False).ids + [2]
        assert (own["length"].iloc[1:] == 64).all()
    assert two_fit.pack(odd.limit(0), path).count() == 0
