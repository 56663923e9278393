"""Removal of byte strings that repeat across documents, by bucket-pointer refinement.

Suffixes start in buckets of equal q-grams and a bucket is refined by sorting on the bucket
identifiers of later offsets; identifiers found for a shorter context are used again for the next longer
one, and a bucket whose suffixes all continue alike is not refined at all. Only the order within the
first LENGTH bytes matters here, so refinement stops there.

Not every suffix travels. Each window of LENGTH bytes has a minimizer, the q-gram of least hash in it, so
equal windows share its bucket: the initial buckets are those of minimizers, about two in 26 positions.
Buckets met by one document only are dropped before any text moves. The others get the bytes
around the minimizer, on which the windows over it are refined.

Plan: documents are shuffled once, by block, and that exchange is used three times. Within a block all copies
of a segment but the one of smallest doc_id are settled at once, so a passage that very many documents
share sends one row a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm.common import table

LENGTH, Q = 50, 26
WINDOW = LENGTH - Q + 1  # q-grams in a window
SIDE = LENGTH - Q  # bytes of context on either side of a minimizer
#: Text of a block at least and at most, text worth of one bucket group, bytes hashed at a time.
BLOCK, LARGEST_BLOCK, GROUP, SLICE = 8 << 20, 256 << 20, 256 << 20, 2 << 20
#: A minimizer met in more blocks than this is dealt by its whole windows instead.
HOT_BLOCKS = 4096

_TABLE = np.random.default_rng(1).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _shifted(x: np.ndarray, n: int) -> np.ndarray:
    """x[i + n] for each i, the last value beyond the end."""
    return np.concatenate([x[n:], np.repeat(x[-1:], min(n, len(x)))])


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Hash of the run that `a` hashes followed by the one that `b` hashes n later."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + _shifted(b, n)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` bytes from each position on (meaningless where fewer are left)."""
    powers = {1: _TABLE[data]}
    n = 1
    while 2 * n <= length:
        powers[2 * n] = _joined(powers[n], powers[n], n)
        n *= 2
    out, done = powers[n], n
    while done < length:
        n = max(p for p in powers if p <= length - done)
        out, done = _joined(out, powers[n], done), done + n
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(31))


def _running(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum of x[i : i + width], or maximum of x[i - width + 1 : i + 1]."""
    pick, n = (np.minimum if least else np.maximum), 1
    x = x if least else x[::-1]
    while 2 * n <= width:
        x, n = pick(x, _shifted(x, n)), 2 * n
    if n < width:
        x = pick(x, _shifted(x, width - n))
    return x if least else x[::-1]


def minimizers(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts of whole windows, least hash in each, minimizer positions, their hashes) of concatenated
    documents; windows never cross documents. All positions that are least in some window count."""
    n = len(data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none.astype(np.uint64)
    grams = gram_hashes(data, Q)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)  # bytes left in the document
    np.maximum(grams, np.uint64(1), out=grams)
    least = _running(grams, WINDOW, True)
    whole = left >= LENGTH
    least[~whole] = 0
    chosen = np.flatnonzero((_running(least, WINDOW, False) == grams) & (left >= Q))
    windows = np.flatnonzero(whole)
    return windows, least[windows], chosen, grams[chosen]


def _leftmost(windows: np.ndarray, least: np.ndarray, chosen: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The first minimizer of each window, as an index into `chosen`."""
    at = np.searchsorted(chosen, windows)
    wrong = np.flatnonzero(hashes[at] != least)
    while len(wrong):
        at[wrong] += 1
        wrong = wrong[hashes[at[wrong]] != least[wrong]]
    return at


def _slices(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, its and the next ones' bytes, bounds) for about SLICE bytes at a time."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE):
            size += len(texts[to])
            to += 1
        bounds = np.cumsum([0, *map(len, texts[at:to])])
        yield at, np.frombuffer(b"".join(texts[at:to]), np.uint8), bounds
        at = to


def _dump(values: np.ndarray) -> bytes:
    """Structured rows, field by field; compressed, as these are most of what is shuffled."""
    return zstandard.compress(b"".join(np.ascontiguousarray(values[n]).tobytes() for n in values.dtype.names), 1)


def _load(data: list[bytes], kind: np.dtype) -> np.ndarray:
    parts = [np.zeros(0, kind)]
    for packed in data:
        raw, at = zstandard.decompress(packed), 0
        part = np.zeros(len(raw) // kind.itemsize, kind)
        for name in kind.names:
            field = kind[name]
            size = len(part) * field.itemsize
            part[name] = np.frombuffer(raw[at : at + size], field.base).reshape(part[name].shape)
            at += size
        parts.append(part)
    return np.concatenate(parts)


def _dump_sorted(hashes: np.ndarray) -> bytes:
    """Ascending hashes as their differences, byte by byte of equal rank."""
    steps = np.diff(hashes, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _load_sorted(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8")[:, 0], dtype=np.uint64)


def _texts(rows: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Texts as bytes, doc_ids, ranks, and whether there is a doc_id. The rank tells rows of one doc_id in
    a block apart: their different texts in the order of their tags; equal rows have equal ranks."""
    text = rows.column("text").combine_chunks().cast(pa.binary()).to_pylist()
    ids = rows.column("doc_id").combine_chunks()
    doc, tag = ids.fill_null(0).to_numpy(), rows.column("tag").to_numpy()
    order = np.lexsort((tag, doc))
    new_doc = np.diff(doc[order], prepend=doc[order][:1] - 1) != 0
    new_tag = new_doc | (np.diff(tag[order], prepend=tag[order][:1]) != 0)
    number = np.cumsum(new_tag) - 1
    rank = np.zeros(len(doc), np.int64)
    rank[order] = number - np.maximum.accumulate(np.where(new_doc, number, 0))
    return text, doc, rank, ids.is_valid().to_numpy(zero_copy_only=False)


def _packed(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


PASS1 = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary()), ("several", pa.binary())])


def bucket_members(rows: pa.Table, block: int, buckets: int) -> pa.Table:
    """Which minimizer buckets a block's documents meet: one row a bucket group, with the distinct hashes and
    whether several documents of the block meet each."""
    texts, doc, _, known = _texts(rows)
    found, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, data, bounds in _slices(texts):
        _, _, chosen, hashes = minimizers(data, bounds)
        row = first + np.searchsorted(bounds, chosen, side="right") - 1
        found.append(hashes[known[row]])
        owners.append(doc[row[known[row]]])
    hashes, owner = np.concatenate(found), np.concatenate(owners)
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    last = np.append(begin[1:], len(hashes)) - 1
    several = owner[begin] != owner[last]
    hashes = hashes[begin]
    group = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order])) + 1
    parts = np.split(order, cuts) if len(order) else []
    return _packed(
        [
            {"bucket": int(group[p[0]]), "block": block, "hashes": _dump_sorted(hashes[p]), "several": np.packbits(several[p]).tobytes()}
            for p in parts
        ],
        PASS1,
    )


SHARED = pa.schema([("block", pa.int32()), ("hashes", pa.binary()), ("hot", pa.binary())])


def shared_buckets(rows: pa.Table, hot_blocks: int = HOT_BLOCKS) -> pa.Table:
    """For each block, those of its minimizer buckets that at least two documents meet anywhere."""
    lists = [_load_sorted(b) for b in rows.column("hashes").to_pylist()]
    several = np.concatenate(
        [np.unpackbits(np.frombuffer(b, np.uint8), count=len(own)) for b, own in zip(rows.column("several").to_pylist(), lists, strict=True)]
    ).astype(bool)
    hashes = np.concatenate(lists)
    values, code, n = np.unique(hashes, return_inverse=True, return_counts=True)
    met = n > 1
    met[code[several]] = True
    keep, hot = met[code], (n > hot_blocks)[code]
    out, at = [], 0
    for block, own in zip(rows.column("block").to_pylist(), lists, strict=True):
        k = keep[at : at + len(own)]
        if k.any():
            out.append({"block": block, "hashes": _dump_sorted(own[k]), "hot": hot[at : at + len(own)][k].tobytes()})
        at += len(own)
    return _packed(out, SHARED)


#: Segments travel in packed columns: key, doc_id, rank, position, least and greatest offset of the minimizer
#: in a window, the bytes before it, nearest first, and those after it.
FIELDS = np.dtype(
    [("key", "<u8"), ("doc", "<i8"), ("rank", "<u4"), ("at", "<u4"), ("low", "u1"), ("high", "u1"),
     ("before", "u1", (SIDE,)), ("after", "u1", (SIDE,))]
)
SETTLED = np.dtype([("doc", "<i8"), ("rank", "<u4"), ("at", "<u4"), ("end", "<u4")])
PASS2 = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("segments", pa.binary()), ("settled", pa.binary())])


def _distinct(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by content, and where a new content begins: key, offsets, context."""
    view = segments
    words = np.concatenate([view["before"], view["after"]], axis=1).view("<u8").reshape(len(view), -1)
    ends = view["low"].astype(np.int64) * 256 + view["high"]
    order = np.lexsort((view["doc"], *words.T[::-1], ends, view["key"]))
    w, e, k = words[order], ends[order], view["key"][order]
    new = np.concatenate([[True], (w[1:] != w[:-1]).any(axis=1) | (e[1:] != e[:-1]) | (k[1:] != k[:-1])])
    return order, new


def block_segments(rows: pa.Table, shared: pa.Table, block: int, buckets: int) -> pa.Table:
    """The segments of a block that lie in shared buckets, dealt by bucket group. Of equal segments only
    those of the smallest doc_id travel; the others are settled: all their windows repeat."""
    if not rows.num_rows or not shared.num_rows:
        return PASS2.empty_table()
    texts, doc, rank, known = _texts(rows)
    hashes = np.concatenate([_load_sorted(b) for b in shared.column("hashes").to_pylist()])
    hot = np.concatenate([np.frombuffer(b, bool) for b in shared.column("hot").to_pylist()])
    order = np.argsort(hashes)
    hashes, hot = hashes[order], hot[order]
    parts = [np.zeros(0, FIELDS)]
    for first, data, bounds in _slices(texts):
        windows, least, chosen, values = minimizers(data, bounds)
        place = np.minimum(np.searchsorted(hashes, least), len(hashes) - 1)
        row = np.searchsorted(bounds, windows, side="right") - 1
        use = (hashes[place] == least) & known[first + row]
        windows, least, place, row = windows[use], least[use], place[use], row[use]
        if not len(windows):
            continue
        at = chosen[_leftmost(windows, least, chosen, values)]
        alone = hot[place]
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1) | alone[1:]])
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(windows)) - 1
        out = np.zeros(len(begin), FIELDS)
        out["key"] = least[begin]
        where = first + row[begin]
        out["doc"], out["rank"] = doc[where], rank[where]
        out["at"] = at[begin] - bounds[row[begin]]
        out["high"], out["low"] = at[begin] - windows[begin], at[begin] - windows[last]
        padded = np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(LENGTH, np.uint8)])
        steps = np.arange(SIDE)
        before = padded[at[begin][:, None] + (SIDE - 1 - steps)]
        out["before"] = np.where(steps < out["high"][:, None], before, 0)
        after = padded[at[begin][:, None] + SIDE + Q + steps]
        out["after"] = np.where(steps < SIDE - out["low"][:, None], after, 0)
        if alone.any():
            # a hot minimizer's windows are dealt by a hash of all their bytes
            whole = gram_hashes(data, LENGTH)[windows[begin]]
            single = alone[begin]
            out["key"][single] = whole[single]
        parts.append(out)
    segments = np.concatenate(parts)
    if not len(segments):
        return PASS2.empty_table()
    order, new = _distinct(segments)
    segments = segments[order]
    smallest = segments["doc"][np.flatnonzero(new)][np.cumsum(new) - 1]
    repeat = segments["doc"] > smallest
    settled = np.zeros(int(repeat.sum()), SETTLED)
    own = segments[repeat]
    settled["doc"], settled["rank"] = own["doc"], own["rank"]
    settled["at"], settled["end"] = own["at"] - own["high"], own["at"] - own["low"] + np.uint32(LENGTH)
    segments = segments[~repeat]
    group = (segments["key"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    out = [
        {"bucket": int(group[p[0]]), "block": block, "segments": _dump(segments[p]), "settled": None}
        for p in np.split(order, np.flatnonzero(np.diff(group[order])) + 1)
    ]
    out[0]["settled"] = _dump(settled)
    return _packed(out, PASS2)


def _refined(ids: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Bucket identifiers after one more byte."""
    return np.unique(ids * 256 + byte, return_inverse=True)[1].astype(np.int64)


REPEATS = pa.schema([("block", pa.int32()), ("spans", pa.binary())])


def repeated_spans(rows: pa.Table) -> pa.Table:
    """Spans of windows that also start in a document of smaller doc_id, sorted out by block."""
    packed, blocks = rows.column("segments").to_pylist(), np.array(rows.column("block").to_pylist(), np.int64)
    lists = [_load([b], FIELDS) for b in packed]
    segments, home = np.concatenate(lists), np.repeat(blocks, [len(x) for x in lists])
    spans, homes = [np.zeros(0, SETTLED)], [np.zeros(0, np.int64)]
    for block, settled in zip(blocks.tolist(), rows.column("settled").to_pylist(), strict=True):
        if settled:
            spans.append(_load([settled], SETTLED))
            homes.append(np.full(len(spans[-1]), block))

    def add(part: np.ndarray, block: np.ndarray, high: np.ndarray, low: np.ndarray) -> None:
        out = np.zeros(len(part), SETTLED)
        out["doc"], out["rank"] = part["doc"], part["rank"]
        at = part["at"].astype(np.int64)
        out["at"], out["end"] = at - high, at - low + LENGTH
        spans.append(out)
        homes.append(block)

    if len(segments):
        order, new = _distinct(segments)
        segments, home = segments[order], home[order]
        begin = np.flatnonzero(new)
        code = np.cumsum(new) - 1
        first = segments["doc"][begin]  # the smallest doc_id of each distinct segment
        # buckets in which all segments are the same need no refinement
        key = segments["key"][begin]
        _, bucket, n = np.unique(key, return_inverse=True, return_counts=True)
        open_ = (n > 1)[bucket]
        which = (segments["doc"] > first[code]) & ~open_[code]
        simple = segments[which]
        add(simple, home[which], simple["high"], simple["low"])
        if open_.any():
            own = segments[begin[open_]]
            doc = first[open_]
            left, right = [bucket[open_].astype(np.int64)], [bucket[open_].astype(np.int64)]
            for k in range(SIDE):
                left.append(_refined(left[-1], own["before"][:, k]))
                right.append(_refined(right[-1], own["after"][:, k]))
            least = np.full((len(own), SIDE + 1), np.iinfo(np.int64).max)
            for k in range(SIDE + 1):  # windows in which k bytes stand before the minimizer
                inside = np.flatnonzero((own["low"] <= k) & (k <= own["high"]))
                if len(inside):
                    pair = left[k][inside] * (len(own) + 1) + right[SIDE - k][inside]
                    _, at = np.unique(pair, return_inverse=True)
                    smallest = np.full(int(at.max()) + 1, np.iinfo(np.int64).max)
                    np.minimum.at(smallest, at, doc[inside])
                    least[inside, k] = smallest[at]
            number = np.cumsum(open_) - 1
            members, where = segments[open_[code]], home[open_[code]]
            rowwise = least[number[code[open_[code]]]]
            hit = rowwise < members["doc"][:, None]
            r, k = np.nonzero(hit)
            # consecutive offsets make one span
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1] + 1)]) if len(r) else np.zeros(0, bool)
            start = np.flatnonzero(new)
            stop = np.append(start[1:], len(r)) - 1
            add(members[r[start]], where[r[start]], k[stop], k[start])
    found, block = np.concatenate(spans), np.concatenate(homes)
    if not len(found):
        return REPEATS.empty_table()
    order = np.argsort(block, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(block[order])) + 1)
    return _packed([{"block": int(block[p[0]]), "spans": _dump(found[p])} for p in parts], REPEATS)


CLEANED = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
     ("kept_sha256", pa.string()), ("kept", pa.binary())]
)


def cleaned_block(rows: pa.Table, spans: pa.Table, keep_bytes: bool) -> pa.Table:
    texts, doc, rank, known = _texts(rows)
    found = _load(spans.column("spans").to_pylist(), SETTLED)
    found = found[np.lexsort((found["at"], found["rank"], found["doc"]))]
    starts: dict[tuple[int, int], slice] = {}
    if len(found):
        new = np.concatenate([[True], (found["doc"][1:] != found["doc"][:-1]) | (found["rank"][1:] != found["rank"][:-1])])
        begin = np.flatnonzero(new)
        for a, b in zip(begin.tolist(), np.append(begin[1:], len(found)).tolist(), strict=True):
            starts[int(found["doc"][a]), int(found["rank"][a])] = slice(a, b)
    out = []
    for k, text in enumerate(texts):
        own = starts.get((int(doc[k]), int(rank[k]))) if known[k] else None
        kept, removed, runs, at = [], 0, 0, 0
        if own is not None:
            end = -1
            for a, b in zip(found["at"][own].tolist(), found["end"][own].tolist(), strict=True):
                if a > end or end < 0:
                    kept.append(text[at:a])
                    runs += 1
                    removed += b - a
                    end = b
                elif b > end:
                    removed += b - end
                    end = b
                at = end
        kept.append(text[at:])
        rest = b"".join(kept)
        out.append(
            {"doc_id": int(doc[k]) if known[k] else None, "n_bytes": len(text), "n_removed": removed, "n_spans": runs,
             "kept_sha256": hashlib.sha256(rest).hexdigest(), "kept": rest if keep_bytes else None}
        )
    return _packed(out, CLEANED)


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def remove_repeats(docs: DataFrame, keep_bytes: bool = False, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document: bytes that lie in a
    50-byte string which also starts in a document of smaller doc_id are removed, judged on the input.
    `kept` holds the remaining bytes if `keep_bytes`.

    A missing text is empty. Texts under 50 bytes keep all. Rows of equal doc_id do not remove from each
    other; rows without doc_id lose nothing and remove nothing. A string may repeat within its own document.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // GROUP)
    blocks = max(1, total // min(LARGEST_BLOCK, max(BLOCK, 650 * buckets)))
    tag = F.xxhash64(text)
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    mixed = tag.bitwiseXOR(F.shiftleft(number, 5) - number).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), tag.alias("tag"), (mixed % blocks).cast("int").alias("block")
    )
    by_block = rows.groupBy("block")

    def members(key: tuple, own: pa.Table) -> pa.Table:
        return bucket_members(own, key[0].as_py(), buckets)

    met = by_block.applyInArrow(members, _ddl(PASS1))
    shared = met.groupBy("bucket").applyInArrow(lambda own: shared_buckets(own, hot_blocks), _ddl(SHARED))
    segments = by_block.cogroup(shared.groupBy("block")).applyInArrow(
        lambda key, own, other: block_segments(own, other, key[0].as_py(), buckets), _ddl(PASS2)
    )
    spans = segments.groupBy("bucket").applyInArrow(repeated_spans, _ddl(REPEATS))
    return by_block.cogroup(spans.groupBy("block")).applyInArrow(
        lambda own, other: cleaned_block(own, other, keep_bytes), _ddl(CLEANED)
    )


def op1_bucket_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
