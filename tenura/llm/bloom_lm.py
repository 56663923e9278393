"""N-gram scores from a log-frequency Bloom filter.

Counts are quantised to powers of two, and an n-gram of level q puts the events (n-gram, 1) to (n-gram, q)
into a Bloom filter. Its level is read back by probing 1, 2, ... until a probe misses, so errors are one-sided
and rare; a level is never above those of the n-gram's own beginning and end. Probabilities are smoothed by
the next shorter n-gram (Dirichlet prior).

The filter grows with the corpus at a fixed number of bits an event, in segments by hash. As long as all
segments together stay below FILTER_BYTES they are broadcast; a larger filter stays where it is and slices of
documents send their n-grams to the segments instead: same levels, same scores.

Exact counts of words serve the base score: words that make up a fair share of all tokens are broadcast (their
number is bounded by that share), all others meet their counts by shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.lineage import dropped, staged
from tenura.llm.common import table

ORDER = 2
#: Weight of the shorter n-gram's probability, in tokens: the best power of two on held-out texts was 256 or 512.
PRIOR = 256.0
#: Bits of the filter and probes for each event.
BITS, PROBES = 8, 4
#: A word is broadcast if it makes up a HOT-th of all tokens: at most HOT words, 16 bytes each.
HOT = 1 << 21
#: Bytes of text for which the filter gets one segment, and that are split into words at once.
SEGMENT, SLICE = 1 << 24, 1 << 21
#: A filter up to this size is broadcast.
FILTER_BYTES = 100_000_000
#: Distinct n-grams that a task holds before it hands them on.
HELD = 1 << 21
ROWS = 1 << 20

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Mean count of each level; level q holds counts from 2^(q-1) to 2^q - 1.
MEAN = np.array([0.0, *((2.0 ** (q - 1) + 2.0**q - 1) / 2 for q in range(1, 65))])
#: Local keys of n-grams have 40 bits beside their segment: collisions are far rarer than the filter's errors.
LOCAL = U((1 << 40) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Tokens(NamedTuple):
    """The tokens of a slice of texts: `stream` names a word (row of `high`, `low`) each, the last one of
    every text being the end token; text i has the tokens from bounds[i] to bounds[i + 1]."""

    stream: np.ndarray
    bounds: np.ndarray
    high: np.ndarray
    low: np.ndarray


def tokens_of(texts: pa.Array) -> Tokens:
    """Lower-case A-Z, cut at white space, and hash the distinct words to 128 bits."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = LOWER[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    solid = ~SPACE[data]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    starts[first] = solid[first]  # a text's first byte begins a word, whatever the text before ends with
    starts = np.flatnonzero(starts)
    squeezed = data[solid]
    at = np.append((np.cumsum(solid) - 1)[starts], len(squeezed)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(squeezed)])
    coded = words.dictionary_encode()
    digest = xxhash.xxh3_128_digest
    # no word holds a space: it stands for the end token
    hashes = np.frombuffer(b"".join([*map(digest, coded.dictionary.to_pylist()), digest(b" ")]), ">u8").reshape(-1, 2)
    upto = np.searchsorted(starts, offsets)
    stream = np.insert(coded.indices.to_numpy().astype(np.int64), upto[1:], len(hashes) - 1)
    return Tokens(stream, upto + np.arange(len(upto)), *hashes.astype(U).T.copy())


def grams(t: Tokens, order: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, the key of the k-gram that ends at each token) for k from 2; end tokens stand before a text."""
    own, last = t.high[t.stream], t.high[-1]
    keys, before = own, last
    for k in range(2, order + 1):
        history = np.roll(keys, 1)
        history[t.bounds[:-1]] = before
        step = U(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64)
        with np.errstate(over="ignore"):
            keys = mixed(history * step + own)
            before = mixed(np.array([before * step + last], U))[0]
        yield k, keys


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[new], *(np.add.reduceat(c[order], new, dtype=np.int64) if len(new) else c for c in counts)


def narrow(counts: np.ndarray) -> bytes:
    """Integers in the fewest bytes that hold them all."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes()


def wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def pack_keys(keys: np.ndarray, kind: int) -> bytes:
    """64-bit keys of words, 40-bit keys of longer n-grams."""
    return keys.astype("<u8").tobytes() if kind == 1 else keys.astype("<u4").tobytes() + (keys >> U(32)).astype("u1").tobytes()


def unpack_keys(data: bytes, kind: int) -> np.ndarray:
    if kind == 1:
        return np.frombuffer(data, "<u8").astype(U)
    n = len(data) // 5
    return np.frombuffer(data, "<u4", n).astype(U) | np.frombuffer(data, "u1", n, 4 * n).astype(U) << U(32)


def dealt(t: Tokens, kind: int, keys: np.ndarray | None, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and local key: of the slice's words (kind 1), or of the given n-grams."""
    if kind == 1:
        return (t.high % U(segments)).astype(np.int64), t.low
    return ((keys >> U(40)) % U(segments)).astype(np.int64), keys & LOCAL


def by_segment(segment: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal segments of a sorted array."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [len(segment)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a < b:
            yield int(segment[a]), slice(a, b)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with a text column, cut to bounded text (one longer text is a slice of its own) and rows."""
    for batch in batches:
        offsets = batch.column("text").cast(pa.large_string())
        ends = np.frombuffer(offsets.buffers()[1], np.int64)[offsets.offset + 1 : offsets.offset + len(offsets) + 1]
        at = 0
        while at < batch.num_rows:
            begin = ends[at - 1] if at else ends[0] - len(batch.column("text")[0].as_buffer())
            to = min(max(int(np.searchsorted(ends, begin + SLICE, side="right")), at + 1), at + ROWS, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


# --- the filter --------------------------------------------------------------------------------------------


class Filter(NamedTuple):
    """Segments of one kind of n-gram, end to end: segment s has bits[s] bits from byte starts[s]."""

    bits: np.ndarray
    starts: np.ndarray
    image: np.ndarray

    def _all_set(self, segment: np.ndarray, keys: np.ndarray, level: int) -> np.ndarray:
        """Places of the keys whose event of this level is in the filter: all PROBES bits are set."""
        kept = np.arange(len(keys))
        bits, starts = self.bits[segment], self.starts[segment]
        for spot in probes(keys, level, bits):
            place = starts[kept] + (spot[kept] >> U(3)).astype(np.int64)
            kept = kept[(self.image[place] >> (spot[kept] & U(7)).astype(np.uint8)) & 1 == 1]
        return kept

    def levels(self, segment: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The level of each key, by probes of level 1, 2, ... until one misses; 0 if the first does."""
        out = np.zeros(len(keys), np.uint8)
        live = np.flatnonzero(self.bits[segment])
        for level in range(1, len(MEAN)):
            live = live[self._all_set(segment[live], keys[live], level)]
            if not len(live):
                break
            out[live] = level
        return out


def probes(keys: np.ndarray, level: int, bits: np.ndarray) -> Iterator[np.ndarray]:
    """The PROBES bit places of the events (key, level) in filters of `bits` bits."""
    with np.errstate(over="ignore"):
        spot = mixed(keys * U(0x9E3779B97F4A7C15) + U(level))
        step = mixed(spot) | U(1)
        for _ in range(PROBES):
            yield ((spot >> U(32)) * bits) >> U(32)
            spot = spot + step


def filled(keys: np.ndarray, counts: np.ndarray, per_event: int = BITS) -> tuple[int, bytes]:
    """Bits and image of the filter of one segment; level q stands for counts from 2^(q-1)."""
    levels = np.frexp(counts.astype(float))[1]
    bits = max(64, -(-per_event * int(levels.sum()) // 8) * 8)
    if bits >= 1 << 32:
        raise ValueError("a segment is too large")
    image = np.zeros(bits, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for spot in probes(keys[levels >= level], level, U(bits)):
            image[spot.astype(np.int64)] = True
    return bits, np.packbits(image, bitorder="little").tobytes()


def joined(rows: Iterable, segments: int, size: int) -> Filter:
    """A filter of `size` bytes from rows (segment, bits, image), taken one by one."""
    bits, starts = np.zeros(max(segments, 1), U), np.zeros(max(segments, 1), np.int64)
    image, at = np.zeros(size, np.uint8), 0
    for r in rows:
        own = np.frombuffer(r["image"], np.uint8)
        bits[r["segment"]], starts[r["segment"]] = r["bits"], at
        image[at : at + len(own)] = own
        at += len(own)
    return Filter(bits, starts, image)


# --- counting ----------------------------------------------------------------------------------------------

COUNTS = "kind int, segment long, keys binary, counts binary, alls binary"
SEGMENTS = (
    "kind int, segment long, n_keys long, tokens long, all_tokens long, bits long, image binary, keys binary, "
    "counts binary, alls binary"
)


def compact(segment: np.ndarray, keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """A slice's counts in the bytes they need (a slice has fewer than 2^32 tokens)."""
    return segment.astype(np.uint32), keys, *(c.astype(np.uint32) for c in counts)


def _counted(docs: DataFrame, order: int, segments: int) -> DataFrame:
    """Counts of all n-grams, added up in each task: a row for each kind and segment that a task meets. Words are
    counted in all rows (`alls`) and in those to learn from (`counts`), longer n-grams in the latter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {k: [] for k in range(1, order + 1)}
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if not parts:
                    continue
                segment, keys, *counts = (np.concatenate(c) for c in zip(*parts, strict=True))
                parts.clear()
                by = np.argsort(segment, kind="stable")
                segment, keys, counts = segment[by], keys[by], [c[by] for c in counts]
                rows = []
                for s, own in by_segment(segment):
                    distinct, *sums = summed(keys[own], *(c[own] for c in counts))
                    alls = narrow(sums[1]) if kind == 1 else None
                    rows.append(
                        {"kind": kind, "segment": s, "keys": pack_keys(distinct, kind), "counts": narrow(sums[0]), "alls": alls}
                    )
                yield pa.RecordBatch.from_pylist(rows, schema)

        schema = pa.schema(
            [("kind", pa.int32()), ("segment", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("alls", pa.binary())]
        )
        for part in slices(batches):
            t = tokens_of(part.column("text"))
            learn = np.repeat(part.column("learn").to_numpy(zero_copy_only=False), np.diff(t.bounds))
            size = len(t.low)
            both = np.bincount(t.stream[learn], minlength=size), np.bincount(t.stream, minlength=size)
            held[1].append(compact(*dealt(t, 1, None, segments), *both))
            n += size
            for k, keys in grams(t, order):
                distinct, times = np.unique(keys[learn], return_counts=True)
                held[k].append(compact(*dealt(t, k, distinct, segments), times))
                n += len(distinct)
            if n >= HELD:
                yield from flush()
                n = 0
        yield from flush()

    return docs.select("text", "learn").mapInArrow(count, COUNTS)


def _build(key: tuple, group: pa.Table, per_event: int) -> pa.Table:
    """One segment: exact counts of its words, and the filter of its keys that were learned from."""
    kind, segment = (k.as_py() for k in key)
    rows = group.to_pylist()
    keys = [unpack_keys(r["keys"], kind) for r in rows]
    counts = [[wide(r[c], len(k)) for r, k in zip(rows, keys, strict=True)] for c in (("counts", "alls") if kind == 1 else ("counts",))]
    distinct, *sums = summed(np.concatenate(keys), *map(np.concatenate, counts))
    learned = sums[0] > 0
    bits, image = filled(distinct[learned], sums[0][learned], per_event)
    row = {
        "kind": kind, "segment": segment, "n_keys": int(learned.sum()), "tokens": int(sums[0].sum()),
        "all_tokens": int(sums[-1].sum()), "bits": bits, "image": image,
        "keys": pack_keys(distinct, 1) if kind == 1 else None,
        "counts": narrow(sums[0]) if kind == 1 else None, "alls": narrow(sums[1]) if kind == 1 else None,
    }
    return pa.Table.from_pylist([row], pa.schema(
        [("kind", pa.int32()), ("segment", pa.int64()), ("n_keys", pa.int64()), ("tokens", pa.int64()),
         ("all_tokens", pa.int64()), ("bits", pa.int64()), ("image", pa.binary()), ("keys", pa.binary()),
         ("counts", pa.binary()), ("alls", pa.binary())]
    ))


class Model(NamedTuple):
    """`segments` has a row for each kind of n-gram and segment: the filter, and for words exact counts.
    `tokens` and `words` are the tokens learned from and their distinct words, `hot` and `hot_counts` the words
    of at least a HOT-th of all counted tokens with their counts."""

    segments: DataFrame
    n_segments: int
    order: int
    tokens: int
    words: int
    filter_bytes: int
    hot: np.ndarray
    hot_counts: np.ndarray


def fit(docs: DataFrame, order: int = ORDER, segment_bytes: int = SEGMENT, hot: int = HOT, per_event: int = BITS) -> Model:
    """Count the n-grams of `docs` (text, learn) and build the filter.

    The filter takes `per_event` bits for each event, whatever the corpus; its segments are as many as keep one in a
    task. Each segment is built in one task from the sums of all others: a word pair that is in every text
    arrives once a task. The driver gets sums, and the words frequent enough to be broadcast, whose number
    `hot` bounds.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-size // segment_bytes))
    build = lambda key, group: _build(key, group, per_event)
    segments = staged(_counted(docs, order, n).groupBy("kind", "segment").applyInArrow(build, SEGMENTS))
    sums = segments.agg(
        F.sum(F.expr("if(kind = 1, tokens, 0)")).alias("tokens"),
        F.sum(F.expr("if(kind = 1, all_tokens, 0)")).alias("all_tokens"),
        F.sum(F.expr("if(kind = 1, n_keys, 0)")).alias("words"),
        F.sum(F.expr("octet_length(image) + 0L")).alias("bytes"),
    ).first()
    least = max(1, -(-(sums["all_tokens"] or 0) // hot))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = unpack_keys(row["keys"], 1)
                often = wide(row["alls"], len(keys)) >= least
                own = keys[often].astype("<u8").tobytes(), wide(row["counts"], len(keys))[often].astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([o], pa.binary()) for o in own], ["keys", "counts"])

    words = segments.filter("kind = 1").select("keys", "counts", "alls").mapInArrow(frequent, "keys binary, counts binary").collect()
    keys = np.frombuffer(b"".join(r["keys"] for r in words), "<u8").astype(U)
    counts = np.frombuffer(b"".join(r["counts"] for r in words), "<i8").astype(np.int64)
    by = np.argsort(keys)
    return Model(segments, n, order, sums["tokens"] or 0, sums["words"] or 0, sums["bytes"] or 0, keys[by], counts[by])


# --- scoring -----------------------------------------------------------------------------------------------

Lookup = Callable[[int, np.ndarray, np.ndarray], np.ndarray]

SCORED = (
    "segment long, row long, doc_id long, learn boolean, n_tokens long, n_known long, base_score double, score double, "
    "keys binary, rows binary, times binary, counts binary"
)
FIELDS = [
    ("segment", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("learn", pa.bool_()), ("n_tokens", pa.int64()),
    ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("keys", pa.binary()),
    ("rows", pa.binary()), ("times", pa.binary()), ("counts", pa.binary()),
]
TABLE = pa.schema(FIELDS)
RESULT = pa.schema([FIELDS[k] for k in (2, 3, 4, 5, 6, 7)])


def log_probabilities(t: Tokens, lookup: Lookup, order: int, tokens: int, words: int, segments: int, prior: float) -> np.ndarray:
    """log10 of each token's smoothed probability. A level is bounded by those of the n-gram's beginning and
    end: what cannot have been counted is not asked."""
    word_level = lookup(1, *dealt(t, 1, None, segments))
    level = word_level[t.stream]
    chance = np.minimum((MEAN[word_level] + 1) / (tokens + words + 1), 1.0)[t.stream]
    end = word_level[-1]
    for k, keys in grams(t, order):
        history = np.roll(level, 1)
        history[t.bounds[:-1]] = end
        bound = np.minimum(level, history)
        level = np.zeros(len(keys), np.uint8)
        asked = np.flatnonzero(bound)
        level[asked] = np.minimum(lookup(k, *dealt(t, k, keys[asked], segments)), bound[asked])
        seen = MEAN[history]
        chance = (MEAN[level] + prior * chance) / (seen + prior)
        if k < order:
            start = mixed_start(t, k)
            end = lookup(k, *dealt(t, k, start, segments))[0]
    return np.log10(chance)


def mixed_start(t: Tokens, k: int) -> np.ndarray:
    """The key of k end tokens in a row."""
    ends = Tokens(np.full(1, len(t.low) - 1), np.array([0, 1]), t.high, t.low)
    return dict(grams(ends, k))[k]


def _scored(part: pa.RecordBatch, first: int, lookup: Lookup, model: Model, prior: float) -> Iterator[pa.RecordBatch]:
    """A row for each text of a slice, with the share of frequent words in its base score, and the other words as
    requests to their segments."""
    t = tokens_of(part.column("text"))
    logs = log_probabilities(t, lookup, model.order, model.tokens, model.words, model.n_segments, prior)
    at = np.minimum(np.searchsorted(model.hot, t.low), max(len(model.hot) - 1, 0))
    known = model.hot[at] == t.low if len(model.hot) else np.zeros(len(t.low), bool)
    counts = np.where(known, model.hot_counts[at], 0) if len(model.hot) else np.zeros(len(t.low), np.int64)
    terms = np.where(known, np.log10((counts + 1) / (model.tokens + model.words + 1)), 0.0)
    of_text = lambda values: np.add.reduceat(values, t.bounds[:-1])
    n, rows = part.num_rows, first + np.arange(part.num_rows)
    nothing = pa.nulls(n, pa.binary())
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, -1 - first)), pa.array(rows), part.column("doc_id"), part.column("learn"),
         pa.array(np.diff(t.bounds)), pa.array(of_text((counts > 0).astype(np.int64)[t.stream])),
         pa.array(of_text(terms[t.stream])), pa.array(of_text(logs)), nothing, nothing, nothing, nothing],
        schema=TABLE,
    )
    rare = np.flatnonzero(~known[t.stream])
    text = np.repeat(np.arange(n), np.diff(t.bounds))[rare]
    pairs, times = np.unique(t.stream[rare] * n + text, return_counts=True)
    word, text = np.divmod(pairs, n)
    segment, keys = dealt(t, 1, None, model.n_segments)
    by = np.argsort(segment[word], kind="stable")
    word, text, times = word[by], text[by], times[by]
    requests = [
        {"segment": s, "row": first, "keys": keys[word[own]].astype("<u8").tobytes(),
         "rows": text[own].astype("<u4").tobytes(), "times": narrow(times[own])}
        for s, own in by_segment(segment[word])
    ]
    yield pa.RecordBatch.from_pylist(requests, TABLE)


def _slice_number(k: int) -> int:
    """The first row number of a task's k-th slice."""
    return (TaskContext.get().partitionId() << 40) | (k << 20)


def _scored_by_broadcast(docs: DataFrame, model: Model, prior: float) -> tuple[DataFrame, Broadcast]:
    sizes = {r["kind"]: r["size"] for r in model.segments.groupBy("kind").agg(F.sum(F.expr("octet_length(image) + 0L")).alias("size")).collect()}
    kinds = {}
    for k in range(1, model.order + 1):
        rows = model.segments.filter(F.col("kind") == k).select("segment", "bits", "image").coalesce(8)
        kinds[k] = joined(rows.toLocalIterator(), model.n_segments, sizes.get(k, 0))
    sent = docs.sparkSession.sparkContext.broadcast((kinds, model._replace(segments=None)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, facts = sent.value
        lookup = lambda kind, segment, keys: filters[kind].levels(segment, keys)
        for k, part in enumerate(slices(batches)):
            yield from _scored(part, _slice_number(k), lookup, facts, prior)

    return docs.mapInArrow(score, SCORED), sent


def _scored_by_segments(docs: DataFrame, model: Model, prior: float) -> tuple[DataFrame, Broadcast]:
    """The same without a broadcast of the filter: each slice sends its distinct n-grams to the segments and gets
    their levels back in the order in which it sent them."""
    sent = docs.sparkSession.sparkContext.broadcast(model._replace(segments=None))
    fields = [("slice", pa.int64()), ("doc_id", pa.int64()), ("learn", pa.bool_()), ("text", pa.string())]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, part in enumerate(slices(batches)):
            own = [pa.array(np.full(part.num_rows, _slice_number(k))), *(part.column(c).cast(t) for c, t in fields[1:])]
            yield pa.RecordBatch.from_arrays(own, schema=pa.schema(fields))

    numbered = staged(docs.mapInArrow(number, "slice long, doc_id long, learn boolean, text string"))

    def asked(t: Tokens) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(kind, segment, places, keys) of what a slice may need; places are those in `wanted` of the kind."""
        facts = sent.value
        for kind, wanted in [(1, t.high), *grams(t, facts.order), *((k, mixed_start(t, k)) for k in range(2, facts.order))]:
            segment, keys = dealt(t, kind, wanted, facts.n_segments)
            by = np.lexsort((keys, segment))
            for s, own in by_segment(segment[by]):
                yield kind, s, by[own], keys[by[own]]

    def ask(key: tuple, group: pa.Table) -> pa.Table:
        rows = []
        for kind, s, _, keys in asked(tokens_of(group.column("text").combine_chunks())):
            rows.append({"slice": key[0].as_py(), "kind": kind, "segment": s, "keys": pack_keys(np.unique(keys), kind)})
        return pa.Table.from_pylist(rows, pa.schema([("slice", pa.int64()), ("kind", pa.int32()), ("segment", pa.int64()), ("keys", pa.binary())]))

    def answer(key: tuple, ask: pa.Table, filters: pa.Table) -> pa.Table:
        kind, segment = (k.as_py() for k in key)
        held = [r | {"segment": 0} for r in filters.select(["bits", "image"]).to_pylist()]
        own = joined(held, 1, sum(len(r["image"]) for r in held))
        rows = []
        for r in ask.to_pylist():
            keys = unpack_keys(r["keys"], kind)
            levels = own.levels(np.zeros(len(keys), np.int64), keys).tobytes()
            rows.append({"slice": r["slice"], "kind": kind, "segment": segment, "keys": r["keys"], "levels": levels})
        return pa.Table.from_pylist(rows, pa.schema([("slice", pa.int64()), ("kind", pa.int32()), ("segment", pa.int64()), ("keys", pa.binary()), ("levels", pa.binary())]))

    def finish(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        got = {}
        for r in answers.to_pylist():
            keys, levels = unpack_keys(r["keys"], r["kind"]), np.frombuffer(r["levels"], np.uint8)
            had = got.get((r["kind"], r["segment"]))
            got[r["kind"], r["segment"]] = (keys, levels) if had is None else tuple(map(np.concatenate, zip(had, (keys, levels), strict=True)))

        def lookup(kind: int, segment: np.ndarray, keys: np.ndarray) -> np.ndarray:
            out = np.zeros(len(keys), np.uint8)
            by = np.argsort(segment, kind="stable")
            for s, own in by_segment(segment[by]):
                known, levels = got[kind, s]
                order = np.argsort(known)
                out[by[own]] = levels[order[np.searchsorted(known, keys[by[own]], sorter=order)]]
            return out

        part = rows.combine_chunks().to_batches()[0] if rows.num_rows else None
        found = _scored(part, key[0].as_py(), lookup, sent.value, prior) if part else []
        return pa.Table.from_batches(list(found), TABLE)

    requests = numbered.groupBy("slice").applyInArrow(ask, "slice long, kind int, segment long, keys binary")
    filters = model.segments.select("kind", "segment", "bits", "image")
    answers = requests.groupBy("kind", "segment").cogroup(filters.groupBy("kind", "segment")).applyInArrow(
        answer, "slice long, kind int, segment long, keys binary, levels binary"
    )
    return numbered.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(finish, SCORED), sent


def score(docs: DataFrame, model: Model, prior: float = PRIOR, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(doc_id, learn, n_tokens, n_known, base_score, score) of every row of `docs` (doc_id, text, learn), which
    must be those counted by `fit` if the bound on the words sent to one segment is to hold.

    A filter of at most `filter_bytes` is broadcast. Texts are never shuffled then: a slice hands on one narrow row
    a text, and its rare words, as (word, text, times), to the segments that hold their counts; what comes back is
    one packed row a request, added up by slice.
    """
    way = _scored_by_broadcast if model.filter_bytes <= filter_bytes else _scored_by_segments
    asked, sent = way(docs.select("doc_id", "text", "learn"), model, prior)
    held = model.segments.filter("kind = 1").select(
        *(F.col(c) if c in ("segment", "keys", "counts") else F.lit(None).alias(c) for c in TABLE.names)
    )
    total = model.tokens + model.words + 1

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        """A segment's answers, one row a request: for each text its share of the base score and its known words."""
        if key[0].as_py() < 0:
            return group.cast(TABLE).drop_columns("counts")
        rows = group.select(["row", "keys", "rows", "times", "counts"]).to_pylist()
        held = next((r for r in rows if r["counts"] is not None), None)
        keys = unpack_keys(held["keys"], 1) if held else np.zeros(1, U)
        counts = wide(held["counts"], len(keys)) if held else np.zeros(1, np.int64)
        out = []
        for r in rows:
            if r["counts"] is None:
                words, texts = unpack_keys(r["keys"], 1), np.frombuffer(r["rows"], "<u4")
                times = wide(r["times"], len(words))
                at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
                found = np.where(keys[at] == words, counts[at], 0)
                of, place = np.unique(texts, return_inverse=True)
                base = np.bincount(place, times * np.log10((found + 1) / total))
                known = np.bincount(place, times * (found > 0)).astype(np.int64)
                out.append({"row": r["row"], "rows": of.tobytes(), "keys": base.astype("<f8").tobytes(), "times": narrow(known)})
        return pa.Table.from_pylist(out, TABLE).drop_columns("counts")

    def add(key: tuple, group: pa.Table) -> pa.Table:
        """The rows of a slice with all their shares."""
        facts = group.filter(pc.is_null(group.column("keys"))).sort_by("row")
        base, known = facts.column("base_score").to_numpy().copy(), facts.column("n_known").to_numpy().copy()
        for r in group.filter(pc.is_valid(group.column("keys"))).select(["rows", "keys", "times"]).to_pylist():
            of = np.frombuffer(r["rows"], "<u4").astype(np.int64)  # no text twice in an answer
            base[of] += np.frombuffer(r["keys"], "<f8")
            known[of] += wide(r["times"], len(of))
        columns = [facts.column("doc_id"), facts.column("learn"), facts.column("n_tokens"), known, base, facts.column("score")]
        return pa.Table.from_arrays([pa.chunked_array([c]) if isinstance(c, np.ndarray) else c for c in columns], schema=RESULT)

    fields = SCORED.split(", ")
    answered = asked.unionByName(held).groupBy("segment").applyInArrow(answer, ", ".join(fields[:-1]))
    added = answered.groupBy(F.shiftright("row", 20).alias("slice")).applyInArrow(
        add, "doc_id long, learn boolean, n_tokens long, n_known long, base_score double, score double"
    )
    result = staged(added)  # so that the filter can leave the executors
    sent.destroy()
    return result


def learned_from(doc_id: Column) -> Column:
    """Six of seven documents, by a checksum of the id; rows without one are learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 != 2


def score_all(docs: DataFrame, order: int = ORDER, prior: float = PRIOR, **bounds) -> DataFrame:
    """Learn from six sevenths of `docs` (doc_id, text) and score every row: (doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score). A missing text is empty and has one token, its end; rows of
    one doc_id are scored each; an empty table gives no rows; further columns are left behind."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        learned_from(F.col("doc_id")).alias("learn"),
    )
    model = fit(rows, order, **{k: v for k, v in bounds.items() if k != "filter_bytes"})
    scored = score(rows, model, prior, bounds.get("filter_bytes", FILTER_BYTES))
    dropped(model.segments)
    return scored.select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op12_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all `documents`; see `score_all` for missing, empty and repeated rows."""
    return score_all(table(spark, sf_dir, "documents"))
