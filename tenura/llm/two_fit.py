"""Packing token sequences by best-two-fit.

A bin is filled greedily with the longest pieces that fit; then its smallest piece gives way to two
unpacked ones if these fill the widened gap more tightly. Pieces of one length are interchangeable, so the
packing is planned on the histogram of lengths (as many counts as a sequence has tokens, whatever the
input) and a bin's pattern is repeated while its lengths last. The rows then look up their places.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenura.lineage import staged
from tenura.llm.common import table, texts
from tenura.llm.tokens import encoded

CAPACITY = 1024
END = 2


def _longest(counts: list[int], limit: int) -> int:
    """The longest length left that is at most `limit`; 0 if there is none."""
    while limit and not counts[limit]:
        limit -= 1
    return limit


def _two_for(counts: list[int], gap: int, least: int) -> tuple[int, int] | None:
    """The two lengths left of the largest sum over `least` and up to `gap`."""
    best, found = least, None
    low, high = 1, min(gap, len(counts) - 1)
    while low <= high:
        if not counts[high] or low + high > gap:
            high -= 1
        elif not counts[low] or (low == high and counts[low] < 2):
            low += 1
        else:
            if low + high > best:
                best, found = low + high, (high, low)
            low += 1
    return found


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, dict[int, int]]]:
    """Patterns (first sequence, repeats, {length: pieces of it}) that use every piece once."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] += n
    patterns: list[tuple[int, int, dict[int, int]]] = []
    sequence, top = 0, capacity
    while top := _longest(counts, top):
        taken: list[int] = []
        gap = capacity
        while length := _longest(counts, gap):
            taken.append(length)
            counts[length] -= 1
            gap -= length
        if gap and len(taken) > 1:
            smallest = taken[-1]
            if two := _two_for(counts, gap + smallest, smallest):
                counts[smallest] += 1
                taken[-1:] = two
                for length in two:
                    counts[length] -= 1
        uses = Counter(taken)
        # the same choices are made again as long as each length of the pattern lasts
        more = min(counts[length] // n for length, n in uses.items())
        for length, n in uses.items():
            counts[length] -= more * n
        patterns.append((sequence, more + 1, dict(uses)))
        sequence += more + 1
    return patterns


def places(patterns: list[tuple[int, int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Runs of the pieces of a length, by their number: where a run begins, its sequence and offset."""
    used: Counter[int] = Counter()
    runs = []
    for sequence, repeats, uses in patterns:
        offset = 0
        for length in sorted(uses, reverse=True):
            n = uses[length]
            runs.append((length, used[length], sequence, n, offset))
            used[length] += repeats * n
            offset += n * length
    runs.sort()
    columns = np.array(runs or np.zeros((0, 5)), np.int64)
    return {name: columns[:, k] for k, name in enumerate(("length", "first", "sequence", "each", "offset"))}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Whole texts as pieces of at most `capacity` ids, the end id included: (part, nth, doc_id, piece,
    start, length, ids_crc32[, ids]). A document is cut only if it is longer; then its first piece takes the
    remainder. A missing text is empty: one piece with the end id. Repeated rows are pieces of their own.
    `part` is the writing task and `nth` counts its pieces of the same length, for numbering them all."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch, ids, bounds in encoded(batches, tokenizer_path, end):
            totals = np.diff(bounds)
            many = -(-totals // capacity)
            row = np.repeat(np.arange(len(totals)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            short = (totals - (many - 1) * capacity)[row]
            start = np.where(piece == 0, 0, short + (piece - 1) * capacity)
            length = np.where(piece == 0, short, capacity)
            order = np.argsort(length, kind="stable")
            ranks = np.empty(len(order), np.int64)
            grouped = length[order]
            firsts = np.searchsorted(grouped, grouped, side="left")
            ranks[order] = np.arange(len(order)) - firsts
            nth = seen[length] + ranks
            seen += np.bincount(length, minlength=capacity + 1)
            data = memoryview(ids.astype("<u4").tobytes())
            at = (bounds[row] + start).tolist()
            parts = [data[4 * a : 4 * (a + n)] for a, n in zip(at, length.tolist(), strict=True)]
            columns = [
                pa.array(np.full(len(row), part, np.int32)),
                pa.array(nth),
                batch.column("doc_id").take(pa.array(row)),
                pa.array(piece.astype(np.int32)),
                pa.array(start),
                pa.array(length),
                pa.array([zlib.crc32(p) for p in parts], pa.int64()),
            ]
            names = ["part", "nth", "doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([p.tobytes() for p in parts], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "part int, nth long, doc_id long, piece int, start long, length long, ids_crc32 long"
    return texts(docs).mapInArrow(cut, schema + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and its gapless offset there; with `with_ids`, also its ids
    (little-endian unsigned 32-bit), to be put together by sequence_id and offset.

    The driver sees at most `capacity` counts and sends back about as many patterns. Pieces are numbered
    without a window over them: their number in the writing task plus the sum of the earlier tasks, joined
    on task and length, so a length that most documents share is no hot key.
    """
    cut = staged(pieces(docs, tokenizer_path, capacity, end, with_ids))
    counts = staged(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = places(plan(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = cut.join(before, ["part", "length"]).withColumn("number", F.col("before") + F.col("nth"))
    # one sortable code: a length's pieces are numbered below 2^52
    keys = runs["length"] * (1 << 52) + runs["first"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            run = np.searchsorted(keys, length * (1 << 52) + number, side="right") - 1
            turn, within = np.divmod(number - runs["first"][run], runs["each"][run])
            added = [pa.array(runs["sequence"][run] + turn), pa.array(runs["offset"][run] + within * length)]
            kept = [n for n in batch.schema.names if n != "number"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in kept] + added, [*kept, "sequence_id", "offset"]
            )

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return numbered.select(*names, "number").mapInArrow(look_up, schema + ", sequence_id long, offset long")


def op8_two_fit(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """The vocabulary's path is a parameter; by default the public tokenizers' own."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(table(spark, sf_dir, "documents"), tokenizer_path)
