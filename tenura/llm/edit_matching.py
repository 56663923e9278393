"""Benchmark decontamination by pigeonhole edit matching.

A test item may appear with up to k edits. Cut into k + 1 pieces, at least one piece then appears
unchanged: pieces are found exactly, and each hit is verified over the item's whole length with Myers'
bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.lineage import staged
from tenura.llm.common import table, texts

#: Edits allowed, as a share of an item's characters.
ERROR_SHARE = 0.05
#: Bytes of items that are searched for in one pass over the documents.
BLOCK_BYTES = 8_000_000

MATCHES = "doc_id long, item_id long, distance int, begin int, end int"


def normalized(text: str) -> str:
    """Lower case, one space for each run of white space, none at the ends."""
    return " ".join(text.lower().split())


def budget(length: int, share: float = ERROR_SHARE) -> int:
    return int(length * share)


def cut(item: str, share: float = ERROR_SHARE) -> list[tuple[int, str]]:
    """The item's budget-plus-one pieces with their offsets, of equal length or one apart."""
    n = budget(len(item), share) + 1
    bounds = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def pattern_bits(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, c in enumerate(pattern):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits


def least_distance(bits: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to any substring of `text`, and the first end of such a
    substring: columns of the distance table as two bit vectors (Myers 1999)."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, score = full, 0, length
    best, at = length, 0
    for i, c in enumerate(text):
        same = bits.get(c, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        plus = down | ~(across | up) & full
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(vertical | plus) & full, plus & vertical
        if score < best:
            best, at = score, i + 1
    return best, at


class Matcher:
    """Searches texts for a block of items."""

    def __init__(self, items: list[tuple[int, str]], share: float = ERROR_SHARE):
        self.items = [(i, normalized(t)) for i, t in items]
        self.share = share
        self.automaton = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item) in enumerate(self.items):
            for offset, piece in cut(item, share) if item else []:
                pieces.setdefault(piece, []).append((k, offset + len(piece)))
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, uses)
        if pieces:
            self.automaton.make_automaton()
        self.bits = [pattern_bits(item) for _, item in self.items]

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, begin, end) of each item found in the normalized text, at its best place;
        `begin` is where the searched window starts, `end` where the match ends."""
        if not len(self.automaton):
            return []
        text = normalized(text)
        windows: dict[int, list[int]] = {}
        for end, uses in self.automaton.iter(text):
            for k, upto in uses:
                windows.setdefault(k, []).append(end + 1 - upto)
        found = []
        for k, starts in windows.items():
            item_id, item = self.items[k]
            limit, size = budget(len(item), self.share), len(item)
            exact = next((s for s in starts if s >= 0 and text.startswith(item, s)), None)
            if exact is not None:
                found.append((item_id, 0, exact, exact + size))
                continue
            best = None
            window: tuple[int, int] | None = None
            for s in [*sorted(set(starts)), None]:
                # windows that overlap are searched as one
                if window and (s is None or s - limit > window[1]):
                    a, b = max(0, window[0]), min(len(text), window[1])
                    distance, at = least_distance(self.bits[k], size, text[a:b])
                    if distance <= limit and (best is None or distance < best[1]):
                        best = (item_id, distance, a, a + at)
                    window = None
                if s is not None:
                    window = (window[0] if window else s - limit, s + size + limit)
            if best:
                found.append(best)
        return found


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The stated query set in blocks of bounded size; one is in the driver at a time."""
    block, held = [], 0
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    for row in items.toLocalIterator():
        block.append((row["item_id"], row["text"]))
        held += len(row["text"])
        if held >= block_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, share: float = ERROR_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, begin, end): every item found in every document's whole text at up to
    `share` of its characters in edits, at its best place; offsets count in the normalized text.

    Items and texts without text hold nothing. An item shorter than 1 / `share` must appear as it is.
    Repeated rows and items of equal text are reported each. One narrow pass over the documents for
    each block of items; no shuffle.
    """
    spark = docs.sparkSession
    rows = texts(docs).filter("text <> ''")
    found = None
    for block in _blocks(benchmark, block_bytes):
        sent = spark.sparkContext.broadcast(block)  # at most block_bytes and one item

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, share)
            for batch in batches:
                columns: list[list] = [[], [], [], [], []]
                for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                    for hit in matcher.find(text.as_py()):
                        for column, value in zip(columns, (doc_id.as_py(), *hit), strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    ["doc_id", "item_id", "distance", "begin", "end"],
                )

        part = rows.mapInArrow(search, MATCHES)
        found = part if found is None else staged(found).unionAll(part)
    return spark.createDataFrame([], MATCHES) if found is None else found


def decontaminated(docs: DataFrame, benchmark: DataFrame, share: float = ERROR_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` whose text holds no item, with all columns; each is searched where it is read, block
    by block of items, without a shuffle. Rows without text or doc_id stay if nothing is found in them."""
    for block in _blocks(benchmark, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)  # at most block_bytes and one item

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, share)
            for batch in batches:
                texts = batch.column("text")
                yield batch.filter(pa.array([not t.is_valid or not matcher.find(t.as_py()) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op7_edit_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
