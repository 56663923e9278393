"""Token ids in Simple-8b files: 64-bit words whose selector says how many ids of which width they hold.

A file image is little-endian: header (magic, documents, ids, blocks), the documents' ids and
lengths, one (first word, words) pair a block, then the words. The upper 4 bits of a word are its selector.
Selectors 0 to 13 pack COUNTS ids of WIDTHS bits, lowest bits first; ESCAPE announces that the next
word is one whole id of up to 64 bits. A block starts at a word of its own, so blocks decode apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenura.lineage import staged
from tenura.llm.common import table
from tenura.llm.tokens import encoded

COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
MAGIC = 0x53384231
#: Ids in a block, and ids after which a file is closed (a document is never cut).
BLOCK, FILE = 4096, 262_144
END = 2


def pack_block(values: np.ndarray) -> np.ndarray:
    """The words of one block, each as full as the ids that come next allow."""
    n = len(values)
    if not n:
        return np.zeros(0, "<u8")
    values = values.astype(np.uint64)
    # the class of each id is the narrowest width that holds it, the last class is the escape
    limits = np.array([1 << w for w in WIDTHS], np.uint64)
    kind = np.searchsorted(limits, values, side="right").astype(np.int8)
    # a selector fits at i if none of its next ids is wider: the narrowest such selector takes most ids
    selector = np.full(n, len(WIDTHS), np.int8)
    for s in range(len(WIDTHS) - 1, -1, -1):
        wide = np.concatenate([[0], np.cumsum(kind > s)])
        ends = np.arange(n) + COUNTS[s]
        fits = (ends <= n) & (wide[np.minimum(ends, n)] == wide[:-1])
        selector[fits] = s
    counts = np.array([*COUNTS, 1], np.int64)[selector].tolist()
    at, starts = 0, []
    while at < n:
        starts.append(at)
        at += counts[at]
    starts = np.array(starts)
    chosen = selector[starts].astype(np.int64)
    escaped = chosen == len(WIDTHS)
    place = np.arange(len(starts)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(starts) + int(escaped.sum()), np.uint64)
    for s in np.unique(chosen[~escaped]).tolist():
        own = chosen == s
        shifts = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
        ids = values[starts[own][:, None] + np.arange(COUNTS[s])]
        words[place[own]] = np.bitwise_or.reduce(ids << shifts, axis=1) | np.uint64(s << 60)
    words[place[escaped]] = np.uint64(ESCAPE << 60)
    words[place[escaped] + 1] = values[starts[escaped]]
    return words.astype("<u8")


def unpack_words(words: np.ndarray) -> np.ndarray:
    """The ids of any run of whole blocks; one vector operation a selector."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)  # words that are whole ids follow an escape
    escapes = np.flatnonzero(selector == ESCAPE)
    if len(escapes):
        last = -1
        for e in escapes.tolist():  # an escaped id may itself look like an escape
            if e != last:
                last = e + 1
                raw[last] = True
    sizes = np.array([*COUNTS, 0, 0], np.int64)[selector]
    sizes[raw] = 1
    begins = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint64)
    for s in np.unique(selector[~raw]).tolist():
        if s == ESCAPE:
            continue
        own = (selector == s) & ~raw
        shifts = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
        ids = (words[own][:, None] >> shifts) & np.uint64((1 << WIDTHS[s]) - 1)
        out[begins[own][:, None] + np.arange(COUNTS[s])] = ids
    out[begins[raw]] = words[raw]
    return out


def write_file(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    packed = [pack_block(ids[k : k + BLOCK]) for k in range(0, len(ids), BLOCK)]
    sizes = np.array([len(p) for p in packed], "<i8")
    index = np.stack([np.cumsum(sizes) - sizes, sizes], axis=1) if len(sizes) else np.zeros((0, 2), "<i8")
    head = np.array([MAGIC, len(doc_ids), len(ids), len(packed)], "<i8")
    return b"".join(
        [head.tobytes(), doc_ids.astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), index.astype("<i8").tobytes()]
        + [p.tobytes() for p in packed]
    )


def open_file(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, lengths, the block index and all words."""
    magic, n_docs, _, n_blocks = np.frombuffer(image, "<i8", 4).tolist()
    if magic != MAGIC:
        raise ValueError("not a file of this format")
    doc_ids = np.frombuffer(image, "<i8", n_docs, 32)
    lengths = np.frombuffer(image, "<i8", n_docs, 32 + 8 * n_docs)
    index = np.frombuffer(image, "<i8", 2 * n_blocks, 32 + 16 * n_docs).reshape(-1, 2)
    return doc_ids, lengths, index, np.frombuffer(image, "<u8", offset=32 + 16 * n_docs + 16 * n_blocks)


def read_ids(image: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids from `start` to `stop` of a file; only the blocks that hold them are decoded."""
    n_ids = int(np.frombuffer(image, "<i8", 3)[2])
    stop = n_ids if stop is None else min(stop, n_ids)
    if start >= stop:
        return np.zeros(0, np.uint64)
    _, _, index, words = open_file(image)
    a, b = start // BLOCK, (stop - 1) // BLOCK
    ids = unpack_words(words[index[a, 0] : index[b, 0] + index[b, 1]])
    return ids[start - a * BLOCK : stop - a * BLOCK]


FILES = "part int, file int, first long, n_ids long, no_id long, image binary"


def write_files(docs: DataFrame, tokenizer_path: str, end: int = END) -> DataFrame:
    """Encode every whole text of `docs` and write the ids in ascending doc_id order: one row a file,
    (part, file, first, n_ids, no_id, image). `first` counts the ids before the file in its part; parts,
    and files within a part, ascend by doc_id. `no_id` rows at a file's beginning have no doc_id.

    A missing text is empty and still gets the end id. Rows without doc_id come first; rows of equal
    doc_id are ordered by their text's hash, equal rows in any order. Texts are dealt by range with a
    tie-breaker, so one doc_id with very many rows spreads over several parts. Files are rows of a
    Parquet table in the shared folder, since only Spark's writer reaches every store; an image is
    FILE ids or a little more, or one longer document.
    """
    tie = F.pmod(F.monotonically_increasing_id(), F.lit(1021))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64("text").alias("hash"),
        tie.alias("tie"),
    )
    order = ("doc_id", "hash", "tie")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file, first = TaskContext.get().partitionId(), 0, 0
        keys: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []
        no_id = n = 0

        def close() -> pa.RecordBatch:
            image = write_file(np.concatenate(keys), np.concatenate(sizes), np.concatenate(held))
            row = {"part": part, "file": file, "first": first, "n_ids": n, "no_id": no_id, "image": image}
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema(
            [("part", pa.int32()), ("file", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
             ("no_id", pa.int64()), ("image", pa.binary())]
        )
        for batch, ids, bounds in encoded(batches, tokenizer_path, end):
            column = batch.column("doc_id")
            doc_ids, missing = column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
            at = 0
            while at < len(doc_ids):
                # as many documents as fill the file
                to = int(np.searchsorted(bounds, bounds[at] + FILE - n, side="left"))
                to = min(max(to, at + 1), len(doc_ids))
                keys.append(doc_ids[at:to])
                sizes.append(np.diff(bounds[at : to + 1]))
                held.append(ids[bounds[at] : bounds[to]])
                n += int(bounds[to] - bounds[at])
                no_id += int(missing[at:to].sum())
                at = to
                if n >= FILE:
                    yield close()
                    keys, sizes, held = [], [], []
                    first, file, n, no_id = first + n, file + 1, 0, 0
        if keys:
            yield close()

    return staged(dealt.mapInArrow(write, FILES))


def read_files(files: DataFrame) -> DataFrame:
    """What the files hold: (doc_id, start, n_tokens, ids_crc32), `start` over all files. One row a part
    is broadcast: as many as the writing job had tasks."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("held"))
    # one row a task of the writing job
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                image = batch.column("image")[r].as_py()
                start = batch.column("start")[r].as_py()
                doc_ids, lengths, _, _ = open_file(image)
                ids = read_ids(image).astype("<u4")
                ends = np.cumsum(lengths)
                data = memoryview(ids.tobytes())
                sums = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                missing = np.arange(len(doc_ids)) < batch.column("no_id")[r].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=missing), pa.array(start + ends - lengths), pa.array(lengths),
                     pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    located = files.join(F.broadcast(offsets), "part").select(
        (F.col("offset") + F.col("first")).alias("start"), "no_id", "image"
    )
    return located.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_simple8b(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """The vocabulary's path is a parameter; by default the public tokenizers' own."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return read_files(write_files(table(spark, sf_dir, "documents"), tokenizer_path))
