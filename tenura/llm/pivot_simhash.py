"""Near-duplicates by 64-bit SimHash, found with tables of distances to reference fingerprints.

The references (pivots) are the 64 rows of a Hadamard matrix. |d(x, p) - d(y, p)| <= d(x, y) for
every pivot p, so a pair whose tables differ by more than the limit anywhere is no link. With these
pivots the mean squared difference of two tables equals the number of differing bits, so five bits or
more always show as a difference over 2; what survives is verified bit by bit.

Tables are compared only within buckets. Two differing bits leave two of four blocks of 16 bits as
they are, hence also the distances to all references that lie in those blocks: a bucket holds the
fingerprints that agree in one pair of blocks. A bucket of more than LARGE fingerprints is dealt again by
pairs of the four bytes left open, and once more by pairs of the four half-bytes left then; after
that only 8 bits are open, and a bucket cannot hold more than 256.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tenura.lineage import staged
from tenura.llm.common import components, table, texts

SHINGLE, SEED, DISTANCE = 3, 42, 2
LARGE = 256
#: Rows of whole buckets compared at a time.
CHUNK = 65_536

PIVOTS = np.array(
    [sum((bin(k & j).count("1") & 1) << j for j in range(64)) for k in range(64)], np.uint64
)


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text; 0 without words."""
    return int(_fingerprints([text], shingle, seed)[0])


def _fingerprints(values: list[str], shingle: int, seed: int) -> np.ndarray:
    hashes: list[int] = []
    sizes = []
    for value in values:
        words = value.encode().lower().split()  # bytes: A-Z alone change, ASCII white space alone splits
        n = len(words)
        if n <= shingle:
            own = [xxh64_intdigest(b" ".join(words), seed)] if n else []
        else:
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = [0, *(ends[:-1] + 1).tolist()]
            own = [xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
        hashes += own
        sizes.append(len(own))
    out = np.zeros(len(values), np.uint64)
    counts = np.array(sizes, np.int64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(counts) - counts)[full]
        votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * votes > counts[full][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, of_text) of every whole text; fp holds the 64 bits as a signed long, of_text tells texts
    apart. A missing text has no words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, values, held = [], [], 0
            for value in batch.column("text"):
                values.append(value.as_py())
                held += len(values[-1])
                if held > 1_000_000:
                    done.append(_fingerprints(values, shingle, seed))
                    values, held = [], 0
            done.append(_fingerprints(values, shingle, seed))
            fp = np.concatenate(done).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fp), batch.column("of_text")], ["doc_id", "fp", "of_text"]
            )

    rows = texts(docs).withColumn("of_text", F.xxhash64("text"))
    return rows.mapInArrow(of, "doc_id long, fp long, of_text long")


def local_stars(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows 0 to n-1 as (row, first row of its component), without the firsts."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root[a] == root[b]).all() and (root == root[root]).all():
            rows = np.flatnonzero(root != np.arange(n))
            return rows, root[rows]


def _links(fp: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same bucket (rows come sorted by bucket) within DISTANCE bits."""
    codes = fp.view(np.uint64)
    distances = np.bitwise_count(codes[:, None] ^ PIVOTS).astype(np.int8)
    left, right = [], []
    near = np.arange(len(fp))
    lag = 1
    while True:
        near = near[near + lag < len(fp)]
        near = near[bucket[near] == bucket[near + lag]]
        if not len(near):
            break
        apart = np.abs(distances[near] - distances[near + lag]).max(axis=1)
        kept = near[apart <= DISTANCE]
        kept = kept[np.bitwise_count(codes[kept] ^ codes[kept + lag]) <= DISTANCE]
        left.append(kept)
        right.append(kept + lag)
        lag += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (fp, mask, value) to links (a, b), in chunks of whole buckets."""

    def stars(fp: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
        rows, firsts = local_stars(*_links(fp, bucket), len(fp))
        return pa.RecordBatch.from_arrays([pa.array(fp[rows]), pa.array(fp[firsts])], ["a", "b"])

    held = np.zeros((0, 3), np.int64)
    for batch in batches:
        new = np.stack([batch.column(n).to_numpy() for n in ("fp", "mask", "value")], axis=1)
        held = np.concatenate([held, new])
        while len(held) > CHUNK:
            changed = (held[1:, 1:] != held[:-1, 1:]).any(axis=1)
            bucket = np.concatenate([[0], np.cumsum(changed)])
            to = int(np.searchsorted(bucket, bucket[CHUNK]))  # the bucket at the cut waits
            to = to or int(np.searchsorted(bucket, bucket[0], side="right"))
            yield stars(held[:to, 0], bucket[:to])
            held = held[to:]
    if len(held):
        changed = (held[1:, 1:] != held[:-1, 1:]).any(axis=1)
        yield stars(held[:, 0], np.concatenate([[0], np.cumsum(changed)]))


def _masks(level: int) -> list[tuple[int, int]]:
    """(mask so far, mask with two more blocks) of a level; 0 stands for no mask yet."""
    width = 16 >> level
    block = (1 << width) - 1
    found = []
    for before in [0] if level == 0 else sorted({m for _, m in _masks(level - 1)}):
        free = [block << s for s in range(0, 64, width) if not before >> s & 1]
        found += [(before, before | a | b) for a, b in combinations(free, 2)]
    return found


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between different fingerprints of `fps` (fp, distinct) at DISTANCE bits or fewer, as
    stars within buckets: connected exactly as the full set of pairs is, but never as many rows."""
    spark = fps.sparkSession
    edges = None
    rows = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    for level in range(3):
        moves: dict[int, list[int]] = {}
        for before, after in _masks(level):
            moves.setdefault(_signed(before), []).append(_signed(after))
        choice = spark.createDataFrame(
            [(k, v) for k, v in moves.items()], "mask long, masks array<long>"
        )  # 1, 6 or 36 rows
        keyed = (
            rows.join(F.broadcast(choice), "mask")
            .select("fp", F.explode("masks").alias("mask"))
            .select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
        )
        if level:
            keyed = keyed.distinct()
        counts = keyed.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        met = staged(keyed.join(counts, ["mask", "value"]))
        small = met.filter(F.col("n") <= LARGE).repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
        found = small.select("fp", "mask", "value").mapInArrow(_compare, "a long, b long")
        edges = found if edges is None else edges.unionAll(found)
        rows = met.filter(F.col("n") > LARGE).select("fp", "mask")
        if rows.isEmpty():
            break
    return edges


def _classes(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(doc_id, fp, of_text, component, component_id) of every row; `component` names the class even where
    rows of different classes share a doc_id."""
    rows = staged(fingerprints(docs, shingle, seed))
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    members = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    named = members.join(distinct, "fp")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    linked = named.join(least, "component").select("fp", "component", "least")
    classes = distinct.join(linked, "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), F.coalesce("least", "first").alias("component_id")
    )
    return rows.join(classes, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links.

    Words are runs without ASCII white space, A-Z in lower case; shingles count with their repeats.
    Texts without words have fingerprint 0 and link like any other; equal texts link by equal
    fingerprints, without a pair. Rows without doc_id are fingerprinted and link, but name no
    component unless a component has no doc_id at all, whose component_id is then null. An empty table gives
    no rows.
    """
    return _classes(docs, shingle, seed).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns kept: of smallest doc_id, among rows that share it the text of
    smallest hash, and of rows equal in both any one. Rows without doc_id stay as they are, since nothing can name
    them, and do not speak for their component; an empty table gives no rows."""
    best = (
        _classes(docs, SHINGLE, SEED)
        .filter("doc_id is not null")
        .groupBy("component")
        .agg(F.min(F.struct("doc_id", "of_text")).alias("best"))
        .select(F.col("best.doc_id").alias("id"), F.col("best.of_text").alias("of_text"))
    )
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("of_text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    kept = rows.join(best, ["id", "of_text"], "left_semi").dropDuplicates(["id", "of_text"])
    return kept.unionAll(rows.filter("id is null")).select("row.*")


def op9_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
