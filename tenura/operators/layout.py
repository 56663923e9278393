"""Placing survival rows in time order over many tasks, once per study.

The time range is cut into slabs of about equal row count. One slab goes to one chunk; a single time
value that holds more rows than a chunk should is a slab of its own and is spread over several chunks.
A chunk is what a task holds in memory, a partition is a run of consecutive chunks. Every model of a
study then reads the same placed rows, column by column in compressed pieces: handing over single rows
took most of the time of a pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.functions.columns import literal_array
from tenura.lineage import checkpointed
from tenura.operators.ordered import Cuts, cut_points, quantile_cuts, with_slab

VALUES_PER_CHUNK = 2_000_000  # about 16 MB of doubles, of which a task has several copies at a time
CHUNKS_PER_PARTITION = 16
MAX_CHUNKS = 65_536
QUANTILES = 1024


@dataclass
class Placed:
    """Rows in chunks ordered by time: _t, _e, one double column per feature, fold columns, _chunk. `packed` holds
    them in pieces of chunks (`pack`)."""

    df: DataFrame
    packed: DataFrame
    features: tuple[str, ...]
    folds: tuple[str, ...]
    rows: int
    means: np.ndarray
    stds: np.ndarray
    nulls: np.ndarray
    slab_of_chunk: np.ndarray
    hot_slabs: frozenset[int]
    partitions: int

    @property
    def chunks(self) -> int:
        return len(self.slab_of_chunk)

    @property
    def results(self) -> int:
        """At most so many results a model: a partition has one, and one a chunk and run between of a hot time."""
        hot = int(np.isin(self.slab_of_chunk, list(self.hot_slabs)).sum())
        return min(self.chunks, self.partitions + 2 * hot)

    @property
    def kinds(self) -> dict[str, type]:
        return _kinds(len(self.features), len(self.folds))

    def release(self) -> None:
        self.packed.unpersist()


def place(
    df: DataFrame,
    features: Sequence[str],
    folds: Sequence[str] = (),
    keys: Sequence[str] = (),
    values_per_chunk: int = VALUES_PER_CHUNK,
    min_rows_per_chunk: int = 4096,
) -> Placed:
    """Lay out the rows that have a duration and an event; feature nulls are kept and left to each
    model, because a model drops only the rows it cannot use itself.

    `keys` identify a row and spread the rows of a hot time over its chunks; without them exact
    copies of a row stay together."""
    features = tuple(dict.fromkeys(features))
    folds = tuple(dict.fromkeys(folds))
    spread = [k for k in keys if k in df.columns] or ["duration", "event", *features, *folds]
    base = df.dropna(subset=["duration", "event"]).select(
        F.col("duration").cast("double").alias("_t"),
        F.col("event").cast("int").alias("_e"),
        *[F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(f"x{i}") for i, f in enumerate(features)],
        *[F.col(f).cast("int").alias(f"k{i}") for i, f in enumerate(folds)],
        F.xxhash64(*spread).alias("_h"),
    )
    spark = df.sparkSession
    names = [f"x{i}" for i in range(len(features))]
    # one aggregate gives the row count, the moments and a fine set of quantiles
    shares = [i / QUANTILES for i in range(1, QUANTILES)]
    facts = base.agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("_t", shares, 4 * QUANTILES).alias("q"),
        *[F.avg(n).alias(f"m_{n}") for n in names],
        *[F.stddev_samp(n).alias(f"s_{n}") for n in names],
        *[F.count(F.when(F.col(n).isNull(), 1)).alias(f"z_{n}") for n in names],
    ).first()
    rows, quantiles = facts["n"], sorted(facts["q"] or [])
    width = len(features) + 2
    wanted = math.ceil(rows * width / values_per_chunk)
    parallel = min(spark.sparkContext.defaultParallelism, math.ceil(rows / min_rows_per_chunk))
    slabs = max(1, min(MAX_CHUNKS // 2, max(wanted, parallel)))
    if slabs > QUANTILES:
        cuts = quantile_cuts(base, "_t", slabs)
    else:
        cuts = cut_points([quantiles[i * QUANTILES // slabs - 1] for i in range(1, slabs)] if quantiles else [])
    starts, slab_of_chunk, hot = _chunk_plan(cuts, quantiles, slabs)
    slabbed = with_slab(base, "_t", cuts)
    if hot:
        first = literal_array(starts[:-1], "int")
        pieces = literal_array([b - a for a, b in zip(starts, starts[1:])], "int")
        at = F.col("_slab") + 1
        chunk = F.element_at(first, at) + F.pmod(F.col("_h"), F.element_at(pieces, at)).cast("int")
    else:
        chunk = F.col("_slab")
    partitions = min(len(slab_of_chunk), max(parallel, math.ceil(len(slab_of_chunk) / CHUNKS_PER_PARTITION), 1))
    placed = (
        slabbed.withColumn("_chunk", chunk.cast("int"))
        .drop("_slab", "_h")
        .repartitionById(partitions, F.floor(F.col("_chunk") * partitions / len(slab_of_chunk)).cast("int"))
        .sortWithinPartitions("_chunk", "_t")
    )
    kinds = _kinds(len(features), len(folds))
    schema = ", ".join(["_chunk int", "_rows int", *[f"{n} binary" for n in kinds]])
    # written once to the shared folder; the cache only spares reading it back
    packed = checkpointed(placed.mapInArrow(lambda batches: pack(batches, kinds), schema)).persist(
        StorageLevel.MEMORY_AND_DISK
    )
    single = packed.mapInArrow(lambda batches: single_rows(batches, kinds), placed.schema)
    array = lambda prefix: np.array([_number(facts[f"{prefix}_{n}"]) for n in names])
    return Placed(
        single, packed, features, folds, rows, array("m"), array("s"), array("z"),
        np.array(slab_of_chunk), frozenset(hot), partitions,
    )


def _number(value) -> float:
    return 0.0 if value is None else float(value)


def _chunk_plan(cuts: Cuts, quantiles: list[float], slabs: int):
    """First chunk of each slab, slab of each chunk, and the slabs split into several chunks.

    The share of a hot time is read off the quantiles; how many chunks it gets affects only the
    balance.
    """
    pieces = [1] * cuts.slabs
    for slab, alone in enumerate(cuts.single()):
        if alone:
            share = quantiles.count(cuts.points[slab - 1]) / QUANTILES
            pieces[slab] = max(1, round(share * slabs))
    starts = [0]
    slab_of_chunk: list[int] = []
    for slab, count in enumerate(pieces):
        slab_of_chunk += [slab] * count
        starts.append(starts[-1] + count)
    return starts, slab_of_chunk, [s for s, c in enumerate(pieces) if c > 1]


@dataclass
class Chunk:
    number: int
    t: np.ndarray
    e: np.ndarray
    x: np.ndarray  # (rows, features), a feature's values side by side
    folds: list[np.ndarray]
    kept: dict = field(default_factory=dict)  # rows outside a fold, once chosen


def _kinds(n_features: int, n_folds: int) -> dict[str, type]:
    kinds = {"_t": np.float64, "_e": np.int32}
    kinds |= {f"x{i}": np.float64 for i in range(n_features)}
    return kinds | {f"k{i}": np.int32 for i in range(n_folds)}


NO_FOLD = np.iinfo(np.int32).min
CODEC = "zstd"


def pack(batches: Iterator[pa.RecordBatch], kinds: dict[str, type]) -> Iterator[pa.RecordBatch]:
    """One row for the rows of one chunk in one record batch: chunk, number of rows, and each column as compressed
    bytes. Order is kept; a null feature becomes NaN."""
    for batch in batches:
        ids = batch.column("_chunk").to_numpy()
        edges = np.flatnonzero(np.diff(ids)) + 1
        for start, stop in zip([0, *edges], [*edges, len(ids)]):
            if start == stop:
                continue
            columns = []
            for name, kind in kinds.items():
                values = batch.column(name).slice(start, stop - start)
                values = values.fill_null(NO_FOLD) if kind is np.int32 else values
                plain = np.ascontiguousarray(values.to_numpy(zero_copy_only=False), dtype=kind)
                columns.append(pa.array([pa.compress(plain.tobytes(), codec=CODEC, asbytes=True)], pa.binary()))
            ends = [pa.array([ids[start]], pa.int32()), pa.array([stop - start], pa.int32())]
            yield pa.RecordBatch.from_arrays([*ends, *columns], names=["_chunk", "_rows", *kinds])


def unpack(batches: Iterator[pa.RecordBatch], kinds: dict[str, type]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Chunk number and columns of each packed piece."""
    for batch in batches:
        columns = {n: batch.column(n) for n in kinds}
        for at, (number, rows) in enumerate(zip(batch.column("_chunk").to_pylist(), batch.column("_rows").to_pylist())):
            yield number, {
                n: np.frombuffer(
                    pa.decompress(columns[n][at].as_buffer(), rows * np.dtype(kind).itemsize, codec=CODEC), kind
                )
                for n, kind in kinds.items()
            }


def single_rows(batches: Iterator[pa.RecordBatch], kinds: dict[str, type]) -> Iterator[pa.RecordBatch]:
    """The rows that were packed, in their order."""
    for number, columns in unpack(batches, kinds):
        plain = [
            pa.array(v, mask=v == NO_FOLD) if kind is np.int32 else pa.array(v, from_pandas=True)
            for v, kind in ((columns[n], kind) for n, kind in kinds.items())
        ]
        chunk = pa.array(np.full(len(columns["_t"]), number, np.int32))
        yield pa.RecordBatch.from_arrays([*plain, chunk], names=[*kinds, "_chunk"])


def chunks_of(batches: Iterator[pa.RecordBatch], n_features: int, n_folds: int) -> Iterator[Chunk]:
    """Whole chunks from the packed pieces of one partition (they arrive sorted by chunk, time)."""
    pieces = unpack(batches, _kinds(n_features, n_folds))
    for number, run in groupby(pieces, key=lambda piece: piece[0]):
        yield _chunk(number, [columns for _, columns in run], n_features, n_folds)


def _chunk(number: int, pieces: list[dict[str, np.ndarray]], n_features: int, n_folds: int) -> Chunk:
    column = lambda name: np.concatenate([p.pop(name) for p in pieces])
    t = column("_t")
    x = np.empty((n_features, len(t))).T
    for i in range(n_features):
        x[:, i] = column(f"x{i}")
    return Chunk(number, t, column("_e"), x, [column(f"k{i}") for i in range(n_folds)])
