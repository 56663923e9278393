"""Dimension reduction: truncated SVD of sparse weights, PCA of dense vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenura.functions.columns import unit_length

COMPONENTS = 64
OVERSAMPLING = 10
ROWS_AT_ONCE = 8  # a block over their columns stays inside the cache of a core and holds fewer zeros than a larger one


@dataclass
class Projection:
    """x -> (x - centre) @ components."""

    components: np.ndarray  # (columns, k)
    centre: np.ndarray | None
    strengths: np.ndarray  # singular values, or explained variance shares
    sparse: bool

    @property
    def size(self) -> int:
        return self.components.shape[1]

    def transform(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """Add array<double> `name`; every row is projected on its own."""
        sent = df.sparkSession.sparkContext.broadcast((self.components, self.centre))
        sparse = self.sparse
        schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            components, centre = sent.value
            for batch in batches:
                values = batch.column(batch.schema.get_field_index(column))
                if sparse:
                    parts = [block @ components[cols] for block, cols in _dense_blocks(values)]
                    out = np.concatenate(parts) if parts else np.zeros((0, components.shape[1]))
                else:
                    out = (_dense(values, components.shape[0]) - centre) @ components
                k = components.shape[1]
                offsets = pa.array(np.arange(0, (len(out) + 1) * k, k, dtype=np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, name])

        return df.mapInArrow(task, schema)


def expand(df: DataFrame, column: str, size: int, prefix: str) -> DataFrame:
    """An array column as numbered columns prefix_0 .. prefix_{size-1}."""
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, *[F.col(column)[i].alias(f"{prefix}_{i}") for i in range(size)])


def numbered(prefix: str, size: int) -> tuple[str, ...]:
    return tuple(f"{prefix}_{i}" for i in range(size))


def _dense(values: pa.Array, width: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), width)


def _dense_blocks(values: pa.StructArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Small dense blocks over the columns that occur in them."""
    names = [values.type.field(i).name for i in range(values.type.num_fields)]
    indices, weights = values.field(names.index("indices")), values.field(names.index("values"))
    lengths = np.asarray(indices.value_lengths().fill_null(0))
    flat_i = indices.flatten().to_numpy(zero_copy_only=False)
    flat_w = weights.flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    for start in range(0, len(values), ROWS_AT_ONCE):
        stop = min(len(values), start + ROWS_AT_ONCE)
        span = slice(ends[start], ends[stop])
        cols, at = np.unique(flat_i[span], return_inverse=True)
        block = np.zeros((stop - start, len(cols)))
        block[np.repeat(np.arange(stop - start), lengths[start:stop]), at] = flat_w[span]
        yield block, cols


def _gram_times(df: DataFrame, column: str, q: np.ndarray, tasks: int) -> np.ndarray:
    """X'X q in one pass: each task adds up its rows, the tasks are added up in a tree, to one for the driver."""
    sent = df.sparkSession.sparkContext.broadcast(q)

    def task(batches):
        basis = sent.value
        total = np.zeros(basis.shape)
        for batch in batches:
            for block, cols in _dense_blocks(batch.column(0)):
                total[cols] += block.T @ (block @ basis[cols])
        yield _partial(TaskContext.get().partitionId(), total)

    parts = df.select(column).mapInArrow(task, PARTIAL)
    while tasks > 1:
        parts = parts.groupBy(F.floor(F.col("part") / FAN_IN).cast("int")).applyInArrow(_add_partials, PARTIAL)
        tasks = -(-tasks // FAN_IN)
    payloads = parts.toArrow().column("payload").to_pylist()
    sent.unpersist()
    return sum((np.frombuffer(p) for p in payloads), np.zeros(q.size)).reshape(q.shape)


PARTIAL = "part int, payload binary"
# Partial matrices added up at a time, on an executor.
FAN_IN = 16


def _partial(part: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "payload"]
    )


def _add_partials(key, table):
    total = sum(np.frombuffer(p) for p in table.column("payload").to_pylist())
    return pa.Table.from_batches([_partial(key[0].as_py(), total)])


def fit_truncated_svd(
    df: DataFrame, column: str, columns: int, k: int = COMPONENTS, passes: int = 200,
    tolerance: float = 1e-9, seed: int = 42,
) -> Projection:
    """Leading right singular vectors of the uncentred sparse matrix, by block Krylov iteration.

    Every pass reads the rows once and multiplies one new block; the best vectors are sought in the
    whole subspace seen so far (Rayleigh-Ritz), which is cut back to its best part when it outgrows
    BASIS columns. Ends when the residual |X'Xv - s^2 v| of every wanted component is below `tolerance`
    times the largest s^2, and raises if `passes` are not enough. The driver holds two matrices of
    (columns x basis); the number of columns is bounded by the vocabulary size. Pass rows that are cheap
    to read again.
    """
    tasks = df.rdd.getNumPartitions()
    k = min(k, columns)
    width = min(columns, k + OVERSAMPLING)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((columns, width)))[0]
    basis, image = np.zeros((columns, 0)), np.zeros((columns, 0))
    for _ in range(passes):
        product = _gram_times(df, column, block, tasks)
        basis, image = np.hstack([basis, block]), np.hstack([image, product])
        small = basis.T @ image
        values, rotation = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1]
        values, rotation = values[order], rotation[:, order]
        vectors, residual = basis @ rotation[:, :k], image @ rotation[:, :k]
        residual -= vectors * values[:k]
        if np.linalg.norm(residual, axis=0).max() <= tolerance * max(values[0], 0.0):
            return Projection(_signed(vectors), None, np.sqrt(np.maximum(values[:k], 0.0)), True)
        # the residuals of all vectors lie in what the last product adds to the whole basis
        block = _new_directions(product, basis, values[0])
        if basis.shape[1] + width > max(BASIS, 4 * width):
            kept = rotation[:, : 2 * width]
            basis, image = basis @ kept, image @ kept
        if not block.shape[1]:  # the subspace is closed: what it holds is exact
            return Projection(_signed(vectors), None, np.sqrt(np.maximum(values[:k], 0.0)), True)
    raise RuntimeError(f"the leading {k} components did not settle within {passes} passes")


#: Columns of the subspace that is kept between passes.
BASIS = 1200


def _new_directions(product: np.ndarray, basis: np.ndarray, scale: float) -> np.ndarray:
    """An orthonormal basis of what `product` adds to `basis`; twice orthogonalised, noise left out."""
    for _ in range(2):
        product = product - basis @ (basis.T @ product)
    left, sizes, _ = np.linalg.svd(product, full_matrices=False)
    left = left[:, sizes > 1e-12 * max(scale, 1e-300)]
    left = left - basis @ (basis.T @ left)
    return np.linalg.qr(left)[0] if left.shape[1] else left


def fit_pca(df: DataFrame, column: str, k: int = COMPONENTS) -> Projection:
    """Principal components of a dense array column, centred on the training rows."""
    vectors = df.select(array_to_vector(column).alias("v"))
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(vectors)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(scaler.transform(vectors))
    return Projection(
        _signed(model.pc.toArray()), scaler.mean.toArray(), model.explainedVariance.toArray(), False
    )


def explained(spark: SparkSession, projection: Projection) -> DataFrame:
    """(component, share, cumulative) of the explained variance of dense components, a row each."""
    shares = np.asarray(projection.strengths, dtype=float)
    rows = [(k, float(s), float(c)) for k, (s, c) in enumerate(zip(shares, np.cumsum(shares), strict=True))]
    return spark.createDataFrame(rows, "component int, share double, cumulative double")


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Fix the sign of each column: its largest entry in size is positive."""
    top = np.abs(vectors).argmax(axis=0)
    sign = np.sign(vectors[top, np.arange(vectors.shape[1])])
    return vectors * np.where(sign == 0, 1.0, sign)


def unit_vectors(df: DataFrame, column: str) -> DataFrame:
    """Scale an array<double> column to length 1; a zero vector stays as it is."""
    return df.withColumn(column, unit_length(F.col(column).cast("array<double>")))


def attach_vectors(df: DataFrame, vectors: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """Join precomputed vectors by key and scale them to unit length."""
    return unit_vectors(df.join(vectors.select(key, column), key, "inner"), column)
