"""Ordered running sums without a single-partition window.

A key range is cut into slabs at approximate quantiles. Sums over whole slabs are tiny, so a
window over slab totals gives each slab its offset, and a window inside each slab finishes the
job. Where the cuts fall changes only the balance, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_SLAB = 250_000
MAX_SLABS = 8192


@dataclass(frozen=True)
class Cuts:
    """Ascending cut points. Slab i holds the keys in [points[i-1], points[i])."""

    points: tuple[float, ...]

    @property
    def slabs(self) -> int:
        return len(self.points) + 1

    def single(self) -> list[bool]:
        """For each slab: does it hold exactly one possible key value?"""
        edges = (-math.inf, *self.points, math.inf)
        return [math.nextafter(low, math.inf) == high for low, high in zip(edges, edges[1:])]


def cut_points(quantiles: Sequence[float]) -> Cuts:
    """Cut points from quantiles; a value that fills more than one quantile gets a slab alone."""
    points: set[float] = set()
    previous = None
    for value in quantiles:
        points.add(float(value))
        if value == previous:
            points.add(math.nextafter(float(value), math.inf))
        previous = value
    return Cuts(tuple(sorted(p for p in points if math.isfinite(p))))


def quantile_cuts(df: DataFrame, key: str, slabs: int) -> Cuts:
    """Approximate quantile cuts of a numeric column, in one aggregate."""
    if slabs <= 1:
        return Cuts(())
    shares = [i / slabs for i in range(1, slabs)]
    accuracy = max(1000, 4 * slabs)
    found = df.agg(F.percentile_approx(F.col(key).cast("double"), shares, accuracy)).first()[0]
    return cut_points(sorted(found or []))


def slabs_for(rows: int, rows_per_slab: int = ROWS_PER_SLAB) -> int:
    return max(1, min(MAX_SLABS, math.ceil(rows / rows_per_slab)))


def with_slab(df: DataFrame, key: str, cuts: Cuts, name: str = "_slab") -> DataFrame:
    """Add the slab number of a key (a binary search in the JVM)."""
    if cuts.slabs == 1:
        return df.withColumn(name, F.lit(0))
    edges = [-math.inf, *cuts.points, math.inf]
    marked = Bucketizer(splits=edges, inputCol="_slab_key", outputCol="_slab_out").transform(
        df.withColumn("_slab_key", F.col(key).cast("double"))
    )
    return marked.withColumn(name, F.col("_slab_out").cast("int")).drop("_slab_key", "_slab_out")


def running_sums(
    df: DataFrame,
    key: str,
    values: dict[str, Column],
    group: Sequence[str] = (),
    descending: bool = False,
    cuts: Cuts = Cuts(()),
) -> DataFrame:
    """Add inclusive running sums of `values` along `key`, per group.

    `df` must hold one row per (group, key): aggregate first, which also folds hot keys together
    before anything is shuffled. Pass a frame that is cheap to read twice.
    """
    marked = with_slab(df, key, cuts)
    for name, value in values.items():
        marked = marked.withColumn(f"_in_{name}", value)
    order = F.col(key).desc() if descending else F.col(key).asc()
    inside = (
        Window.partitionBy(*group, "_slab").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    result = marked
    for name in values:
        result = result.withColumn(name, F.sum(f"_in_{name}").over(inside))
    if cuts.slabs > 1:
        result = _add_offsets(result, marked, list(values), group, descending)
    return result.drop("_slab", *[f"_in_{name}" for name in values])


def _add_offsets(result, marked, names, group, descending):
    totals = marked.groupBy(*group, "_slab").agg(
        *[F.sum(f"_in_{name}").alias(f"_sum_{name}") for name in names]
    )
    order = F.col("_slab").desc() if descending else F.col("_slab").asc()
    # at most MAX_SLABS rows per group reach this window
    before = (
        Window.partitionBy(*(group or [F.lit(0)]))
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *[F.col(g).alias(f"_g_{g}") for g in group],
        F.col("_slab").alias("_offset_slab"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in names],
    )
    same = F.col("_slab") == F.col("_offset_slab")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = result.join(offsets, same, "left")
    for name in names:
        joined = joined.withColumn(name, F.col(name) + F.col(f"_off_{name}"))
    return joined.drop(
        "_offset_slab", *[f"_g_{g}" for g in group], *[f"_off_{name}" for name in names]
    )
