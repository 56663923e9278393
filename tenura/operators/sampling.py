"""Exact seeded splits that never shuffle or sort the rows they split.

Rows are ordered by the md5 of their key and a seed. A split then needs only the hash value at a
few ranks. Those are found by counting hash prefixes and looking closer at the prefixes that hold
the wanted ranks, so each split becomes a comparison with a literal.
"""

from __future__ import annotations

import math
from collections.abc import Hashable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.functions.columns import order_hash

PREFIX_STEP = 3
FEW_ROWS = 4096
MAX_STRATA = 1000

HOLDOUT_FRACTION = 0.20
HOLDOUT_SEED = 1729
FOLDS = 5
FOLD_SEED = 42


def rank_cutoffs(
    df: DataFrame, hash_column: str, stratum: str | None, wanted: dict[Hashable, Sequence[int]]
) -> dict[tuple[Hashable, int], str]:
    """Hash at each wanted rank (1 = smallest) of each stratum.

    Counting by prefix returns at most 16**PREFIX_STEP rows per stratum and wanted rank and level.
    """
    base = df.select(
        F.col(hash_column).alias("h"),
        (F.col(stratum) if stratum else F.lit(0)).alias("s"),
    )
    found: dict[tuple[Hashable, int], str] = {}
    # (stratum, rank asked for) -> (prefix known so far, rank inside the prefix)
    open_ranks = {(s, r): ("", r) for s, ranks in wanted.items() for r in ranks if r > 0}
    length = 0
    while open_ranks:
        narrowed = _inside(base, {(s, p) for (s, _), (p, _) in open_ranks.items()}, length)
        known, length = length, min(32, length + PREFIX_STEP)
        counts: dict[tuple, list[tuple[str, int]]] = {}
        rows = narrowed.groupBy("s", F.substring("h", 1, length).alias("p")).count().collect()
        for row in rows:
            counts.setdefault((row["s"], row["p"][:known]), []).append((row["p"], row["count"]))
        close: dict[tuple, tuple[str, int]] = {}
        further: dict[tuple, tuple[str, int]] = {}
        for (s, asked), (prefix, rank) in open_ranks.items():
            for deeper, count in sorted(counts.get((s, prefix), [])):
                if rank <= count:
                    (close if count <= FEW_ROWS else further)[(s, asked)] = (deeper, rank)
                    break
                rank -= count
            else:
                raise ValueError(f"stratum {s!r} has fewer than {asked} rows")
        if close:
            found.update(_pick(base, close, length))
        if further and length >= 32:
            raise ValueError("the key columns do not identify a row")
        open_ranks = further
    return found


def _inside(base: DataFrame, places: set[tuple], length: int) -> DataFrame:
    if length == 0:
        return base
    keep = F.lit(False)
    for s, prefix in places:
        keep = keep | (F.col("s").eqNullSafe(F.lit(s)) & F.col("h").startswith(prefix))
    return base.filter(keep)


def _pick(base: DataFrame, close: dict, length: int) -> dict:
    places = {(s, prefix) for (s, _), (prefix, _) in close.items()}
    members: dict[tuple, list[str]] = {}
    for row in _inside(base, places, length).collect():
        members.setdefault((row["s"], row["h"][:length]), []).append(row["h"])
    picked = {}
    for (s, asked), (prefix, rank) in close.items():
        hashes = sorted(members[(s, prefix)])
        if rank < len(hashes) and hashes[rank] == hashes[rank - 1]:
            raise ValueError("the key columns do not identify a row")
        picked[(s, asked)] = hashes[rank - 1]
    return picked


def _stratum_counts(df: DataFrame, stratum: str) -> dict[Hashable, int]:
    rows = df.groupBy(stratum).count().limit(MAX_STRATA + 1).collect()
    if len(rows) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata in {stratum}")
    return {row[0]: row[1] for row in rows}


def _largest_remainder(counts: dict[Hashable, int], total: int) -> dict[Hashable, int]:
    """Share `total` over the strata in proportion to their size, in whole rows."""
    rows = sum(counts.values())
    whole = {s: c * total // rows for s, c in counts.items()}
    missing = total - sum(whole.values())
    by_remainder = sorted(counts, key=lambda s: (-(counts[s] * total % rows), str(s)))
    for s in by_remainder[:missing]:
        whole[s] += 1
    return whole


def _below(hash_column: str, stratum: str, limits: dict[Hashable, str | None]):
    """True for the rows at or below their stratum's cutoff."""
    inside = F.lit(False)
    for s, limit in limits.items():
        if limit is not None:
            inside = inside | (F.col(stratum).eqNullSafe(F.lit(s)) & (F.col(hash_column) <= F.lit(limit)))
    return inside


def holdout_split(
    df: DataFrame,
    keys: Sequence[str],
    stratum: str = "event",
    fraction: float = HOLDOUT_FRACTION,
    seed: int = HOLDOUT_SEED,
) -> DataFrame:
    """Add `split` = train / test. Sizes are exact: ceil(n * fraction) test rows in all, and the
    training rows are shared over the strata by largest remainder."""
    marked = df.withColumn("_hash", order_hash(keys, seed))
    counts = _stratum_counts(df, stratum)
    rows = sum(counts.values())
    if rows == 0:
        return df.withColumn("split", F.lit("train"))
    # 12 digits hide the binary rounding of n * fraction, such as 0.1 * 30 > 3
    test_rows = math.ceil(round(rows * fraction, 12))
    train = _largest_remainder(counts, rows - test_rows)
    sizes = {s: counts[s] - train[s] for s in counts}
    cutoffs = rank_cutoffs(marked, "_hash", stratum, {s: [k] for s, k in sizes.items()})
    in_test = _below("_hash", stratum, {s: cutoffs.get((s, k)) for s, k in sizes.items()})
    return marked.withColumn("split", F.when(in_test, "test").otherwise("train")).drop("_hash")


def with_folds(
    df: DataFrame,
    keys: Sequence[str],
    folds: int = FOLDS,
    seed: int = FOLD_SEED,
    name: str = "fold",
    basis: DataFrame | None = None,
) -> DataFrame:
    """Add the fold number. Folds are blocks of the hash order of the `basis` rows (all rows by
    default); the first n % folds get one row more."""
    counted = (df if basis is None else basis).withColumn("_hash", order_hash(keys, seed))
    rows = counted.count()
    ends, end = [], 0
    for fold in range(folds):
        end += rows // folds + (1 if fold < rows % folds else 0)
        ends.append(end)
    cutoffs = rank_cutoffs(counted, "_hash", None, {0: ends[:-1]})
    fold = F.lit(folds - 1)
    for number in reversed(range(folds - 1)):
        limit = cutoffs.get((0, ends[number]))
        if limit is not None:
            fold = F.when(F.col("_hash") <= F.lit(limit), number).otherwise(fold)
    marked = df.withColumn("_hash", order_hash(keys, seed))
    return marked.withColumn(name, fold.cast("int")).drop("_hash")


def stratified_cap(
    df: DataFrame, max_rows: int | None, keys: Sequence[str], event: str = "event", seed: int = FOLD_SEED
) -> DataFrame:
    """Keep at most `max_rows` rows with the event rate preserved. This is the row-cap feature of
    the survival table (None keeps everything); it is never used to make a query cheaper."""
    if max_rows is None:
        return df
    counts = _stratum_counts(df, event)
    rows = sum(counts.values())
    if rows <= max_rows:
        return df
    events, others = counts.get(1, 0), counts.get(0, 0)
    take_events = min(int(max_rows * (events / rows)), events)
    take = {1: take_events, 0: min(max_rows - take_events, others)}
    marked = df.withColumn("_hash", order_hash(keys, seed))
    cutoffs = rank_cutoffs(marked, "_hash", event, {s: [k] for s, k in take.items()})
    kept = _below("_hash", event, {s: cutoffs.get((s, k)) for s, k in take.items()})
    return marked.filter(kept).drop("_hash")
