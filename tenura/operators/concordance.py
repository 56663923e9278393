"""Exact concordance of risks with outcomes, for many models at once, without pairing rows.

A pair (i, j) counts when i has the event and j is observed longer (or equally long and censored).
It is concordant when j has the lower risk and tied when the risks are equal.

Rows with the same model, time, event and risk are counted together first. Times are cut into
leaf slabs. Pairs inside one leaf are counted there. Pairs across leaves are counted level by
level, 64 slabs at a time: every level splits a parent slab into children and counts the pairs
whose two rows fall into different children. Within a level, risks are cut into slabs too: pairs
in different risk slabs come from a small grid of counts, and pairs in the same risk slab from one
pass in risk order. A time or a risk that holds very many rows has a slab of its own, in which
nothing is left to compare, so hot values need no task of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.functions.columns import literal_array
from tenura.lineage import staged
from tenura.operators.ordered import Cuts, cut_points, quantile_cuts, with_slab

CHILDREN = 64
LEAF_ROWS = 50_000
MIN_RISK_SLABS, MAX_RISK_SLABS = 64, 4096
MAX_LEAVES = CHILDREN**3
SLOTS = 2**20  # risk slab numbers set aside for one model
PART_SCHEMA = "model string, concordant double, tied double, pairs double"


def concordance(
    df: DataFrame,
    model: str | None = None,
    risk: str | Column = "risk",
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """C index per model: rows (model, concordant, tied, pairs, cindex).

    Needs `duration`, `event` and a risk (a higher risk means an earlier event). Risks are
    compared exactly: round them first where equal inputs may differ in their last bits. A model
    without an admissible pair has a NULL index.
    """
    risk_column = F.col(risk) if isinstance(risk, str) else risk
    cells = (
        df.select(
            (F.col(model).cast("string") if model else F.lit("")).alias("model"),
            F.col("duration").cast("double").alias("t"),
            F.col("event").cast("int").alias("e"),
            risk_column.cast("double").alias("r"),
        )
        .dropna()
        .groupBy("model", "t", "e", "r")
        .agg(F.count(F.lit(1)).alias("w"))
    )
    cells = staged(cells)
    sizes = {row["model"]: row["count"] for row in cells.groupBy("model").count().collect()}
    largest = max(sizes.values(), default=0)
    placed, leaves, single = _place(cells, largest, leaf_rows)
    parts = [_inside_leaves(placed, single)]
    if leaves > 1:
        placed, names, hot = _with_risk_slab(placed, largest, leaf_rows)
        for level in range(_levels(leaves)):
            parts += _between_children(placed, names, hot, level, _levels(leaves))
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    found = total.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("concordant", "tied", "pairs")])
    models = placed.select("model").distinct()
    result = models.join(found, "model", "left").na.fill(0.0, ["concordant", "tied", "pairs"])
    score = (F.col("concordant") + 0.5 * F.col("tied")) / F.col("pairs")
    result = result.withColumn("cindex", F.when(F.col("pairs") > 0, score))
    return result.withColumnRenamed("model", model) if model else result.drop("model")


def _levels(leaves: int) -> int:
    levels = 0
    while CHILDREN**levels < leaves:
        levels += 1
    return levels


# ---------------------------------------------------------------- slabs


def _place(cells: DataFrame, largest: int, leaf_rows: int):
    """Add the leaf. A time with a slab of its own gets two leaves, events before censored."""
    wanted = min(MAX_LEAVES, math.ceil(largest / leaf_rows))
    cuts = quantile_cuts(cells, "t", wanted) if wanted > 1 else Cuts(())
    slabbed = with_slab(cells, "t", cuts, "slab")
    first, single, leaves = [], [], 0
    for alone in cuts.single():
        first.append(leaves)
        if alone:
            single += [leaves, leaves + 1]
        leaves += 2 if alone else 1
    leaf = F.element_at(literal_array(first, "int"), F.col("slab") + 1)
    if single:
        alone = literal_array([int(a) for a in cuts.single()], "int")
        leaf = leaf + F.element_at(alone, F.col("slab") + 1) * (1 - F.col("e"))
    return slabbed.withColumn("leaf", leaf.cast("int")).drop("slab"), leaves, single


def _with_risk_slab(placed: DataFrame, largest: int, leaf_rows: int):
    """Add the risk slab of each row, numbered over all models; also returns the models in that
    order and the slabs with a single risk. Each slab is one stretch of work, so their number grows
    with the rows."""
    slabs = min(MAX_RISK_SLABS, max(MIN_RISK_SLABS, math.ceil(largest / leaf_rows)))
    shares = [i / slabs for i in range(1, slabs)]
    found = placed.groupBy("model").agg(F.percentile_approx("r", shares, 4 * slabs).alias("q")).collect()
    cuts = {row["model"]: cut_points(sorted(row["q"])) for row in found}
    names = sorted(cuts)
    edges = {m: (SLOTS * i, np.array(cuts[m].points)) for i, m in enumerate(names)}
    hot = [SLOTS * i + slab for i, m in enumerate(names) for slab, alone in enumerate(cuts[m].single()) if alone]

    @F.pandas_udf("long")
    def risk_slab(models: pd.Series, risks: pd.Series) -> pd.Series:
        out = np.zeros(len(risks), dtype=np.int64)
        for name, at in risks.groupby(models, sort=False).indices.items():
            first, points = edges[name]
            out[at] = first + np.searchsorted(points, risks.to_numpy()[at], side="right")
        return pd.Series(out)

    return staged(placed.withColumn("rs", risk_slab("model", "r"))), names, hot


# ---------------------------------------------------------------- pairs inside one leaf


def count_pairs(cls: np.ndarray, risk: np.ndarray, events: np.ndarray, weight: np.ndarray):
    """Concordant, tied and admissible pairs in memory, bit by bit of the time class.

    Two rows with different classes first differ at one bit; with that bit as the split and the
    higher bits as the group, running sums in risk order count all such pairs.
    """
    order = np.argsort(risk, kind="stable")
    cls, risk = cls[order], risk[order]
    events, weight = events[order], weight[order]
    here = np.arange(len(cls))
    concordant = tied = pairs = 0.0
    for bit in reversed(range(int(cls.max()).bit_length())):
        # rows lie in order of (higher bits, risk)
        group = cls >> (bit + 1)
        later = (cls >> bit) & 1
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        g_start, g_stop = _spans(new_group)
        r_start, r_stop = _spans(new_group | np.concatenate([[True], risk[1:] != risk[:-1]]))
        upto = np.concatenate([[0.0], np.cumsum(weight * later)])
        early = events * (1 - later)
        concordant += float((early * (upto[r_start] - upto[g_start])).sum())
        tied += float((early * (upto[r_stop] - upto[r_start])).sum())
        pairs += float((early * (upto[g_stop] - upto[g_start])).sum())
        # move the early rows of each group in front of its later rows, keeping risk order
        zeros = np.concatenate([[0], np.cumsum(1 - later)])
        ahead = zeros[:-1] - zeros[g_start]
        front = zeros[g_stop] - zeros[g_start]
        place = g_start + np.where(later == 0, ahead, front + (here - g_start - ahead))
        moved = np.empty_like(place)
        moved[place] = here
        cls, risk, events, weight = cls[moved], risk[moved], events[moved], weight[moved]
    return concordant, tied, pairs


def _spans(starts_here: np.ndarray):
    """First position and end position of the run that each position belongs to."""
    starts = np.flatnonzero(starts_here)
    lengths = np.diff(np.concatenate([starts, [len(starts_here)]]))
    return np.repeat(starts, lengths), np.repeat(starts + lengths, lengths)


def _inside_leaves(placed: DataFrame, single: list[int]) -> DataFrame:
    # every row of a single leaf has the same time and event, so no pair of it is admissible
    rows = placed.filter(~F.col("leaf").isin(single)) if single else placed

    def work(key, table):
        t, e, r, w = (table.column(c).to_numpy() for c in ("t", "e", "r", "w"))
        cls = 2 * np.unique(t, return_inverse=True)[1] + (1 - e)
        found = count_pairs(cls, r, (e * w).astype(float), w.astype(float))
        return pa.table(
            {"model": pa.array([key[0].as_py()]), **{n: pa.array([v]) for n, v in zip(PARTS, found)}}
        )

    # a leaf holds about LEAF_ROWS distinct rows
    return rows.groupBy("model", "leaf").applyInArrow(work, PART_SCHEMA)


PARTS = ("concordant", "tied", "pairs")


# ---------------------------------------------------------------- pairs across leaves


def _between_children(
    placed: DataFrame, names: list[str], hot: list[int], level: int, levels: int
) -> list[DataFrame]:
    below = CHILDREN ** (levels - level - 1)
    rows = placed.select(
        "model",
        F.floor(F.col("leaf") / (below * CHILDREN)).cast("int").alias("parent"),
        F.pmod(F.floor(F.col("leaf") / below), F.lit(CHILDREN)).cast("int").alias("child"),
        "rs",
        "r",
        (F.col("w") * F.col("e")).cast("double").alias("ev"),
        F.col("w").cast("double").alias("w"),
    )
    counts = rows.groupBy("model", "parent", "rs", "child").agg(F.sum("ev").alias("ev"), F.sum("w").alias("w"))

    def grid(key, table):
        model = key[0].as_py()
        rs, slot = np.unique(table.column("rs").to_numpy(), return_inverse=True)
        child = table.column("child").to_numpy()
        ev, al = np.zeros((len(rs), CHILDREN)), np.zeros((len(rs), CHILDREN))
        ev[slot, child] = table.column("ev").to_numpy()
        al[slot, child] = table.column("w").to_numpy()
        later = _later_children(al)
        lower = np.cumsum(later, axis=0) - later  # later children in lower risk slabs
        alone = np.isin(rs, hot)
        found = ((ev * lower).sum(), (ev * later)[alone].sum(), (ev * later.sum(axis=0)).sum())
        return pa.table(
            {"model": pa.array([model]), **{n: pa.array([float(v)]) for n, v in zip(PARTS, found)}}
        )

    # at most (2 * MAX_RISK_SLABS) x CHILDREN counts per group
    across = counts.groupBy("model", "parent").applyInArrow(grid, PART_SCHEMA)

    mixed = rows.filter(~F.col("rs").isin(hot)) if hot else rows
    ordered = mixed.drop("model").repartition("rs", "parent").sortWithinPartitions("rs", "parent", "r")
    return [across, ordered.mapInArrow(lambda batches: _in_risk_order(batches, names), PART_SCHEMA)]


def _later_children(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts[..., ::-1], axis=-1)[..., ::-1] - counts


def _in_risk_order(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Pairs in the same risk slab, from one pass over rows sorted by slab and risk. Only counts
    per child are carried from batch to batch, so a slab may have any number of rows."""
    sums: dict[str, np.ndarray] = {}
    lower = np.zeros(CHILDREN)  # counts at lower risks of the current slab
    here = np.zeros((2, CHILDREN))  # events and counts at the current risk
    at = None  # model, slab, parent and risk that `here` belongs to
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rs, parent, r, child = (batch.column(c).to_numpy() for c in ("rs", "parent", "r", "child"))
        new_slab = np.concatenate([[True], (rs[1:] != rs[:-1]) | (parent[1:] != parent[:-1])])
        new_risk = new_slab | np.concatenate([[True], r[1:] != r[:-1]])
        run = np.cumsum(new_risk) - 1
        cell = run * CHILDREN + child
        size = (run[-1] + 1) * CHILDREN
        grid = [
            np.bincount(cell, batch.column(c).to_numpy(), minlength=size).reshape(-1, CHILDREN) for c in ("ev", "w")
        ]
        stops = np.append(np.flatnonzero(new_slab), len(rs))
        for start, stop in zip(stops[:-1], stops[1:]):
            first, last = run[start], run[stop - 1] + 1
            slab = (names[rs[start] // SLOTS], rs[start], parent[start])
            events, counts = grid[0][first:last], grid[1][first:last]
            if at is not None and at[:-1] == slab:
                if at[-1] == r[start]:
                    events[0] += here[0]
                    counts[0] += here[1]
                else:
                    _settle(sums, at[0], here[0][None], here[1][None], lower)
                    lower = lower + here[1]
            else:
                if at is not None:
                    _settle(sums, at[0], here[0][None], here[1][None], lower)
                lower = np.zeros(CHILDREN)
            # the last risk may go on in the next batch
            _settle(sums, slab[0], events[:-1], counts[:-1], lower)
            lower = lower + counts[:-1].sum(axis=0)
            here = np.stack([events[-1], counts[-1]])
            at = (*slab, r[stop - 1])
    if at is not None:
        _settle(sums, at[0], here[0][None], here[1][None], lower)
    for model, (concordant, tied) in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([model]), pa.array([concordant]), pa.array([tied]), pa.array([0.0])],
            names=["model", *PARTS],
        )


def _settle(sums, model: str, events: np.ndarray, counts: np.ndarray, lower: np.ndarray) -> None:
    if len(events) == 0:
        return
    below = lower + np.cumsum(counts, axis=0) - counts
    total = sums.setdefault(model, np.zeros(2))
    total += [(events * _later_children(below)).sum(), (events * _later_children(counts)).sum()]
