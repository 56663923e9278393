"""Descriptive and diagnostic tables over the covariates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.lineage import staged
from tenura.operators.ordered import quantile_cuts, running_sums, slabs_for

# A rank table up to this many rows is small enough to send to every executor.
BROADCAST_VALUES = 200_000
COLLINEAR = 0.7


def contract_rules(features: Sequence[str]) -> dict[str, Column]:
    """Value rules of the survival and signal columns. A NULL breaks its rule."""
    rules = {
        "event_binary": F.col("event").isin(0, 1),
        "duration_positive": F.col("duration") > 0,
    }
    ranges = {"sentiment_score": (-1.0, 1.0), "frustration_level": (0.0, 1.0)}
    binary = ("technical_issue", "value_complaint", "engagement_dropped", "positive_signal")
    for name, (low, high) in ranges.items():
        if name in features:
            rules[f"{name}_range"] = F.col(name).between(low, high)
    for name in binary:
        if name in features:
            rules[f"{name}_binary"] = F.col(name).isin(0, 1)
    return rules


def contract_violations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Number of rows that break each rule, all rules in one pass."""
    rules = contract_rules(features)
    counted = df.agg(
        *[F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias(name) for name, ok in rules.items()]
    )
    return _rows(counted, "rule", list(rules), {"violations": "{0}"})


def describe_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, minimum and maximum per feature, in one pass."""
    measures = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(
        *[
            measure(F.col(f).cast("double")).alias(f"{f}__{m}")
            for f in features
            for m, measure in measures.items()
        ]
    )
    return _rows(wide, "feature", features, {m: "{0}__" + m for m in measures})


def rates_by_event(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Share of rows with each binary signal, per event class."""
    wide = df.groupBy("event").agg(*[F.avg(f).alias(f) for f in features])
    return _rows(wide, "feature", features, {"rate": "{0}"}, keep=["event"])


def _rows(wide: DataFrame, label: str, names: Sequence[str], values: dict[str, str], keep: Sequence[str] = ()):
    """One output row per name from a one-row-per-group wide aggregate."""
    entries = F.array(
        *[
            F.struct(F.lit(n).alias(label), *[F.col(c.format(n)).alias(v) for v, c in values.items()])
            for n in names
        ]
    )
    return wide.select(*keep, F.explode(entries).alias("_row")).select(*keep, "_row.*")


def density_by_event(
    df: DataFrame, features: Sequence[str], points: int = 200, bins: int = 1024
) -> DataFrame:
    """Gaussian kernel density per event class on a grid, from binned counts.

    Bandwidth is the deviation times n**(-1/5), and the grid reaches three bandwidths past the
    data. Values are counted in fine bins first, so the kernel sum costs bins x points per class
    whatever the number of rows.
    """
    long = _rows(df.filter(F.col("event").isNotNull()), "feature", features, {"x": "{0}"}, keep=["event"])
    long = long.select("event", "feature", F.col("x").cast("double").alias("x")).filter(F.col("x").isNotNull())
    shape = long.groupBy("event", "feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.stddev_samp("x").alias("sd"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
    )
    shape = (
        shape.filter(F.col("sd") > 0)
        .withColumn("bw", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
        .withColumn("start", F.col("low") - 3 * F.col("bw"))
        .withColumn("width", F.col("high") - F.col("low") + 6 * F.col("bw"))
        .drop("sd", "low", "high")
    )
    # classes x features rows
    placed = long.join(F.broadcast(shape), ["event", "feature"])
    bin_of = F.floor((F.col("x") - F.col("start")) / F.col("width") * bins)
    binned = placed.groupBy("event", "feature", "n", "bw", "start", "width", bin_of.alias("bin")).agg(
        F.count(F.lit(1)).alias("c")
    )
    spread = binned.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("start") + F.col("width") * F.col("point") / F.lit(float(points - 1))
    centre = F.col("start") + F.col("width") * (F.col("bin") + 0.5) / F.lit(float(bins))
    z = (at - centre) / F.col("bw")
    kernel = F.exp(-z * z / 2) / F.lit(math.sqrt(2 * math.pi))
    return spread.groupBy("event", "feature", "point").agg(
        F.min(at).alias("x"),
        (F.sum(F.col("c") * kernel) / F.min(F.col("n") * F.col("bw"))).alias("density"),
    )


def histogram_by_event(df: DataFrame, feature: str, low: float, high: float, bins: int) -> DataFrame:
    """Row counts per event class and equal-width bin; the last bin includes its upper edge. Rows below
    the range are counted in bin -1 and rows above it in bin `bins`, missing values in a null bin."""
    x = F.col(feature)
    place = F.least(F.floor((x - F.lit(low)) / F.lit((high - low) / bins)).cast("int"), F.lit(bins - 1))
    bin_of = F.when(x < low, F.lit(-1)).when(x > high, F.lit(bins)).when(x.isNotNull(), place)
    return df.groupBy("event", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))


def spearman_matrix(df: DataFrame, features: Sequence[str], rows_per_slab: int = 250_000) -> DataFrame:
    """Spearman correlation of every pair, as rows (feature_x, feature_y, rho), each over the rows that
    have both values: a sparse feature does not change the correlations of the others.

    Equal rows are counted together first. A feature is ranked once over its own rows, and once more for
    each sparse partner over the rows that have both; all rankings share one long pass, so the number of
    jobs does not depend on the features. A constant feature has no correlation; NaN counts as missing.
    """
    names = [f"f{i}" for i in range(len(features))]
    values = [F.col(f).cast("double") for f in features]
    typed = df.select(*[F.when(~F.isnan(v), v).alias(n) for v, n in zip(values, names)])
    joint = staged(
        typed.groupBy(*names).agg(F.count(F.lit(1)).alias("w")).withColumn("id", F.monotonically_increasing_id())
    )
    gaps = joint.agg(*[F.max(F.col(n).isNull()).alias(n) for n in names]).first()
    sparse = [i for i in range(len(names)) if gaps[i]]
    places = range(len(names))
    rankings = [(i, None) for i in places] + [(i, j) for i in places for j in sparse if i != j]
    number = {ranking: k for k, ranking in enumerate(rankings)}

    entries = [
        F.struct(F.lit(k).alias("ranking"), (F.col(names[i]) if j is None else F.when(F.col(names[j]).isNotNull(), F.col(names[i]))).alias("x"))
        for k, (i, j) in enumerate(rankings)
    ]
    long = joint.select("id", "w", F.inline(F.array(*entries))).filter("x IS NOT NULL")
    counts = staged(long.groupBy("ranking", "x").agg(F.sum("w").alias("c")))
    size = counts.count()
    # slabs of the values of all rankings together: none holds more than its share
    cuts = quantile_cuts(counts, "x", slabs_for(size, rows_per_slab))
    middle = counts.groupBy("ranking").agg(((F.sum("c") + 1) / 2.0).alias("middle"))
    ranks = (
        running_sums(counts, "x", {"upto": F.col("c")}, group=["ranking"], cuts=cuts)
        .join(F.broadcast(middle), "ranking")  # one row a ranking
        .select("ranking", "x", (F.col("upto") - (F.col("c") - 1) / 2.0 - F.col("middle")).alias("r"))
    )
    ranked = long.join(F.broadcast(ranks) if size <= BROADCAST_VALUES else ranks, ["ranking", "x"])
    wide = ranked.groupBy("id", "w").agg(
        *[F.max(F.when(F.col("ranking") == k, F.col("r"))).alias(f"r{k}") for k in range(len(rankings))]
    )

    def of(i: int, j: int) -> int:
        return number[i, j if j in sparse and i != j else None]

    pairs = list(combinations_with_replacement(places, 2))
    sums = wide.agg(
        *[F.sum(F.col("w") * F.col(f"r{k}") * F.col(f"r{k}")).alias(f"q{k}") for k in range(len(rankings))],
        *[F.sum(F.col("w") * F.col(f"r{of(i, j)}") * F.col(f"r{of(j, i)}")).alias(f"s_{i}_{j}") for i, j in pairs],
    )
    found = []
    for i, j in pairs:
        scale = F.sqrt(f"q{of(i, j)}") * F.sqrt(f"q{of(j, i)}")
        rho = F.when(scale > 0, F.lit(1.0) if i == j else F.col(f"s_{i}_{j}") / scale)
        for x, y in dict.fromkeys([(i, j), (j, i)]):
            found.append(F.struct(F.lit(features[x]).alias("feature_x"), F.lit(features[y]).alias("feature_y"), rho.alias("rho")))
    return sums.select(F.inline(F.array(*found)))


def collinear_pairs(matrix: DataFrame, threshold: float = COLLINEAR) -> DataFrame:
    """Distinct pairs whose absolute correlation exceeds the threshold."""
    return matrix.filter((F.col("feature_x") < F.col("feature_y")) & (F.abs("rho") > threshold))
