"""Kaplan-Meier curves as ordered running sums over distinct times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.functions.tails import Z_95
from tenura.lineage import staged
from tenura.operators.ordered import ROWS_PER_SLAB, Cuts, quantile_cuts, running_sums, slabs_for


def time_steps(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Deaths and departures per distinct time; hot times fold together before the shuffle."""
    return (
        df.dropna(subset=["duration", "event"])
        .groupBy(*group, F.col("duration").cast("double").alias("time"))
        .agg(F.sum("event").cast("long").alias("deaths"), F.count(F.lit(1)).alias("removed"))
    )


def cuts_of(steps: DataFrame, rows_per_slab: int = ROWS_PER_SLAB) -> Cuts:
    return quantile_cuts(steps, "time", slabs_for(steps.count(), rows_per_slab))


def kaplan_meier(df: DataFrame, group: str | None = None, rows_per_slab: int = ROWS_PER_SLAB) -> DataFrame:
    """Survival per group and time with a log-log confidence band.

    Each curve opens with time 0 and survival 1. The band is [1, 1] before the first death and
    NULL once survival is 0.
    """
    keys = [group] if group else []
    steps = staged(time_steps(df, keys))
    cuts = cuts_of(steps, rows_per_slab)
    # at risk are all that leave at this time or later; written, as the next sums read it more than once
    at_risk = staged(running_sums(steps, "time", {"at_risk": F.col("removed")}, keys, descending=True, cuts=cuts))
    lived = F.col("at_risk") - F.col("deaths")
    summed = running_sums(
        at_risk,
        "time",
        {
            "_log_s": F.when(lived > 0, F.log(lived / F.col("at_risk"))).otherwise(F.lit(0.0)),
            "_var": F.when(lived > 0, F.col("deaths") / (F.col("at_risk") * lived)).otherwise(F.lit(0.0)),
            "_ended": (lived == 0).cast("int"),
        },
        keys,
        cuts=cuts,
    )
    survival = F.when(F.col("_ended") > 0, F.lit(0.0)).otherwise(F.exp("_log_s"))
    spread = F.lit(Z_95) * F.sqrt("_var") / F.col("_log_s")

    def bound(sign: int):
        return (
            F.when(F.col("_ended") > 0, F.lit(None).cast("double"))
            .when(F.col("_log_s") == 0, F.lit(1.0))
            .otherwise(F.exp(F.col("_log_s") * F.exp(F.lit(float(sign)) * spread)))
        )

    curve = summed.select(
        *keys,
        "time",
        "at_risk",
        "deaths",
        survival.alias("survival"),
        # _log_s is negative, so a minus sign widens the exponent and gives the lower bound
        bound(-1).alias("lower"),
        bound(+1).alias("upper"),
    )
    start = steps.groupBy(*keys).agg(F.sum("removed").alias("at_risk"), F.min("time").alias("_first"))
    origin = start.filter(F.col("_first") > 0).select(
        *keys,
        F.lit(0.0).alias("time"),
        "at_risk",
        F.lit(0).cast("long").alias("deaths"),
        F.lit(1.0).alias("survival"),
        F.lit(1.0).alias("lower"),
        F.lit(1.0).alias("upper"),
    )
    return origin.unionByName(curve)


def median_survival(curve: DataFrame, group: str | None = None) -> DataFrame:
    """First time at which survival is 0.5 or less; NULL where the curve stays above."""
    keys = [group] if group else []
    # 1e-12 keeps an exact half from being missed by the rounding of exp(sum of logs)
    reached = F.col("survival") <= F.lit(0.5 + 1e-12)
    return curve.groupBy(*keys).agg(F.min(F.when(reached, F.col("time"))).alias("median_time"))


def by_median(df: DataFrame, column: str, name: str = "above_median") -> DataFrame:
    """Mark the rows above the exact median of a column (1) and the others (0)."""
    middle = exact_median(df, column)
    return df.filter(F.col(column).isNotNull()).withColumn(
        name, (F.col(column) > F.lit(middle)).cast("int")
    )


def exact_median(df: DataFrame, column: str, rows_per_slab: int = ROWS_PER_SLAB) -> float | None:
    """Exact median from value counts: running counts are ordered slab by slab, and only the one
    or two middle values come to the driver."""
    counts = staged(
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    shape = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not shape[1]:
        return None
    cuts = quantile_cuts(counts, "value", slabs_for(shape[0], rows_per_slab))
    summed = running_sums(counts, "value", {"upto": F.col("n")}, cuts=cuts)
    low, high = (shape[1] + 1) // 2, shape[1] // 2 + 1
    holds = lambda rank: (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)
    middle = summed.agg(
        F.min(F.when(holds(low), F.col("value"))), F.min(F.when(holds(high), F.col("value")))
    ).first()
    return (middle[0] + middle[1]) / 2.0
