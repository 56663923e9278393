"""Cox quantities at given coefficients, as aggregates per distinct time and ordered running sums."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenura.functions.columns import linear_predictor
from tenura.functions.tails import normal_two_sided
from tenura.lineage import staged
from tenura.operators.cox import CoxModel
from tenura.operators.ordered import ROWS_PER_SLAB, Cuts, quantile_cuts, running_sums, slabs_for, with_slab

# Ties at one time are worked off in blocks of this many deaths.
DEATHS_PER_BLOCK = 65_536
BROADCAST_TIMES = 200_000


def partial_hazard(coef: dict[str, float], means: dict[str, float] | None = None) -> Column:
    """exp(sum of coef * (x - mean)) of a row."""
    return F.exp(linear_predictor(coef, means))


def risk_table(
    df: DataFrame,
    coef: dict[str, float],
    means: dict[str, float] | None = None,
    moments: bool = False,
    rows_per_slab: int = ROWS_PER_SLAB,
) -> tuple[DataFrame, Cuts]:
    """One row per distinct time: rows, deaths, the risk sum s0 over everyone still observed, the
    risk sum d0 over the deaths; with `moments` also s1_k, d1_k and x_k (plain sum over deaths).

    Only distinct times leave the first aggregate, so a time shared by very many rows is one row.
    """
    features = list(coef)
    rows = df.dropna(subset=["duration", "event", *features]).select(
        F.col("duration").cast("double").alias("time"),
        F.col("event").cast("int").alias("e"),
        partial_hazard(coef, means).alias("r"),
        linear_predictor(coef, means).alias("eta"),
        *[F.col(f).cast("double").alias(f"f_{k}") for k, f in enumerate(features)],
    )
    dead = F.col("r") * F.col("e")
    sums = {"deaths": F.sum("e").cast("long"), "r0": F.sum("r"), "d0": F.sum(dead),
            "eta": F.sum(F.col("eta") * F.col("e"))}
    if moments:
        for k in range(len(features)):
            sums[f"r1_{k}"] = F.sum(F.col("r") * F.col(f"f_{k}"))
            sums[f"d1_{k}"] = F.sum(dead * F.col(f"f_{k}"))
            sums[f"x_{k}"] = F.sum(F.col("e") * F.col(f"f_{k}"))
    steps = staged(
        rows.groupBy("time").agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in sums.items()])
    )
    cuts = quantile_cuts(steps, "time", slabs_for(steps.count(), rows_per_slab))
    running = {"s0": F.col("r0")}
    if moments:
        running |= {f"s1_{k}": F.col(f"r1_{k}") for k in range(len(features))}
    table = running_sums(steps, "time", running, descending=True, cuts=cuts)
    return table.drop("r0", *[f"r1_{k}" for k in range(len(features))]), cuts


def _tie_sums(table: DataFrame) -> DataFrame:
    """Add the Efron sums over l = 0..d-1 of log(phi), 1/phi and (l/d)/phi with phi = s0 - (l/d) d0.

    The deaths of one time are split into blocks, so a time with very many deaths becomes many
    rows of bounded work.
    """
    deaths = table.filter(F.col("deaths") > 0).select("time", "deaths", "s0", "d0")
    blocks = deaths.withColumn(
        "l0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deaths") - 1, F.lit(DEATHS_PER_BLOCK).cast("long")))
    )
    last = F.least(F.col("l0") + DEATHS_PER_BLOCK - 1, F.col("deaths") - 1)
    frac = lambda l: l / F.col("deaths")  # noqa: E731, E741
    phi = lambda l: F.col("s0") - frac(l) * F.col("d0")  # noqa: E731, E741
    zero = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("inv"), F.lit(0.0).alias("frac_inv"))
    summed = F.aggregate(
        F.sequence(F.col("l0"), last),
        zero,
        lambda acc, l: F.struct(  # noqa: E741
            (acc["log"] + F.log(phi(l))).alias("log"),
            (acc["inv"] + 1 / phi(l)).alias("inv"),
            (acc["frac_inv"] + frac(l) / phi(l)).alias("frac_inv"),
        ),
    )
    return (
        blocks.repartition("time", "l0")
        .select("time", summed.alias("s"))
        .groupBy("time")
        .agg(
            F.sum("s.log").alias("log_phi"), F.sum("s.inv").alias("inv"), F.sum("s.frac_inv").alias("frac_inv")
        )
    )


def partial_loglik(
    df: DataFrame, coef: dict[str, float], means: dict[str, float] | None = None,
    rows_per_slab: int = ROWS_PER_SLAB,
) -> DataFrame:
    """Efron partial log-likelihood: one row (n_rows, n_events, loglik)."""
    table, _ = risk_table(df, coef, means, rows_per_slab=rows_per_slab)
    logs = _tie_sums(table).agg(F.coalesce(F.sum("log_phi"), F.lit(0.0)).alias("log_phi"))
    counts = table.agg(
        F.sum("n").alias("n_rows"), F.sum("deaths").alias("n_events"), F.sum("eta").alias("eta")
    )
    return counts.join(F.broadcast(logs)).select(  # two one-row aggregates
        "n_rows", "n_events", (F.col("eta") - F.col("log_phi")).alias("loglik")
    )


def baseline_hazard(
    df: DataFrame, coef: dict[str, float], means: dict[str, float] | None = None,
    rows_per_slab: int = ROWS_PER_SLAB,
) -> DataFrame:
    """Breslow baseline: per distinct time the hazard d/s0 and its running sum."""
    table, cuts = risk_table(df, coef, means, rows_per_slab=rows_per_slab)
    hazard = staged(table.select("time", (F.col("deaths") / F.col("s0")).alias("hazard")))
    return running_sums(hazard, "time", {"cumulative_hazard": F.col("hazard")}, cuts=cuts)


def _with_means(table: DataFrame, p: int) -> DataFrame:
    """Add the Efron-averaged covariate mean e_k of the risk set at each event time."""
    ties = _tie_sums(table).withColumnRenamed("time", "_time")
    joined = table.join(ties, F.col("time") == F.col("_time")).drop("_time")
    means = {
        f"e_{k}": (F.col(f"s1_{k}") * F.col("inv") - F.col(f"d1_{k}") * F.col("frac_inv")) / F.col("deaths")
        for k in range(p)
    }
    return joined.withColumns(means)


def schoenfeld_residuals(
    df: DataFrame, coef: dict[str, float], keep: Sequence[str] = (), means: dict[str, float] | None = None,
    rows_per_slab: int = ROWS_PER_SLAB,
) -> DataFrame:
    """Per event row the covariates minus their risk-set mean at that time, one column per feature."""
    features = list(coef)
    table, _ = risk_table(df, coef, means, moments=True, rows_per_slab=rows_per_slab)
    at_times = staged(_with_means(table, len(features)).select("time", *[f"e_{k}" for k in range(len(features))]))
    if at_times.count() <= BROADCAST_TIMES:
        at_times = F.broadcast(at_times)
    events = df.dropna(subset=["duration", "event", *features]).filter(F.col("event") == 1)
    joined = events.join(at_times, events["duration"].cast("double") == F.col("time"))
    return joined.select(
        *keep, "time", *[(F.col(f).cast("double") - F.col(f"e_{k}")).alias(f) for k, f in enumerate(features)]
    )


def rank_residual_sums(
    df: DataFrame, coef: dict[str, float], means: dict[str, float] | None = None,
    rows_per_slab: int = ROWS_PER_SLAB,
) -> DataFrame:
    """What the proportional-hazards test needs, per covariate: the sum over events of the centred
    rank of time times the Schoenfeld residual, the sum of squared centred ranks, and the events.

    The residuals of one time share its rank, so sums per time suffice.
    """
    features = list(coef)
    table, cuts = risk_table(df, coef, means, moments=True, rows_per_slab=rows_per_slab)
    upto = staged(running_sums(table, "time", {"upto": F.col("n")}, cuts=cuts))
    ranked = _with_means(upto, len(features)).withColumn("g", F.col("upto") - (F.col("n") - 1) / 2.0)
    d, g = F.col("deaths"), F.col("g")
    residual = {k: F.col(f"x_{k}") - d * F.col(f"e_{k}") for k in range(len(features))}
    sums = ranked.agg(
        F.sum(d).alias("d"), F.sum(d * g).alias("g1"), F.sum(d * g * g).alias("g2"),
        *[F.sum(residual[k]).alias(f"r_{k}") for k in residual],
        *[F.sum(g * residual[k]).alias(f"gr_{k}") for k in residual],
    )
    mean = F.col("g1") / F.col("d")
    entries = [
        F.struct(
            F.lit(f).alias("covariate"),
            (F.col(f"gr_{k}") - mean * F.col(f"r_{k}")).alias("rank_residual"),
            (F.col("g2") - mean * F.col("g1")).alias("rank_variation"),
            F.col("d").alias("n_events"),
        )
        for k, f in enumerate(features)
    ]
    return sums.select(F.explode(F.array(*entries)).alias("_row")).select("_row.*")


def ph_test(df: DataFrame, model: CoxModel, rows_per_slab: int = ROWS_PER_SLAB) -> DataFrame:
    """Test of proportional hazards per covariate on scaled Schoenfeld residuals against the rank
    of time (Grambsch and Therneau 1994): covariate, test_statistic, p, ph_violated."""
    rows = rank_residual_sums(df, model.coefficients(), model.centres(), rows_per_slab).collect()
    by_name = {r["covariate"]: r for r in rows}
    u = np.array([by_name[f]["rank_residual"] for f in model.features])
    d, spread = rows[0]["n_events"], rows[0]["rank_variation"]
    v = model.covariance
    statistic = (d * (v @ u)) ** 2 / (d * np.diag(v) * spread)
    out = []
    for name, value in zip(model.features, statistic.tolist()):
        p = normal_two_sided(value**0.5)
        out.append((name, value, p, p < 0.05))
    schema = "covariate string, test_statistic double, p double, ph_violated boolean"
    return df.sparkSession.createDataFrame(out, schema).orderBy("p", "covariate")


def predict_survival(
    baseline: DataFrame,
    coef: dict[str, float],
    means: dict[str, float],
    observations: Sequence[dict[str, float]],
    times: DataFrame | None = None,
    rows_per_slab: int = ROWS_PER_SLAB,
) -> DataFrame:
    """Survival curves (curve_id, time, survival_prob) of a few observations.

    Without `times` the curve is given at the baseline's own times, otherwise it is interpolated
    linearly between them and held constant beyond both ends.
    """
    risks = [
        float(np.exp(sum(c * (float(obs[f]) - means[f]) for f, c in coef.items()))) for obs in observations
    ]
    curves = F.explode(
        F.array(*[F.struct(F.lit(i).alias("curve_id"), F.lit(r).alias("risk")) for i, r in enumerate(risks)])
    )
    if times is None:
        placed = baseline.select("time", curves.alias("c"), F.col("cumulative_hazard").alias("h"))
        value = F.exp(-F.col("h") * F.col("c.risk"))
    else:
        placed = surrounding(baseline, times, rows_per_slab).withColumn("c", curves)
        low = F.exp(-F.col("h0") * F.col("c.risk"))
        high = F.exp(-F.col("h1") * F.col("c.risk"))
        share = (F.col("time") - F.col("t0")) / (F.col("t1") - F.col("t0"))
        value = F.when(F.col("t1") == F.col("t0"), low).otherwise(low + (high - low) * share)
    return placed.select(F.col("c.curve_id").alias("curve_id"), "time", value.alias("survival_prob"))


def surrounding(baseline: DataFrame, times: DataFrame, rows_per_slab: int = ROWS_PER_SLAB) -> DataFrame:
    """For each requested time the nearest baseline points at or before (t0, h0) and at or after
    it (t1, h1); beyond an end both are the end point."""
    points = baseline.select("time", F.struct("time", F.col("cumulative_hazard").alias("h")).alias("p"))
    points = staged(points)
    asked = times.select(F.col("time").cast("double").alias("time")).distinct().withColumn("p", F.lit(None).cast(points.schema["p"].dataType))
    cuts = quantile_cuts(points, "time", slabs_for(points.count(), rows_per_slab))
    rows = with_slab(points.unionByName(asked), "time", cuts)
    # a point at exactly the requested time serves on both sides: range frames include it
    order = Window.partitionBy("_slab").orderBy("time")
    before = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = order.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    located = rows.select(
        "_slab", "time", "p",
        F.last("p", ignorenulls=True).over(before).alias("b"),
        F.first("p", ignorenulls=True).over(after).alias("a"),
    ).filter(F.col("p").isNull())
    # one row per slab
    ends = with_slab(points, "time", cuts).groupBy("_slab").agg(F.max("p").alias("top"), F.min("p").alias("low"))
    slabs = times.sparkSession.range(cuts.slabs).select(F.col("id").cast("int").alias("_slab")).join(ends, "_slab", "left")
    by_slab = Window.partitionBy(F.lit(0)).orderBy("_slab")
    neighbours = slabs.select(
        "_slab",
        F.last("top", ignorenulls=True).over(by_slab.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.first("low", ignorenulls=True).over(by_slab.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    joined = located.join(neighbours, "_slab", "left")
    b, a = F.coalesce("b", "earlier"), F.coalesce("a", "later")
    return joined.select("time", F.coalesce(b, a).alias("b"), F.coalesce(a, b).alias("a")).select(
        "time",
        F.col("b.time").alias("t0"), F.col("b.h").alias("h0"),
        F.col("a.time").alias("t1"), F.col("a.h").alias("h1"),
    )
