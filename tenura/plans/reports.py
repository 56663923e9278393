"""The tables behind the figures of a study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.functions.columns import log10_evidence
from tenura.plans.studies import SIGNALS

# The steps of the additive ablation, by lift in C.
LARGE_LIFT = 0.25
MEDIUM_LIFT = 0.10


def family(feature: Column | str) -> Column:
    name = F.col(feature) if isinstance(feature, str) else feature
    return F.when(name.isin(*SIGNALS), F.lit("signal")).otherwise(F.lit("behavioural"))


def hazard_forest(ratios: DataFrame) -> DataFrame:
    """Hazard ratios with their bounds and covariate family, smallest first."""
    return ratios.select("feature", "HR", "HR_lower", "HR_upper", family("feature").alias("family")).orderBy(
        "HR", "feature"
    )


def ablation_isolation(isolation: DataFrame) -> DataFrame:
    return isolation.select("label", "cv_mean", "cv_std", "holdout_cindex")


def ablation_additive(additive: DataFrame) -> DataFrame:
    """Lift of each stacked variant over the baseline, and its tier."""
    base = additive.filter(F.col("label") == "Baseline").select(F.col("cv_mean").alias("_base"))
    delta = F.col("cv_mean") - F.col("_base")
    tier = (
        F.when(delta == 0, "none").when(delta > LARGE_LIFT, "large").when(delta > MEDIUM_LIFT, "medium").otherwise("small")
    )
    return additive.join(F.broadcast(base)).select(  # one row
        "label", "cv_mean", "cv_std", "holdout_cindex", delta.alias("delta"), tier.alias("tier")
    )


def leakage_decomposition(variants: DataFrame) -> DataFrame:
    """Stacked parts of the C index: behavioural floor, non-polarity lift, the rest of the full lift."""
    pick = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    parts = variants.agg(
        pick("baseline", "cv_mean").alias("base"),
        pick("non_polarity", "delta_vs_baseline").alias("non_polarity_lift"),
        pick("full_augmented", "delta_vs_baseline").alias("_full"),
    )
    return parts.withColumn("polarity_lift", F.col("_full") - F.col("non_polarity_lift")).drop("_full")


def ph_bars(test: DataFrame) -> DataFrame:
    """Evidence against proportional hazards per covariate, most significant first."""
    return test.select("covariate", "p", log10_evidence("p").alias("evidence"), "ph_violated").orderBy("p", "covariate")


def univariate_ranking(scores: DataFrame) -> DataFrame:
    return scores.withColumn("family", family("feature")).orderBy(F.col("univariate_c").desc(), "feature")


def heatmap(matrix: DataFrame) -> DataFrame:
    """The correlation rows as one row per feature."""
    names = [r[0] for r in matrix.select("feature_x").distinct().orderBy("feature_x").collect()]
    return matrix.groupBy("feature_x").pivot("feature_y", names).agg(F.first("rho")).orderBy("feature_x")
