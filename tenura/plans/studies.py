"""The studies: experiment, ablation and leakage audit, composed from the operators.

Each returns tidy DataFrames of a few rows; the row work all happens in the operators.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.lineage import staged
from tenura.operators import reduce
from tenura.operators.cox import check_features, hazard_ratios, likelihood_ratio_test
from tenura.operators.dataset import KEYS, backfill_behaviour
from tenura.operators.evaluate import Results, evaluate
from tenura.operators.sampling import (
    FOLD_SEED,
    FOLDS,
    HOLDOUT_FRACTION,
    HOLDOUT_SEED,
    holdout_split,
    with_folds,
)
from tenura.operators.text import fit_tfidf

# The covariate families.
BEHAVIOURAL = ("log_playtime_2weeks", "log_items_count")
SIGNALS = (
    "sentiment_score", "frustration_level", "technical_issue",
    "value_complaint", "engagement_dropped", "positive_signal",
)
AUGMENTED = BEHAVIOURAL + SIGNALS
NON_POLARITY = ("technical_issue", "engagement_dropped")
POLARITY = ("sentiment_score", "frustration_level", "positive_signal", "value_complaint")


@dataclass
class Study:
    """Result tables by name, and the evaluation they came from."""

    tables: dict[str, DataFrame]
    results: Results
    split: DataFrame | None = None  # the train / test assignment of every row

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def split_train_test(df: DataFrame, keys: Sequence[str], fraction: float, seed: int):
    # the split reads the rows a few times, so they are written first
    marked = holdout_split(staged(df), keys, fraction=fraction, seed=seed)
    return marked.filter(F.col("split") == "train"), marked.filter(F.col("split") == "test"), marked


def _deltas(table: DataFrame, base: str) -> DataFrame:
    """Add the differences of every variant to the base variant."""
    reference = table.filter(F.col("variant") == base).select(
        F.col("cv_mean").alias("_cv"), F.col("holdout_cindex").alias("_holdout")
    )
    joined = table.join(F.broadcast(reference))  # one row
    return joined.withColumns(
        {
            "delta_vs_baseline": F.col("cv_mean") - F.col("_cv"),
            "delta_holdout": F.col("holdout_cindex") - F.col("_holdout"),
        }
    ).drop("_cv", "_holdout")


def _lr_table(spark: SparkSession, results: Results, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    rows = []
    for full, restricted in pairs:
        test = likelihood_ratio_test(results.models[full], results.models[restricted])
        rows.append((f"{full}_vs_{restricted}", *[test[k] for k in LR_FIELDS]))
    schema = (
        "comparison string, lr_statistic double, df int, p_value double, log_p_value double, significant boolean"
    )
    return spark.createDataFrame(rows, schema)


LR_FIELDS = ("lr_statistic", "df", "p_value", "log_p_value", "significant")


def run_experiment(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    fraction: float = HOLDOUT_FRACTION,
    seed: int = HOLDOUT_SEED,
    **options,
) -> Study:
    """Behavioural covariates against behavioural plus signals, on one stratified hold-out."""
    df = backfill_behaviour(df)
    check_features(AUGMENTED, df.columns)
    spark = df.sparkSession
    needed = df.select(*dict.fromkeys([*keys, "duration", "event", *AUGMENTED]))
    train, test, marked = split_train_test(needed, keys, fraction, seed)
    results = evaluate(train, {"baseline": BEHAVIOURAL, "augmented": AUGMENTED}, keys, test, **options)
    models = _deltas(results.table(spark), "baseline")
    lr = _lr_table(spark, results, [("augmented", "baseline")])
    sizes = marked.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
        F.avg("event").alias("churn_rate"),
    ).withColumn("holdout_seed", F.lit(seed))
    best = models.filter(F.col("variant") == "augmented").select(
        F.col("cv_mean").alias("cv_cindex"), "holdout_cindex",
        F.col("delta_vs_baseline").alias("delta_cindex"), "delta_holdout",
    )
    summary = best.join(F.broadcast(lr.select("log_p_value", "significant")))  # one row each
    tables = {
        "models": models,
        "lr_test": lr,
        "hazard_ratios": hazard_ratios(spark, results.models["augmented"]),
        "sizes": sizes,
        "summary": summary,
    }
    return Study(tables, results, marked.select(*keys, "event", "split"))


def add_text_features(
    df: DataFrame, is_train: str = "split", text: str = "review_text", components: int = reduce.COMPONENTS,
    **rules,
) -> tuple[DataFrame, tuple[str, ...], reduce.Projection]:
    """TF-IDF and truncated SVD fitted on the training rows, applied to all: tfidf_0, tfidf_1, ..."""
    train = df.filter(F.col(is_train) == "train")
    vocabulary = fit_tfidf(train, text, **rules)
    weighted = staged(vocabulary.transform(df, text).drop(text))  # texts go no further
    svd = reduce.fit_truncated_svd(
        weighted.filter(F.col(is_train) == "train"), "tfidf", vocabulary.size, components
    )
    projected = svd.transform(weighted, "tfidf", "_svd").drop("tfidf")
    return reduce.expand(projected, "_svd", svd.size, "tfidf"), reduce.numbered("tfidf", svd.size), svd


def add_dense_features(
    df: DataFrame, is_train: str = "split", embedding: str = "embedding", components: int = reduce.COMPONENTS
) -> tuple[DataFrame, tuple[str, ...], reduce.Projection]:
    """Centred PCA fitted on the training rows, applied to all: dense_0, dense_1, ..."""
    unit = reduce.unit_vectors(df, embedding)
    pca = reduce.fit_pca(unit.filter(F.col(is_train) == "train"), embedding, components)
    projected = pca.transform(unit, embedding, "_pca").drop(embedding)
    return reduce.expand(projected, "_pca", pca.size, "dense"), reduce.numbered("dense", pca.size), pca


ISOLATION = ("Baseline", "TF-IDF only", "Dense only", "Signals only")
ADDITIVE = {
    "Baseline": "Baseline",
    "+TF-IDF": "TF-IDF only",
    "+TF-IDF +Dense": "+TF-IDF +Dense",
    "+Dense +Signals": "+Dense +Signals",
    "+TF-IDF +Dense +Signals": "+TF-IDF +Dense +Signals",
}


def _representations(marked: DataFrame, components: int, rules: dict):
    """Rows with all representations, fitted on the rows marked train, and the variants to fit."""
    with_text, tfidf, _ = add_text_features(marked, components=components, **rules)
    with_dense, dense, _ = add_dense_features(with_text, components=components)
    variants = {
        "Baseline": BEHAVIOURAL,
        "TF-IDF only": BEHAVIOURAL + tfidf,
        "Dense only": BEHAVIOURAL + dense,
        "Signals only": AUGMENTED,
        "+TF-IDF +Dense": BEHAVIOURAL + tfidf + dense,
        "+Dense +Signals": BEHAVIOURAL + dense + SIGNALS,
        "+TF-IDF +Dense +Signals": BEHAVIOURAL + tfidf + dense + SIGNALS,
    }
    return staged(with_dense.drop("review_text")), variants


def run_ablation(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    components: int = reduce.COMPONENTS,
    fraction: float = HOLDOUT_FRACTION,
    seed: int = HOLDOUT_SEED,
    folds: int = FOLDS,
    fold_seed: int = FOLD_SEED,
    tfidf_rules: dict | None = None,
    refit_per_fold: bool = False,
    **options,
) -> Study:
    """Each text representation alone, then stacked, on top of the behavioural covariates.

    Needs review_text, an embedding array and the six signals. Seven variants are fitted in shared
    passes; the two rows that both tables share are fitted once. Representations are fitted on the
    whole training slice, so the folds of the cross-validation see its vocabulary; the hold-out
    does not. `refit_per_fold` fits the representations again on the other folds for each fold.
    """
    df = backfill_behaviour(df)
    check_features(AUGMENTED, df.columns)
    spark = df.sparkSession
    _, _, marked = split_train_test(df, keys, fraction, seed)
    whole, variants = _representations(marked, components, tfidf_rules or {})
    inner = 0 if refit_per_fold else folds
    results = evaluate(
        whole.filter(F.col("split") == "train"), variants, keys, whole.filter(F.col("split") == "test"),
        folds=inner, seed=fold_seed, **options,
    )
    if refit_per_fold:
        folded = staged(with_folds(marked.filter(F.col("split") == "train"), keys, folds, fold_seed))
        results.folds = {v: [] for v in variants}
        for fold in range(folds):
            sides = folded.withColumn("split", F.when(F.col("fold") == fold, "test").otherwise("train"))
            rows, own = _representations(sides, components, tfidf_rules or {})
            found = evaluate(
                rows.filter(F.col("split") == "train"), own, keys, rows.filter(F.col("split") == "test"),
                folds=0, apparent=False, **options,
            )
            for v in variants:
                results.folds[v].append(found.holdout[v])
    table = results.table(spark)
    order = spark.createDataFrame(
        [(i, name, source) for i, (name, source) in enumerate(ADDITIVE.items())],
        "position int, label string, variant string",
    )
    additive = order.join(table, "variant").orderBy("position").drop("position", "variant")
    isolation = table.filter(F.col("variant").isin(*ISOLATION)).withColumnRenamed("variant", "label")
    sizes = whole.agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test")
    ).withColumn("holdout_seed", F.lit(seed))
    return Study({"isolation": isolation, "additive": additive, "sizes": sizes}, results, whole.select(*keys, "event", "split"))


def run_leakage_audit(df: DataFrame, keys: Sequence[str] = KEYS, **options) -> Study:
    """How much of the signals' lift comes from those that restate the outcome? Fits on all rows."""
    df = backfill_behaviour(df)
    check_features(AUGMENTED, df.columns)
    spark = df.sparkSession
    variants = {
        "baseline": BEHAVIOURAL,
        "non_polarity": BEHAVIOURAL + NON_POLARITY,
        "polarity_only": BEHAVIOURAL + POLARITY,
        "full_augmented": BEHAVIOURAL + NON_POLARITY + POLARITY,
    }
    results = evaluate(df, variants, keys, apparent=False, **options)
    table = _deltas(results.table(spark), "baseline").drop("holdout_cindex", "apparent_cindex", "delta_holdout")
    lr = _lr_table(
        spark, results,
        [("polarity_only", "baseline"), ("non_polarity", "baseline"), ("full_augmented", "baseline")],
    )
    return Study({"variants": table, "lr_tests": lr, "decomposition": decomposition(table)}, results)


def decomposition(variants: DataFrame) -> DataFrame:
    """The three lifts in one row, and each of the two partial lifts as a share of the full one.

    Lifts are not additive, so the shares need not sum to 1; they are NULL when the full lift is 0.
    """
    lift = lambda v: F.max(F.when(F.col("variant") == v, F.col("delta_vs_baseline")))
    lifts = variants.agg(
        lift("non_polarity").alias("defensible_predictive_lift"),
        lift("polarity_only").alias("polarity_lift"),
        lift("full_augmented").alias("full_augmented_lift"),
    )
    return lifts.withColumns(
        {
            "polarity_share": F.try_divide("polarity_lift", "full_augmented_lift"),
            "non_polarity_share": F.try_divide("defensible_predictive_lift", "full_augmented_lift"),
        }
    )
