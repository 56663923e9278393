"""The registered queries: each takes (spark, folder of tables) and returns a DataFrame."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.functions.columns import linear_predictor
from tenura.lineage import shared_dir, staged
from tenura.operators import cox, dataset, diagnostics, evaluate, kaplan_meier, reduce, risk_sets, sampling, text
from tenura.operators.concordance import concordance
from tenura.operators.layout import place
from tenura.operators.signals import (
    FIELDS,
    NEUTRAL,
    align,
    enrich_signals,
    enrich_with_scorer,
    with_batches,
    with_violations,
)
from tenura.plans import reports, studies
from tenura.plans.frames import (
    BEHAVIOURAL,
    L_KEYS,
    SIGNALS,
    document_items,
    frame_l,
    frame_t,
    frame_v,
    frame_v_signals,
    labelled_reviews,
    line_pairs,
    table,
)
from tenura.sources import nested, tables
from tenura.streaming.scoring import score_stream, write_scores

FEATURES = (*BEHAVIOURAL, *SIGNALS)
BINARY = ("technical_issue", "value_complaint", "engagement_dropped", "positive_signal")
CONTINUOUS = ("sentiment_score", "frustration_level")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def survival_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frame_l(spark, sf_dir), 6, *BEHAVIOURAL, *CONTINUOUS)


def text_survival_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = dataset.build_survival_table(
        labelled_reviews(spark, sf_dir), document_items(spark, sf_dir), max_rows=None
    )
    return rounded(built, 6, "duration", "playtime_2weeks", *BEHAVIOURAL)


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.stage_counts(labelled_reviews(spark, sf_dir), document_items(spark, sf_dir))


def line_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = line_pairs(spark, sf_dir)
    ranged = dataset.in_duration_range(pairs)
    return pairs.agg(F.count(F.lit(1)).alias("joined")).join(
        F.broadcast(  # one row
            ranged.agg(
                F.count(F.lit(1)).alias("in_range"),
                F.count_distinct("user_id", "item_id").alias("deduplicated"),
            )
        )
    )


def churn_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dataset.churn_summary(frame_l(spark, sf_dir)), 6, "churn_rate")


def stratified_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sampling.stratified_cap(staged(frame_l(spark, sf_dir).select(*L_KEYS, "event")), dataset.MAX_REVIEWS, L_KEYS)
    return kept.select("user_id", "item_id", "event")


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = sampling.holdout_split(staged(frame_l(spark, sf_dir).select(*L_KEYS, "event")), L_KEYS)
    return split.select("user_id", "item_id", "event", "split")


def kfold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.with_folds(staged(frame_l(spark, sf_dir).select(*L_KEYS)), L_KEYS).select("user_id", "item_id", "fold")


def _curve(df: DataFrame) -> DataFrame:
    return rounded(df, 6, "survival", "lower", "upper")


def km_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(kaplan_meier.kaplan_meier(frame_l(spark, sf_dir), "priority"))


def km_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(kaplan_meier.kaplan_meier(frame_l(spark, sf_dir), "event"))


def km_median_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = kaplan_meier.by_median(
        staged(frame_l(spark, sf_dir).select("duration", "event", "frustration_level")), "frustration_level"
    )
    return _curve(kaplan_meier.kaplan_meier(split, "above_median"))


def median_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = kaplan_meier.kaplan_meier(frame_l(spark, sf_dir), "priority")
    return kaplan_meier.median_survival(curve, "priority")


def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.contract_violations(frame_l(spark, sf_dir), FEATURES)


def describe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        diagnostics.describe_features(frame_l(spark, sf_dir), FEATURES), 6, "mean", "std", "min", "max"
    )


def rates_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.rates_by_event(frame_l(spark, sf_dir), BINARY), 6, "rate")


def density_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.density_by_event(staged(frame_l(spark, sf_dir).select("event", *CONTINUOUS)), CONTINUOUS), 6, "x", "density")


def histogram_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.histogram_by_event(frame_l(spark, sf_dir), "log_items_count", 0.0, 4.0, 16)


def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.spearman_matrix(frame_l(spark, sf_dir), SIGNALS), 6, "rho")


def collinear_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs above the usual 0.7, with the raw covariates beside their logarithms."""
    raw = {f.removeprefix("log_"): F.round(F.expm1(f)) for f in BEHAVIOURAL}
    matrix = diagnostics.spearman_matrix(frame_l(spark, sf_dir).withColumns(raw), (*FEATURES, *raw))
    return rounded(diagnostics.collinear_pairs(matrix), 6, "rho")


#: Covariates that are known for some rows only, and when.
KNOWN = {"sentiment_score": "log_items_count > 2.5", "frustration_level": "value_complaint = 1", "engagement_dropped": "event = 0"}


def spearman_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations over the rows that have both values, where some covariates are missing."""
    seen = {f: F.when(F.expr(known), F.col(f)) for f, known in KNOWN.items()}
    frame = frame_l(spark, sf_dir).select(*[seen.get(f, F.col(f)).alias(f) for f in FEATURES])
    return rounded(diagnostics.spearman_matrix(frame, FEATURES), 6, "rho")


# ---------------------------------------------------------------- Cox quantities at fixed coefficients

FIXED = {"log_playtime_2weeks": 0.1, "frustration_level": 0.3, "technical_issue": -0.2}


def cindex_fixed_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rounded, so that equal covariates give equal risks in any engine
    risk = F.round(linear_predictor(FIXED), 9)
    return rounded(concordance(frame_l(spark, sf_dir), risk=risk), 6, "cindex")


def cox_loglik_fixed_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk_sets.partial_loglik(frame_l(spark, sf_dir), FIXED), 3, "loglik")


def baseline_hazard_fixed_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = risk_sets.baseline_hazard(frame_l(spark, sf_dir), FIXED)
    return rounded(base, 9, "hazard").withColumn("cumulative_hazard", F.round("cumulative_hazard", 6))


def schoenfeld_fixed_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    residuals = risk_sets.schoenfeld_residuals(staged(frame_l(spark, sf_dir)), FIXED, keep=L_KEYS)
    return rounded(residuals, 6, *FIXED)


def ph_sums_fixed_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = risk_sets.rank_residual_sums(frame_l(spark, sf_dir), FIXED)
    return sums.withColumns(
        {"rank_residual": F.round("rank_residual", 0), "rank_variation": F.round("rank_variation", 0)}
    )


OBSERVATIONS = (
    {"log_playtime_2weeks": 1.0, "frustration_level": 0.0, "technical_issue": 0},
    {"log_playtime_2weeks": 3.5, "frustration_level": 1.0, "technical_issue": 1},
)


def _predicted(spark: SparkSession, base: DataFrame, coef: dict[str, float], means: dict[str, float]) -> DataFrame:
    times = spark.range(0, 130).select((F.col("id") * 20 + F.lit(0.25)).alias("time"))
    return rounded(risk_sets.predict_survival(base, coef, means, OBSERVATIONS, times), 6, "survival_prob")


def survival_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = risk_sets.baseline_hazard(frame_l(spark, sf_dir), FIXED)
    return _predicted(spark, base, FIXED, dict.fromkeys(FIXED, 0.0))


def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curves of `survival_curve` from a model that was saved with its baseline hazard and loaded."""
    p = len(FIXED)
    model = cox.CoxModel(
        cox.Spec("fixed", tuple(FIXED)), 0.0, 0, 0, np.zeros(p), np.ones(p), np.array(list(FIXED.values())),
        0.0, 0.0, np.zeros(p), -np.eye(p), 0,
    )
    path = f"{shared_dir(spark)}/{uuid.uuid4()}"
    cox.save_model(spark, model, path, risk_sets.baseline_hazard(frame_l(spark, sf_dir), FIXED))
    again = cox.load_model(spark, path)
    coef, means = (dict(zip(again.features, v.tolist(), strict=True)) for v in (again.coef, again.means))
    return _predicted(spark, cox.load_baseline(spark, path), coef, means)


# ---------------------------------------------------------------- fitted models


def _fit(spark: SparkSession, sf_dir: str, *variants):
    frame = staged(frame_l(spark, sf_dir))
    placed = place(frame, list(dict.fromkeys(f for v in variants for f in v)), keys=L_KEYS)
    try:
        models = cox.fit_many(placed, [cox.Spec(str(i), tuple(v)) for i, v in enumerate(variants)])
    finally:
        placed.release()
    return frame, [models[str(i)] for i in range(len(variants))]


def cox_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, (model,) = _fit(spark, sf_dir, BEHAVIOURAL)
    ratios = cox.hazard_ratios(spark, model).select("feature", "coef", "se", "HR", "HR_lower", "HR_upper")
    return rounded(ratios, 6, "coef", "se", "HR", "HR_lower", "HR_upper")


def hazard_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, (model,) = _fit(spark, sf_dir, FEATURES)
    return rounded(reports.hazard_forest(cox.hazard_ratios(spark, model)), 6, "HR", "HR_lower", "HR_upper")


def cox_gradient_at_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalised gradient per row at the fit of all covariates, computed again from the residuals
    of every event; it must vanish."""
    frame, (model,) = _fit(spark, sf_dir, FEATURES)
    residuals = risk_sets.schoenfeld_residuals(frame, model.coefficients(), means=model.centres())
    sums = residuals.agg(*[F.sum(f).alias(f) for f in FEATURES])
    entries = []
    for feature, std, beta in zip(model.features, model.stds.tolist(), model.beta.tolist()):
        gradient = F.col(feature) / (std * model.n) - model.penalizer * beta
        entries.append(F.struct(F.lit(feature).alias("feature"), F.abs(F.round(gradient, 7)).alias("gradient")))
    return sums.select(F.explode(F.array(*entries)).alias("_row")).select("_row.*")


def lr_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, (full, restricted) = _fit(spark, sf_dir, BEHAVIOURAL, BEHAVIOURAL[:1])
    found = cox.likelihood_ratio_test(full, restricted)
    row = (full.loglik, restricted.loglik, found["lr_statistic"], found["df"])
    schema = "loglik_full double, loglik_restricted double, lr_statistic double, df int"
    return rounded(spark.createDataFrame([row], schema), 4, "loglik_full", "loglik_restricted", "lr_statistic")


def lr_test_all_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, (full, restricted) = _fit(spark, sf_dir, FEATURES, BEHAVIOURAL)
    found = rounded(spark.createDataFrame([cox.likelihood_ratio_test(full, restricted)]), 4, "lr_statistic", "log_p_value")
    return rounded(found, 6, "p_value")


def ph_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, (model,) = _fit(spark, sf_dir, FEATURES)
    return rounded(rounded(reports.ph_bars(risk_sets.ph_test(frame, model)), 6, "p"), 4, "evidence")


def cv_cindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.cv_cindex(frame_l(spark, sf_dir), BEHAVIOURAL, L_KEYS)
    scores = spark.createDataFrame(
        [(k, s) for k, s in enumerate(found["folds"])], "fold int, cindex double"
    )
    return rounded(scores, 4, "cindex")


def univariate_cindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = evaluate.univariate_cindex(frame_l(spark, sf_dir), FEATURES, L_KEYS)
    return rounded(reports.univariate_ranking(scores), 4, "univariate_c")


def experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(studies.run_experiment(frame_l(spark, sf_dir), L_KEYS)["models"])


def experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run in one row: scores of the augmented model, their lift, and the evidence for it."""
    found = studies.run_experiment(frame_l(spark, sf_dir), L_KEYS)["summary"]
    return rounded(found, 4, "cv_cindex", "holdout_cindex", "delta_cindex", "delta_holdout", "log_p_value")


def _variants(table: DataFrame) -> DataFrame:
    """Rounded scores; lists as text."""
    scores = [c for c in table.columns if c not in ("variant", "n_features", "features", "cv_folds")]
    folds = F.transform("cv_folds", lambda c: F.format_number(c, 4))
    return rounded(
        table.withColumns({"features": F.array_join("features", ","), "cv_folds": F.array_join(folds, ",")}), 4, *scores
    )


def experiment_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The behavioural model of the experiment: hold-out split, folds, fits and all concordances."""
    frame = frame_l(spark, sf_dir).select(*L_KEYS, "duration", "event", *BEHAVIOURAL)
    train, test, _ = studies.split_train_test(frame, L_KEYS, sampling.HOLDOUT_FRACTION, sampling.HOLDOUT_SEED)
    found = evaluate.evaluate(train, {"baseline": BEHAVIOURAL}, L_KEYS, test).table(spark)
    scores = ("cv_mean", "cv_std", "holdout_cindex", "apparent_cindex")
    return rounded(found.select("variant", "n_features", *scores), 4, *scores)


def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(studies.run_leakage_audit(frame_l(spark, sf_dir), L_KEYS)["variants"])


def leakage_lr_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three tests of the audit against the baseline."""
    found = studies.run_leakage_audit(frame_l(spark, sf_dir), L_KEYS)["lr_tests"]
    return rounded(rounded(found, 4, "lr_statistic", "log_p_value"), 6, "p_value")


def leakage_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lifts of the audit, and the partial ones as shares of the full lift."""
    found = studies.run_leakage_audit(frame_l(spark, sf_dir), L_KEYS)["decomposition"]
    lifts = ("defensible_predictive_lift", "polarity_lift", "full_augmented_lift")
    return rounded(rounded(found, 4, *lifts), 3, "polarity_share", "non_polarity_share")


def leakage_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = studies.run_leakage_audit(frame_l(spark, sf_dir), L_KEYS)
    parts = ("base", "non_polarity_lift", "polarity_lift")
    return rounded(reports.leakage_decomposition(audit["variants"]), 4, *parts)


def _ablation(spark: SparkSession, sf_dir: str) -> studies.Study:
    return studies.run_ablation(frame_v_signals(spark, sf_dir), ["item_id"])


def ablation_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ablation_isolation(_ablation(spark, sf_dir)["isolation"])


def ablation_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ablation_additive(_ablation(spark, sf_dir)["additive"])


# ---------------------------------------------------------------- text


def tfidf_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = staged(frame_t(spark, sf_dir).select("item_id", "review_text"))
    return rounded(text.vocabulary(frame, frame.count()), 6, "idf")


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = staged(frame_t(spark, sf_dir).select("item_id", "review_text"))
    model = text.fit_tfidf(frame)
    return rounded(text.weight_rows(model.transform(frame), model, "item_id"), 6, "weight")


def tfidf_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = staged(frame_t(spark, sf_dir).select("item_id", "review_text"))
    model = text.fit_tfidf(frame)
    weighted = staged(model.transform(frame).drop("review_text"))
    svd = reduce.fit_truncated_svd(weighted, "tfidf", model.size)
    return svd.transform(weighted, "tfidf", "components").drop("tfidf")


def dense_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "item_id")
    joined = reduce.attach_vectors(frame_t(spark, sf_dir), vectors, "item_id")
    return joined.select("item_id", F.posexplode("embedding").alias("position", "value")).withColumn(
        "value", F.round("value", 6)
    )


def pca_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = reduce.unit_vectors(frame_v(spark, sf_dir).select("item_id", "embedding"), "embedding")
    frame = staged(frame)
    return reduce.fit_pca(frame, "embedding").transform(frame, "embedding", "components").drop("embedding")


def pca_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the variance that each component explains, and of all up to it; as many as there are columns,
    so the last sum is 1."""
    frame = staged(reduce.unit_vectors(frame_v(spark, sf_dir).select("item_id", "embedding"), "embedding"))
    width = frame.agg(F.max(F.size("embedding"))).first()[0] or 0
    return rounded(reduce.explained(spark, reduce.fit_pca(frame, "embedding", width)), 6, "share", "cumulative")


def pca_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variance along all components against the variance of all columns, and their number."""
    frame = staged(reduce.unit_vectors(frame_v(spark, sf_dir).select("item_id", "embedding"), "embedding"))
    width = frame.agg(F.max(F.size("embedding"))).first()[0] or 0
    placed = reduce.fit_pca(frame, "embedding", width).transform(frame, "embedding", "components")
    along = placed.select(F.posexplode("components").alias("component", "x")).groupBy("component").agg(F.var_samp("x").alias("v"))
    total = along.agg(F.count(F.lit(1)).alias("n_components"), F.sum("v").alias("variance"))
    return rounded(total, 6, "variance")


# ---------------------------------------------------------------- signals


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("review_text"), "lang")


def text_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich_signals(_documents(spark, sf_dir)).drop("review_text", "lang")


def signals_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arriving as a stream, scored and appended to a table."""
    schema = table(spark, sf_dir, "documents").schema
    # a pattern for the one name: a stream takes a table of one file, or of a folder of files, only by a pattern
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/[d]ocuments.parquet")
    scored = score_stream(stream.select("doc_id", F.col("text").alias("review_text"))).drop("review_text")
    out = f"{shared_dir(spark)}/{uuid.uuid4()}"
    write_scores(scored, f"{out}/scores", f"{out}/state", once=True).awaitTermination()
    return spark.read.schema(scored.schema).parquet(f"{out}/scores")


def signal_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw signal values, some of them out of range, checked against the contract."""
    raw = line_pairs(spark, sf_dir).select(
        (1 - 25 * F.col("discount")).alias("sentiment_score"),
        F.when(F.col("tax") > 0.07, F.lit("unknown")).otherwise(F.round(F.col("tax") / 0.06, 6).cast("string")).alias("frustration_level"),
        (F.col("quantity") % 3).cast("int").alias("technical_issue"),
        (F.col("price") > 53000).alias("value_complaint"),
        (F.col("order_status") == "F").cast("int").alias("engagement_dropped"),
        F.when(F.col("event") == 0, 1).alias("positive_signal"),
    )
    marked = with_violations(raw).withColumn("broken", F.array_join("violations", ","))
    return marked.groupBy("broken").agg(F.count(F.lit(1)).alias("n_rows"))


def align_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per batch of ten documents: signals of the labelled ones against the number of English ones."""
    batched = with_batches(enrich_signals(_documents(spark, sf_dir)), "doc_id")
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id"), F.lit(True).alias("labelled"))
    fields = F.struct(*FIELDS)
    # ten documents per batch
    grouped = (
        batched.join(labelled, "doc_id", "left")
        .groupBy("batch")
        .agg(
            F.count_if(F.col("lang") == "en").cast("int").alias("expected"),
            F.sort_array(
                F.collect_list(F.when(F.col("labelled"), F.struct("doc_id", fields.alias("signal"))))
            ).alias("found"),
        )
        .select("batch", "expected", F.col("found.signal").alias("signals"))
    )
    aligned = align(grouped)
    score = F.aggregate("aligned", F.lit(0.0), lambda acc, s: acc + s["sentiment_score"])
    return aligned.select(
        "batch", "expected", F.size("signals").alias("returned"), "surplus", "shortage",
        F.size("aligned").alias("n_aligned"), F.round(score, 6).alias("sentiment_sum"),
    )


def signal_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python scorer that fails on batches with a certain word and returns too few signals for others."""

    def scorer(texts: list[str]) -> list[dict]:
        if any("worthless" in t for t in texts):
            raise RuntimeError("no answer")
        found = [{**NEUTRAL, "frustration_level": min(1.0, len(t) / 20000), "positive_signal": "best" in t} for t in texts]
        return found[:-1] if any("pathetic" in t for t in texts) else found

    # the order of the texts in a batch decides which one is filled: number the batches by key
    batched = with_batches(_documents(spark, sf_dir), "doc_id").repartition("batch")
    scored = enrich_with_scorer(batched.sortWithinPartitions("batch", "doc_id"), scorer, batch="batch", presorted=True)
    return scored.groupBy("batch", "signal_fallback", "signal_shortage").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("positive_signal").cast("int").alias("n_positive"),
        F.round(F.sum("frustration_level"), 6).alias("frustration_sum"),
    )


# ---------------------------------------------------------------- raw records


def _literal(column: str):
    """A string as a quoted literal: JSON escapes are also Python escapes."""
    return F.regexp_extract(F.to_json(F.array(column)), r"(?s)^\[(.*)\]$", 1)


def _written_lines(spark: SparkSession, lines: DataFrame) -> str:
    path = f"{shared_dir(spark)}/{uuid.uuid4()}"
    lines.write.option("compression", "gzip").text(path)
    return path


def _review_lines(spark: SparkSession, sf_dir: str) -> str:
    """Labelled documents written as gzipped record literals, with some broken lines."""
    documents = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    line = F.format_string(
        "{'user_id': %s, u'reviews': [{'item_id': '%d', %s'review': %s}, {'item_id': 'short', 'review': ' x '}]}",
        _literal("source"), F.col("doc_id"),
        F.when(F.col("quality") == 1, "'recommend': True, ").otherwise(""), _literal("text"),
    )
    broken = F.when(F.col("doc_id") % 10 == 3, F.expr("left(line, 40)")).otherwise(F.col("line"))
    return _written_lines(spark, documents.withColumn("line", line).select(broken.alias("value")))


def ingest_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record literals read back as flat reviews."""
    flat, _ = nested.load_reviews(spark, _review_lines(spark, sf_dir))
    return flat.select("user_id", "item_id", "recommend", "posted", F.md5("review_text").alias("text_md5"))


def ingest_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines were read, and how many of them are broken."""
    return nested.bad_lines(nested.read_dict_lines(spark, _review_lines(spark, sf_dir), nested.REVIEWS))


def ingest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as records of a customer with two items each, written and read back."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    line = F.format_string(
        "{'user_id': 'u%d', 'items_count': %d, 'items': ["
        "{'item_id': '%d', 'playtime_forever': %s, 'playtime_2weeks': %d}, {'item_id': 's%d'}]}",
        "o_custkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("string"), "l_linenumber", "l_suppkey",
    )
    records = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(line.alias("value"))
    flat, _ = nested.load_items(spark, _written_lines(spark, records))
    return flat.groupBy("user_id", "item_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.sum("playtime_forever"), 6).alias("hours"),
        F.round(F.sum("playtime_2weeks"), 6).alias("recent_hours"),
        F.max("items_count").alias("items_count"),
    )


# ---------------------------------------------------------------- tables written and read back


def _new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4()}"


def survival_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survival table built once, and found again as its input is the same."""
    path, inputs = _new_path(spark), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    tables.materialize(spark, path, lambda: frame_l(spark, sf_dir), inputs)
    again = tables.materialize(spark, path, lambda: frame_l(spark, sf_dir).limit(0), inputs)
    return rounded(again, 6, *BEHAVIOURAL, *CONTINUOUS)


def split_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of a saved split, selected from the rows by the stored assignment."""
    path, rows = _new_path(spark), staged(frame_l(spark, sf_dir).select(*L_KEYS, "event"))
    split = sampling.holdout_split(rows, L_KEYS).select(*L_KEYS, "split")
    tables.write_split(split, path, sampling.HOLDOUT_SEED, sampling.HOLDOUT_FRACTION)
    saved = tables.read_table(spark, path)
    train, test = (
        tables.select_by_split(rows, saved, L_KEYS, side).withColumn("split", F.lit(side)) for side in ("train", "test")
    )
    return train.unionByName(test)


def weights_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new_path(spark)
    tables.write_table(tfidf_weights(spark, sf_dir), path)
    return tables.read_table(spark, path)


def vectors_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the documents with an event cached first, then those that are missing."""
    path, rows = _new_path(spark), frame_t(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "item_id")

    def encode(wanted: DataFrame) -> DataFrame:
        return reduce.attach_vectors(wanted.select("item_id"), vectors, "item_id")

    tables.cached_vectors(spark, path, rows.filter("event = 1"), "item_id", encode)
    cached = tables.cached_vectors(spark, path, rows, "item_id", encode)
    return cached.select("item_id", F.posexplode("embedding").alias("position", "value")).withColumn(
        "value", F.round("value", 6)
    )


def vectors_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache after one text has changed: that text alone gets a new vector (of its length and words), in a
    version of its own; asking again adds nothing."""
    path, rows = _new_path(spark), staged(frame_t(spark, sf_dir).select("item_id", "review_text"))

    def encode(wanted: DataFrame) -> DataFrame:
        numbers = F.array(F.length("review_text"), F.size(F.split("review_text", " ", -1))).cast("array<double>")
        return wanted.select("item_id", numbers.alias("embedding"))

    first = rows.agg(F.min("item_id").alias("first_id"))
    text = F.when(F.col("item_id") == F.col("first_id"), F.concat("review_text", F.lit(" again"))).otherwise(F.col("review_text"))
    changed = rows.join(F.broadcast(first)).select("item_id", text.alias("review_text"))  # one row
    for frame in (rows, changed, changed):
        found = tables.cached_vectors(spark, path, frame, "item_id", encode, "review_text")
    return found.select(
        "item_id", "version", F.col("embedding")[0].alias("chars"), F.col("embedding")[1].alias("words")
    )


def results_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result tables written as one nested document, and its leaves read back as rows."""
    frame = staged(frame_l(spark, sf_dir))
    rates = diagnostics.rates_by_event(frame, BINARY).groupBy("feature").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("event").cast("string"), F.round("rate", 6)))).alias("by_event")
    )
    shape = rounded(diagnostics.describe_features(frame, FEATURES), 6, "mean", "std", "min", "max")
    path = _new_path(spark)
    tables.write_results({"summary": rounded(dataset.churn_summary(frame), 6, "churn_rate"), "rates": rates, "shape": shape}, path)
    leaves = tables.document_leaves(spark.read.text(f"{path}/document"))
    number = F.col("leaf").try_cast("double")
    names = leaves.filter("path = 'feature'").select("table", "row", F.col("leaf").alias("feature"))
    return (
        leaves.filter("path <> 'feature'")
        .join(F.broadcast(names), ["table", "row"], "left")  # a row a feature
        .select("table", "feature", "path", F.round(number, 6).alias("value"))
    )


QUERIES = {
    f.__name__: f
    for f in (
        survival_dataset,
        text_survival_dataset,
        stage_counts,
        line_stage_counts,
        churn_summary,
        stratified_cap,
        holdout_split,
        kfold_assignment,
        km_by_group,
        km_by_event,
        km_median_split,
        median_survival,
        contract_violations,
        describe_features,
        rates_by_event,
        density_by_event,
        histogram_by_event,
        spearman_matrix,
        spearman_sparse,
        collinear_pairs,
        cindex_fixed_risk,
        cox_loglik_fixed_beta,
        baseline_hazard_fixed_beta,
        schoenfeld_fixed_beta,
        ph_sums_fixed_beta,
        survival_curve,
        model_roundtrip,
        cox_fit,
        hazard_ratios,
        cox_gradient_at_fit,
        lr_test,
        lr_test_all_signals,
        ph_test,
        cv_cindex,
        univariate_cindex,
        experiment,
        experiment_baseline,
        experiment_summary,
        leakage_audit,
        leakage_decomposition,
        leakage_lr_tests,
        leakage_shares,
        ablation_isolation,
        ablation_additive,
        tfidf_vocab,
        tfidf_weights,
        tfidf_svd,
        dense_vectors,
        pca_embedding,
        pca_explained,
        pca_total,
        text_signals,
        signals_stream,
        signal_contract,
        align_batches,
        signal_fallbacks,
        ingest_reviews,
        ingest_items,
        ingest_bad_lines,
        survival_saved,
        split_saved,
        weights_saved,
        vectors_cached,
        vectors_changed,
        results_document,
    )
}
