import numpy as np
import pandas as pd
import pytest
from references import concordance as brute
from references import ridge_fit

from tenura.operators import evaluate as ev
from tenura.plans import reports, studies


#: Odds of a bad month, by covariate: mood, two complaints and one consolation; the rest has no effect.
EFFECTS = {"sentiment_score": -1.1, "frustration_level": 1.4, "technical_issue": 0.7, "positive_signal": -0.9}


def planted(n, seed=0):
    """Customers observed month by month for two years at most: each month is a coin toss whose odds depend
    on the covariates, so durations are whole months with many ties."""
    rng = np.random.default_rng(100 + seed)
    names = [*studies.BEHAVIOURAL, *studies.SIGNALS]
    pdf = pd.DataFrame({f: rng.beta(2, 2, n) for f in names}).assign(user_id=np.arange(n), item_id=1)
    pdf[list(studies.SIGNALS[2:])] = (pdf[list(studies.SIGNALS[2:])] > 0.6).astype(int)
    odds = np.exp(sum(w * pdf[f] for f, w in EFFECTS.items()) - 3.2)
    leaves = rng.random((n, 24)) < (odds / (1 + odds)).values[:, None]
    event = leaves.any(axis=1)
    return pdf.assign(duration=np.where(event, leaves.argmax(axis=1) + 1.0, 24.0), event=event.astype(int))


@pytest.fixture(scope="module")
def experiment(spark):
    return studies.run_experiment(spark.createDataFrame(planted(1500)))


def test_augmented_recovers_the_planted_signal(experiment):
    rows = {r.variant: r for r in experiment["models"].collect()}
    base, best = rows["baseline"], rows["augmented"]
    assert best.holdout_cindex > 0.6 and best.holdout_cindex >= base.holdout_cindex - 0.02
    assert best.cv_mean == pytest.approx(np.mean(best.cv_folds)) and best.cv_std == pytest.approx(np.std(best.cv_folds))
    assert best.delta_vs_baseline == pytest.approx(best.cv_mean - base.cv_mean)
    assert experiment["lr_test"].first().significant
    sizes = experiment["sizes"].first()
    assert (sizes.n_samples, sizes.n_train, sizes.n_test) == (1500, 1200, 300)


def test_scores_equal_brute_force(spark, experiment):
    pdf = planted(1500).merge(experiment.split.toPandas()[["user_id", "split"]])
    train, test = pdf[pdf.split == "train"], pdf[pdf.split == "test"]
    cols = list(studies.AUGMENTED)
    coef, _, _ = ridge_fit(train.duration.values, train.event.values, train[cols].values.astype(float))
    for rows, mine in [(train, experiment.results.apparent), (test, experiment.results.holdout)]:
        conc, tied, pairs = brute(rows.duration.values, rows.event.values, rows[cols].values @ coef)
        assert mine["augmented"] == pytest.approx((conc + 0.5 * tied) / pairs, abs=1e-9)


def test_shuffled_covariate_has_no_concordance(spark):
    pdf = planted(800, seed=2)
    pdf["useless"] = pdf.frustration_level.sample(frac=1, random_state=1).values
    df = spark.createDataFrame(pdf)
    useless, useful = (ev.cv_cindex(df, [f], ["user_id"]) for f in ("useless", "frustration_level"))
    assert abs(useless["mean"] - 0.5) < 0.05 < useful["mean"] - 0.5 + 0.03
    assert useful["mean"] > useless["mean"] and len(useless["folds"]) == 5


def test_folds_of_a_variant_with_missing_values(spark):
    pdf = planted(400)
    pdf.loc[::3, "sentiment_score"] = np.nan
    df = spark.createDataFrame(pdf)
    both = ev.evaluate(df, {"all": ["log_items_count"], "some": ["sentiment_score"]}, ["user_id"], apparent=False)
    alone = ev.evaluate(
        spark.createDataFrame(pdf.dropna()), {"some": ["sentiment_score"]}, ["user_id"], apparent=False
    )
    assert both.folds["some"] == pytest.approx(alone.folds["some"])
    assert both.models["some"].n == pdf.sentiment_score.notna().sum()


def test_failed_folds_are_skipped(spark):
    pdf = planted(200).assign(constant=1.0)
    rows = ev.univariate_cindex(spark.createDataFrame(pdf), ["constant", "sentiment_score"], ["user_id"]).collect()
    assert rows[0].feature == "sentiment_score" and rows[1].univariate_c is None


def test_leakage_audit(spark):
    pdf = planted(900)
    pdf["positive_signal"] = np.where(pdf.event == 0, 1, pdf.positive_signal)
    audit = studies.run_leakage_audit(spark.createDataFrame(pdf))
    lifts = audit["decomposition"].first()
    assert lifts.polarity_lift > lifts.defensible_predictive_lift
    assert lifts.polarity_share == pytest.approx(lifts.polarity_lift / lifts.full_augmented_lift)
    assert audit["lr_tests"].count() == 3
    parts = reports.leakage_decomposition(audit["variants"]).first()
    assert parts.base + parts.non_polarity_lift + parts.polarity_lift == pytest.approx(
        audit.results.mean("full_augmented")
    )


def test_published_lifts_decompose(spark):
    # figures published for the 10,000-review sample
    rows = [("baseline", 0.6039, 0.0), ("non_polarity", 0.7481, 0.1443), ("polarity_only", 0.8650, 0.2611),
            ("full_augmented", 0.8656, 0.2617)]
    variants = spark.createDataFrame(rows, "variant string, cv_mean double, delta_vs_baseline double")
    found = studies.decomposition(variants).first()
    assert found.polarity_share == pytest.approx(0.2611 / 0.2617)
    flat = spark.createDataFrame([("full_augmented", 0.6, 0.0), ("polarity_only", 0.6, 0.0)], variants.schema)
    assert studies.decomposition(flat).first().polarity_share is None


def test_missing_signals_fail_early(spark):
    with pytest.raises(ValueError, match="missing covariates"):
        studies.run_experiment(spark.createDataFrame(planted(50).drop(columns=["value_complaint"])))


def test_report_tables(spark, experiment):
    forest = reports.hazard_forest(experiment["hazard_ratios"]).collect()
    assert [r.HR for r in forest] == sorted(r.HR for r in forest)
    assert {r.feature: r.family for r in forest}["log_items_count"] == "behavioural"
    additive = spark.createDataFrame(
        [("Baseline", 0.6, 0.0, 0.6), ("a", 0.65, 0.0, 0.6), ("b", 0.75, 0.0, 0.6), ("c", 0.9, 0.0, 0.6)],
        "label string, cv_mean double, cv_std double, holdout_cindex double",
    )
    tiers = {r.label: r.tier for r in reports.ablation_additive(additive).collect()}
    assert tiers == {"Baseline": "none", "a": "small", "b": "medium", "c": "large"}


@pytest.mark.parametrize("refit", [False, True])
def test_ablation(spark, refit):
    pdf = planted(240, seed=5)
    rng = np.random.default_rng(9)
    words = np.array([f"word{i}" for i in range(30)])
    # events tend to use the first words
    lean = np.where(pdf.event.values[:, None] == 1, np.arange(30) < 10, np.arange(30) >= 8) + 0.2
    pdf["review_text"] = [" ".join(rng.choice(words, 15, p=w / w.sum())) for w in lean]
    pdf["embedding"] = (rng.normal(size=(240, 6)) + pdf.event.values[:, None]).tolist()
    study = studies.run_ablation(spark.createDataFrame(pdf), components=3, folds=2, refit_per_fold=refit)
    isolation = {r.label: r for r in study["isolation"].collect()}
    assert set(isolation) == set(studies.ISOLATION)
    assert [isolation[v].n_features for v in studies.ISOLATION] == [2, 5, 5, 8]
    additive = study["additive"].collect()
    assert [r.label for r in additive] == list(studies.ADDITIVE)
    assert [r.n_features for r in additive] == [2, 5, 8, 11, 14]
    assert additive[1].cv_mean == isolation["TF-IDF only"].cv_mean
    assert isolation["TF-IDF only"].cv_mean > isolation["Baseline"].cv_mean + 0.05
    assert all(len(r.cv_folds) == 2 for r in additive)
    assert study.split.count() == 240
