import numpy as np
import pandas as pd
import pytest
from references import efron
from test_cox import FEATURES, tied_frame

from tenura.operators import cox, risk_sets


@pytest.fixture(scope="module")
def data(spark):
    pdf = tied_frame(500, seed=11, hot=True)
    return pdf, spark.createDataFrame(pdf)


COEF = {"a": 0.4, "b": -0.05, "c": 1.2}


@pytest.mark.parametrize("rows_per_slab", [100_000, 9])
def test_loglik_equals_direct_efron(data, rows_per_slab):
    pdf, df = data
    x = pdf[list(FEATURES)].values
    ll, _, _ = efron(pdf.duration.values, pdf.event.values, x, np.array(list(COEF.values())))
    row = risk_sets.partial_loglik(df, COEF, rows_per_slab=rows_per_slab).first()
    assert row.loglik == pytest.approx(ll, rel=1e-10)
    assert (row.n_rows, row.n_events) == (len(pdf), pdf.event.sum())


def test_blocks_of_deaths(data, monkeypatch):
    pdf, df = data
    whole = risk_sets.partial_loglik(df, COEF).first().loglik
    monkeypatch.setattr(risk_sets, "DEATHS_PER_BLOCK", 3)
    assert risk_sets.partial_loglik(df, COEF).first().loglik == pytest.approx(whole, rel=1e-12)


def test_residuals_sum_to_the_gradient(data):
    pdf, df = data
    x = pdf[list(FEATURES)].values
    _, grad, _ = efron(pdf.duration.values, pdf.event.values, x, np.array(list(COEF.values())))
    res = risk_sets.schoenfeld_residuals(df, COEF, keep=["user_id"], rows_per_slab=9).toPandas()
    assert len(res) == pdf.event.sum()
    np.testing.assert_allclose(res[list(FEATURES)].sum(), grad, rtol=1e-8)
    # the rank sums of the PH test from the rows themselves
    g = pdf.set_index("user_id").duration.rank().loc[res.user_id].values
    u = ((g - g.mean())[:, None] * res[list(FEATURES)].values).sum(axis=0)
    sums = risk_sets.rank_residual_sums(df, COEF, rows_per_slab=9).toPandas().set_index("covariate")
    np.testing.assert_allclose(sums.loc[list(FEATURES), "rank_residual"], u, rtol=1e-8)
    assert sums.rank_variation.iloc[0] == pytest.approx(((g - g.mean()) ** 2).sum())


def test_ph_test_flags_a_crossing_effect(spark):
    rng = np.random.default_rng(2)
    n = 2000
    x, y = rng.integers(0, 2, n), rng.normal(size=n)
    # x doubles the early hazard and halves the late one
    early = rng.exponential(0.5, n)
    crossing = np.where(early < 0.5, early, 0.5 + rng.exponential(4, n))
    t = np.where(x == 1, crossing, rng.exponential(1.5, n))
    df = spark.createDataFrame(pd.DataFrame({"user_id": np.arange(n), "duration": t, "event": 1, "x": x, "y": y}))
    rows = {r.covariate: r for r in risk_sets.ph_test(df, cox.fit(df, ["x", "y"])).collect()}
    assert rows["x"].ph_violated and rows["x"].p < 1e-3


def test_baseline_and_predicted_curve(spark, data):
    pdf, df = data
    means = {f: float(pdf[f].mean()) for f in FEATURES}
    r = np.exp(sum(COEF[f] * (pdf[f] - means[f]) for f in FEATURES))
    times = np.sort(pdf.duration.unique())
    hazard = [r[(pdf.duration == t) & (pdf.event == 1)].size / r[pdf.duration >= t].sum() for t in times]
    base = risk_sets.baseline_hazard(df, COEF, means, rows_per_slab=9)
    got = base.toPandas().sort_values("time")
    np.testing.assert_allclose(got.cumulative_hazard, np.cumsum(hazard))
    obs = [{"a": 0.0, "b": 10.0, "c": -1.0}, {"a": 1.0, "b": 8.0, "c": -1.2}]
    asked = [0.1, 1.0, 3.5, 7.0, 22.2, 55.5, 1e4]
    curve = risk_sets.predict_survival(
        base, COEF, means, obs, spark.createDataFrame([(t,) for t in asked], "time double"), rows_per_slab=9
    ).toPandas()
    for i, o in enumerate(obs):
        s = np.exp(-np.cumsum(hazard) * np.exp(sum(COEF[f] * (o[f] - means[f]) for f in FEATURES)))
        mine = curve[curve.curve_id == i].sort_values("time")
        np.testing.assert_allclose(mine.survival_prob, np.interp(asked, times, s))
