import dataclasses
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from references import efron, ridge_fit

from tenura.functions.tails import log_chi2_tail
from tenura.operators import cox, layout
from tenura.operators.layout import place


def tied_frame(n=900, seed=3, hot=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.2] + [0, 10, -1]
    t = np.ceil(rng.exponential(20 / np.exp(0.5 * x[:, 0])))
    if hot:
        t[rng.random(n) < 0.4] = 7.0
    e = (rng.random(n) < 0.6).astype(int)
    return pd.DataFrame(
        {"user_id": np.arange(n), "item_id": 0, "duration": t, "event": e, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}
    )


FEATURES = ("a", "b", "c")


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("min_rows", [10_000, 60])
def test_fit_equals_direct_efron(spark, hot, min_rows):
    pdf = tied_frame(hot=hot)
    placed = place(spark.createDataFrame(pdf), FEATURES, keys=["user_id"], min_rows_per_chunk=min_rows)
    if min_rows == 60:
        assert placed.chunks > 5
        assert bool(placed.hot_slabs) == hot
    model = cox.fit_many(placed, [cox.Spec("m", FEATURES)])["m"]
    placed.release()
    coef, ll, hess = ridge_fit(pdf.duration.values, pdf.event.values, pdf[list(FEATURES)].values)
    np.testing.assert_allclose(model.coef, coef, rtol=1e-8)
    assert model.loglik == pytest.approx(ll, rel=1e-10)
    np.testing.assert_allclose(model.hessian, hess, rtol=1e-7, atol=1e-7)
    assert np.abs(model.gradient).max() / model.n < 1e-9


def test_executor_side_addition_gives_the_same_fit(spark, monkeypatch):
    pdf = tied_frame(hot=True)
    placed = place(spark.createDataFrame(pdf), FEATURES, keys=["user_id"], min_rows_per_chunk=60)
    spec = cox.Spec("m", FEATURES)
    on_driver = cox.fit_many(placed, [spec])["m"]
    monkeypatch.setattr(cox, "DRIVER_BYTES", 0)
    on_executors = cox.fit_many(placed, [spec])["m"]
    placed.release()
    np.testing.assert_allclose(on_driver.coef, on_executors.coef, rtol=1e-10)


@pytest.mark.parametrize("hot", [False, True])
def test_a_task_holds_one_small_chunk_of_several_and_gives_one_result(spark, hot):
    pdf = tied_frame(hot=hot)
    width = len(FEATURES) + 2
    placed = place(spark.createDataFrame(pdf), FEATURES, keys=["user_id"], values_per_chunk=30 * width)
    assert placed.df.rdd.getNumPartitions() == placed.partitions < placed.chunks / 4
    sizes = [r["count"] for r in placed.df.groupBy("_chunk").count().collect()]
    assert max(sizes) < 120 and sum(sizes) == len(pdf) and (placed.hot_slabs or not hot)
    view = cox._View(placed, [cox.Spec("m", FEATURES)])
    found = list(cox._gather(cox._run_pass(placed, cox._moments(view, [0]), cox._merged_moments)))
    assert len(found) <= placed.partitions and sum(p[0] for _, _, p in found) == len(pdf)
    model = cox.fit_many(placed, [cox.Spec("m", FEATURES)])["m"]
    placed.release()
    coef, ll, hess = ridge_fit(pdf.duration.values, pdf.event.values, pdf[list(FEATURES)].values)
    np.testing.assert_allclose(model.coef, coef, rtol=1e-8)
    assert model.loglik == pytest.approx(ll, rel=1e-10)
    np.testing.assert_allclose(model.hessian, hess, rtol=1e-7, atol=1e-7)


def test_values_of_one_chunk_stay_far_below_the_memory_of_a_task():
    # a task has about ten arrays of this size at a time
    assert 8 * layout.VALUES_PER_CHUNK <= 32e6


def test_models_use_their_own_complete_rows_and_folds(spark, monkeypatch):
    pdf = tied_frame()
    pdf.loc[::7, "b"] = np.nan
    pdf["fold"] = np.arange(len(pdf)) % 3
    monkeypatch.setattr(cox, "OFFSET_BYTES", 1)  # one model per group
    placed = place(spark.createDataFrame(pdf), FEATURES, ["fold"], ["user_id"], min_rows_per_chunk=100)
    specs = [cox.Spec("ac", ("a", "c")), cox.Spec("ab1", ("a", "b"), "fold", 1)]
    models = cox.fit_many(placed, specs)
    placed.release()
    for name, rows, cols in [("ac", pdf, ["a", "c"]), ("ab1", pdf[pdf.fold != 1].dropna(), ["a", "b"])]:
        coef, ll, _ = ridge_fit(rows.duration.values, rows.event.values, rows[cols].values)
        assert models[name].n == len(rows)
        np.testing.assert_allclose(models[name].coef, coef, rtol=1e-8)
        assert models[name].loglik == pytest.approx(ll, rel=1e-10)


def test_copies_of_one_row_do_not_change_the_result_layout(spark):
    pdf = pd.concat([tied_frame(300), tied_frame(1).loc[[0] * 200]], ignore_index=True)
    pdf["user_id"] = np.arange(len(pdf))
    placed = place(spark.createDataFrame(pdf), FEATURES, keys=["user_id"], min_rows_per_chunk=50)
    model = cox.fit_many(placed, [cox.Spec("m", FEATURES)])["m"]
    sizes = [r["count"] for r in placed.df.groupBy("_chunk").count().collect()]
    placed.release()
    assert max(sizes) < 150  # the 200 copies are spread
    coef, _, _ = ridge_fit(pdf.duration.values, pdf.event.values, pdf[list(FEATURES)].values)
    np.testing.assert_allclose(model.coef, coef, rtol=1e-8)


def test_bad_inputs_are_refused(spark):
    pdf = tied_frame(200)
    pdf["same"] = 1.0
    df = spark.createDataFrame(pdf)
    with pytest.raises(ValueError, match="constant"):
        cox.fit(df, ["a", "same"])
    with pytest.raises(ValueError, match="survival time"):
        cox.fit(df.withColumn("log_duration", df.duration), ["a", "log_duration"])
    with pytest.raises(ValueError, match="missing"):
        cox.fit(df, ["a", "absent"])


def test_likelihood_ratio_test(spark):
    pdf = tied_frame(350, seed=13)
    df = spark.createDataFrame(pdf)
    full, small = cox.fit(df, FEATURES), cox.fit(df, FEATURES[:1])
    t, e, x = pdf.duration.values, pdf.event.values, pdf[list(FEATURES)].values.astype(float)
    gain = 2 * (ridge_fit(t, e, x)[1] - ridge_fit(t, e, x[:, :1])[1])
    result = cox.likelihood_ratio_test(full, small)
    assert result["lr_statistic"] == pytest.approx(gain, rel=1e-6) and result["df"] == len(FEATURES) - 1
    assert result["log_p_value"] == pytest.approx(log_chi2_tail(gain, len(FEATURES) - 1), abs=1e-6)
    assert result["p_value"] == pytest.approx(math.exp(result["log_p_value"]))
    assert result["significant"] is (result["p_value"] < 0.05)
    # a statistic whose p value is no double any more
    far = cox.likelihood_ratio_test(full, dataclasses.replace(small, loglik=full.loglik - 4000.0))
    assert far["p_value"] == 0.0 and far["log_p_value"] == pytest.approx(log_chi2_tail(8000.0, len(FEATURES) - 1))
    with pytest.raises(ValueError):
        cox.likelihood_ratio_test(small, full)  # not nested


@pytest.mark.parametrize(
    "x, df, expected",
    [
        (1276.7449, 6, -626.1446),
        (1478.1519, 4, -732.4692),
        (700.1884, 2, -350.0942),
        (1553.1682, 6, -763.9649),
        (3.841458820694124, 1, math.log(0.05)),
        (7.814727903251179, 3, math.log(0.05)),
        (11.070497693516351, 5, math.log(0.05)),
    ],
)
def test_log_chi2_tail(x, df, expected):
    assert log_chi2_tail(x, df) == pytest.approx(expected, abs=2e-4)


def test_log_chi2_tail_edges():
    assert log_chi2_tail(0.0, 3) == 0.0
    assert math.isfinite(log_chi2_tail(1e6, 3))
    with pytest.raises(ValueError):
        log_chi2_tail(1.0, 0)


def test_save_and_load(spark, tmp_path):
    model = cox.fit(spark.createDataFrame(tied_frame(300)), FEATURES)
    cox.save_model(spark, model, str(tmp_path / "m"))
    again = cox.load_model(spark, str(tmp_path / "m"))
    np.testing.assert_allclose(again.coef, model.coef)
    np.testing.assert_allclose(again.covariance, model.covariance)
    ratios = cox.hazard_ratios(spark, again).collect()
    assert [r.feature for r in ratios][0] in FEATURES and len(ratios) == 3
    effects = [abs(math.log(r.HR)) for r in ratios]
    assert effects == sorted(effects, reverse=True)


def test_placed_rows_are_read_in_pieces_of_whole_chunks(spark):
    pdf = tied_frame(hot=True)
    pdf.loc[::7, "b"] = None
    pdf["fold"] = [None if i % 11 == 0 else i % 3 for i in range(len(pdf))]
    frame = spark.createDataFrame(pdf).withColumn("fold", F.nanvl("fold", F.lit(None)).cast("int"))
    placed = place(frame, FEATURES, ["fold"], ["user_id"], min_rows_per_chunk=60)
    pieces = placed.packed.select("_chunk", "_rows").collect()
    assert len(pieces) == placed.chunks > 5 and sum(p["_rows"] for p in pieces) == len(pdf)
    rows = placed.df.toPandas()
    assert rows.x1.isna().sum() == pdf.b.isna().sum() and rows.k0.isna().sum() == pdf.fold.isna().sum()
    assert (rows.groupby("_chunk")._t.diff().dropna() >= 0).all()
    chunks = list(layout.chunks_of(iter(placed.packed.toArrow().to_batches()), len(FEATURES), 1))
    assert sum(len(c.t) for c in chunks) == len(pdf) and all(c.x.flags.f_contiguous for c in chunks)
    view = cox._View(placed, [cox.Spec(f"{f}{k}", (f,), "fold", k) for f in ("a", "c") for k in range(3)])
    for i in range(6):
        k = i % 3
        kept = [view.rows(i, c) for c in chunks]
        assert sum(len(e) for _, e, _ in kept) == (pdf.fold != k).sum()
        column = ("a", "c")[i // 3]
        values = np.concatenate([z[:, 0] for *_, z in kept]) * view.stds[i] + view.means[i]
        np.testing.assert_allclose(np.sort(values), np.sort(pdf[column][pdf.fold != k]))
    assert all(len(c.kept) == 3 for c in chunks)  # once a fold, not once a model
    placed.release()
