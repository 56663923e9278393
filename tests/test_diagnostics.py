import numpy as np
import pandas as pd
import pytest

from tenura.operators import diagnostics, sampling


def test_spearman_is_pairwise_over_missing_values(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.integers(0, 12, (300, 4)).astype(float), columns=list("abcd"))
    pdf["b"] += pdf["a"]
    pdf.loc[::3, "c"] = np.nan
    pdf.loc[1::4, "d"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double")
    expected = pdf.corr(method="spearman")
    found = diagnostics.spearman_matrix(df, list("abcd")).collect()
    assert len(found) == 16
    for r in found:
        assert r.rho == pytest.approx(expected.loc[r.feature_x, r.feature_y], abs=1e-9)


def test_spearman_jobs_do_not_grow_with_sparse_features(spark):
    rng = np.random.default_rng(9)

    def jobs(sparse, slab):
        pdf = pd.DataFrame(rng.integers(0, 30, (200, 6)).astype(float), columns=list("abcdef"))
        for c in list("abcdef")[:sparse]:
            pdf.loc[rng.random(200) < 0.3, c] = np.nan
        df = spark.createDataFrame(pdf)  # NaN counts as missing
        group = f"spearman-{sparse}-{slab}"
        spark.sparkContext.setJobGroup(group, group)
        found = diagnostics.spearman_matrix(df, list("abcdef"), slab).collect()
        expected = pdf.corr(method="spearman")
        assert len(found) == 36
        assert all(r.rho == pytest.approx(expected.loc[r.feature_x, r.feature_y], abs=1e-9) for r in found)
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return n

    assert jobs(5, 250_000) <= jobs(1, 250_000) + 2
    jobs(3, 40)  # many slabs


def test_constant_and_empty_features_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, float(i), None) for i in range(9)], "a double, b double, c double")
    found = {(r.feature_x, r.feature_y): r.rho for r in diagnostics.spearman_matrix(df, list("abc")).collect()}
    assert len(found) == 9 and found.pop(("b", "b")) == 1.0 and set(found.values()) == {None}
    assert {r.rho for r in diagnostics.spearman_matrix(df.limit(0), list("abc")).collect()} == {None}


def test_histogram_counts_every_row(spark):
    values = [(0, -0.5), (0, 0.0), (1, 0.99), (1, 4.0), (1, 4.01), (0, None)]
    df = spark.createDataFrame(values, "event int, x double")
    bins = {(r.event, r.bin): r.n_rows for r in diagnostics.histogram_by_event(df, "x", 0.0, 4.0, 4).collect()}
    assert bins == {(0, -1): 1, (0, 0): 1, (1, 0): 1, (1, 3): 1, (1, 4): 1, (0, None): 1}


def test_repeated_keys_are_named(spark, monkeypatch):
    monkeypatch.setattr(sampling, "FEW_ROWS", 4)
    df = spark.range(40).selectExpr("1 AS id", "0 AS event")
    with pytest.raises(ValueError, match="do not identify a row"):
        sampling.holdout_split(df, ["id"])
