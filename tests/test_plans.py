"""Properties of the physical plans, and results that must not depend on the layout of the input."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_cox import FEATURES, tied_frame

from tenura.lineage import shared_dir, staged
from tenura.operators import cox, kaplan_meier, sampling, text
from tenura.operators.layout import place
from tenura.operators.signals import with_batches


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_splits_do_not_shuffle_the_rows(spark, tmp_path):
    spark.range(2000).select("id", (F.col("id") % 3 == 0).cast("int").alias("event")).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    for split in (
        sampling.holdout_split(rows, ["id"]),
        sampling.with_folds(rows, ["id"]),
        sampling.stratified_cap(rows, 500, ["id"]),
    ):
        assert "Exchange" not in plan(split)


def test_passes_read_the_placed_rows_without_a_shuffle(spark):
    df = spark.createDataFrame(tied_frame(400))
    placed = place(df, FEATURES, keys=["user_id"], min_rows_per_chunk=50)
    specs = [cox.Spec("m", FEATURES)]
    work = cox._run_pass(placed, cox._moments(cox._View(placed, specs), [0]))
    assert "Exchange" not in plan(work) and "InMemoryTableScan" in plan(work)
    placed.release()


def test_tfidf_weights_are_narrow(spark):
    df = spark.createDataFrame([(i, f"one two three w{i % 4}") for i in range(40)], "id int, review_text string")
    model = text.fit_tfidf(df)
    assert "Exchange" not in plan(model.transform(df))


def test_staged_rows_are_pruned(spark):
    rows = spark.range(50).select("id", F.lit("a long text").alias("review_text"), (F.col("id") % 2).alias("event"))
    scan = plan(staged(rows).filter("event = 1").select("event"))
    assert "review_text" not in scan and "id#" not in scan and "PushedFilters: [IsNotNull(event), EqualTo(event,1)]" in scan


def test_batches_rank_keys_only(spark, tmp_path):
    spark.range(100).select("id", F.lit("a long text").alias("review_text")).write.parquet(str(tmp_path / "t"))
    numbered = with_batches(spark.read.parquet(str(tmp_path / "t")), "id")
    windows = [line for line in plan(numbered).splitlines() if "Window" in line]
    assert windows and not any("review_text" in line for line in windows)


def test_the_session_folder_wins(spark):
    assert shared_dir(spark) == spark.sparkContext.getCheckpointDir()


@pytest.mark.parametrize("parts", [1, 7, 32])
def test_results_do_not_depend_on_partitions(spark, parts):
    pdf = tied_frame(400, seed=21, hot=True)
    df = spark.createDataFrame(pdf).repartition(parts)
    curve = kaplan_meier.kaplan_meier(df, rows_per_slab=17).toPandas().sort_values("time")
    n, expected, s = len(pdf), [], 1.0
    for t in np.sort(pdf.duration.unique()):
        at_risk, dead = (pdf.duration >= t).sum(), ((pdf.duration == t) & (pdf.event == 1)).sum()
        s *= 1 - dead / at_risk
        expected.append(s)
    assert curve.time.iloc[0] == 0 and curve.at_risk.iloc[0] == n and curve.survival.iloc[0] == 1
    np.testing.assert_allclose(curve.survival.iloc[1:], expected, atol=1e-12)
    assert (np.diff(curve.survival) <= 1e-15).all()
    middle = kaplan_meier.exact_median(df, "b", rows_per_slab=17)
    assert middle == pytest.approx(pdf.b.median())


def test_km_ends(spark):
    rows = [("all", 1.0, 1), ("all", 2.0, 1), ("all", 2.0, 1), ("none", 1.0, 0), ("none", 3.0, 0), (None, 4.0, 1), (None, 5.0, 0)]
    curve = kaplan_meier.kaplan_meier(spark.createDataFrame(rows, "g string, duration double, event int"), "g")
    found = {(r.g, r.time): r for r in curve.collect()}
    assert found[("all", 1.0)].survival == pytest.approx(2 / 3)
    assert found[("all", 2.0)].survival == 0.0 and found[("all", 2.0)].upper is None
    assert found[("none", 3.0)].survival == 1.0 and found[("none", 3.0)].lower == 1.0
    assert found[(None, 4.0)].survival == pytest.approx(0.5)
    medians = {r.g: r.median_time for r in kaplan_meier.median_survival(curve, "g").collect()}
    assert medians == {"all": 2.0, "none": None, None: 4.0}
