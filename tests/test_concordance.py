import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from references import concordance as brute

from tenura.operators.concordance import concordance


def frame(n, seed, ties, hot=False):
    rng = np.random.default_rng(seed)
    t = rng.exponential(10, n)
    r = rng.normal(size=n) - 0.05 * t
    if ties:
        t, r = np.ceil(t), np.round(r, 1)
    if hot:
        t[rng.random(n) < 0.35] = 5.0
        r[rng.random(n) < 0.35] = 0.3
    return pd.DataFrame({"duration": t, "event": (rng.random(n) < 0.5).astype(int), "risk": r})


def check(spark, pdf, leaf_rows, parts=7):
    row = concordance(spark.createDataFrame(pdf).repartition(parts), leaf_rows=leaf_rows).first()
    assert (row.concordant, row.tied, row.pairs) == brute(
        pdf.duration.values, pdf.event.values, pdf.risk.values
    )
    return row.cindex


@pytest.mark.parametrize("ties, hot", [(False, False), (True, False), (False, True), (True, True)])
def test_every_level_agrees_with_brute_force(spark, ties, hot):
    pdf = frame(1500, 5, ties, hot)
    # one leaf; one level; two levels (more than 64 leaves)
    scores = [check(spark, pdf, leaf_rows) for leaf_rows in (10_000, 100, 6)]
    assert len(set(scores)) == 1


def test_small_batches_carry_counts(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        check(spark, frame(900, 8, False, True), 50, parts=2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_models_are_kept_apart_and_null_without_pairs(spark):
    a, b = frame(400, 1, True), frame(500, 2, False)
    none = frame(30, 3, True).assign(event=0)
    both = pd.concat([a.assign(m="a"), b.assign(m="b"), none.assign(m="none")])
    found = {r.m: r for r in concordance(spark.createDataFrame(both), "m", leaf_rows=40).collect()}
    for name, pdf in [("a", a), ("b", b)]:
        expected = brute(pdf.duration.values, pdf.event.values, pdf.risk.values)
        assert (found[name].concordant, found[name].tied, found[name].pairs) == expected
    assert found["none"].cindex is None


def test_monotone_and_negated_risks(spark):
    df = spark.createDataFrame(frame(600, 4, True))
    c = concordance(df).first().cindex
    assert concordance(df, risk=F.exp("risk")).first().cindex == c
    assert concordance(df, risk=-F.col("risk")).first().cindex == pytest.approx(1 - c)


def test_hand_cases(spark):
    # event/event tie in time is no pair; event/censored tie is; equal risks count half
    rows = [(1.0, 1, 2.0), (1.0, 1, 1.0), (1.0, 0, 2.0), (3.0, 0, 0.5)]
    row = concordance(spark.createDataFrame(rows, "duration double, event int, risk double")).first()
    assert (row.pairs, row.tied, row.concordant) == (4, 1, 2)
