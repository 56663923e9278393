import pytest
from pyspark.sql import functions as F

from tenura.operators import signals


def test_scorer_reads_whole_texts(spark):
    filler = "word " * 2000
    rows = [
        (1, "I love it, the best, would recommend"),
        (2, filler + "crash! lag, garbage. Not worth it, I gave up"),
        (3, None),
    ]
    found = {r.id: r for r in signals.enrich_signals(spark.createDataFrame(rows, "id int, review_text string")).collect()}
    assert found[1].sentiment_score == 1 and found[1].positive_signal == 1 and found[1].frustration_level == 0
    two = found[2]
    assert (two.technical_issue, two.value_complaint, two.engagement_dropped, two.positive_signal) == (1, 1, 1, 0)
    assert two.sentiment_score == -1 and two.frustration_level == 0.25
    assert [found[3][f] for f in signals.FIELDS] == [0.0, 0.0, 0, 0, 0, 0]


def test_contract_rejects_bad_rows(spark):
    rows = [("0.5", "0.1", "0"), ("5.0", "0.0", "0"), ("not a number", "0.0", "1"), ("0", None, "2")]
    df = spark.createDataFrame(rows, "sentiment_score string, frustration_level string, technical_issue string")
    for f in signals.FLAGS[1:]:
        df = df.withColumn(f, F.lit(True))
    found = [r.violations for r in signals.with_violations(df).collect()]
    assert found == [[], ["sentiment_score"], ["sentiment_score"], ["frustration_level", "technical_issue"]]


@pytest.mark.parametrize("have, expected, kept", [(12, 10, 10), (7, 10, 7), (5, 5, 5)])
def test_align(spark, have, expected, kept):
    positive = F.struct(
        F.lit(0.9).alias("sentiment_score"), F.lit(0.0).alias("frustration_level"),
        *[F.lit(int(f == "positive_signal")).alias(f) for f in signals.FLAGS],
    )
    df = spark.range(1).select(F.array_repeat(positive, have).alias("signals"), F.lit(expected).alias("expected"))
    row = signals.align(df).first()
    assert len(row.aligned) == expected
    assert all(s.positive_signal == 1 for s in row.aligned[:kept])
    assert all(s.positive_signal == 0 and s.sentiment_score == 0.0 for s in row.aligned[kept:])
    assert (row.surplus, row.shortage) == (max(0, have - expected), max(0, expected - have))


def test_pluggable_scorer(spark):
    def scorer(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("no answer")
        good = {**signals.NEUTRAL, "sentiment_score": 0.5, "positive_signal": True}
        return [good] * (len(texts) - 1 if "short" in texts else len(texts) + (2 if "long" in texts else 0))

    texts = ["x"] * 10 + ["boom"] + ["x"] * 9 + ["short"] + ["x"] * 9 + ["long"] + ["x"] * 4
    df = spark.createDataFrame(list(enumerate(texts)), "id int, review_text string")
    batched = signals.with_batches(df.repartition(4), "id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = signals.enrich_with_scorer(batched, scorer, batch="batch").orderBy("id").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == 35 and list(out.id) == list(range(35))
    assert list(out.groupby("batch").signal_fallback.all()) == [False, True, False, False]
    assert out.sentiment_score[10:20].eq(0).all() and out.sentiment_score[:10].eq(0.5).all()
    assert list(out.groupby("batch").signal_shortage.max()) == [0, 0, 1, 0]
    assert list(out.groupby("batch").signal_surplus.max()) == [0, 0, 0, 2]
    narrow = signals.enrich_with_scorer(df.coalesce(1), lambda t: [signals.NEUTRAL] * len(t))
    assert narrow.count() == 35
    bad = signals.enrich_with_scorer(df, lambda t: [{**signals.NEUTRAL, "sentiment_score": 5.0}] * len(t))
    assert signals.fallback_summary(bad).first().n_fallback == 35
