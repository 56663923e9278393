"""Scoring reviews as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tenura.functions.columns import MIN_TEXT_CHARS
from tenura.operators.dataset import with_enough_text
from tenura.operators.signals import enrich_signals


def score_stream(reviews: DataFrame, text: str = "review_text", more_than: int = MIN_TEXT_CHARS) -> DataFrame:
    """Signals of each incoming review: stateless, so it runs in append mode at any rate."""
    return enrich_signals(with_enough_text(reviews, text, more_than), text)


def write_scores(scored: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append scored reviews to a Parquet table; restarts continue from the checkpoint without
    losing or repeating rows. With `once`, process what is there and stop."""
    writer = scored.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)
