"""The right-censored survival table: one row per (user, item)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.functions.columns import (
    MAX_DURATION,
    MIN_DURATION,
    MIN_TEXT_CHARS,
    field_or,
    log1p_or_zero,
)
from tenura.operators.sampling import FOLD_SEED, stratified_cap

KEYS = ("user_id", "item_id")
# Fixed value: the size of the published sample. Only a caller who asks for a cap gets one.
MAX_REVIEWS = 10_000

# The columns of the survival table, in order.
SURVIVAL_COLUMNS = (
    "user_id",
    "item_id",
    "duration",
    "event",
    "review_text",
    "playtime_2weeks",
    "log_playtime_2weeks",
    "log_items_count",
)


def in_duration_range(df: DataFrame, low: float = MIN_DURATION, high: float = MAX_DURATION) -> DataFrame:
    return df.filter(F.col("duration").between(low, high))


def with_enough_text(df: DataFrame, text: str = "review_text", more_than: int = MIN_TEXT_CHARS) -> DataFrame:
    return df.filter(F.length(text) > more_than)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key under `order`, remaining columns breaking ties (nulls come first).

    A minimum over structs is combined on the map side, so a key with very many rows is reduced
    before the shuffle; a window would bring all of its rows into one task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    ordered = [c for c in order if c not in keys]
    first = df.groupBy(*keys).agg(F.min(F.struct(*ordered, *rest)).alias("_first"))
    return first.select([F.col(k) if k in keys else F.col(f"_first.{k}").alias(k) for k in df.columns])


def _usable(reviews: DataFrame, items: DataFrame, low: float, high: float):
    texts = with_enough_text(reviews)
    played = in_duration_range(items.withColumn("duration", F.col("playtime_forever")), low, high)
    return texts, played


def join_reviews_items(
    reviews: DataFrame,
    items: DataFrame,
    order: Sequence[str] = (),
    min_duration: float = MIN_DURATION,
    max_duration: float = MAX_DURATION,
) -> DataFrame:
    """Join, filter and deduplicate, ending with one row per (user_id, item_id).

    Joining first would multiply the copies of a key on both sides. The first joined row in range
    is the first usable review with the first usable item, so each side is filtered and reduced
    to one row per key before the join.
    """
    texts, played = _usable(reviews, items, min_duration, max_duration)
    item_columns = [*KEYS, "duration", "playtime_2weeks", "items_count"]
    item_order = [c for c in order if c in played.columns]
    first_review = keep_first(texts, KEYS, [c for c in order if c in texts.columns])
    first_item = keep_first(played.select(*item_columns, *item_order), KEYS, item_order)
    return first_review.drop(*order).join(first_item.drop(*order), list(KEYS), "inner")


def as_survival(joined: DataFrame) -> DataFrame:
    """Event and behavioural covariates, cut down to the contract columns."""
    recommended = field_or(F.col("recommend"), False)
    return joined.select(
        "user_id",
        "item_id",
        F.col("duration").cast("double").alias("duration"),
        (~recommended).cast("int").alias("event"),
        "review_text",
        F.col("playtime_2weeks").cast("double").alias("playtime_2weeks"),
        log1p_or_zero("playtime_2weeks").alias("log_playtime_2weeks"),
        log1p_or_zero("items_count").alias("log_items_count"),
    )


def build_survival_table(
    reviews: DataFrame,
    items: DataFrame,
    order: Sequence[str] = (),
    max_rows: int | None = None,
    seed: int = FOLD_SEED,
    min_duration: float = MIN_DURATION,
    max_duration: float = MAX_DURATION,
) -> DataFrame:
    """The table of all usable reviews; `max_rows` names the size of a stratified cap, if one is wanted."""
    joined = join_reviews_items(reviews, items, order, min_duration, max_duration)
    return stratified_cap(as_survival(joined), max_rows, KEYS, seed=seed)


def stage_counts(
    reviews: DataFrame,
    items: DataFrame,
    min_duration: float = MIN_DURATION,
    max_duration: float = MAX_DURATION,
) -> DataFrame:
    """Rows after each stage. The joined size is the sum of products of the copies per key, so
    the multiplied join is never produced."""
    texts, played = _usable(reviews, items, min_duration, max_duration)
    text_counts = texts.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_reviews"))
    item_counts = items.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count(F.when(F.col("playtime_forever").between(min_duration, max_duration), 1)).alias("n_played"),
    )
    per_key = text_counts.join(item_counts, list(KEYS), "inner").agg(
        F.coalesce(F.sum(F.col("n_reviews") * F.col("n_items")), F.lit(0)).alias("joined"),
        F.count(F.when(F.col("n_played") > 0, 1)).alias("filtered"),
    )
    loaded = texts.agg(F.count(F.lit(1)).alias("reviews"))
    owned = items.agg(F.count(F.lit(1)).alias("items"))
    stages = [("reviews", loaded), ("items", owned), ("joined", per_key), ("filtered", per_key)]
    result = None
    for name, frame in stages:
        row = frame.select(F.lit(name).alias("stage"), F.col(name).cast("long").alias("n_rows"))
        result = row if result is None else result.unionByName(row)
    return result


def churn_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("event").cast("long").alias("n_churned"),
        F.sum(1 - F.col("event")).cast("long").alias("n_retained"),
        F.avg("event").alias("churn_rate"),
    )


def backfill_behaviour(df: DataFrame) -> DataFrame:
    """Supply log_playtime_2weeks where an older table lacks it."""
    if "log_playtime_2weeks" in df.columns:
        return df
    if {"playtime_2wk_ratio", "duration"} <= set(df.columns):
        value = F.log1p(F.col("playtime_2wk_ratio") * (F.col("duration") + F.lit(1e-6)))
    elif "playtime_2weeks" in df.columns:
        value = log1p_or_zero("playtime_2weeks")
    else:
        value = F.lit(0.0)
    return df.withColumn("log_playtime_2weeks", value)
