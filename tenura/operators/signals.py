"""Six structured signals per review: their contract, a built-in scorer, and a pluggable one."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenura.functions.columns import words
from tenura.operators.ordered import quantile_cuts, running_sums, slabs_for

# The signal fields, their ranges, and the batch size of a scorer call.
RANGES = {"sentiment_score": (-1.0, 1.0), "frustration_level": (0.0, 1.0)}
FLAGS = ("technical_issue", "value_complaint", "engagement_dropped", "positive_signal")
FIELDS = (*RANGES, *FLAGS)
BATCH_SIZE = 10
RANKING_SLABS = 16
# Text length that a remote scorer is shown; the built-in scorer always reads whole texts.

NEUTRAL = {**dict.fromkeys(RANGES, 0.0), **dict.fromkeys(FLAGS, False)}

POSITIVE_WORDS = (
    "amazing", "awesome", "beautiful", "best", "brilliant", "enjoy", "enjoyed", "excellent",
    "fantastic", "fun", "good", "great", "love", "loved", "masterpiece", "perfect", "recommend",
    "superb", "wonderful",
)
NEGATIVE_WORDS = (
    "angry", "annoying", "awful", "bad", "boring", "disappointed", "disappointing", "disgusting",
    "frustrated", "frustrating", "garbage", "hate", "hated", "horrible", "idiot", "pathetic",
    "poor", "stupid", "terrible", "trash", "unplayable", "useless", "waste", "worst", "worthless",
)
TECHNICAL_WORDS = (
    "broken", "bug", "buggy", "bugs", "crash", "crashed", "crashes", "crashing", "disconnect",
    "error", "errors", "fps", "freeze", "freezes", "glitch", "glitches", "lag", "laggy", "lags",
    "stutter", "unplayable",
)
VALUE_WORDS = ("cost", "costs", "expensive", "microtransactions", "overpriced", "pricey", "refund", "worthless")
VALUE_PHRASES = ("not worth", "pay to win", "waste of money", "rip off")
DROPPED_WORDS = ("abandoned", "bored", "quit", "quitting", "uninstall", "uninstalled", "uninstalling")
DROPPED_PHRASES = ("gave up", "lost interest", "stopped playing", "no longer play")
POSITIVE_SIGNAL_WORDS = ("best", "love", "loved", "recommend", "recommended")
POSITIVE_SIGNAL_PHRASES = ("keep playing", "still playing", "must buy")
HITS_FOR_FULL_FRUSTRATION = 4


def _hits(tokens: Column, vocabulary: Sequence[str]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*vocabulary)))


def _mentions(tokens: Column, joined: Column, vocabulary: Sequence[str], phrases: Sequence[str] = ()) -> Column:
    found = F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in vocabulary]))
    for phrase in phrases:
        found = found | joined.contains(f" {phrase} ")
    return found


def enrich_signals(df: DataFrame, text: str = "review_text") -> DataFrame:
    """Add the six signals, scored from the words of the whole text. Works on streams too.

    Sentiment is the balance of positive and negative words, frustration grows with the negative
    ones, and a flag is set when the text mentions one of its words or phrases. Flags are 0 / 1.
    """
    prepared = df.withColumn("_words", words(text))
    counted = prepared.withColumns(
        {
            "_joined": F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")),
            "_pos": _hits(F.col("_words"), POSITIVE_WORDS),
            "_neg": _hits(F.col("_words"), NEGATIVE_WORDS),
        }
    )
    tokens, joined = F.col("_words"), F.col("_joined")
    both = F.col("_pos") + F.col("_neg")
    flags = {
        "technical_issue": _mentions(tokens, joined, TECHNICAL_WORDS),
        "value_complaint": _mentions(tokens, joined, VALUE_WORDS, VALUE_PHRASES),
        "engagement_dropped": _mentions(tokens, joined, DROPPED_WORDS, DROPPED_PHRASES),
        "positive_signal": _mentions(tokens, joined, POSITIVE_SIGNAL_WORDS, POSITIVE_SIGNAL_PHRASES),
    }
    full = F.lit(float(HITS_FOR_FULL_FRUSTRATION))
    scored = counted.withColumns(
        {
            "sentiment_score": F.when(both > 0, (F.col("_pos") - F.col("_neg")) / both).otherwise(F.lit(0.0)),
            "frustration_level": F.least(F.lit(1.0), F.col("_neg") / full),
            **{name: flag.cast("int") for name, flag in flags.items()},
        }
    )
    return scored.drop("_words", "_joined", "_pos", "_neg")


def with_violations(df: DataFrame, name: str = "violations") -> DataFrame:
    """Add the array of signal fields that break the contract: a missing value, a value of the
    wrong type, or one out of range. Rows are marked, never clamped."""
    checks = []
    for field, (low, high) in RANGES.items():
        value = F.col(field).try_cast("double")
        checks.append(F.when(~F.coalesce(value.between(low, high), F.lit(False)), F.lit(field)))
    for field in FLAGS:
        value = F.col(field).cast("string").isin("0", "1", "true", "false")
        checks.append(F.when(~F.coalesce(value, F.lit(False)), F.lit(field)))
    return df.withColumn(name, F.array_compact(F.array(*checks)))


def neutral_signal() -> Column:
    return F.struct(
        *[F.lit(NEUTRAL[f]).alias(f) for f in RANGES], *[F.lit(0).alias(f) for f in FLAGS]
    )


def align(df: DataFrame, signals: str = "signals", expected: str = "expected") -> DataFrame:
    """Bring an ordered signal array to its expected length: surplus entries are cut off at the
    end, missing ones are filled with neutral signals, and both counts are reported."""
    n, have = F.col(expected), F.size(signals)
    fill = F.array_repeat(neutral_signal(), F.greatest(n - have, F.lit(0)))
    return df.withColumns(
        {
            "aligned": F.slice(F.concat(F.col(signals), fill), F.lit(1), n),
            "surplus": F.greatest(have - n, F.lit(0)),
            "shortage": F.greatest(n - have, F.lit(0)),
        }
    )


def with_batches(df: DataFrame, key: str, size: int = BATCH_SIZE, name: str = "batch") -> DataFrame:
    """Add the number of the fixed-size batch each row falls into, in the order of a unique numeric key.

    Only keys are ranked, in several slabs at any size; the batch is then joined to the rows by key, so
    no text is sorted or gathered. Rows of an equal key share a batch, rows without key have none.
    """
    keys = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    slabs = max(RANKING_SLABS, slabs_for(keys.count()))
    ranked = running_sums(keys, "_key", {"_rank": F.col("_n")}, cuts=quantile_cuts(keys, "_key", slabs))
    numbered = ranked.select("_key", F.floor((F.col("_rank") - 1) / size).alias(name))
    return df.join(numbered, F.col(key) == F.col("_key"), "left").drop("_key")


def _checked(signal: dict) -> dict:
    out = {}
    for field, (low, high) in RANGES.items():
        value = signal[field]
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not low <= value <= high:
            raise ValueError(f"{field} is not a number in [{low}, {high}]")
        out[field] = float(value)
    for field in FLAGS:
        if signal[field] not in (0, 1):
            raise ValueError(f"{field} is not a truth value")
        out[field] = int(signal[field])
    return out


def enrich_with_scorer(
    df: DataFrame,
    scorer: Callable[[list[str]], list[dict]],
    text: str = "review_text",
    batch_size: int = BATCH_SIZE,
    max_chars: int | None = None,
    batch: str | None = None,
    presorted: bool = False,
) -> DataFrame:
    """Add signals from a Python scorer that takes a list of texts and returns a list of signals.

    Rows are handed over in batches of `batch_size` inside each task, without a shuffle; name a
    `batch` column to fix the batches instead (`presorted` if its rows already lie together). A call that raises or breaks the contract makes
    its batch neutral (`signal_fallback`); a wrong number of signals is cut or filled, and the
    batch's `signal_surplus` or `signal_shortage` says by how much.
    """
    schema = T.StructType(
        [
            *df.schema.fields,
            *[T.StructField(f, T.DoubleType()) for f in RANGES],
            *[T.StructField(f, T.IntegerType()) for f in FLAGS],
            T.StructField("signal_fallback", T.BooleanType()),
            T.StructField("signal_surplus", T.IntegerType()),
            T.StructField("signal_shortage", T.IntegerType()),
        ]
    )
    neutral = _checked(NEUTRAL)

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        texts = ["" if t is None else t[:max_chars] for t in frame[text]]
        surplus = shortage = 0
        try:
            found = [_checked(s) for s in scorer(texts)]
            fallback = False
            surplus, shortage = max(0, len(found) - len(texts)), max(0, len(texts) - len(found))
        except Exception:  # any failure of the scorer degrades its batch
            found, fallback = [], True
        found = (found + [neutral] * len(texts))[: len(texts)]
        scores = pd.DataFrame(found, index=frame.index)
        return pd.concat([frame, scores], axis=1).assign(
            signal_fallback=fallback, signal_surplus=surplus, signal_shortage=shortage
        )

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            done = 0
            for start, stop in _spans(rest, batch, batch_size):
                # the last span may continue in the next Arrow batch
                if stop == len(rest):
                    break
                yield score(rest.iloc[start:stop])
                done = stop
            rest = rest.iloc[done:]
        if rest is not None:
            for start, stop in _spans(rest, batch, batch_size):
                yield score(rest.iloc[start:stop])

    rows = df if batch is None or presorted else df.repartition(batch).sortWithinPartitions(batch)
    return rows.mapInPandas(task, schema)


def _spans(frame: pd.DataFrame, batch: str | None, size: int) -> Iterator[tuple[int, int]]:
    edges = [0, len(frame)]
    if batch is not None:
        ids = frame[batch].to_numpy()
        edges = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(frame)]
    for low, high in zip(edges, edges[1:]):
        for part in range(math.ceil((high - low) / size)):
            yield low + part * size, min(high, low + (part + 1) * size)


def fallback_summary(df: DataFrame) -> DataFrame:
    """Rows scored, rows given neutral signals because their batch failed, and misaligned rows."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("signal_fallback").alias("n_fallback"),
        F.count_if(F.col("signal_surplus") > 0).alias("n_surplus"),
        F.count_if(F.col("signal_shortage") > 0).alias("n_shortage"),
    )
