"""Survival frames derived from the star-schema and text tables.

L is the main frame: a line item of a customer's order is a (user, item) pair, the days from
order to shipping are the duration, and a returned line is the event. T carries text, V carries
vectors. Their covariates stand in for behaviour and text signals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.functions.columns import field_or, order_hash, stripped
from tenura.lineage import staged
from tenura.operators.dataset import as_survival, in_duration_range, join_reviews_items, keep_first
from tenura.operators.signals import enrich_signals

BEHAVIOURAL = ("log_playtime_2weeks", "log_items_count")
SIGNALS = (
    "sentiment_score",
    "frustration_level",
    "technical_issue",
    "value_complaint",
    "engagement_dropped",
    "positive_signal",
)
L_KEYS = ("user_id", "item_id")
BROADCAST_BYTES = 8 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items joined to their orders, before any filter."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "inner").select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.datediff("l_shipdate", "o_orderdate").cast("double").alias("duration"),
        (F.col("l_returnflag") == "R").cast("int").alias("event"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_linestatus").alias("line_status"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderpriority").alias("priority"),
    )


L_ORDER = ("duration", "event", "quantity", "price", "discount", "tax", "line_status", "order_status", "priority")


def frame_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = keep_first(in_duration_range(line_pairs(spark, sf_dir)), L_KEYS, L_ORDER)
    per_user = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.count(F.lit(1)).alias("n_orders")
    )
    low_hash = F.substring(order_hash(L_KEYS, 0), 1, 1) < "8"
    return pairs.join(per_user, "user_id", "inner").select(
        "user_id",
        "item_id",
        "duration",
        "event",
        "priority",
        F.log1p("quantity").alias("log_playtime_2weeks"),
        F.log1p("n_orders").alias("log_items_count"),
        (1 - 20 * F.col("discount")).alias("sentiment_score"),
        (F.col("tax") / 0.08).alias("frustration_level"),
        (F.col("line_status") == "F").cast("int").alias("technical_issue"),
        (F.col("price") > 53000).cast("int").alias("value_complaint"),
        (F.col("order_status") == "F").cast("int").alias("engagement_dropped"),
        # known only when the outcome is: the covariate that a leakage audit must find
        ((F.col("event") == 0) & low_hash).cast("int").alias("positive_signal"),
    )


def labelled_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a quality label, in the shape of flat reviews."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return documents.join(labels, "doc_id", "inner").select(
        F.col("source").alias("user_id"),
        F.col("doc_id").alias("item_id"),
        (F.col("quality") == 1).alias("recommend"),
        stripped(field_or("text", "")).alias("review_text"),
    )


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the shape of owned items: their length plays the minutes, the number of
    documents in the same language the items of their owner."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    # few languages: sent to all tasks after a look at their size, as a join on `lang` would gather the
    # documents in as many tasks as there are languages
    per_lang = staged(documents.groupBy("lang").agg(F.count(F.lit(1)).alias("items_count")))
    size = per_lang.agg(F.sum(F.octet_length("lang") + 32)).first()[0] or 0
    per_lang = F.broadcast(per_lang) if size <= BROADCAST_BYTES else per_lang
    return documents.join(per_lang, "lang", "inner").select(
        F.col("source").alias("user_id"),
        F.col("doc_id").alias("item_id"),
        (F.col("n_chars") / 60).alias("playtime_forever"),
        (F.pmod(F.col("doc_id"), F.lit(97)) / 60).alias("playtime_2weeks"),
        "items_count",
    )


def frame_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_survival(
        join_reviews_items(labelled_reviews(spark, sf_dir), document_items(spark, sf_dir))
    )


def frame_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T with the precomputed vector of each document, where there is one."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    return frame_t(spark, sf_dir).join(vectors, "item_id", "inner")


def frame_v_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V with six signals: the word scores of the text, and stand-ins for the flags that are rare
    in it (digits, marks, the toxic label, several lines)."""
    toxic = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), "toxic")
    text = F.col("review_text")
    return (
        enrich_signals(frame_v(spark, sf_dir))
        .join(toxic, "item_id", "inner")
        .withColumns(
            {
                "technical_issue": text.rlike("[0-9]").cast("int"),
                "value_complaint": text.rlike("[|!]").cast("int"),
                "engagement_dropped": F.col("toxic"),
                "positive_signal": (F.size(F.split(text, "\n")) > 5).cast("int"),
            }
        )
        .drop("toxic")
    )
