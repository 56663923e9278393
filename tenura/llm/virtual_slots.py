"""Sharding by fixed virtual slots, in DataFrame functions only.

Rows are hashed into a fixed number of virtual slots. A small versioned map gives each slot its shard;
adding a shard or evening out bytes edits the map and moves whole slots, never single rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenura.lineage import shared_dir, staged
from tenura.llm.common import table

#: Fixed for the life of a data set: a row's slot never changes.
SLOTS = 8192
#: Parts of a slot that are numbered by separate tasks.
PARTS = 16
ROW_BYTES = 16
#: Places of equal rows that are numbered at a time.
BLOCK = 4096


def slot_of(key, slots: int = SLOTS):
    """The slot of a row; rows without a key share one."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of the map (version, slot, shard): decided by the shard count alone, slots dealt in
    turn, so that every shard has as many slots as any other, or one more."""
    if not 1 <= shards <= slots:
        raise ValueError("there must be at least one shard, and no more shards than slots")
    return spark.range(slots).select(
        F.lit(1).alias("version"),
        F.col("id").cast("int").alias("slot"),
        F.pmod("id", F.lit(shards)).cast("int").alias("shard"),
    )


def current(slot_map: DataFrame) -> DataFrame:
    """The newest entry of each slot."""
    return (
        slot_map.groupBy("slot")
        .agg(F.max_by("shard", "version").alias("shard"), F.max("version").alias("version"))
        .select("version", "slot", "shard")
    )


def store_edits(edits: DataFrame, path: str) -> None:
    """Append a version to the stored map; earlier versions stay readable."""
    edits.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The stored map as it was at `version`, or as it is now."""
    stored = spark.read.parquet(path).select("version", "slot", "shard")
    return current(stored if version is None else stored.filter(F.col("version") <= version))


def with_shard_added(slot_map: DataFrame) -> DataFrame:
    """The edits that give one more shard its share: from each shard as many of its slots as leave all
    shards level, chosen by a hash of the slot. Only the new shard takes slots; nothing else moves.
    Depends on the map alone, hence on the shard count alone if the map is `first_map`."""
    now = current(slot_map)
    facts = now.agg(
        (F.max("shard") + 1).cast("int").alias("fresh"),
        F.max("version").alias("top"),
        F.count(F.lit(1)).alias("slots"),
    )
    # slots in the order in which they would leave: first one of each shard, then a second of each ...
    spot = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("slot"), "slot"))
    turn = F.row_number().over(Window.orderBy("spot", "shard"))
    return (
        now.withColumn("spot", spot)
        .withColumn("turn", turn)
        .crossJoin(F.broadcast(facts))  # one row
        .filter(F.col("turn") <= F.floor(F.col("slots") / (F.col("fresh") + 1)))
        .select((F.col("top") + 1).alias("version"), "slot", F.col("fresh").alias("shard"))
    )


def slot_bytes(rows: DataFrame) -> DataFrame:
    """rows (slot, size, n): bytes and rows of each slot that has any."""
    return rows.groupBy("slot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows"))


def levelling_edits(slot_map: DataFrame, weights: DataFrame) -> DataFrame:
    """Edits of a rebalancing: each shard above the mean hands over its lightest slots as far as they
    fit into its surplus, and these fill the shards below the mean in order of their lack.

    Surplus and lack are laid side by side as running sums, so a slot's new shard is the one whose
    interval holds the middle of the slot's own. Works on the map (at most SLOTS rows), not on the rows.
    """
    now = current(slot_map).select("slot", "shard")
    weighed = now.join(weights.select("slot", "bytes"), "slot", "left").fillna(0, ["bytes"])
    totals = weighed.groupBy("shard").agg(F.sum("bytes").alias("held"))
    mean = totals.agg(F.avg("held").alias("mean"))
    gaps = totals.crossJoin(F.broadcast(mean)).withColumn("over", F.col("held") - F.col("mean"))  # one row
    lightest = Window.partitionBy("shard").orderBy("bytes", "slot").rowsBetween(Window.unboundedPreceding, 0)
    leaving = (
        weighed.withColumn("given", F.sum("bytes").over(lightest))
        .join(gaps.select("shard", "over"), "shard")
        .filter((F.col("over") > 0) & (F.col("bytes") > 0) & (F.col("given") <= F.col("over")))
    )
    line = Window.orderBy(F.col("bytes").desc(), "slot").rowsBetween(Window.unboundedPreceding, 0)
    leaving = leaving.withColumn("middle", F.sum("bytes").over(line) - F.col("bytes") / 2)
    needs = Window.orderBy("over", "shard").rowsBetween(Window.unboundedPreceding, 0)
    taking = gaps.filter("over < 0").withColumn("upto", F.sum(-F.col("over")).over(needs)).select(
        F.col("shard").alias("to_shard"), "upto", (F.col("upto") + F.col("over")).alias("start")
    )
    top = slot_map.agg((F.max("version") + 1).alias("version"))
    return (
        leaving.join(F.broadcast(taking), (F.col("middle") > F.col("start")) & (F.col("middle") <= F.col("upto")))
        .crossJoin(F.broadcast(top))  # one row
        .select("version", "slot", F.col("to_shard").alias("shard"))
    )


def versions(rows: DataFrame, shards: int, slots: int, path: str) -> DataFrame:
    """Store three versions of the map at `path` and read them back, one row a slot: (virtual_slot, shard,
    grown_shard, level_shard, slot_bytes). Version 1 is `first_map`, version 2 has one more shard, version 3 is
    version 1 levelled by the bytes that `rows` (virtual_slot, size, n) hold in each slot."""
    spark = rows.sparkSession
    weights = slot_bytes(rows.withColumnRenamed("virtual_slot", "slot"))
    base, level = first_map(spark, shards, slots), f"{path}/levelled"
    store_edits(base, f"{path}/grown")
    store_edits(with_shard_added(load_map(spark, f"{path}/grown")), f"{path}/grown")
    store_edits(base, level)
    store_edits(levelling_edits(load_map(spark, level), weights), level)
    read = {"shard": (f"{path}/grown", 1), "grown_shard": (f"{path}/grown", None), "level_shard": (level, None)}
    found = weights.select(F.col("slot"), F.col("bytes").alias("slot_bytes"))
    found = spark.range(slots).select(F.col("id").cast("int").alias("slot")).join(found, "slot", "left").fillna(0)
    for name, (at, version) in read.items():
        found = found.join(load_map(spark, at, version).select("slot", F.col("shard").alias(name)), "slot")
    return found.withColumnRenamed("slot", "virtual_slot")


def shard_rows(docs: DataFrame, shards: int, slots: int = SLOTS, block: int = BLOCK) -> DataFrame:
    """Place `docs` into `shards` shards: (doc_id, size, text_crc32, law, shard, slot, virtual_slot,
    grown_shard, level_shard, slot_bytes).

    The law is `key`: doc_id and the shard count decide the shard. `size` is the text's UTF-8 bytes plus
    16, `slot` the row's place in its shard, gapless from 0 in order of virtual slot, `grown_shard` the
    shard once one more is added. `level_shard` is the shard after a rebalancing by the bytes of the virtual
    slots, `slot_bytes`; it depends on all rows, so the law does not use it. A missing text counts as no bytes,
    a missing doc_id is a key like any other, equal rows take neighbouring places; further columns are left
    behind; an empty table gives no rows.

    Plan: texts become a size and a checksum in the scan. Equal narrow rows are counted before the
    first shuffle, so a row that is repeated without bound arrives as one, and leaves in blocks of places. A slot
    is numbered in PARTS parts, split by the row's content, each a window of its own: one hot doc_id with many
    texts is spread over them. The broadcast table has SLOTS x PARTS rows whatever the input. The map and its
    versions are stored in the shared folder and read from there.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
        )
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns(
            {
                "virtual_slot": slot_of(F.col("doc_id"), slots),
                "part": F.pmod(F.xxhash64("text_crc32", "size"), F.lit(PARTS)).cast("int"),
            }
        )
    )
    mapped = versions(rows, shards, slots, f"{shared_dir(spark).rstrip('/')}/slot-map-{uuid.uuid4().hex}")
    counts = rows.groupBy("virtual_slot", "part").agg(F.sum("n").alias("held"))
    order = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, 0)
    starts = (
        counts.join(F.broadcast(mapped), "virtual_slot")
        .withColumn("first", F.sum("held").over(order) - F.col("held"))
        .drop("held")
    )
    inside = (
        Window.partitionBy("virtual_slot", "part")
        .orderBy("doc_id", "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = rows.withColumn("upto", F.sum("n").over(inside)).join(
        F.broadcast(starts), ["virtual_slot", "part"]
    )
    first, n = F.col("first") + F.col("upto") - F.col("n"), F.col("n")
    # equal rows leave in blocks, so no array is longer than `block`
    blocks = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / block))))
    begin = F.col("block") * block
    return blocks.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(first + begin, first + F.least(begin + block, n) - 1)).alias("slot"),
        "virtual_slot",
        "grown_shard",
        "level_shard",
        "slot_bytes",
    )


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in 40 shards, with the versioned map; see `shard_rows` for missing and repeated rows."""
    return shard_rows(table(spark, sf_dir, "documents"), 40)
