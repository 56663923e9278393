"""Tables of a study on disk: reading with a schema, building once, caching vectors, result documents."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tenura.lineage import dropped, staged

SURVIVAL_SCHEMA = (
    "user_id string, item_id string, duration double, event int, review_text string, "
    "playtime_2weeks double, log_playtime_2weeks double, log_items_count double"
)
SIGNAL_SCHEMA = (
    "sentiment_score double, frustration_level double, technical_issue int, value_complaint int, "
    "engagement_dropped int, positive_signal int"
)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def fingerprint(df: DataFrame) -> dict[str, str]:
    """Row count and an order-independent hash of all rows, in one pass."""
    # strings and xor-free sums of a 64-bit hash in decimal: no overflow at any row count
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).alias("h")
    ).first()
    return {"rows": str(row["n"]), "hash": str(row["h"])}


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
        return True
    except AnalysisException:
        return False


def materialize(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    inputs: DataFrame | None = None,
    refresh: bool = False,
) -> DataFrame:
    """The table at `path`, built if it is absent, on request, or if the input rows changed.

    A table without a matching record of its inputs is rebuilt rather than trusted; without `inputs` it
    is always rebuilt.
    """
    want = fingerprint(inputs) if inputs is not None else {"rows": "", "hash": ""}
    note = f"{path.rstrip('/')}_inputs"
    if inputs is not None and not refresh and _exists(spark, path) and _exists(spark, note):
        if spark.read.parquet(note).select("rows", "hash").first().asDict() == want:
            return spark.read.parquet(path)
    write_table(build(), path)
    write_table(spark.createDataFrame([want], "rows string, hash string"), note)
    return spark.read.parquet(path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a cache, as its manifest lists them."""
    manifest = f"{path.rstrip('/')}/manifest"
    return sorted(r[0] for r in spark.read.parquet(manifest).select("version").distinct().collect()) if _exists(spark, manifest) else []


def read_vectors(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """Everything in the cache, one row for each key and text: (key, text_hash, version, embedding). Of several
    vectors of one text the newest counts. None if there is no complete version."""
    versions = _versions(spark, path)
    if not versions:
        return None
    held = spark.read.parquet(*[f"{path.rstrip('/')}/version-{v}" for v in versions])
    newest = held.groupBy(key, "text_hash").agg(F.max("version").alias("version"))
    return held.join(newest, [key, "text_hash", "version"], "left_semi").dropDuplicates([key, "text_hash"])


def cached_vectors(
    spark: SparkSession, path: str, df: DataFrame, key: str, encode: Callable[[DataFrame], DataFrame], text: str | None = None
) -> DataFrame:
    """Vectors (key, text_hash, version, embedding) of the rows of `df`, encoding only what the cache at `path`
    lacks. `encode` takes rows and returns (key, embedding).

    A vector is found by its key and a hash of the `text` it was made from, so a changed text gets a new vector
    and its old one stays for rows that still have the old text. Each call that encodes anything writes a version
    of its own, and lists it in the manifest once it is complete: a job that died leaves nothing that is read, one
    that is repeated writes the same version again.
    """
    root = path.rstrip("/")
    content = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256) if text else F.lit("")
    wanted = df.withColumn("text_hash", content)
    held = read_vectors(spark, path, key)
    missing = wanted if held is None else wanted.join(held.select(key, "text_hash"), [key, "text_hash"], "left_anti")
    if held is None or not missing.isEmpty():
        version = max(_versions(spark, path), default=-1) + 1
        hashes = missing.select(key, "text_hash").dropDuplicates([key])
        made = encode(missing.drop("text_hash")).select(key, "embedding").join(hashes, key)
        write_table(made.select(key, "text_hash", F.lit(version).alias("version"), "embedding"), f"{root}/version-{version}")
        listed = spark.range(1).select(F.lit(version).alias("version"))
        listed.write.mode("append").parquet(f"{root}/manifest")
        held = read_vectors(spark, path, key)
    return held.join(wanted.select(key, "text_hash").distinct(), [key, "text_hash"], "left_semi")


def write_split(df: DataFrame, path: str, seed: int, fraction: float) -> None:
    """The split assignment with the seed and fraction that made it."""
    write_table(df.withColumns({"holdout_seed": F.lit(seed), "holdout_fraction": F.lit(fraction)}), path)


def select_by_split(df: DataFrame, assignment: DataFrame, keys: Sequence[str], split: str) -> DataFrame:
    """Rows of one side of a saved split."""
    members = assignment.filter(F.col("split") == split).select(*keys)
    return df.join(members, list(keys), "left_semi")


def write_results(tables: dict[str, DataFrame], path: str) -> None:
    """Every result table as Parquet under its name, and all of them as one nested JSON document."""
    for name, table in tables.items():
        write_table(table, f"{path}/{name}")
    document(tables).coalesce(1).write.mode("overwrite").text(f"{path}/document")


def document(tables: dict[str, DataFrame]) -> DataFrame:
    """One row holding the result tables as a nested JSON document; results are a few rows each."""
    result = None
    for name, table in tables.items():
        rows = table.agg(F.collect_list(F.struct(*table.columns)).alias(name))
        result = rows if result is None else result.join(F.broadcast(rows))  # one row each
    return result.select(F.to_json(F.struct(*tables)).alias("value"))


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """A saved result document as one row of nested columns."""
    return spark.read.option("multiLine", True).json(f"{path}/document")


def read_document_dict(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/document").first()[0])


def document_leaves(df: DataFrame, value: str = "value") -> DataFrame:
    """(table, row, path, leaf) of every leaf of JSON documents of unknown depth: `table` is the key at the top,
    `row` the place in its list, `path` the keys and places below, joined by dots, `leaf` the value as text.

    One level is opened a round, until nothing is nested; empty lists and objects have no leaves.
    """
    spark = df.sparkSession
    level = staged(df.select(F.array().cast("array<string>").alias("path"), F.parse_json(value).alias("v")))
    leaves = None
    while True:
        opened = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(
            F.concat("path", F.array(F.coalesce("key", F.col("pos").cast("string")))).alias("path"), F.col("value").alias("v")
        )
        kind = F.schema_of_variant("v")
        opened = staged(opened.withColumn("nested", kind.startswith("OBJECT<") | kind.startswith("ARRAY<")))
        found = opened.filter(~F.col("nested")).select("path", F.try_variant_get("v", "$", "string").alias("leaf"))
        leaves = found if leaves is None else leaves.unionByName(found)
        dropped(level)
        level = staged(opened.filter("nested").select("path", "v"))
        if level.isEmpty():
            break
    return leaves.select(
        F.get("path", F.lit(0)).alias("table"),
        F.get("path", F.lit(1)).cast("int").alias("row"),
        F.array_join(F.slice("path", 3, F.greatest(F.size("path") - 2, F.lit(0))), ".").alias("path"),
        "leaf",
    )
