"""What several operators share: reading tables, row schemas, connected components, word splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.lineage import dropped, staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text; a missing text is empty. Further columns are left behind, so
    names in the caller's table can never clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a, b; any order, repeats allowed): (node, component) with the
    smallest node of each component, for every node of an edge.

    Alternating large-star and small-star steps: each node hangs its neighbours on the smallest node
    it knows, which takes about log2(diameter) rounds and never lists the pairs of a component. A
    round shuffles one row per remaining edge twice; a node with very many edges is met by map-side
    minima and by joins that AQE may split. Rounds end when an order-free checksum of the edges stays.
    """
    edges = staged(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    before = None
    while True:
        # large star: every larger neighbour of a node joins the node's smallest neighbour (or itself)
        both = edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionAll(
            edges.select(F.col("lo").alias("n"), F.col("hi").alias("m"))
        )
        least = both.groupBy("n").agg(F.min("m").alias("m0")).select("n", F.least("n", "m0").alias("m0"))
        larger = edges.select(F.col("lo").alias("n"), F.col("hi").alias("m"))
        large = larger.join(least, "n").select(F.col("m").alias("hi"), F.col("m0").alias("lo")).distinct()
        # small star: every smaller neighbour, and the node itself, joins the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m0"))
        small = large.join(low, "hi").select(
            F.explode(F.array(F.struct(F.col("lo").alias("x")), F.struct(F.col("hi").alias("x")))).alias("s"), "m0"
        )
        old = edges
        edges = staged(
            small.select(F.col("s.x").alias("hi"), F.col("m0").alias("lo")).filter("hi <> lo").distinct()
        )
        dropped(old)
        after = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(hi, lo))")).first()
        if after == before:
            break
        before = after
    own = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(own)
