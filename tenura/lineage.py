"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The reliable folder of this session.

    `spark.checkpoint.dir` (or a folder set on the context) always wins. Only a local session
    that names none gets a temporary folder; on a cluster that is an error, because executors on
    other machines could not read it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="tenura-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder, keeping its partitions and the order of rows in them. Reads
    cannot be pruned, so this is for rows whose placement matters; all others are `staged`."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's own setting: the shuffle files of an execution go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Executions inside leave no shuffle files behind: right for those whose result is written."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and continue from a scan of it.

    Unlike a checkpoint the written table is compressed, keeps column pruning, filter pushdown and
    size statistics, and survives the loss of any executor. Row order and partitioning are not
    kept. The folder belongs to the session: it goes with the shared folder, or with `dropped`. The
    shuffle files of the write go at its end.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/staged-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.partitionBy(*partition_by).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._staged_path = path
    return found


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again: not these, nor what was derived from them and is not
    staged itself. Other tables are left alone."""
    for df in tables:
        path = getattr(df, "_staged_path", None)
        if path:
            jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(hadoop).delete(folder, True)
            df._staged_path = None
