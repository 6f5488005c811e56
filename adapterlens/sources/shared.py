"""The folder that driver and executors share, and cutting lineage there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where none is named, a local session
    gets one of its own; on a cluster that is an error, since executors would not see it."""
    context = spark.sparkContext
    named, used = spark.conf.get("spark.checkpoint.dir", None), context._jsc.sc().getCheckpointDir()
    if used.isEmpty():
        if not named and not context.master.startswith("local"):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-tables-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Compute `df` once and cut its lineage with a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
