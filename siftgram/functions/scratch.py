"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the setting is missing, as in unit tests, a folder of this
    machine is used; a cluster has to name one that every node sees.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    context_dir = spark.sparkContext.getCheckpointDir()
    if not got:
        if context_dir is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siftgram-"))
            context_dir = spark.sparkContext.getCheckpointDir()
        got = context_dir
    elif context_dir is None:
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/siftgram-{what}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read again: short lineage, no recomputation."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
