"""What the operators of this subpackage have in common on the driver's side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftgram.functions.scratch import materialised, scratch, shared_dir
from siftgram.functions.sharing import with_types

__all__ = ["materialised", "released", "scratch", "shared_dir", "table", "with_types"]


def released(df: DataFrame) -> None:
    """Lets Spark's cleaner drop shuffle files that no live DataFrame needs: it works when the driver's garbage is collected."""
    import gc

    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
