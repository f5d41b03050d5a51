"""Broadcasts of this package's own objects."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def share(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcasts value; the returned function gives it on an executor.

    The value travels with its classes, as functions do, so that executors need
    not have the package on their path. Callers see to a bound on its size.
    """
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)


def with_types(df: DataFrame, names: list[str], more: str) -> T.StructType:
    """The schema of df's columns `names` as they are (fields of structs may have any name), then that of `more`."""
    return T.StructType([*[T.StructField(n, df.schema[n].dataType) for n in names], *T.StructType.fromDDL(more).fields])
