"""Small files of a run, written and read through Spark's file systems."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from siftgram.sources.shards import _hadoop


def put(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _hadoop(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def put_json(spark: SparkSession, path: str, value: object) -> None:
    put(spark, path, json.dumps(value, indent=1, sort_keys=True, default=str) + "\n")


def get_json(spark: SparkSession, path: str) -> dict:
    return json.loads(get(spark, path))


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, p = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
