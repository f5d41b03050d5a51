"""The split between learning and held-out documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(key: Column, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo folds, is 0; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == 0


def order(key: Column) -> Column:
    """A pseudo-random order that samples are taken in; reruns agree."""
    return F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit("sample"))
