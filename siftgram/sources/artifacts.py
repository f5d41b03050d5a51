"""Artifacts beside an index: stop-grams and spaced seeds with their meta data, and a binary table of hashes for exchange."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgram.config import Normalization, ScanConfig
from siftgram.functions.text import blake64
from siftgram.operators import spaced
from siftgram.operators.index import Index, check_meta, masks, read_meta, write_meta

# stop-grams


def save_stopgrams(grams: DataFrame, path: str, n: int, norm: Normalization | None = None, **about) -> None:
    """(gram, df) and a meta table with n and the normalization."""
    norm = norm or Normalization()
    grams.select("gram", "df", blake64("gram").alias("hash")).write.mode("overwrite").parquet(f"{path}/grams")
    write_meta(grams.sparkSession, f"{path}/meta", {"version": 1, "ngram": n, "normalization": norm.fingerprint(), **about})


def load_stopgrams(spark: SparkSession, path: str, n: int, norm: Normalization | None = None) -> DataFrame:
    check_meta(read_meta(spark, f"{path}/meta"), n, norm or Normalization(), "the table of stop-grams")
    return spark.read.parquet(f"{path}/grams").select("gram", "df")


# spaced seeds


def save_spaced(index: Index, path: str, cfg: ScanConfig, family: spaced.SeedFamily = spaced.FAMILY, class_map: str = "none") -> None:
    """(seed, item_idx, item_pos), (item_idx, item_toks) and a meta table. Scans match classes of tokens only where they verify tokens."""
    if class_map != "none":
        raise ValueError("artifacts hold seeds of plain tokens")
    posts, items = spaced.seed_postings(index, family)
    posts.write.mode("overwrite").parquet(f"{path}/seeds")
    items.write.mode("overwrite").parquet(f"{path}/tokens")
    meta = {
        "version": 1, "ngram": index.ngram, "normalization": index.normalization.fingerprint(), "index": index.fingerprint(), "patterns": list(family.patterns),
        "class_map": class_map, "min_loci": cfg.spaced_min_loci, "ver_min_span": cfg.spaced_ver_min_span, "ver_identity": cfg.spaced_ver_identity,
    }
    write_meta(index.items.sparkSession, f"{path}/meta", meta)


def check_spaced(spark: SparkSession, path: str, index: Index, cfg: ScanConfig) -> spaced.SeedFamily:
    """The seeds' family, if the artifact fits the index; its thresholds are those of the scan or an error."""
    meta = read_meta(spark, f"{path}/meta")
    check_meta(meta, cfg.ngram, index.normalization, "the table of seeds")
    if meta["index"] != index.fingerprint():
        raise ValueError("the table of seeds was built from another index")
    mine = {"min_loci": cfg.spaced_min_loci, "ver_min_span": cfg.spaced_ver_min_span, "ver_identity": cfg.spaced_ver_identity}
    other = [k for k, v in mine.items() if meta[k] != v]
    if other:
        raise ValueError(f"the table of seeds has another {', '.join(other)}")
    return spaced.SeedFamily(tuple(meta["patterns"]), cfg.ngram if cfg.ngram < min(map(len, meta["patterns"])) else 13)


def load_spaced(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(seed postings, item tokens)."""
    return spark.read.parquet(f"{path}/seeds"), spark.read.parquet(f"{path}/tokens")


# binary exchange: a header of 36 bytes, then (hash, mask) pairs of unsigned 64-bit numbers in the order of hashes

MAGIC = b"SIFTGRAM"
_HEADER = struct.Struct("<8sIIIIIQ")
_BYTE_ORDER = 0x01020304
HASHES, MASKS = 1, 2


def write_header(out: BinaryIO, kind: int, ngram: int, count: int) -> None:
    out.write(_HEADER.pack(MAGIC, kind, 1, _BYTE_ORDER, ngram, 0, count))


def read_header(source: BinaryIO, kind: int) -> tuple[int, int] | None:
    """(n, records), or None where the file has no header; another kind, version or byte order is an error."""
    start = source.tell()
    raw = source.read(_HEADER.size)
    if len(raw) < _HEADER.size or not raw.startswith(MAGIC):
        source.seek(start)
        return None
    _, found, version, order, ngram, _, count = _HEADER.unpack(raw)
    if order != _BYTE_ORDER:
        raise ValueError("the file has another byte order")
    if (found, version) != (kind, 1):
        raise ValueError(f"the file is of kind {found}, version {version}")
    return ngram, count


def export_masks(index: Index, path: str) -> int:
    """Writes the index's hashes and masks for exchange, streamed through the driver in the order of hashes."""
    rows = masks(index).select("hash", "mask").orderBy("hash")
    count = rows.count()
    with open(path, "wb") as out:
        write_header(out, MASKS, index.ngram, count)
        for r in rows.toLocalIterator(prefetchPartitions=True):
            out.write(struct.pack("<Qq", int(r["hash"]), r["mask"]))
    return count


def import_masks(path: str) -> Iterator[tuple[int, int]]:
    """(hash, mask) pairs; a file that is cut short or not in order is an error."""
    with open(path, "rb") as source:
        head = read_header(source, MASKS)
        if head is None:
            raise ValueError("the file has no header")
        last = -1
        for _ in range(head[1]):
            raw = source.read(16)
            if len(raw) < 16:
                raise ValueError("the file is cut short")
            h, mask = struct.unpack("<Qq", raw)
            if h <= last:
                raise ValueError("hashes are not in order")
            last = h
            yield h, mask
        if source.read(1):
            raise ValueError("the file goes on after its records")


def stopgram_hashes(grams: DataFrame) -> DataFrame:
    """(hash) of stop-grams, sorted, as other tools exchange them."""
    return grams.select(blake64("gram").alias("hash")).distinct().orderBy(F.col("hash"))
