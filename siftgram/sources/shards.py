"""Corpus shards: Parquet and JSON lines (plain, gz, zst) with row numbers, and their sinks."""

from __future__ import annotations

import glob
import hashlib
import os
import urllib.parse
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXTENSIONS = (".parquet", *(f".jsonl{packed}" for packed in ("", ".gz", ".zst")))


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) as Spark sees them, for stores that only Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _plain(path: str) -> str:
    return path[5:] if path.startswith("file:/") and not path.startswith("file://") else path.removeprefix("file://")


def _listed(spark: SparkSession, one: str) -> list[str]:
    fs, p = _hadoop(spark, one)
    found = []
    for status in fs.globStatus(p) or []:
        if not status.isDirectory():
            found.append(status.getPath().toString())
            continue
        files = fs.listFiles(status.getPath(), True)
        while files.hasNext():
            found.append(files.next().getPath().toString())
    return [_plain(f) for f in found if not f.rsplit("/", 1)[-1].startswith(("_", "."))]


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a path, sorted."""
    fs, p = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def collect_files(paths: Iterable[str], spark: SparkSession | None = None) -> list[str]:
    """Directories (recursive), globs and files to a sorted list of distinct shards of known extensions.

    With a session, through the file systems that Spark knows; without, on this machine.
    """
    found: set[str] = set()
    for one in paths:
        if spark is not None:
            names = _listed(spark, one)
        elif os.path.isdir(one):
            names = [str(p) for p in Path(one).rglob("*") if p.is_file()]
        else:
            names = [one] if os.path.isfile(one) else glob.glob(one, recursive=True)
        if not names:
            raise FileNotFoundError(f"no input matches {one!r}")
        found |= {n if "://" in n else os.path.realpath(n) for n in names if n.endswith(EXTENSIONS)}
    if not found:
        raise FileNotFoundError(f"no {', '.join(EXTENSIONS)} among the inputs")
    return sorted(found)


def slug(name: str) -> str:
    """A name as part of a path."""
    return name.strip().replace("/", "__").replace(" ", "-")


SURVEY = "path string, bytes long, sha256 string, codec string, error string"


def survey(spark: SparkSession, files: list[str], digest: bool = True) -> list[dict]:
    """Size, digest, codec and readability of every shard, found out by tasks: the driver reads no shard."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs, parquet

        for batch in batches:
            for path in batch.column(0).to_pylist():
                size, sha, codec, error = None, None, None, None
                try:
                    store, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                    size = store.get_file_info(place).size
                    if path.endswith(".parquet"):
                        about = parquet.ParquetFile(place, filesystem=store).metadata
                        codec = about.row_group(0).column(0).compression.lower() if about.num_row_groups and about.num_columns else "snappy"
                    if digest:
                        total = hashlib.sha256()
                        with store.open_input_stream(place, compression=None) as f:
                            while block := f.read(1 << 20):
                                total.update(block)
                        sha = total.hexdigest()
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"[:500]
                yield pa.RecordBatch.from_pydict({"path": [path], "bytes": pa.array([size], pa.int64()), "sha256": pa.array([sha], pa.string()), "codec": pa.array([codec], pa.string()), "error": pa.array([error], pa.string())})

    rows = spark.createDataFrame([(f,) for f in files], "path string").repartition(min(len(files), 10_000))
    return sorted((r.asDict() for r in rows.mapInArrow(look, SURVEY).collect()), key=lambda r: r["path"])


def stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return next((name[: -len(e)] for e in sorted(EXTENSIONS, key=len, reverse=True) if name.endswith(e)), name)


def read_parquet(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows with `shard` and `row_index` from the reader's own metadata."""
    df = spark.read.parquet(*paths)
    shard = F.url_decode(F.regexp_extract("_metadata.file_path", r"([^/]+)\.parquet$", 1))
    return df.select("*", shard.alias("shard"), F.col("_metadata.row_index").alias("row_index"))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(shard, line_no, row_index, line): raw lines of JSON-lines shards, in one plan; blank lines have no row_index.

    Line numbers are running counts over a file's splits: lines are numbered within a split, and split offsets order
    the splits, whose line counts are summed.
    """
    raw = spark.read.option("lineSep", "\n").text(paths)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("line"), (F.btrim("value", F.lit(" \t\r\n")) == "").alias("b"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, k = None, 0, 0
        for batch in batches:
            files, ats, blank = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            ns, ks = [], []
            for split, b in zip(zip(files, ats, strict=True), blank, strict=True):
                if split != last:
                    last, n, k = split, 0, 0
                ns.append(n)
                ks.append(None if b else k)
                n, k = n + 1, k + (not b)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ns, pa.int64()), pa.array(ks, pa.int64())], names=["file", "at", "line", "n", "k"])

    tagged = raw.mapInArrow(number, "file string, at long, line string, n long, k long")
    sizes = tagged.groupBy("file", "at").agg((F.max("n") + 1).alias("lines"), (F.coalesce(F.max("k"), F.lit(-1)) + 1).alias("rows"))
    order = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("file").alias("file2"), F.col("at").alias("at2"), F.coalesce(F.sum("lines").over(order), F.lit(0)).alias("l0"), F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("r0"))
    out = tagged.join(before, (F.col("file") == F.col("file2")) & (F.col("at") == F.col("at2")))  # one row per split
    name = F.regexp_extract("file", r"([^/]+?)\.jsonl(?:\.gz|\.zst)?$", 1)
    return out.select(F.url_decode(name).alias("shard"), (F.col("n") + F.col("l0")).alias("line_no"), (F.col("k") + F.col("r0")).alias("row_index"), "line")


def read_jsonl(spark: SparkSession, paths: list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of JSON-lines shards with `shard` and `row_index` (among non-blank lines)."""
    use = schema if schema is not None else spark.read.json(paths).schema
    rows = read_lines(spark, paths).where("row_index IS NOT NULL")
    return rows.select(F.from_json("line", use).alias("r"), "shard", "row_index").select("r.*", "shard", "row_index")


def read_shards(spark: SparkSession, inputs: list[str], files: list[str] | None = None) -> DataFrame:
    """All shards of the inputs (or those named) as one DataFrame with shard and row_index."""
    files = files if files is not None else collect_files(inputs, spark)
    check_stems(files)
    parquet = [f for f in files if f.endswith(".parquet")]
    lines = [f for f in files if not f.endswith(".parquet")]
    parts = ([read_parquet(spark, parquet)] if parquet else []) + ([read_jsonl(spark, lines)] if lines else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def check_stems(files: list[str]) -> None:
    stems = [stem(f) for f in files]
    if len(set(stems)) < len(stems):
        raise ValueError("shards share a name; results are kept by shard name")


def by_shard(df: DataFrame):
    """A writer of one folder per shard that leaves other shards' folders as they are: a second run replaces, never adds."""
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard")


def write_records(records: DataFrame, path: str, mode: str = "shards") -> None:
    """Records as JSON lines, a folder per shard; without records nothing stays of an earlier run."""
    body = F.to_json(F.struct(*[c for c in records.columns]), {"ignoreNullFields": "false"})
    rows = records.select("shard", body.alias("value"))
    (by_shard(rows) if mode == "shards" else rows.write.mode("overwrite").partitionBy("shard")).text(path)


def write_hits(hits: DataFrame, path: str) -> None:
    by_shard(hits.sortWithinPartitions("shard", "gram_id")).parquet(path)


def packing(path: str) -> str:
    return "gzip" if path.endswith(".gz") else "zstd" if path.endswith(".zst") else "none"


def rename_parts(spark: SparkSession, folder: str, out: str, names: dict[str, str]) -> list[str]:
    """Moves the one file of each `shard=` folder to out/<its shard's own name>; a shard without rows gets no file."""
    fs, base = _hadoop(spark, folder)
    moved = []
    for status in fs.listStatus(base):
        name = status.getPath().getName()
        if not name.startswith("shard="):
            continue
        shard = urllib.parse.unquote(name.removeprefix("shard="))
        files = [f.getPath() for f in fs.listStatus(status.getPath()) if not f.getPath().getName().startswith(("_", "."))]
        if len(files) != 1:
            raise RuntimeError(f"{len(files)} files for shard {shard}")
        to = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{names[shard]}")
        if not fs.rename(files[0], to):
            raise RuntimeError(f"{names[shard]} could not be put in place")
        moved.append(names[shard])
    fs.delete(base, True)
    return sorted(moved)


def filter_lines(spark: SparkSession, paths: str | list[str], gone: DataFrame | None, to: str) -> None:
    """JSON-lines shards without the rows in gone (shard, row_index), a folder `shard=` with one file each; other lines stay byte
    for byte, blank ones too. All paths have one compression."""
    paths = [paths] if isinstance(paths, str) else paths
    rows = read_lines(spark, paths)
    kept = rows
    if gone is not None:
        on = [c for c in ("shard", "row_index") if c in gone.columns]
        kept = rows.join(gone.select(*on).distinct(), on, "left_anti")  # blank lines have no row_index and stay
    # a shard is one file, as it came: its lines meet in one task
    kept = kept.repartition("shard").sortWithinPartitions("shard", "line_no").select("shard", "line")
    kept.write.mode("overwrite").partitionBy("shard").option("compression", packing(paths[0])).option("lineSep", "\n").text(to)


def to_parquet_shards(df: DataFrame, path: str, max_rows: int, split: str = "split") -> list[str]:
    """A split as Parquet shards of at most max_rows rows, `<split>-00000-of-N.parquet`."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("maxRecordsPerFile", max_rows).parquet(f"{path}/_parts")
    fs, base = _hadoop(spark, f"{path}/_parts")
    files = sorted((f.getPath() for f in fs.listStatus(base) if f.getPath().getName().endswith(".parquet")), key=lambda p: p.getName())
    names = [f"{slug(split)}-{i:05d}-of-{len(files):05d}.parquet" for i in range(len(files))]
    for f, n in zip(files, names, strict=True):
        fs.rename(f, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}"))
    fs.delete(base, True)
    return names


def finished(summaries: DataFrame, shards: list[str], fingerprint: str) -> list[str]:
    """Shards that still have to be scanned: those without a summary of the same fingerprint."""
    done = {r["shard"] for r in summaries.where(F.col("fingerprint") == fingerprint).where(F.col("error").isNull()).select("shard").distinct().collect()}
    return [s for s in shards if s not in done]
