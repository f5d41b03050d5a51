"""The index: protected items, postings of n-grams to items and fields, statistics."""

from __future__ import annotations

import hashlib
import json
import warnings
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftgram.config import FIELD_SEPARATOR, BenchmarkSpec, ItemStopGrams, Normalization
from siftgram.functions import kernels as K
from siftgram.functions.scratch import materialised
from siftgram.functions.text import blake64, missing_label, reject_pattern, rejected, tokens, unsigned, windows
from siftgram.sources.shards import collect_files, folders, read_jsonl


class EmptyBenchmarkError(ValueError):
    """A benchmark without rows or without n-grams."""


@dataclass(frozen=True)
class Index:
    """items: item_idx, benchmark, item_id, fields (array<array<string>>), field_names (or null), n_grams.
    postings: gram, gram_id (a 64-bit hash of it, as kernels compute it), item_idx, benchmark, field_idx, fan_out (items that hold the gram)."""

    items: DataFrame
    postings: DataFrame
    ngram: int
    normalization: Normalization

    @property
    def grams(self) -> DataFrame:
        return self.postings.select("gram").distinct()

    @cached_property
    def sizes(self) -> tuple[int, int]:
        """(posting rows, items), counted once: what may be broadcast goes by them."""
        return self.postings.count(), self.items.count()

    @cached_property
    def names(self) -> list[str]:
        """Benchmarks in the order of their names, which numbers them."""
        return [r["benchmark"] for r in self.items.select("benchmark").distinct().orderBy("benchmark").collect()]

    @cached_property
    def shared(self) -> dict:
        """Broadcasts made for scans of this index, by what they hold."""
        return {}

    def save(self, path: str, about: dict | None = None) -> dict:
        """Tables as Parquet (items, postings with hashes for exchange, benchmarks) and, last of all, a meta table."""
        self.items.write.mode("overwrite").parquet(f"{path}/items")
        self.postings.withColumn("hash", blake64("gram")).write.mode("overwrite").parquet(f"{path}/postings")
        stats(self).coalesce(1).write.mode("overwrite").parquet(f"{path}/benchmarks")
        meta = {"version": 3, "ngram": self.ngram, "normalization": self.normalization.fingerprint(), "normalization_sha256": self.normalization.sha256(), "benchmarks": self.names}
        meta |= {"content": self.fingerprint()} | (about or {})
        write_meta(self.items.sparkSession, f"{path}/meta", meta)
        return meta

    def fingerprint(self) -> str:
        """Of what the index holds: a sum of hashes of its postings and items, whatever their order."""
        wide = lambda df, *c: df.agg(F.sum(F.xxhash64(*c).cast("decimal(38,0)")), F.count("*")).first()
        body = [self.ngram, self.normalization.fingerprint(), *map(str, wide(self.postings, "gram", "item_idx", "field_idx")), *map(str, wide(self.items, "item_idx", "item_id"))]
        return hashlib.sha256(json.dumps(body).encode()).hexdigest()

    @classmethod
    def load(cls, spark: SparkSession, path: str, ngram: int, normalization: Normalization | None = None) -> Index:
        norm = normalization or Normalization()
        check_meta(read_meta(spark, f"{path}/meta"), ngram, norm, "the index")
        return cls(spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/postings").drop("hash"), ngram, norm)


def write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def check_meta(meta: dict, ngram: int, norm: Normalization, what: str) -> None:
    """Artifacts have to agree with the scan in n and normalization."""
    if meta["ngram"] != ngram:
        raise ValueError(f"{what} has n = {meta['ngram']}, the scan {ngram}")
    if meta["normalization"] != norm.fingerprint():
        raise ValueError(f"{what} was built with another normalization")


def hash_grams(column: pa.Array, pows: K.Powers) -> np.ndarray:
    """Hashes of n-gram strings (words between single spaces), as kernels compute them from texts."""
    data, offs = K.buffers(column)
    n, counts = len(data), np.zeros(len(offs) - 1, np.int64)
    out = np.zeros(len(offs) - 1, np.uint64)
    if not n:
        return out
    stop = np.zeros(n + 1, bool)
    stop[:-1] = data == 32
    stop[offs[1:]] = True  # a text's end
    filled = offs[1:] > offs[:-1]
    ends = np.flatnonzero(stop)
    ends = ends[ends > 0]
    begin = np.zeros(n + 1, bool)
    begin[:-1][offs[:-1][filled]] = True
    begin[1:][data == 32] = True
    starts = np.flatnonzero(begin[:-1])
    ends = ends[: len(starts)]
    a, b = pows.upto(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(K.VALUE[data] * a[:n], out=sums[1:])
        words = K.mix64((sums[ends] - sums[starts]) * b[starts])
        first = np.searchsorted(starts, offs)
        counts = np.diff(first)
        for size in np.unique(counts[counts > 0]):
            rows = np.flatnonzero(counts == size)
            h = words[first[rows]].copy()
            for j in range(1, size):
                h = h * K.MULTIPLIER + words[first[rows] + j]
            out[rows] = K.mix64(h)
    return out


@F.pandas_udf(T.LongType())
def gram_id(s: pd.Series) -> pd.Series:
    column = pa.array(s, pa.large_string())
    if not len(s):
        return pd.Series([], dtype="int64")
    return pd.Series(hash_grams(column, K.Powers()).view(np.int64))


@dataclass(frozen=True)
class SplitStatus:
    """What became of one (config, split) of a benchmark."""

    benchmark: str
    config: str | None
    split: str
    path: str
    rows: int | None
    error: str | None


def split_paths(spark: SparkSession, spec: BenchmarkSpec) -> list[tuple[str | None, str, str]]:
    """(config, split, path): configs `*` are the folders below the path; `all` goes where others make it up."""
    if spec.data_files:
        return [(None, spec.splits[0], f"{spec.path.rstrip('/')}/{f}") for f in spec.data_files]
    if not spec.configs:
        return [(None, spec.splits[0], spec.path)]
    configs = list(spec.configs)
    if configs == ["*"]:
        configs = folders(spark, spec.path)
        if len(configs) > 1 and "all" in configs:
            configs.remove("all")
    configs = [c for c in configs if c not in spec.drop_configs]
    return [(c, split, f"{spec.path.rstrip('/')}/{c}/{split}*") for c in configs for split in spec.splits]


def _table(spark: SparkSession, spec: BenchmarkSpec, path: str) -> DataFrame:
    """A split's rows with `__file` and `__at`, which don't depend on how files are split."""
    if spec.format == "parquet":
        return spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    if spec.format == "jsonl":
        return read_jsonl(spark, collect_files([path], spark)).withColumnRenamed("shard", "__file").withColumnRenamed("row_index", "__at")
    # a file of several lines a record is one split, in its order
    df = spark.read.option("header", True).option("multiLine", True).format(spec.format).load(path)
    return df.select("*", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__at"))


def load_benchmark(spark: SparkSession, spec: BenchmarkSpec, path: str | None = None, status: list[SplitStatus] | None = None) -> DataFrame:
    """A benchmark's rows as (benchmark, ord, fields, field_names); nested values are flattened to texts.

    Splits that can't be read are noted in `status`; when none can, or no list is given, that is an error.
    """
    out, failed = None, None
    splits = [(None, spec.splits[0], path)] if path else split_paths(spark, spec)
    for at, (config, split, place) in enumerate(splits):
        try:
            df = _table(spark, spec, place)
            missing = [f for f in spec.fields if f not in df.columns]
            if missing:
                raise ValueError(f"{spec.name}: no field {', '.join(missing)}; there are {[c for c in df.columns if not c.startswith('__')]}")
            if spec.label_field and spec.label_field in df.columns and df.where(~missing_label(F.col(f"`{spec.label_field}`"))).isEmpty():
                warnings.warn(f"{spec.name}: all labels of {split} are missing: it is hardly the split that is scored", stacklevel=2)
            one = df.select(F.lit(at).alias("__split"), "__file", "__at", F.array(*[field_value(df, f) for f in spec.fields]).alias("fields"))
            if status is not None:
                status.append(SplitStatus(spec.name, config, split, place, one.count(), None))
        except Exception as e:
            if status is None:
                raise
            status.append(SplitStatus(spec.name, config, split, place, None, f"{type(e).__name__}: {e}"[:500]))
            failed = e
            continue
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError(f"{spec.name}: no split could be read") from failed
    # one row per protected item, which is what a benchmark's size bounds
    order = F.row_number().over(Window.orderBy("__split", "__file", "__at")) - 1
    names = F.array(*[F.lit(f) for f in spec.fields])
    return out.select(F.lit(spec.name).alias("benchmark"), order.cast("long").alias("ord"), "fields", names.alias("field_names"))


def check_revisions(specs: list[BenchmarkSpec], allow_unpinned: bool = False, most: int = 64) -> None:
    """Benchmarks that name a dataset have to pin its revision; masks hold `most` benchmarks."""
    loose = [s.name for s in specs if s.dataset and not s.revision]
    if loose and not allow_unpinned:
        raise ValueError(f"no revision: {', '.join(loose)}")
    names = [s.name for s in specs]
    if len(set(names)) < len(names):
        raise ValueError("benchmarks share a name")
    if len(names) > most:
        raise ValueError(f"{len(names)} benchmarks; an index holds {most} at most")


def field_value(df: DataFrame, name: str):
    """A field as array<string>: stripped text chunks; of structs the `text`, else `labels`, else all in key order."""
    from pyspark.sql import types as T

    def chunks(col, kind):
        if isinstance(kind, T.StringType):
            return F.array(F.btrim(F.coalesce(col, F.lit(""))))
        if isinstance(kind, T.ArrayType):
            inner = F.flatten(F.transform(F.coalesce(col, F.array().cast(kind)), lambda x: chunks(x, kind.elementType)))
            return inner
        if isinstance(kind, T.MapType):
            return chunks(F.map_values(col), T.ArrayType(kind.valueType))
        if isinstance(kind, T.StructType):
            named = {f.name: f.dataType for f in kind}
            use = ["text"] if "text" in named else ["labels"] if "labels" in named else sorted(named)
            return F.concat(*[chunks(col[n], named[n]) for n in use])
        return F.when(col.isNull(), F.array().cast("array<string>")).otherwise(F.array(col.cast("string")))

    return F.filter(chunks(F.col(f"`{name}`"), df.schema[name].dataType), lambda x: x != "")


def item_text(fields) -> F.Column:
    """Fields joined by the separator that no window crosses, empty ones dropped."""
    texts = F.transform(fields, lambda f: F.array_join(f, " "))
    return F.array_join(F.filter(texts, lambda x: x != ""), f" {FIELD_SEPARATOR} ")


def _field_grams(items: DataFrame, n: int, norm: Normalization) -> DataFrame:
    """(…, field_idx, gram): windows of every field by itself."""
    keep = [c for c in items.columns if c != "fields"]
    fields = items.select(*keep, F.posexplode("fields").alias("field_idx", "value"))
    toks = fields.select(*keep, "field_idx", tokens(F.array_join("value", " "), norm).alias("toks"))
    return toks.select(*keep, "field_idx", F.explode(windows(F.col("toks"), n)["gram"]).alias("gram"))


def build_index(
    benchmarks: DataFrame, n: int = 13, normalization: Normalization | None = None, subtract: DataFrame | None = None,
    item_stopgrams: ItemStopGrams | None = None, benchmark_order: list[str] | None = None,
) -> Index:
    """benchmarks: (benchmark, ord, fields array<array<string>>). Items are numbered over all benchmarks.

    subtract: (benchmark, text) of splits whose n-grams are removed from their own benchmark only.
    """
    norm = normalization or Normalization()
    rank = F.col("benchmark")
    if benchmark_order:
        rank = F.array_position(F.array(*[F.lit(b) for b in benchmark_order]), F.col("benchmark"))
    # one row per protected item, which is what a benchmark's size bounds
    items = benchmarks.withColumn("item_idx", (F.row_number().over(Window.orderBy(rank, "ord")) - 1).cast("int"))
    names = F.col("field_names") if "field_names" in benchmarks.columns else F.lit(None)
    items = items.select("item_idx", "benchmark", F.concat("benchmark", F.lit("#"), F.col("ord").cast("string")).alias("item_id"), "fields", names.cast("array<string>").alias("field_names"))
    grams = _field_grams(items.select("item_idx", "benchmark", "fields"), n, norm).where(~rejected(F.col("gram"), norm)).distinct()
    if subtract is not None:
        toks = subtract.select("benchmark", tokens(F.col("text"), norm).alias("toks"))
        gone = toks.select("benchmark", F.explode(windows(F.col("toks"), n)["gram"]).alias("gram")).distinct()
        grams = grams.join(gone, ["benchmark", "gram"], "left_anti")
    holders = grams.select("gram", "item_idx").distinct().groupBy("gram").agg(F.count("*").alias("fan_out"))
    if item_stopgrams is not None:
        n_items = items.count()
        common = (F.col("fan_out") > item_stopgrams.max_item_share * n_items) & (F.col("fan_out") >= item_stopgrams.min_count)
        holders = holders.where(~common)
    postings = grams.join(holders, "gram").select("gram", gram_id("gram").alias("gram_id"), "item_idx", "benchmark", "field_idx", "fan_out")
    sizes = postings.groupBy("item_idx").agg(F.count_distinct("gram").alias("n_grams"))
    items = items.join(sizes, "item_idx", "left").na.fill(0, ["n_grams"])
    return Index(items, postings, n, norm)


def cached(index: Index) -> Index:
    """The index with its tables written: it is used by every branch of a scan."""
    return replace(index, items=materialised(index.items, "items"), postings=materialised(index.postings, "postings"))


def check_not_empty(index: Index, allow: bool = False) -> list[str]:
    """Names of benchmarks without n-grams; an error unless allowed."""
    rows = index.items.groupBy("benchmark").agg(F.sum("n_grams").alias("n")).where("n = 0").orderBy("benchmark").collect()
    empty = [r["benchmark"] for r in rows]
    if not allow and (empty or index.items.isEmpty()):
        raise EmptyBenchmarkError(f"no n-grams: {', '.join(empty) or 'no items'}")
    return empty


def stats(index: Index, min_hits: int = 3) -> DataFrame:
    """Per benchmark: items, distinct n-grams, items without n-grams, items below min_hits."""
    grams = index.postings.groupBy("benchmark").agg(F.count_distinct("gram").alias("n_ngrams"))
    items = index.items.groupBy("benchmark").agg(
        F.count("*").alias("n_items"), F.count_if(F.col("n_grams") == 0).alias("n_empty"), F.count_if(F.col("n_grams") < min_hits).alias("n_short")
    )
    return items.join(grams, "benchmark", "left").na.fill(0, ["n_ngrams"])


def reject_stats(items: DataFrame, n: int, norm: Normalization | None = None) -> DataFrame:
    """(pattern_idx, n): candidate windows by the pattern that rejects them; null: retained."""
    norm = norm or Normalization()
    if not norm.is_default:
        return _field_grams(items, n, norm).groupBy(reject_pattern(F.col("gram"), norm).alias("pattern_idx")).agg(F.count("*").alias("n"))
    from siftgram.operators.matching import reject_counts

    texts = items.select(F.explode("fields").alias("value")).select(F.array_join("value", " ").alias("text"))
    got = reject_counts(texts, n, norm)
    # a generator's input is computed for every row: texts that the kernel handed on are exploded, counts are one row each
    handed = F.transform(windows(tokens(F.col("text"), replace(norm, nfkc=False)), n)["gram"], lambda g: F.struct(reject_pattern(g, norm).alias("pattern_idx"), F.lit(1).cast("long").alias("n")))
    rows = F.when(F.col("text").isNotNull(), handed).otherwise(F.array(F.struct("pattern_idx", "n")))
    return got.select(F.explode(rows).alias("r")).groupBy("r.pattern_idx").agg(F.sum("r.n").alias("n"))


def top_rejected(items: DataFrame, n: int, norm: Normalization | None = None, k: int = 10) -> DataFrame:
    """(pattern_idx, n): the k patterns that reject most windows."""
    return reject_stats(items, n, norm).where("pattern_idx IS NOT NULL").orderBy(F.desc("n"), "pattern_idx").limit(k)


def source_ids(mask) -> F.Column:
    """The numbers of the benchmarks in a mask, ascending."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.getbit(mask, i) == 1, i)), lambda i: i.isNotNull())


def masks(index: Index) -> DataFrame:
    """(gram, hash, mask): a bit per benchmark, numbered by name, 64 at most."""
    names = index.names
    if len(names) > 64:
        raise ValueError("masks hold 64 benchmarks at most")
    at = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("benchmark")) - 1
    bits = index.postings.select("gram", at.cast("int").alias("at")).select("gram", F.expr("shiftleft(1L, at)").alias("bit"))
    out = bits.groupBy("gram").agg(F.bit_or("bit").alias("mask"))
    return out.withColumn("hash", unsigned(blake64("gram")))


def hidden_labels(rows: DataFrame, group: list[str], label: str) -> DataFrame:
    """group, hidden: whether every label of a split is missing."""
    return rows.groupBy(*group).agg(F.bool_and(missing_label(F.col(label))).alias("hidden"))


def numbered_postings(index: Index) -> DataFrame:
    """Postings with the gram_id that matching returns."""
    return index.postings
