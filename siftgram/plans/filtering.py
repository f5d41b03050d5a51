"""Cleaned data: whole records or only the contaminated parts removed."""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftgram.config import ScanConfig
from siftgram.functions.scratch import materialised
from siftgram.operators.index import Index
from siftgram.operators.index import stats as index_stats
from siftgram.operators.segments import with_rows
from siftgram.plans.scan import ROW, ScanResult, row_benchmarks, scan
from siftgram.sources import files as small
from siftgram.sources import shards


def flags(result: ScanResult) -> DataFrame:
    """(shard, row_index, marks): per contaminated row a map `field_ord/turn` -> flagged parts."""
    each = result.flagged.groupBy("shard", "row_index", F.concat_ws("/", "field_ord", "turn").alias("at")).agg(F.sort_array(F.collect_set("part")).alias("parts"))
    return each.groupBy("shard", "row_index").agg(F.map_from_entries(F.collect_list(F.struct("at", "parts"))).alias("marks"))


def filter_records(df: DataFrame, result: ScanResult, shard: str | None = None, row_index: str | None = None) -> DataFrame:
    """df without contaminated rows; schema and order of columns stay."""
    gone = result.flagged.select("shard", "row_index").distinct()
    rows = with_rows(df, shard, row_index)
    out = rows.join(gone, rows["__shard"].eqNullSafe(gone["shard"]) & rows["__row"].eqNullSafe(gone["row_index"]), "left_anti")
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def _without(text: Column, parts: Column, cfg: ScanConfig) -> Column:
    if cfg.packed_doc_sep is None:
        return F.lit("")
    body = F.replace(text, F.lit(cfg.packed_doc_sep_typo), F.lit(cfg.packed_doc_sep)) if cfg.packed_doc_sep_typo else text
    kept = F.filter(F.split(body, r"\Q" + cfg.packed_doc_sep + r"\E", -1), lambda x, i: ~F.array_contains(parts, i))
    return F.array_join(kept, cfg.packed_doc_sep)


def filter_parts(df: DataFrame, result: ScanResult, shard: str | None = None, row_index: str | None = None) -> DataFrame:
    """df with contaminated parts cut out: emptied texts become "", emptied turns go, rows without any text go."""
    cfg, marks = result.cfg, flags(result).withColumnRenamed("shard", "__s").withColumnRenamed("row_index", "__r")
    rows = with_rows(df, shard, row_index)
    rows = rows.join(marks, rows["__shard"].eqNullSafe(marks["__s"]) & rows["__row"].eqNullSafe(marks["__r"]), "left")
    at = lambda ord_, turn: F.get(F.array(F.element_at("marks", F.concat(F.lit(f"{ord_}/"), turn))), F.lit(0))
    out, any_text = rows, F.lit(False)
    for i, k in enumerate(cfg.text_keys):
        parts = at(i, F.lit("-1"))
        out = out.withColumn(k, F.when(F.col("marks").isNotNull() & parts.isNotNull() & F.col(f"`{k}`").isNotNull(), _without(F.col(f"`{k}`"), parts, cfg)).otherwise(F.col(f"`{k}`")))
        any_text = any_text | (F.coalesce(F.btrim(F.col(f"`{k}`")), F.lit("")) != "")
    if cfg.messages_key:
        m, ord_ = cfg.messages_key, len(cfg.text_keys)
        turns = F.transform(F.col(m), lambda x, i: F.struct(x.alias("m"), i.cast("string").alias("i")))
        cut = F.transform(turns, lambda t: F.when(at(ord_, t["i"]).isNotNull() & t["m"]["content"].isNotNull(), t["m"].withField("content", _without(t["m"]["content"], at(ord_, t["i"]), cfg))).otherwise(t["m"]))
        both = F.zip_with(cut, turns, lambda c, t: F.struct(c.alias("c"), at(ord_, t["i"]).isNotNull().alias("hit")))
        kept = F.transform(F.filter(both, lambda x: ~(x["hit"] & (F.btrim(F.coalesce(x["c"]["content"], F.lit(""))) == ""))), lambda x: x["c"])
        out = out.withColumn(m, F.when(F.col("marks").isNotNull(), kept).otherwise(F.col(m)))
        any_text = any_text | F.exists(F.coalesce(F.col(m), F.array().cast(df.schema[m].dataType)), lambda x: F.btrim(F.coalesce(x["content"], F.lit(""))) != "")
    out = out.where(F.col("marks").isNull() | any_text)
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def removals(result: ScanResult, index: Index | None = None) -> DataFrame:
    """benchmark, rows: contaminated rows by benchmark, by n-grams or by items that other channels found, a row once for
    each; null: all rows."""
    key = ["shard", "row_index"]
    by = row_benchmarks(result).select(*key, F.explode("benchmarks").alias("benchmark")).distinct()
    per = by.groupBy("benchmark").agg(F.count("*").alias("rows"))
    total = result.flagged.select(*key).distinct().agg(F.count("*").alias("rows")).select(F.lit(None).cast("string").alias("benchmark"), "rows")
    return per.unionByName(total)


def removals_by(result: ScanResult, what: str) -> DataFrame:
    """(channel or shard, rows, parts): contaminated rows and sub-documents, by channel (one may count in several) or by shard."""
    value = F.explode("channels").alias("channel") if what == "channel" else F.col("shard")
    each = result.flagged.select(F.struct("shard", "row_index").alias("row"), *[c for c in ROW if c not in ("shard", "row_index")], value)
    return each.groupBy(what).agg(F.count_distinct("row").alias("rows"), F.count("*").alias("parts"))


def removed_ids(result: ScanResult) -> DataFrame:
    """shard, row_index, id, channels, benchmarks of every contaminated row."""
    rows = row_benchmarks(result).groupBy("shard", "row_index").agg(
        F.first("id").alias("id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("channels")))).alias("channels"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("benchmarks")))).alias("benchmarks"),
    )
    return rows


def check_consistent(result: ScanResult) -> None:
    """A filter needs an uncapped scan whose rows are known."""
    if result.cfg.max_return_records:
        raise ValueError("filtering needs max_return_records = 0")
    if not result.flagged.where("row_index is null").isEmpty():
        raise ValueError("flagged records without row_index")


def dataset_card(removed: DataFrame, stats: DataFrame | None = None, settings: dict | None = None) -> str:
    """Rows removed by benchmark, with what the index holds of each where it is given; a benchmark's counts stand once."""
    rows = removed.orderBy(F.col("benchmark").asc_nulls_first()).collect()
    lines = ["| benchmark | rows removed |", "|:-|:-|"]
    if stats is None:
        lines += [f"| {r['benchmark'] or 'all'} | {r['rows']} |" for r in rows]
    else:
        gone = {r["benchmark"]: r["rows"] for r in rows}
        lines = [f"Rows removed: {gone.get(None, 0)}", "", "| benchmark | items | n-grams | rows removed |", "|:-|-:|-:|-:|"]
        # stats may have several rows for a benchmark's splits: the first of them carries the counts
        order = Window.partitionBy("benchmark").orderBy("n_items")
        for r in stats.withColumn("turn", F.row_number().over(order)).orderBy("benchmark", "turn").collect():
            first = r["turn"] == 1
            lines.append(f"| {r['benchmark']} | {r['n_items'] if first else '-'} | {r['n_ngrams'] if first else '-'} | {gone.get(r['benchmark'], 0) if first else '-'} |")
    if settings:
        lines += ["", "A row counts for every benchmark that its flagged text matches.", "", "Settings: " + ", ".join(f"{k} = {v}" for k, v in sorted(settings.items()) if v not in (None, False, ""))]
    return "\n".join(lines) + "\n"


RESERVED = ("removed_ids", "card.md", "filter_manifest.json", "_scan")


def plan_filter(spark: SparkSession, inputs: list[str], out: str, overwrite: bool = False) -> dict[str, str]:
    """input file -> name of the cleaned file. Nothing may be lost: an error where inputs and outputs overlap, names collide
    or the folder holds other files."""
    files = shards.collect_files(inputs, spark)
    shards.check_stems(files)
    place = lambda p: os.path.realpath(p) if "://" not in p else p.rstrip("/")
    target = place(out)
    for one in inputs:
        if target == place(one) or target.startswith(place(one) + "/"):
            raise ValueError(f"{out} lies inside the input {one}")
    for f in files:
        if f.startswith(target + "/"):
            raise ValueError(f"the input {f} lies inside {out}")
    names = {f: f.rsplit("/", 1)[-1] for f in files}
    taken = sorted(set(names.values()) & set(RESERVED))
    if taken:
        raise ValueError(f"reserved names: {', '.join(taken)}")
    there = small.names_in(spark, out)
    if there and not overwrite:
        raise ValueError(f"{out} is not empty; --overwrite replaces an earlier filter's files")
    if there:
        if "filter_manifest.json" not in there:
            raise ValueError(f"{out} holds files that no filter wrote")
        known = set(small.get_json(spark, f"{out}/filter_manifest.json")["files"]) | set(RESERVED)
        strange = [n for n in there if n not in known and not n.startswith(".")]
        if strange:
            raise ValueError(f"{out} holds {', '.join(strange[:5])}, which no filter wrote")
        for n in there:
            small.remove(spark, f"{out}/{n}")
    return names


def write_filtered(
    spark: SparkSession, inputs: list[str], out: str, index: Index, cfg: ScanConfig, granularity: str = "record",
    stopgrams: DataFrame | None = None, overwrite: bool = False,
) -> dict:
    """Scans without a cap and writes every shard under its own name, less what is contaminated; also removed_ids, a card
    and a manifest. JSON lines that stay are byte for byte what they were, if whole records go."""
    if granularity not in ("record", "subdoc"):
        raise ValueError("granularity is record or subdoc")
    names = plan_filter(spark, inputs, out, overwrite)
    about = shards.survey(spark, list(names), digest=False)
    broken = [f"{a['path']}: {a['error']}" for a in about if a["error"]]
    if broken:
        raise ValueError("unreadable shards, nothing was written: " + "; ".join(broken))
    cfg = replace(cfg, max_return_records=0)
    df = shards.read_shards(spark, inputs, list(names))
    result = scan(df, index, cfg, "shard", "row_index", stopgrams)
    result = replace(result, decided=materialised(result.flagged, "flagged"))
    check_consistent(result)
    gone = result.flagged.select("shard", "row_index").distinct()
    own = {shards.stem(f): n for f, n in names.items()}
    groups: dict[tuple[str, str], list[str]] = {}
    for a in about:
        kind = "parquet" if a["path"].endswith(".parquet") else "lines"
        groups.setdefault((kind, a["codec"] if kind == "parquet" else shards.packing(a["path"])), []).append(a["path"])
    written = []
    for (kind, codec), files in groups.items():
        work = f"{out}/_scan/{kind}-{codec}"
        if kind == "lines" and granularity == "record":
            shards.filter_lines(spark, files, gone, work)
        else:
            part = shards.read_shards(spark, inputs, files)
            kept = (filter_records if granularity == "record" else filter_parts)(part, result, "shard", "row_index")
            kept = kept.repartition("shard").sortWithinPartitions("shard", "row_index").drop("row_index")
            if kind == "lines":
                body = F.to_json(F.struct(*[c for c in kept.columns if c != "shard"]))
                kept.select("shard", body.alias("value")).write.partitionBy("shard").option("compression", codec).text(work)
            else:
                kept.write.partitionBy("shard").option("compression", codec if codec in ("snappy", "gzip", "zstd", "lz4", "brotli") else "none").parquet(work)
        written += shards.rename_parts(spark, work, out, own)
    small.remove(spark, f"{out}/_scan")
    removed = removed_ids(result)
    body = F.to_json(F.struct(*removed.columns))
    removed.orderBy("shard", "row_index").select(body.alias("value")).write.mode("overwrite").text(f"{out}/removed_ids")
    by = {name: {(r[0] or "all"): r["rows"] for r in t.collect()} for name, t in (("benchmark", removals(result)), ("channel", removals_by(result, "channel")), ("shard", removals_by(result, "shard")))}
    manifest = {
        "granularity": granularity, "files": sorted([*written]), "missing": sorted(set(names.values()) - set(written)), "index": index.fingerprint(),
        "fingerprint": cfg.fingerprint(), "rows_before": df.count(), "rows_contaminated": gone.count(), "parts_flagged": result.flagged.count(), "removals": by,
    }
    if max((r["m"] for r in gone.groupBy("shard").agg(F.max("row_index").alias("m")).join(df.groupBy("shard").agg(F.max("row_index").alias("last")), "shard", "left").where("last IS NULL OR m > last").collect()), default=-1) >= 0:
        raise ValueError("flagged rows lie past the end of their shards: inputs changed during the run")
    settings = {k: getattr(cfg, k) for k in ("ngram", "min_hits", "min_coverage", "gate_mode", "min_item_coverage", "min_longest_run", "exact_channel", "spaced")}
    small.put(spark, f"{out}/card.md", dataset_card(removals(result), index_stats(index), settings))
    small.put_json(spark, f"{out}/filter_manifest.json", manifest)
    return manifest
