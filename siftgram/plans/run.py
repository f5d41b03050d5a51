"""Runs: which shards are read with which settings, what is written, resume, checks, and reproduction.

A run folder holds `records/`, `hits/`, `item_best/` and `summaries/` (a folder for each
shard), `manifest.json`, `summary.json` and `summary.csv`. Summaries are written last: a
shard is finished when it has one under the run's fingerprint.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftgram import __version__
from siftgram.config import ScanConfig
from siftgram.functions.scratch import materialised
from siftgram.operators.index import Index
from siftgram.plans import scan as scans
from siftgram.sources import files as small
from siftgram.sources import shards

TABLES = ("records", "hits", "item_best", "summaries")
COUNTS = ("scanned", "contaminated", "empty_after_filter", "by_ngram", "by_spaced", "by_exact")
RECORD = (
    "doc_id string, row_index long, shard string, field string, role string, turn int, part int, match_count long, channels array<string>, spaced_item int, "
    "src_hits array<struct<source_id:int,hits:long>>, item_hits array<struct<item_id:int,hits:long,longest_run_tokens:long,unique_hits:long,shared_hits:long,"
    "boilerplate_hits:long,item_ngrams:long,item_coverage:double,field_hits:array<struct<field:int,hits:long>>,fields_matched:array<string>,"
    "text:struct<choices_found:int,choices_total:int,numbers_total:int,numbers_matched:int,lcs_chars:int,lcs_ratio:double>>>, "
    "exact_hits array<struct<item_id:int,field:int,choices_found:int,choices_total:int,numbers_total:int,numbers_matched:int,lcs_chars:int,lcs_ratio:double>>"
)


def run_fingerprint(cfg: ScanConfig, index: Index, stopgrams: DataFrame | None = None) -> str:
    """Of settings, the index's content and stop-grams: what makes results differ. Paths and parallelism are no part of it."""
    body = [cfg.fingerprint(), index.fingerprint()]
    if stopgrams is not None:
        body.append(str(tuple(stopgrams.agg(F.sum(F.xxhash64("gram").cast("decimal(38,0)")), F.count("*")).first())))
    return hashlib.sha256(json.dumps(body).encode()).hexdigest()


@dataclass(frozen=True)
class Plan:
    """files: all shards; todo: those to scan; failed: shard name -> why it can't be read."""

    files: list[str]
    todo: list[str]
    failed: dict[str, str]
    about: list[dict]
    fingerprint: str

    def __str__(self) -> str:
        lines = [f"{len(self.files)} shards, {len(self.todo)} to scan, {len(self.files) - len(self.todo) - len(self.failed)} finished, {len(self.failed)} unreadable"]
        return "\n".join([*lines, *[f"  scan {f}" for f in self.todo], *[f"  {k}: {v}" for k, v in sorted(self.failed.items())]])


def planned(spark: SparkSession, inputs: list[str], out: str, fingerprint: str, resume: bool = True, digest: bool = True) -> Plan:
    """Nothing is written: this is also the dry run."""
    files = shards.collect_files(inputs, spark)
    shards.check_stems(files)
    about = shards.survey(spark, files, digest)
    failed = {shards.stem(a["path"]): a["error"] for a in about if a["error"]}
    todo = [f for f in files if shards.stem(f) not in failed]
    if resume and shards.exists(spark, f"{out}/summaries"):
        open_ = set(shards.finished(spark.read.schema(_SUMMARY).parquet(f"{out}/summaries"), [shards.stem(f) for f in todo], fingerprint))
        todo = [f for f in todo if shards.stem(f) in open_]
    return Plan(files, todo, failed, about, fingerprint)


_SUMMARY = ", ".join([*[f"{c} long" for c in COUNTS], "contam_rate double, fingerprint string, error string, shard string"])


def _summaries(result: scans.ScanResult | None, plan: Plan, spark: SparkSession) -> DataFrame:
    """One row per shard that was to be scanned, also where it has no documents, and one per shard that failed."""
    every = [(shards.stem(f), None) for f in plan.todo] + list(plan.failed.items())
    names = spark.createDataFrame(every, "name string, error string")
    none = {c: F.lit(0).cast("long").alias(c) for c in COUNTS}
    if result is None:
        rows = names.select(F.col("name").alias("shard"), *none.values(), F.lit(0.0).alias("contam_rate"), "error")
    else:
        found = scans.shard_summary(result)
        rows = names.join(F.broadcast(found), F.col("name") == F.col("shard"), "left")  # a row per shard
        rows = rows.select(F.col("name").alias("shard"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS], F.coalesce("contam_rate", F.lit(0.0)).alias("contam_rate"), "error")
    return rows.withColumn("fingerprint", F.lit(plan.fingerprint))


def write(spark: SparkSession, result: scans.ScanResult | None, plan: Plan, out: str) -> None:
    """The tables of the shards in the plan; what an earlier run left of them goes first, other shards' folders stay."""
    for name in [shards.stem(f) for f in plan.todo] + list(plan.failed):
        for t in TABLES:
            small.remove(spark, f"{out}/{t}/shard={name}")
    if result is not None:
        # documents are read once: all tables come from this one
        result = replace(result, decided=materialised(result.decided, "decided"))
        body = scans.records(result)
        text = F.to_json(F.struct(*body.columns), {"ignoreNullFields": "false"})
        body.select("shard", text.alias("value")).write.mode("append").partitionBy("shard").text(f"{out}/records")
        scans.hits(result).sortWithinPartitions("shard", "gram_id").write.mode("append").partitionBy("shard").parquet(f"{out}/hits")
        scans.item_best(result).repartition("shard").sortWithinPartitions("shard", "item_idx").write.mode("append").partitionBy("shard").parquet(f"{out}/item_best")
    _summaries(result, plan, spark).write.mode("append").partitionBy("shard").parquet(f"{out}/summaries")


def run_totals(spark: SparkSession, out: str, fingerprint: str) -> dict:
    """Totals over finished shards; failed ones are counted apart."""
    rows = summaries(spark, out).where(F.col("fingerprint") == fingerprint)
    ok = F.col("error").isNull()
    total = rows.agg(F.count_if(ok).alias("shards"), F.count_if(~ok).alias("failed_shards"), *[F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(c) for c in COUNTS]).first().asDict()
    return total | {"contam_rate": total["contaminated"] / total["scanned"] if total["scanned"] else 0.0}


def execute(
    spark: SparkSession, inputs: list[str], out: str, index: Index, cfg: ScanConfig, stopgrams: DataFrame | None = None,
    resume: bool = True, dry_run: bool = False, about: dict | None = None,
) -> tuple[Plan, dict | None]:
    """Scans the shards that are not finished, and writes tables, summary and manifest."""
    plan = planned(spark, inputs, out, run_fingerprint(cfg, index, stopgrams), resume)
    if dry_run:
        return plan, None
    result = None
    if plan.todo:
        result = scans.scan(shards.read_shards(spark, inputs, plan.todo), index, cfg, "shard", "row_index", stopgrams)
    if plan.todo or plan.failed:
        write(spark, result, plan, out)
    total = run_totals(spark, out, plan.fingerprint)
    manifest = {
        "version": 2, "library": __version__, "fingerprint": plan.fingerprint, "index": index.fingerprint(), "normalization": index.normalization.fingerprint(),
        "normalization_sha256": index.normalization.sha256(), "ngram": index.ngram, "inputs": inputs, "shards": {a["path"]: {k: a[k] for k in ("bytes", "sha256", "error")} for a in plan.about},
        "config": settings_of(cfg), "outputs": list(TABLES), "summary": total, **(about or {}),
    }
    small.put_json(spark, f"{out}/manifest.json", manifest)
    small.put_json(spark, f"{out}/summary.json", total)
    lines = [",".join(["shard", *COUNTS, "contam_rate", "error"])]
    for r in summaries(spark, out).where(F.col("fingerprint") == plan.fingerprint).orderBy("shard").toLocalIterator():
        lines.append(",".join([_cell(r["shard"]), *[str(r[c]) for c in COUNTS], str(r["contam_rate"]), _cell(r["error"] or "")]))
    small.put(spark, f"{out}/summary.csv", "\n".join(lines) + "\n")
    return plan, total


def _cell(x: str) -> str:
    return '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\n') else x


def settings_of(cfg: ScanConfig) -> dict:
    """The settings as given, without the normalization (its fingerprint stands beside them)."""
    return {k: v for k, v in asdict(cfg).items() if k != "normalization"}


# reading a run


def summaries(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(_SUMMARY).parquet(f"{out}/summaries")


def hits(spark: SparkSession, out: str) -> DataFrame:
    if not small.names_in(spark, f"{out}/hits"):
        return spark.createDataFrame([], "gram_id long, shard string")
    return spark.read.schema("gram_id long, shard string").parquet(f"{out}/hits")


def item_best(spark: SparkSession, out: str) -> DataFrame:
    kind = "item_idx int, hits long, item_ngrams long, item_coverage double, doc_id string, shard string"
    return spark.read.schema(kind).parquet(f"{out}/item_best") if small.names_in(spark, f"{out}/item_best") else spark.createDataFrame([], kind)


def parse_record(line: str) -> dict:
    """A record of any version: pairs in place of objects are those of old runs."""
    raw = json.loads(line)
    raw["src_hits"] = [dict(zip(("source_id", "hits"), map(int, x), strict=True)) if isinstance(x, (list, tuple)) else {k: int(x[k]) for k in ("source_id", "hits")} for x in raw.get("src_hits") or []]
    items = []
    for x in raw.get("item_hits") or []:
        if isinstance(x, (list, tuple)):
            x = {"item_id": int(x[0]), "hits": int(x[1]), "longest_run_tokens": int(x[2]) if len(x) > 2 else 0}
        items.append({"unique_hits": 0, "shared_hits": 0, "boilerplate_hits": 0} | x)
    raw["item_hits"] = items
    return raw


def read_records(spark: SparkSession, out: str) -> DataFrame:
    """Records of a run; lines of older versions are brought to the present form."""
    if not small.names_in(spark, f"{out}/records"):
        return spark.createDataFrame([], RECORD)
    lines = spark.read.schema("value string, shard string").text(f"{out}/records")
    old = F.col("value").rlike(r'"(?:src_hits|item_hits)" ?: ?\[\s*\[')
    fixed = F.udf(lambda x: json.dumps(parse_record(x)))  # few and old
    return lines.select(F.from_json(F.when(old, fixed("value")).otherwise(F.col("value")), T.StructType.fromDDL(RECORD)).alias("r")).select("r.*")


# checks


def inspected(spark: SparkSession, out: str, deep: bool = True) -> dict:
    """What a run folder holds, and what in it doesn't agree."""
    manifest = small.get_json(spark, f"{out}/manifest.json")
    rows = summaries(spark, out).where(F.col("fingerprint") == manifest["fingerprint"])
    wrong = []
    per = {r["shard"]: r for r in rows.collect()}  # one per shard
    for path in manifest["shards"]:
        if shards.stem(path) not in per:
            wrong.append(f"{shards.stem(path)}: no summary")
    got = {"fingerprint": manifest["fingerprint"], "summary": run_totals(spark, out, manifest["fingerprint"]), "shards": len(per), "hits": hits(spark, out).count()}
    if got["summary"] != manifest["summary"]:
        wrong.append("the manifest has another summary")
    if deep:
        cap = manifest["config"]["max_return_records"] or None
        counted = {r["shard"]: r for r in read_records(spark, out).groupBy("shard").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("bad")).collect()}
        for name, s in sorted(per.items()):
            n = counted[name]["n"] if name in counted else 0
            want = min(s["contaminated"], cap) if cap else s["contaminated"]
            if n != want:
                wrong.append(f"{name}: {n} records, {want} expected")
            if name in counted and counted[name]["bad"]:
                wrong.append(f"{name}: {counted[name]['bad']} records can't be read")
        got["records"] = sum(r["n"] for r in counted.values())
    return got | {"wrong": wrong}


def reproduce(spark: SparkSession, manifest_path: str, index: Index, out: str, stopgrams: DataFrame | None = None) -> list[str]:
    """Runs a manifest again into another folder; what differs, or nothing."""
    about = small.get_json(spark, manifest_path)
    now = {a["path"]: a for a in shards.survey(spark, list(about["shards"]))}
    wrong = [f"{f}: {now[f]['error'] or 'has changed'}" for f, a in about["shards"].items() if now[f]["sha256"] != a["sha256"]]
    if wrong:
        return wrong
    config = {k: tuple(v) if isinstance(v, list) else v for k, v in about["config"].items()}
    cfg = ScanConfig(**config, normalization=index.normalization)
    if run_fingerprint(cfg, index, stopgrams) != about["fingerprint"]:
        return ["the index, the stop-grams or the settings are not those of the run"]
    _, total = execute(spark, about["inputs"], out, index, cfg, stopgrams, resume=False)
    return [f"{k}: {about['summary'][k]} then, {v} now" for k, v in total.items() if about["summary"][k] != v]
