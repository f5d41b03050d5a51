"""Leak reports: by benchmark, item and shard, with top-k tables and a Markdown rendering."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftgram.operators import gates
from siftgram.operators.index import Index, numbered_postings


def _ratio(a: str, b: str):
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


#: How tables are sorted where they are written.
ORDER = {
    "leak_by_benchmark": [F.desc, "fraction", F.asc, "benchmark"],
    "leak_by_item": [F.desc, "fraction", F.desc, "leaked", F.asc, "benchmark", F.asc, "item_idx"],
    "leak_by_shard": [F.desc, "unique_grams", F.asc, "shard"],
}


def ordered(table: DataFrame, name: str) -> DataFrame:
    turns = ORDER[name]
    return table.orderBy(*[way(c) for way, c in zip(turns[::2], turns[1::2], strict=True)])


def leak_by_benchmark(hits: DataFrame, index: Index) -> DataFrame:
    """benchmark, leaked, total, fraction: distinct n-grams met anywhere against distinct n-grams indexed."""
    of = numbered_postings(index).select("gram_id", "benchmark").distinct()
    met = hits.select("gram_id").distinct().withColumn("met", F.lit(1))
    out = of.join(met, "gram_id", "left").groupBy("benchmark").agg(F.count("met").alias("leaked"), F.count("*").alias("total"))
    names = index.items.select("benchmark").distinct()
    return names.join(out, "benchmark", "left").na.fill(0, ["leaked", "total"]).withColumn("fraction", _ratio("leaked", "total"))


def leak_by_item(hits: DataFrame, index: Index, boilerplate_threshold: int = 50, best: DataFrame | None = None) -> DataFrame:
    """item_idx, benchmark, item_id, leaked and its split by fan-out, total, fraction; items with a leak."""
    of = numbered_postings(index).select("gram_id", "item_idx", "fan_out").distinct()
    met = of.join(hits.select("gram_id").distinct(), "gram_id", "left_semi")
    b = boilerplate_threshold
    out = met.groupBy("item_idx").agg(
        F.count("*").alias("leaked"), F.count_if(F.col("fan_out") <= 1).alias("unique_leaked"),
        F.count_if((F.col("fan_out") > 1) & (F.col("fan_out") < b)).alias("shared_leaked"), F.count_if((F.col("fan_out") > 1) & (F.col("fan_out") >= b)).alias("boilerplate_leaked"),
    )
    out = out.join(index.items.select("item_idx", "benchmark", "item_id", F.col("n_grams").alias("total")), "item_idx").withColumn("fraction", _ratio("leaked", "total"))
    if best is not None:
        order = F.struct((-F.col("hits")).alias("h"), "shard", "doc_id")
        top = best.groupBy("item_idx").agg(F.min(order).alias("b"))
        out = out.join(top.select("item_idx", (-F.col("b.h")).alias("best_hits"), F.col("b.shard").alias("best_shard"), F.col("b.doc_id").alias("best_doc")), "item_idx", "left")
    return out


def hits_by_shard(hits: DataFrame, index: Index) -> DataFrame:
    """shard, benchmark, n: distinct n-grams of a benchmark met in a shard."""
    of = numbered_postings(index).select("gram_id", "benchmark").distinct()
    return hits.join(gates.small(of, index.sizes[0]), "gram_id").groupBy("shard", "benchmark").agg(F.count("*").alias("n"))


def leak_by_shard(hits: DataFrame, index: Index, summary: DataFrame) -> DataFrame:
    """shard, unique_grams, scanned, per_1k_docs; a shard without a summary has no documents."""
    known = hits.join(numbered_postings(index).select("gram_id").distinct(), "gram_id", "left_semi")
    out = known.groupBy("shard").agg(F.count_distinct("gram_id").alias("unique_grams")).join(summary.select("shard", "scanned"), "shard", "left").na.fill(0, ["scanned"])
    return out.withColumn("per_1k_docs", F.when(F.col("scanned") > 0, F.col("unique_grams") / F.col("scanned") * 1000).otherwise(0.0))


def worst_shards(by_shard: DataFrame, k: int = 50) -> DataFrame:
    return by_shard.orderBy(F.desc("unique_grams"), F.desc("per_1k_docs"), "shard").limit(k)


def worst_shards_per_benchmark(by_shard: DataFrame, k: int = 20) -> DataFrame:
    """by_shard: shard, benchmark, n; the k worst of each benchmark, zeros dropped."""
    order = Window.partitionBy("benchmark").orderBy(F.desc("n"), "shard")
    return by_shard.where("n > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def shard_benchmarks(by_shard: DataFrame) -> DataFrame:
    """shard, benchmarks: `name:count;…`, counts descending, then name."""
    item = F.struct((-F.col("n")).alias("o"), F.col("benchmark").alias("b"), "n")
    listed = F.transform(F.sort_array(F.collect_list(item)), lambda x: F.concat(x["b"], F.lit(":"), x["n"].cast("string")))
    return by_shard.groupBy("shard").agg(F.array_join(listed, ";").alias("benchmarks"))


def field_matches(field_hits: DataFrame, index: Index) -> DataFrame:
    """kind, n: (sub-document, item) pairs by which fields matched: full, question_only, partial, single_field."""
    all_fields = index.postings.select("item_idx", "field_idx").distinct().groupBy("item_idx").agg(F.collect_set("field_idx").alias("all_fields"))
    key = [c for c in field_hits.columns if c not in ("field_idx", "hits")]
    got = field_hits.groupBy(*key).agg(F.collect_set("field_idx").alias("fields")).join(gates.small(all_fields, index.sizes[1]), "item_idx")
    kind = (
        F.when(F.size("all_fields") == 1, F.lit("single_field"))
        .when(F.size(F.array_except("all_fields", "fields")) == 0, F.lit("full"))
        .when((F.size("fields") == 1) & F.array_contains("fields", 0), F.lit("question_only"))
        .otherwise(F.lit("partial"))
    )
    return got.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def exact_summary(decided: DataFrame, choices: DataFrame) -> DataFrame:
    """exact_only sub-documents, items matched verbatim, and pairs with all, some or no choices near."""
    only = decided.where((F.size("channels") == 1) & F.array_contains("channels", "exact")).agg(F.count("*").alias("exact_only"))
    f, t = F.col("choices_found"), F.col("choices_total")
    pairs = choices.agg(
        F.count_distinct("item_idx").alias("items"), F.count_if((t > 0) & (f == t)).alias("all_choices"),
        F.count_if((f > 0) & (f < t)).alias("some_choices"), F.count_if((t > 0) & (f == 0)).alias("no_choices"),
    )
    return only.withColumn("k", F.lit(1)).join(pairs.withColumn("k", F.lit(1)), "k").drop("k")


def _head(*names: str) -> list[str]:
    return [f"| {' | '.join(names)} |", "|" + ":-|" * len(names)]


def _texts(records: DataFrame) -> DataFrame:
    """(shard, doc_id, item_idx, hits, what was found of the text) per record and item, from n-grams and from the exact channel."""
    keep = ["choices_found", "choices_total", "numbers_total", "numbers_matched", "lcs_chars", "lcs_ratio"]
    by_gram = records.select("shard", "doc_id", F.explode("item_hits").alias("i")).where("i.text IS NOT NULL")
    by_gram = by_gram.select("shard", "doc_id", F.col("i.item_id").alias("item_idx"), F.col("i.hits").alias("hits"), *[F.col(f"i.text.{c}").alias(c) for c in keep])
    exact = records.select("shard", "doc_id", F.explode("exact_hits").alias("i")).select("shard", "doc_id", F.col("i.item_id").alias("item_idx"), F.lit(0).cast("long").alias("hits"), *[F.col(f"i.{c}").alias(c) for c in keep])
    both = by_gram.unionByName(exact)
    return both.groupBy("shard", "doc_id", "item_idx").agg(F.max("hits").alias("hits"), *[F.max(c).alias(c) for c in keep])


def variants(records: DataFrame) -> DataFrame:
    """Template variants among the records of a run."""
    from siftgram.operators.exact import template_variants

    return template_variants(_texts(records))


def exact_of(records: DataFrame) -> DataFrame:
    """exact_summary() of the records of a run."""
    pairs = records.select("shard", "doc_id", F.explode("exact_hits").alias("e")).select(F.col("e.item_id").alias("item_idx"), "e.choices_found", "e.choices_total")
    return exact_summary(records, pairs)


def fields_of(records: DataFrame) -> DataFrame:
    """(shard, doc_id, item_idx, field_idx, hits) of the records of a run."""
    each = records.select("shard", "doc_id", F.explode("item_hits").alias("i")).select("shard", "doc_id", F.col("i.item_id").alias("item_idx"), F.explode("i.field_hits").alias("f"))
    return each.select("shard", "doc_id", "item_idx", F.col("f.field").alias("field_idx"), F.col("f.hits").alias("hits"))


def markdown(benchmarks: DataFrame, shards: DataFrame, top: int = 10, worst: int = 20, each: DataFrame | None = None, per: int = 5, examples: list[str] | None = None) -> str:
    """A short rendering: the `top` benchmarks, the `worst` shards, `per` shards of each benchmark, and sample files."""
    lines = ["# Leak report", "", *_head("benchmark", "leaked", "total", "fraction")]
    lines += [f"| {r['benchmark']} | {r['leaked']} | {r['total']} | {r['fraction']:.4f} |" for r in benchmarks.orderBy(F.desc("fraction"), "benchmark").limit(top).collect()]
    lines += ["", *_head("shard", "distinct n-grams", "per 1,000 documents")]
    lines += [f"| {r['shard']} | {r['unique_grams']} | {r['per_1k_docs']:.2f} |" for r in worst_shards(shards, worst).collect()]
    if each is not None:
        lines += ["", *_head("benchmark", "shard", "distinct n-grams")]
        lines += [f"| {r['benchmark']} | {r['shard']} | {r['n']} |" for r in worst_shards_per_benchmark(each, per).orderBy("benchmark", "rank").collect()]
    if examples:
        lines += ["", "Records:", "", *[f"- `{e}`" for e in examples]]
    return "\n".join(lines) + "\n"


def as_json(**tables: DataFrame) -> str:
    """Small report tables as one JSON document."""
    return json.dumps({k: [r.asDict(recursive=True) for r in t.collect()] for k, t in tables.items()}, sort_keys=True, default=str)


def write_report(spark: SparkSession, run_dir: str, index: Index, out: str, topk_overall: int = 50, topk_per_benchmark: int = 20, boilerplate_threshold: int = 50) -> dict:
    """The report of a finished run, from its tables alone: tables as CSV and Parquet, report.json and report.md."""
    from siftgram.plans import run as runs
    from siftgram.sources import files

    about = files.get_json(spark, f"{run_dir}/manifest.json")
    if about["index"] != index.fingerprint():
        raise ValueError("the run was made with another index")
    summary = runs.summaries(spark, run_dir).where((F.col("fingerprint") == about["fingerprint"]) & F.col("error").isNull())
    met, records = runs.hits(spark, run_dir).join(summary.select("shard"), "shard", "left_semi"), runs.read_records(spark, run_dir)
    by_benchmark = ordered(leak_by_benchmark(met, index), "leak_by_benchmark")
    by_shard = leak_by_shard(met, index, summary)
    each = hits_by_shard(met, index)
    listed = ordered(by_shard.join(shard_benchmarks(each), "shard", "left"), "leak_by_shard")
    tables = {"leak_by_benchmark": by_benchmark, "leak_by_shard": listed, "leak_by_item": ordered(leak_by_item(met, index, boilerplate_threshold, runs.item_best(spark, run_dir)), "leak_by_item"), "template_variants": variants(records)}
    for name, t in tables.items():
        t.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/{name}")
    shown = [n for n in files.names_in(spark, f"{run_dir}/records") if n.startswith("shard=")]
    examples = [f"records/{n}" for n in shown[:10]]
    body = {
        "summary": about["summary"], "benchmarks": [r.asDict() for r in by_benchmark.collect()],
        "worst_shards": [r.asDict() for r in worst_shards(listed, topk_overall).collect()],
        "worst_shards_per_benchmark": [r.asDict() for r in worst_shards_per_benchmark(each, topk_per_benchmark).orderBy("benchmark", "rank").collect()],
        "field_matches": {r["kind"]: r["n"] for r in field_matches(fields_of(records), index).collect()},
        "exact": exact_of(records).first().asDict(), "examples": {"files": examples, "found": len(shown)},
    }
    files.put_json(spark, f"{out}/report.json", body)
    files.put(spark, f"{out}/report.md", markdown(by_benchmark, by_shard, each=each, examples=examples))
    return body
