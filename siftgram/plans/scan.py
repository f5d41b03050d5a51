"""The scan: sub-documents, gates, channels, records, hits and summaries as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftgram.config import ScanConfig
from siftgram.operators import exact, gates, spaced
from siftgram.operators.index import Index, numbered_postings
from siftgram.operators.matching import SOURCES, fits_kernel, match
from siftgram.operators.segments import KEY, check_columns, segments, sub_documents

CARRIED = (*KEY, "id", "doc_id", "field", "role")
#: A row's sub-document; turn is -1 and part 0 where they don't apply.
ROW = ["shard", "row_index", "field_ord", "turn", "part"]


@dataclass(frozen=True)
class ScanResult:
    """decided: one row per sub-document with its gates and evidence."""

    parts: DataFrame
    decided: DataFrame
    index: Index
    cfg: ScanConfig

    @property
    def flagged(self) -> DataFrame:
        return self.decided.where("flagged")

    @property
    def verdicts(self) -> DataFrame:
        """Per (sub-document, item) what the gates say."""
        return gates.item_verdicts(self.decided, self.cfg, ROW)

    @property
    def exact(self) -> DataFrame | None:
        """(…, item_idx, question, choices, light) of what the exact channel found, None when it is off."""
        if self.cfg.exact_channel == "off":
            return None
        each = self.decided.select(*ROW, "doc_id", F.col("seen").alias("text"), F.explode("exact_items").alias("item_idx"))
        return exact.with_texts(each, self.index, self.cfg, [*ROW, "doc_id"], self.index.normalization.nfkc)


def scan(
    df: DataFrame, index: Index, cfg: ScanConfig | None = None, shard: str | None = None, row_index: str | None = None,
    stopgrams: DataFrame | None = None, plan: str = "auto",
) -> ScanResult:
    """One pass over the rows: sub-documents, n-gram, spaced and exact channels, gates. Nothing is joined to rows by a
    key in the kernel plan; in the join plan results come back by the digest of the text."""
    cfg = cfg or ScanConfig(ngram=index.ngram)
    if cfg.ngram != index.ngram:
        raise ValueError(f"the index has n = {index.ngram}, the scan {cfg.ngram}")
    check_columns(df.drop(*[c for c in (shard, row_index) if c and c not in cfg.text_keys and c != cfg.id_key]), cfg)
    parts = sub_documents(segments(df, cfg, shard, row_index), cfg).withColumn("part", F.coalesce("part", F.lit(0)))
    nfkc, asks = index.normalization.nfkc, cfg.exact_channel != "off"
    if plan == "auto":
        plan = "kernel" if fits_kernel(index, stopgrams) else "join"
    if plan == "kernel" and asks and exact.kernel(index, cfg, nfkc) is None:
        plan = "join"
    texts_from = cfg.min_hits if asks or cfg.confirm else None
    if plan == "kernel":
        matched = match(parts, index, stopgrams, CARRIED, plan, cfg.boilerplate_threshold, spaced.kernel(index, cfg) if cfg.spaced else None, exact.kernel(index, cfg, nfkc) if asks else None, texts_from)
    else:
        matched = _joined(parts, index, cfg, stopgrams, texts_from)
    decided = gates.union_gate(matched, cfg).withColumn("match_count", F.col("n_hits"))
    if cfg.gate_mode == "item":
        best = F.array_max(F.transform("items", lambda i: i["hits"]))
        decided = decided.withColumn("match_count", F.coalesce(best, F.lit(0))).withColumn("ngram_flag", gates.any_item(cfg, "item_gate"))
    elif cfg.min_item_coverage > 0:
        decided = decided.withColumn("ngram_flag", F.col("union_flag") | gates.any_item(cfg, "coverage_path"))
    else:
        decided = decided.withColumn("ngram_flag", F.col("union_flag"))
    # parts of too few bytes or of stop-grams alone never reach the spaced channel
    clean = ~F.col("ngram_flag") & ~F.col("skipped") & (F.col("n_kept") > 0)
    decided = decided.withColumn("spaced_item", F.when(clean, F.col("spaced_item")) if cfg.spaced else F.lit(None).cast("int"))
    decided = decided.withColumn("exact_flag", F.size("exact_items") > 0 if asks else F.lit(False))
    channels = F.array_compact(
        F.array(F.when(F.col("ngram_flag"), F.lit("ngram")), F.when(F.col("spaced_item").isNotNull(), F.lit("spaced")), F.when(F.col("exact_flag"), F.lit("exact")))
    )
    decided = decided.withColumn("channels", channels).withColumn("flagged", F.size("channels") > 0)
    decided = decided.withColumn("scanned", ~F.col("skipped") | F.col("exact_flag"))
    decided = decided.withColumn("empty_after_filter", ~F.col("skipped") & (F.col("n_grams") > 0) & (F.col("n_kept") == 0) & ~F.col("exact_flag"))
    return ScanResult(parts, decided, index, cfg)


def _joined(parts: DataFrame, index: Index, cfg: ScanConfig, stopgrams: DataFrame | None, texts_from: int | None) -> DataFrame:
    """The same columns by joins, for indexes or normalizations that no kernel takes."""
    asks = cfg.exact_channel != "off"
    out = match(parts.withColumn("__d", F.sha2("text", 256)), index, stopgrams, (*CARRIED, "__d"), "join", cfg.boilerplate_threshold, texts_from=texts_from)
    texts = parts.select(F.sha2("text", 256).alias("__d"), "text").dropDuplicates(["__d"])
    if cfg.spaced:
        out = out.join(spaced.verified(texts, index, cfg, ["__d"]).select("__d", "spaced_item"), "__d", "left")
    if asks:
        found = exact.exact_hits(texts, index, cfg, ["__d"], index.normalization.nfkc, "join").groupBy("__d").agg(F.sort_array(F.collect_set("item_idx")).alias("exact_items"))
        out = out.join(found, "__d", "left").withColumn("exact_items", F.coalesce("exact_items", F.array().cast("array<int>")))
    return out.drop("__d")


def capped(rows: DataFrame, most: int | None) -> DataFrame:
    """The first `most` flagged sub-documents of every shard, in scan order; 0 and None are no cap."""
    if not most:
        return rows
    order = Window.partitionBy("shard").orderBy("row_index", "field_ord", "turn", "part")
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


def records(result: ScanResult) -> DataFrame:
    """Nested evidence per flagged sub-document, under the cap of each shard."""
    cfg, index = result.cfg, result.index
    # what a row holds names it, so that null or repeated keys do no harm
    mark = F.sha2(F.to_json(F.struct(*ROW, "hits", "n_grams", *(["seen"] if "seen" in result.decided.columns else []))), 256)
    top = capped(result.flagged, cfg.max_return_records).withColumn("uid", mark)
    told = F.filter("items", lambda i: (F.col("n_hits") >= cfg.min_hits) & gates.verdict(i, F.col("n_grams"), cfg)["evidence"])
    top = top.withColumn("told", told)
    each = top.where(F.size("told") > 0).select("uid", F.explode(F.array_distinct(F.transform("hits", lambda h: h["gram_id"]))).alias("gram_id"), F.transform("told", lambda i: i["item_idx"]).alias("of")).distinct()
    post = gates.small(index.postings.select("gram_id", "item_idx", "field_idx"), index.sizes[0])
    fields = each.join(post, "gram_id").where(F.array_contains("of", F.col("item_idx"))).groupBy("uid", "item_idx", "field_idx").agg(F.count("*").alias("hits"))
    fields = fields.groupBy("uid", "item_idx").agg(F.sort_array(F.collect_list(F.struct(F.col("field_idx").alias("field"), "hits"))).alias("fields"))
    about = gates.small(index.items.select("item_idx", "field_names"), index.sizes[1])
    names = F.transform("fields", lambda f: F.coalesce(F.get("field_names", f["field"]), F.concat(F.lit("field_"), f["field"].cast("string"))))
    fields = fields.join(about, "item_idx").groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("item_idx", F.struct("fields", names.alias("names"))))).alias("by_field"))
    out = top.join(fields, "uid", "left")
    asks = cfg.exact_channel != "off"
    if asks or cfg.confirm:
        pairs = top.select("uid", F.col("seen").alias("text"), F.explode(F.array_union(F.transform("told", lambda i: i["item_idx"]), F.col("exact_items") if asks else F.array().cast("array<int>"))).alias("item_idx")).dropDuplicates(["uid", "item_idx"])
        q = gates.small(exact.questions(index, cfg, index.normalization.nfkc, every=True), index.sizes[1] * exact.TEXT)
        light = exact.light(F.col("text"), index.normalization.nfkc)
        seen = exact.evidence(pairs.select("uid", "item_idx", light.alias("light")).join(q, "item_idx"), cfg)
        keep = ["choices_found", "choices_total", *(["numbers_total", "numbers_matched", "lcs_chars", "lcs_ratio"] if cfg.confirm else [])]
        seen = seen.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("item_idx", F.struct(*keep)))).alias("by_text"))
        out = out.join(seen, "uid", "left")

    def item(i):
        shown = [i["item_idx"].alias("item_id"), *[i[c].alias(c) for c in ("hits", "longest_run_tokens", "unique_hits", "shared_hits", "boilerplate_hits", "item_ngrams")], (i["hits"] / i["item_ngrams"]).alias("item_coverage")]
        field = F.element_at("by_field", i["item_idx"])
        shown += [field["fields"].alias("field_hits"), field["names"].alias("fields_matched")]
        return F.struct((-i["hits"]).alias("o"), *shown, *([F.element_at("by_text", i["item_idx"]).alias("text")] if asks or cfg.confirm else []))

    order = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).when(a["item_id"] < b["item_id"], -1).when(a["item_id"] > b["item_id"], 1).otherwise(0)
    listed = F.transform(F.array_sort(F.transform("told", item), order), lambda x: x.dropFields("o"))
    more = []
    if asks:
        hit = lambda x: F.struct(x.alias("item_id"), F.lit(0).alias("field"), *[F.element_at("by_text", x)[k].alias(k) for k in keep])
        more = [F.transform("exact_items", hit).alias("exact_hits")]
    none = F.when(F.col("turn") >= 0, F.col("turn"))
    return out.select(
        "doc_id", "row_index", "shard", "field", "role", none.alias("turn"), (F.col("part") if cfg.packed_doc_sep else F.lit(None).cast("int")).alias("part"),
        "match_count", "channels", "spaced_item", F.col("sources").alias("src_hits"), listed.alias("item_hits"), *more,
    )


def named(found: DataFrame, result: ScanResult) -> DataFrame:
    """found (…, item_idx) with the benchmark of the item."""
    return found.join(gates.small(result.index.items.select("item_idx", "benchmark"), result.index.sizes[1]), "item_idx")


def row_benchmarks(result: ScanResult) -> DataFrame:
    """Flagged sub-documents with `benchmarks`: those of their n-grams, and of the items that the other channels found."""
    index = result.index
    by_gram = F.transform(F.when(F.col("ngram_flag"), F.col("sources")).otherwise(F.array().cast(SOURCES)), lambda s: gates.benchmark_name(s["source_id"], index))
    items = F.array_compact(F.array("spaced_item"))
    if result.cfg.exact_channel != "off":
        items = F.array_union(items, F.col("exact_items"))
    rows = result.flagged.withColumn("benchmarks", by_gram).withColumn("other", items)
    # the items a benchmark has are few against rows: their numbers, in order of benchmarks, make up ranges
    ranges = [(r["benchmark"], r["lo"], r["hi"]) for r in index.items.groupBy("benchmark").agg(F.min("item_idx").alias("lo"), F.max("item_idx").alias("hi")).collect()]
    of = lambda i: F.coalesce(*[F.when((i >= lo) & (i <= hi), F.lit(b)) for b, lo, hi in ranges]) if ranges else F.lit(None).cast("string")
    return rows.withColumn("benchmarks", F.array_sort(F.array_union("benchmarks", F.transform("other", of)))).drop("other")


def hits(result: ScanResult) -> DataFrame:
    """(shard, gram_id): n-grams of the index met in a shard, in flagged and other sub-documents."""
    return gates.hit_rows(result.decided, ["shard"]).distinct()


def shard_summary(result: ScanResult) -> DataFrame:
    one = lambda c: F.count_if(F.array_contains("channels", c))
    out = result.decided.groupBy("shard").agg(
        F.count_if("scanned").alias("scanned"), F.count_if("flagged").alias("contaminated"), F.count_if("empty_after_filter").alias("empty_after_filter"),
        one("ngram").alias("by_ngram"), one("spaced").alias("by_spaced"), one("exact").alias("by_exact"),
    )
    return out.withColumn("contam_rate", F.when(F.col("scanned") > 0, F.col("contaminated") / F.col("scanned")).otherwise(0.0))


def run_summary(result: ScanResult) -> DataFrame:
    out = shard_summary(result).agg(F.count("*").alias("shards"), *[F.sum(c).alias(c) for c in ("scanned", "contaminated", "empty_after_filter", "by_ngram", "by_spaced", "by_exact")])
    return out.withColumn("contam_rate", F.when(F.col("scanned") > 0, F.col("contaminated") / F.col("scanned")).otherwise(0.0))


def item_best(result: ScanResult) -> DataFrame:
    return gates.item_best(result.decided.where("n_hits > 0"), ROW)


__all__ = ["ScanResult", "capped", "hits", "item_best", "numbered_postings", "records", "run_summary", "scan", "shard_summary"]
