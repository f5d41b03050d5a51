"""Gates: which sub-documents are contaminated, and the evidence per item.

Everything starts from match(): one row per sub-document with its hits and its
evidence by item and benchmark. Gates are expressions over that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgram.config import ScanConfig
from siftgram.operators.index import Index
from siftgram.operators.matching import small


def union_gate(matched: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Adds coverage and union_flag."""
    out = matched.withColumn("coverage", F.when(F.col("n_grams") > 0, F.col("n_hits") / F.col("n_grams")).otherwise(0.0))
    return out.withColumn("union_flag", (F.col("n_hits") >= cfg.min_hits) & (F.col("coverage") >= cfg.min_coverage))


def hit_rows(matched: DataFrame, key: list[str]) -> DataFrame:
    """(key, gram_id): distinct matched n-grams of each sub-document."""
    return matched.select(*key, F.explode(F.array_distinct(F.transform("hits", lambda h: h["gram_id"]))).alias("gram_id"))


def benchmark_name(source_id: Column, index: Index) -> Column:
    return F.get(F.array(*[F.lit(n) for n in index.names]), source_id) if index.names else F.lit(None).cast("string")


def benchmark_hits(matched: DataFrame, index: Index, key: list[str]) -> DataFrame:
    """(key, benchmark, hits): matched n-grams by benchmark."""
    each = matched.select(*key, F.explode("sources").alias("s"))
    return each.select(*key, benchmark_name(F.col("s.source_id"), index).alias("benchmark"), "s.hits")


def longest_runs(matched: DataFrame, key: list[str]) -> DataFrame:
    """(key, item_idx, longest_run_tokens): the longest run of tokens that an item's n-grams cover without a gap."""
    return matched.select(*key, F.explode("items").alias("i")).select(*key, "i.item_idx", "i.longest_run_tokens")


def _coverage(item: Column) -> Column:
    return F.when(item["item_ngrams"] > 0, item["hits"] / item["item_ngrams"]).otherwise(0.0)


def item_hits(matched: DataFrame, key: list[str]) -> DataFrame:
    """(key, item_idx, hits, unique_hits, shared_hits, boilerplate_hits, longest_run_tokens, item_ngrams, item_coverage)."""
    each = matched.select(*key, F.explode("items").alias("i"))
    return each.select(*key, "i.*", _coverage(F.col("i")).alias("item_coverage"))


def verdict(item: Column, n_grams: Column, cfg: ScanConfig) -> dict[str, Column]:
    """What the gates say of one item of a sub-document."""
    enough = item["hits"] >= cfg.min_hits
    doc_ok = enough & (item["hits"] / n_grams >= cfg.min_coverage)
    if cfg.min_longest_run:
        doc_ok = doc_ok & (item["longest_run_tokens"] >= cfg.min_longest_run)
    holds = enough & (_coverage(item) >= cfg.min_item_coverage)
    gate, path = doc_ok & holds, holds if cfg.min_item_coverage > 0 else F.lit(False)
    return {"doc_ok": doc_ok, "holds_item": holds, "item_gate": gate, "coverage_path": path, "evidence": gate if cfg.gate_mode == "item" else doc_ok | path}


def any_item(cfg: ScanConfig, what: str) -> Column:
    """Whether some item of a row passes a gate."""
    return F.exists("items", lambda i: verdict(i, F.col("n_grams"), cfg)[what])


def item_verdicts(matched: DataFrame, cfg: ScanConfig, key: list[str]) -> DataFrame:
    """item_hits() with doc_ok, holds_item, item_gate, coverage_path, evidence."""
    each = matched.where(F.col("n_hits") >= cfg.min_hits).select(*key, "n_grams", F.explode("items").alias("i"))
    said = verdict(F.col("i"), F.col("n_grams"), cfg)
    return each.select(*key, "n_grams", "i.*", _coverage(F.col("i")).alias("item_coverage"), *[c.alias(n) for n, c in said.items()])


def field_hits(matched: DataFrame, index: Index, key: list[str]) -> DataFrame:
    """(key, item_idx, field_idx, hits): an n-gram that stands in two fields counts in both."""
    of = index.postings.select("gram_id", "item_idx", "field_idx")
    return hit_rows(matched, key).join(small(of, index.sizes[0]), "gram_id").groupBy(*key, "item_idx", "field_idx").agg(F.count("*").alias("hits"))


def item_best(matched: DataFrame, key: list[str], shard: str = "shard", doc: str = "doc_id") -> DataFrame:
    """(shard, item_idx, hits, item_ngrams, item_coverage, doc_id): the best sub-document of each item, the first on ties."""
    per = item_hits(matched, list(dict.fromkeys([*key, shard, doc])))
    order = F.struct((-F.col("hits")).alias("h"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(key)], F.col(doc).alias("doc"), "item_ngrams", "item_coverage")
    best = per.groupBy(shard, "item_idx").agg(F.min(order).alias("b"))
    return best.select(shard, "item_idx", (-F.col("b.h")).alias("hits"), F.col("b.item_ngrams").alias("item_ngrams"), F.col("b.item_coverage").alias("item_coverage"), F.col("b.doc").alias(doc))
