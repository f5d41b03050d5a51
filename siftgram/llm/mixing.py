"""Mixing sources to target weights (operator 5).

Every document gets a hash-random key. Within its source the documents stand in
key order; the mix takes whole epochs of a source and then the beginning of that
order up to the source's exact budget, so that only the document at the cut is
taken in part.

Prefix sums are distributed: the key space of a source is cut into ranges of
equal width (the keys are uniform), at most 16**STEP at a time; ranges are summed
with partial aggregation, their running totals give the range of the cut, and
that range alone is cut again, until it holds about RANGE_ROWS rows. Only the
rows of that last range are put in order. No source, however large, meets in one
task; a running total sees 16**STEP rows of a source at most.

Edge cases: a null or empty text has size 0 and takes 0 words. Null sources are
one source, last in order. The key is a hash of doc_id and text, so that rows
that share a doc_id have keys of their own; rows that share both are
interchangeable. An empty table gives no rows. Own columns of any name stay as
they are: where `epoch` or `take_words` is one of them, the mix's own column of
that name gets as many `_` as set it apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftgram.llm.shared import materialised

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_EPOCHS = 2
SEED = "mix-1"
#: Rows in one key range, about; the cut of a source orders this many rows.
RANGE_ROWS = 1_000
STEP = 3  # hexadecimal digits of the key by which ranges are cut at once


def size_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same and target, one row per source.

    What sources above `most` times their size can't hold is dealt to the rest by
    weight until none is above. That end state is min(cap, level * weight) with a
    common level, found here by running sums in the order of cap / weight. The
    windows have no partition: they see one row per source, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    turn = (F.row_number().over(by_name) - 1) % n
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (turn + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    budget = F.col("total") * share_percent
    level = (budget - 100 * F.col("cap_before")) / (100 * (F.col("all_weight") - F.col("weight_before")))
    rows = rows.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    shared = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("level").alias("level")))).over(everything)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), shared["level"] * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, keep: bool = False) -> DataFrame:
    """One row per document: key, size, source_size, target, taken (words, repeats counted).

    keep: the documents' own columns stand in a struct `row` as well.
    """
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    body = F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    at = F.md5(F.concat(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.lit(f":{seed}:"), body))
    thin = materialised(docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{source}`").alias("source"), size_of(F.col(f"`{text}`")).alias("size"), at.alias("at"), *own), "mix")
    lean = thin.select("source", "size", "at")
    n = lean.count()
    digits = 0
    while 16**digits * RANGE_ROWS < n:
        digits += 1
    goal = targets(lean.groupBy("source").agg(F.sum("size").alias("source_size")))
    goal = (
        goal.withColumn("budget", F.round("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    )
    goal = materialised(goal, "goal")
    cut = goal.select(F.col("source").alias("cut_source"), "rest", F.lit("").alias("cut_bin"), F.lit(0).cast("long").alias("cut_start"))
    done = 0
    while done < digits:
        upto = min(digits, done + STEP)
        inside = F.col("source").eqNullSafe(F.col("cut_source")) & (F.substring("at", 1, done) == F.col("cut_bin"))
        bins = lean.join(_small(cut), inside).groupBy("source", F.substring("at", 1, upto).alias("bin")).agg(F.sum("size").alias("bin_size"), F.first("rest").alias("rest"), F.first("cut_start").alias("cut_start"))
        before = F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        bins = bins.withColumn("start", F.col("cut_start") + F.coalesce(before, F.lit(0)))
        cut = bins.where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("bin_size")))
        cut = materialised(cut.select(F.col("source").alias("cut_source"), "rest", F.col("bin").alias("cut_bin"), F.col("start").alias("cut_start")), "cut")
        done = upto
    bin_ = F.substring("at", 1, digits)
    goal = goal.join(cut.drop("rest"), F.col("source").eqNullSafe(F.col("cut_source")), "left").withColumnRenamed("source", "goal_source").drop("cut_source")
    rows = thin.join(_small(goal), F.col("source").eqNullSafe(F.col("goal_source")), "left").withColumn("bin", bin_)
    # rows at the cut are put in order within their range; for all others the answer needs no order
    at_cut = F.coalesce(F.col("bin") == F.col("cut_bin"), F.lit(False))
    order = Window.partitionBy("source", "bin").orderBy("at", "k", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = rows.where(at_cut).withColumn("prefix", F.col("cut_start") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    ordered = ordered.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("prefix"))))
    others = rows.where(~at_cut).withColumn("prefix", F.lit(None).cast("long"))
    others = others.withColumn("part", F.when(F.col("rest") > 0, F.when(F.col("bin") < F.col("cut_bin"), F.col("size")).otherwise(0)).otherwise(0).cast("long"))
    out = ordered.unionByName(others)
    taken = (F.col("epochs") * F.col("size") + F.col("part")).cast("long")
    return out.select(F.col("k").alias(key), "size", "source_size", "target", taken.alias("taken"), *(["row"] if keep else []))


def _small(goal: DataFrame) -> DataFrame:
    """Sources are broadcast only where their number is known to be small."""
    held = materialised(goal, "targets")
    return F.broadcast(held) if held.count() <= 100_000 else held


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def mixed(docs: DataFrame, **names: str) -> DataFrame:
    """The mix itself: a row for each epoch of a document, with its columns, `epoch`
    and `take_words`, the number of its first words that this epoch uses."""
    got = mix(docs, keep=True, **names)
    times = F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    each = got.where(F.col("taken") > 0).withColumn("_e", F.explode(F.sequence(F.lit(1), times)))
    words = F.least(F.col("size"), F.col("taken") - (F.col("_e") - 1) * F.col("size")).cast("long")
    return each.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("_e").alias(_free("epoch", docs.columns)), words.alias(_free("take_words", docs.columns)))
