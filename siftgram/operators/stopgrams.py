"""Stop-grams: n-grams frequent in a background corpus, or held by many items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgram.config import DOC_SEPARATOR, DOC_SEPARATOR_TYPO, Normalization
from siftgram.functions.text import may_reject, rejected, tokens, windows
from siftgram.operators.matching import frequent


def background_documents(rows: DataFrame, fields: list[str], sep: str | None = DOC_SEPARATOR, typo: str | None = DOC_SEPARATOR_TYPO) -> DataFrame:
    """(text): fields joined by newlines, packed texts split, trimmed, empty ones dropped."""
    text = F.concat_ws("\n", *[F.col(f) for f in fields])
    if sep is None:
        return rows.select(F.btrim(text).alias("text")).where("text <> ''")
    if typo:
        text = F.replace(text, F.lit(typo), F.lit(sep))
    parts = F.explode(F.split(text, r"\Q" + sep + r"\E", -1))
    return rows.select(parts.alias("text")).select(F.btrim("text", F.lit(" \t\r\n\x0b\x0c")).alias("text")).where("text <> ''")


def background_stopgrams(docs: DataFrame, n: int, tau: float, norm: Normalization | None = None) -> DataFrame:
    """(gram, df): n-grams in at least max(1, ceil(tau * N)) of the N documents; exact counts, by kernels where the
    normalization and the number of candidates allow, else with partial aggregation."""
    norm = norm or Normalization()
    if norm.is_default and tau > 0 and (got := frequent(docs, n, tau, norm)) is not None:
        return got
    total = docs.count()
    need = max(1, -int(-(tau * total) // 1))
    toks = docs.select(tokens(F.col("text"), norm).alias("toks"))
    ws = windows(F.col("toks"), n)["gram"]
    ws = F.when(may_reject(F.col("toks"), norm), F.filter(ws, lambda g: ~rejected(g, norm))).otherwise(ws)
    return toks.select(F.explode(F.array_distinct(ws)).alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") >= need)


def item_stopgrams(index, max_item_share: float, min_count: int) -> DataFrame:
    """(gram, n_items): n-grams of an index held by more than a share of items and by min_count at least."""
    n = index.items.count()
    return index.postings.select("gram", F.col("fan_out").alias("n_items")).distinct().where((F.col("n_items") > max_item_share * n) & (F.col("n_items") >= min_count))
