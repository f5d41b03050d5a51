"""The union gate over a stream: stateless scoring per micro-batch, exact merges of hits and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftgram.config import ScanConfig
from siftgram.operators import gates
from siftgram.operators.index import Index
from siftgram.operators.matching import match
from siftgram.operators.segments import segments, sub_documents
from siftgram.plans.scan import CARRIED


def scored(stream: DataFrame, index: Index, cfg: ScanConfig, shard: str, row_index: str) -> DataFrame:
    """A streaming DataFrame of sub-documents with their union gate; the index is static."""
    parts = sub_documents(segments(stream, cfg, shard, row_index), cfg)
    return gates.union_gate(match(parts, index, keep=CARRIED, plan="kernel"), cfg)


def run(stream: DataFrame, index: Index, cfg: ScanConfig, shard: str, row_index: str, out: str, checkpoint: str) -> StreamingQuery:
    """Writes flagged sub-documents and hits of each micro-batch under its number, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.where("union_flag").drop("hits").write.mode("overwrite").parquet(f"{out}/flagged/batch={number}")
        gates.hit_rows(batch, ["shard"]).distinct().write.mode("overwrite").parquet(f"{out}/hits/batch={number}")
        batch.groupBy("shard").agg(F.count_if(~F.col("skipped")).alias("scanned"), F.count_if("union_flag").alias("contaminated")).write.mode("overwrite").parquet(f"{out}/counts/batch={number}")
        batch.unpersist()

    return scored(stream, index, cfg, shard, row_index).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark, out: str) -> DataFrame:
    """Scanned and contaminated per shard over all batches."""
    return spark.read.parquet(f"{out}/counts").groupBy("shard").agg(F.sum("scanned").alias("scanned"), F.sum("contaminated").alias("contaminated"))
