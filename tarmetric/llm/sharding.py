"""Sharding by global byte prefix sums: contiguous shards of nearly equal size.

Rows are put in order of (hash of the text, doc_id, size) by a range exchange and written once with the number
of their range; only ids, sizes and checksums move, never texts. The totals of the ranges, one row each, give
every range its start in the global order; with the running sum inside a range each row knows its bytes
before. The row's shard is where the middle of its bytes falls among equal targets, so shards are contiguous
and differ from the target by less than one row at each end. Equal texts stand next to each other, so a group
of them is cut only where a target falls inside it.

Cases: a null text has no bytes and checksum 0; a null doc_id sorts first; equal rows take neighbouring slots;
a row larger than a shard's target may leave a shard empty; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tarmetric.llm.common import table
from tarmetric.session import materialize

SHARDS = 8


def ordered_rows(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, order key and the number of the range a row lies in."""
    bytes_ = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(bytes_) + F.lit(1)).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"), F.xxhash64("text").alias("_h"))
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "_h", "doc_id", "size").withColumn("_range", F.spark_partition_id())
    return materialize(ranged, "sharding-order")


def shard_rows(docs: DataFrame, shards: int = SHARDS, parts: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    rows = ordered_rows(docs, parts)
    totals = rows.groupBy("_range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # one row a range
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    starts = totals.select(
        "_range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_bytes"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_rows"),
        F.sum("bytes").over(every).alias("_total"),
    )
    inside = W.partitionBy("_range").orderBy("_h", "doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.select("*", F.sum("size").over(inside).alias("_sum"), F.count("*").over(inside).alias("_n")).join(F.broadcast(starts), "_range")
    # twice the middle of the row's bytes, to stay in whole numbers
    middle = 2 * (F.col("_bytes") + F.col("_sum")) - F.col("size")
    shard = F.least(F.floor(middle.cast("decimal(30,0)") * shards / (2 * F.col("_total"))).cast("int"), F.lit(shards - 1))
    placed = materialize(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("_rows") + F.col("_n") - 1).alias("_place")), "sharding-places")
    first = placed.groupBy("shard").agg(F.min("_place").alias("_first"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_place") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
