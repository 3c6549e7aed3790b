"""Contiguous balanced shards by global prefix sums of byte sizes, with DataFrame functions alone.

Rows are put in the order of their text's digest, then id: equal texts lie side by side. Range partitions of that order
(sampled, so a hot text or id is spread over several) each sum up their sizes; sums over the partitions before, plus the
running sum within, give every row's byte offset, and the shard is its place between equal cuts of the total. The rows of
equal texts that a cut would part go together to the side that holds the middle of them, if they're at most 1/GROUP_SHARE of
a shard; there are no more such groups than cuts. The law is near equal bytes: a group kept whole moves a cut by half its size
at most, so no shard is off by more than 1/GROUP_SHARE of its target, while whole groups up to a shard's size would leave
shards of half and of one and a half targets. Slots are row numbers within the shard, from the same kind of sums.

A row's size is its text's UTF-8 bytes (none for null) plus 1, so it's never zero. Repeated rows each get their own slot, an
empty table gives no rows; columns beyond id and text are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed, table

SHARDS, GROUP_SHARE = 16, 8


def shard(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = checkpointed(df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.md5(text).alias("digest"), F.monotonically_increasing_id().alias("row")))
    order = ["digest", "id", "row"]
    parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(sized.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    # One row a partition: at most spark.sql.shuffle.partitions rows pass through the unpartitioned window.
    sums = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(W.partitionBy()).alias("total"))
    within = W.partitionBy("part").orderBy(*order)
    placed = ranged.join(F.broadcast(sums), "part").select("id", "size", "crc", "digest", "total", (F.col("bytes_before") + F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("at"), (F.col("rows_before") + F.row_number().over(within) - 1).alias("number"))
    cut = lambda c: F.expr(f"cast(least({shards - 1}, ({c}) * {shards} div total) as int)")
    placed = checkpointed(placed.withColumn("shard", cut("at")))
    groups = placed.groupBy("digest").agg(F.min("shard").alias("first"), F.max("shard").alias("last"), F.min("at").alias("at"), F.sum("size").alias("bytes"), F.max("total").alias("total"))
    parted = groups.where((F.col("first") < F.col("last")) & (F.col("bytes") * shards * GROUP_SHARE <= F.col("total"))).select("digest", cut("at + bytes div 2").alias("whole"))
    # Every parted group holds one of the cuts, so there are fewer of them than shards.
    final = placed.join(F.broadcast(parted), "digest", "left").withColumn("shard", F.coalesce("whole", "shard"))
    starts = final.groupBy("shard").agg(F.min("number").alias("start"))
    return final.join(F.broadcast(starts), "shard").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("number") - F.col("start")).cast("long").alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
