"""Sharding: contiguous shards of near equal bytes, from global prefix sums.

Documents are put in the order of doc_id by range partitions.  Sizes are summed
within each partition; the running totals of the partitions, one row each, give
every document the bytes that come before it in the whole corpus.  The corpus
is cut at equal targets: a document goes to the shard in which its middle lies.

Edge cases: a null text has no bytes, a null doc_id comes first.  Rows with the
same doc_id are ordered by size, checksum and place, so a repeated key cannot
fill one partition.  A document larger than a target leaves shards without
rows.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.llm._base import Scratch, table

LAW = "bytes"
#: Rows that one task of the range exchange should order.
ROWS_A_TASK = 1_000_000


def shard_by_bytes(docs: DataFrame, shards: int, *, overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (place in the shard) of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    order = ["doc_id", "size", "text_crc32", "_tie"]
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    # as many tasks as the rows need, whatever the session's default
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // ROWS_A_TASK))
    # written, so that every later step sees the same partitions
    ranged = scratch.table(sized.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        ranged.groupBy("_part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .select(
            "_part",
            F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("_bytes"),
            F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("_rows"),
            F.sum("bytes").over(Window.partitionBy()).alias("_all"),
        )
    )
    within = Window.partitionBy("_part").orderBy(*order)
    # one row for each partition of the range exchange: as small as the number of tasks
    placed = ranged.join(F.broadcast(before), "_part").select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("_rows") + F.row_number().over(within) - 1).alias("row"),
        (F.col("_bytes") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
        "_all",
    )
    cut = F.least(F.lit(shards - 1).cast("long"), F.expr(f"((2 * start + size) * {int(shards)}L) div (2 * _all)"))
    placed = scratch.table(placed.select("doc_id", "size", "text_crc32", "row", cut.cast("int").alias("shard")))
    first = placed.groupBy("shard").agg(F.min("row").alias("_first"))
    # at most one row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("_first")).cast("long").alias("slot")
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), 24).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
