"""Incremental assembly: each arriving batch replaces the rows of the documents it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from plinth.sources.writers import upsert_table


def stream_upserts(spark: SparkSession, source: str, schema: StructType, target: str, key: str, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Follow a folder of JSON lines and merge each batch into the table at target, which ``read_table`` reads.

    order: of several rows of a key in one batch the one that is last by this
    column counts.  A batch that is run again after a failure gives the same
    table, since it replaces rows by key and a failure leaves the version before.
    """

    def merge(batch: DataFrame, _: int) -> None:
        if order:
            n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
            batch = batch.withColumn("_n", n).where("_n = 1").drop("_n")
        upsert_table(batch, target, key)

    rows = spark.readStream.schema(schema).json(source)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
