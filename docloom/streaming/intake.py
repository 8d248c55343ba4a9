"""Document intake as a stream: each micro-batch is judged against the knowledge before it, then appended.

A batch is keyed by its id, so one that runs again after a failure replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.knowledge import vendor_amounts


def process_folder(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, judge: Callable[[DataFrame, DataFrame | None], DataFrame]) -> StreamingQuery:
    """Read JSON documents as they arrive; `judge(batch, accepted before it)` adds status. All results go to `store`."""

    def take(batch: DataFrame, batch_id: int) -> None:
        before = accepted(spark, store, batch_id)  # a batch that runs again must not see its own rows
        judge(batch, before).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return spark.readStream.schema(schema).json(source).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accepted(spark: SparkSession, store: str, before: int | None = None) -> DataFrame | None:
    """What has been accepted so far, or before a batch; after a restart this is read from the store again."""
    try:
        rows = spark.read.parquet(store)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    rows = rows.where(F.col("status") == "accepted")
    return rows if before is None else rows.where(F.col("batch") < before)


def amounts_before(before: DataFrame | None) -> DataFrame | None:
    """Vendor statistics rebuilt from all accepted documents; medians and spreads are not patched in place."""
    return None if before is None else vendor_amounts(before.select("vendor", "total"))


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of an event stream by time window and kind, late events up to `late` counted (an addition)."""
    ts = events.withWatermark("ts", late) if events.isStreaming else events
    return ts.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
