"""Incremental jobs: windowed totals of events, and rows that are merged into a bucketed table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.store import BucketTable
from tallyforge.operators.tables import newest


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of each event type by tumbling windows of event time; later than ``late`` is left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = timed.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def merge_batches(stream: DataFrame, table: BucketTable, order: str, checkpoint: str, name: str = "stream"):
    """A query that merges each batch into ``table``: of the rows of a key the newest by ``order`` stays.

    A batch reads and writes the buckets of its keys alone. The table notes the last batch of ``name``, so one that runs
    again after a failure changes nothing, and a row that comes late doesn't replace a newer one.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        table.change(batch, lambda old, new: newest(old, new, table.key, order), (name, epoch))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
