"""Event queries; the batch form of the streaming job."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.plans.registry import query
from tallyforge.sources import testbed as T
from tallyforge.streaming.events import windowed


@query("q_event_windows", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 3) as total from events group by 1, 2")
def q_event_windows(spark, sf_dir):
    return windowed(T.table(spark, sf_dir, "events")).withColumn("total", F.round("total", 3))
