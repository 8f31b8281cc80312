"""The activity panel of the account model, kept up from a stream of events.

A day is emitted once, when the watermark has passed its end: from then on no
accepted event can change it, which is what the one-day-at-a-time build needs.
State holds one counter per account and open day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_activity(events: DataFrame, key: str, ts: str, lateness: str = "1 day") -> DataFrame:
    """``(key, txn_date, txn_count)`` per tumbling day. Events later than ``lateness`` are dropped.

    Event time must be an instant, so a zoneless timestamp is read in the session's zone.
    """
    return (
        events.withColumn("_at", F.col(ts).cast("timestamp"))
        .withWatermark("_at", lateness)
        .groupBy(F.window("_at", "1 day").alias("_day"), key)
        .agg(F.count(F.lit(1)).alias("txn_count"))
        .select(key, F.to_date("_day.start").alias("txn_date"), "txn_count")
    )


def append_closed_days(activity: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is available now and stop. A restart resumes from ``checkpoint``."""
    return (
        activity.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
