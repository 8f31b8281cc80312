"""The account history kept up from a stream of account events, each batch once.

Events have ``kind`` (created, closed, reopened, activity), ``account_id``, ``user_id``, ``account_type``,
``ts`` and ``txn_count`` (of activity; none counts as one). A batch is stored by day and batch, then every
day that it closes is built from the day before (``incremental.build_day``), then it is recorded. All
three replace what an attempt before them left, and a recorded batch is not done again, so a stream that
was killed anywhere and started again ends up with the same history.

A day is closed when an event more than ``wait`` days after it was seen. Rows of closed days, and rows
without a time, are late: they are kept and counted apart instead of dropped, and ``repair_late`` takes
them in. The stream holds no state but the newest record.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions import calendar_day
from plumbline.plans import late
from plumbline.plans.incremental import build_day
from plumbline.plans.lifecycle import DEFAULT_EDGES, Sources, account_datelist
from plumbline.sources.storage import committed, delete, enter, entries, exists, publish

EVENTS = (
    "kind string, account_id long, user_id long, account_type string, ts timestamp_ntz, txn_count long"
)
_STORED = f"{EVENTS}, late boolean, day date, batch long"
_RECORD = "query string, batch long, closed_through date, seen_through date, rows long, late_rows long"
#: Records that are kept, as many as a stream keeps of its own.
KEPT = 100


class ForeignStream(RuntimeError):
    """The store was written by a stream with another checkpoint, whose batches are numbered anew."""


def account_events(sources: Sources) -> DataFrame:
    """The four inputs of the account model as one stream of events."""
    parts = [
        sources.created.select("account_id", "user_id", "account_type", F.col("created_ts").alias("ts"), F.lit("created").alias("kind")),
        sources.closed.select("account_id", F.col("closed_ts").alias("ts"), F.lit("closed").alias("kind")),
        sources.reopened.select("account_id", F.col("reopened_ts").alias("ts"), F.lit("reopened").alias("kind")),
        sources.transactions.select(
            "account_id", F.col("txn_date").cast("timestamp_ntz").alias("ts"), F.lit("activity").alias("kind"), "txn_count"
        ),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    return every.selectExpr(*(f"cast({f.split()[0]} AS {f.split()[1]})" for f in EVENTS.split(", ")))


def as_sources(events: DataFrame) -> Sources:
    """Events as the inputs of the account model; activity is summed by account and day."""

    def of(kind: str, *columns: str) -> DataFrame:
        return events.where(F.col("kind") == kind).select("account_id", *columns, F.col("ts").alias(f"{kind}_ts"))

    activity = events.where("kind = 'activity'").groupBy("account_id", calendar_day("ts").alias("txn_date"))
    return Sources(
        of("created", "user_id", "account_type"), of("closed"), of("reopened"),
        activity.agg(F.sum(F.coalesce("txn_count", F.lit(1))).alias("txn_count")),
    )


def last_record(spark: SparkSession, path: str) -> Row | None:
    """The record of the newest finished batch, which says what is closed; none before the first."""
    done = committed(spark, f"{path}/_batches")
    return spark.read.schema(_RECORD).parquet(done[-1]).first() if done else None


def _record(spark: SparkSession, path: str, row: tuple) -> None:
    folder = f"{path}/_batches"
    rows = spark.createDataFrame([row], _RECORD).coalesce(1)
    rows.write.mode("overwrite").parquet(f"{folder}/batch-{row[1]:019d}")
    for old in committed(spark, folder)[:-KEPT]:
        delete(spark, old)


def _stored(spark: SparkSession, path: str, folder: str = "") -> DataFrame:
    base = f"{path}/events"
    at = f"{base}/{folder}"
    reader = spark.read.schema(_STORED).option("basePath", base)
    return reader.parquet(at) if exists(spark, at) else spark.createDataFrame([], _STORED)


def _on_time(spark: SparkSession, path: str, day: dt.date | None = None) -> DataFrame:
    return _stored(spark, path, "late=false" if day is None else f"late=false/day={day}")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """What came after its day was closed, or without a time, with ``day`` and ``batch``."""
    return _stored(spark, path, "late=true").drop("late")


def history(spark: SparkSession, path: str) -> DataFrame | None:
    """The history of all closed days; none before the first."""
    last = last_record(spark, path)
    if last is None or last.closed_through is None:
        return None
    rows = spark.read.parquet(f"{path}/history")
    rows = rows.withColumn("snapshot_date", F.col("snapshot_date").cast("date"))
    return rows.where(F.col("snapshot_date") <= F.lit(last.closed_through))


def _close(
    spark: SparkSession, path: str, closed: dt.date | None, through: dt.date, edges: Sequence[int]
) -> dt.date | None:
    """Build the days after ``closed`` up to ``through``. Until an account was created none is closed."""
    if closed is None:
        known = _on_time(spark, path).where(F.col("day") <= F.lit(through))
        if known.where("kind = 'created' AND account_type IS NOT NULL AND account_id IS NOT NULL").isEmpty():
            return None
        publish(account_datelist(as_sources(known), through, edges), f"{path}/history", "snapshot_date")
        return through
    while closed < through:
        closed += dt.timedelta(days=1)
        build_day(spark, f"{path}/history", as_sources(_on_time(spark, path, closed)), closed, edges)
    return closed


def take_batch(
    batch: DataFrame, number: int, path: str, wait: int = 1, edges: Sequence[int] = DEFAULT_EDGES, query: str = ""
) -> None:
    """Store one batch, build the days it closes, and record it; nothing if it was recorded before."""
    spark = batch.sparkSession
    last = last_record(spark, path)
    if last is not None and last.query != query:
        raise ForeignStream(f"{path} belongs to stream {last.query}, not to {query}")
    if last is not None and number <= last.batch:
        return
    closed, seen = (last.closed_through, last.seen_through) if last is not None else (None, None)
    day = calendar_day("ts")
    is_late = day.isNull() if closed is None else day.isNull() | (day <= F.lit(closed))
    rows = batch.select(*(f.split()[0] for f in EVENTS.split(", "))).withColumns(
        {"late": is_late, "day": day, "batch": F.lit(number).cast("long")}
    )
    if batch.isEmpty():
        _record(spark, path, (query, number, closed, seen, 0, 0))
        return
    counts = Observation()
    counted = rows.observe(
        counts, F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late"),
        F.max(F.when(~F.col("late"), F.col("day"))).alias("seen"),
    )
    (
        counted.hint("rebalance", "late", "day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("late", "day", "batch")
        .parquet(f"{path}/events")
    )
    found = counts.get
    seen = max((d for d in (seen, found["seen"]) if d is not None), default=None)
    if seen is not None:
        through = seen - dt.timedelta(days=wait + 1)
        if closed is None or through > closed:
            closed = _close(spark, path, closed, through, edges)
    _record(spark, path, (query, number, closed, seen, found["rows"], found["late"]))


def keep_history(
    events: DataFrame, path: str, checkpoint: str, wait: int = 1, edges: Sequence[int] = DEFAULT_EDGES
) -> StreamingQuery:
    """Take in what is available now and stop. A restart goes on from ``checkpoint``."""

    def take(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        take_batch(batch, number, path, wait, edges, query)

    return (
        events.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def close_through(spark: SparkSession, path: str, day: dt.date, edges: Sequence[int] = DEFAULT_EDGES) -> None:
    """Close the days up to ``day`` although nothing later was seen, as at the end of a stream."""
    last = last_record(spark, path)
    if last is None or (last.closed_through is not None and last.closed_through >= day):
        return
    closed = _close(spark, path, last.closed_through, day, edges)
    _record(spark, path, tuple((last.asDict() | {"closed_through": closed}).values()))


def repair_late(spark: SparkSession, path: str, edges: Sequence[int] = DEFAULT_EDGES) -> list[dt.date]:
    """Take the late rows that came since the last repair into the closed days. Returns the days replaced."""
    last = last_record(spark, path)
    if last is None or last.closed_through is None:
        return []
    before = entries(spark, f"{path}/_repaired")
    done = before.agg(F.max("batch")).first()[0] if before is not None else -1
    rows = late_rows(spark, path).where((F.col("batch") > done) & F.col("day").isNotNull())
    every = _on_time(spark, path).unionByName(_stored(spark, path, "late=true")).where(F.col("day").isNotNull())
    known = as_sources(every).up_to(last.closed_through)
    days = late.repair(spark, f"{path}/history", known, as_sources(rows), last.closed_through, edges)
    enter(spark.createDataFrame([(last.batch,)], "batch long"), f"{path}/_repaired")
    return days
