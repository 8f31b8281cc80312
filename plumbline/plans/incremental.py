"""The account history one day at a time.

A day needs the previous day's partition and two more: activity leaves the
7-day and 28-day windows exactly 7 and 28 days after it happened, so

    l7(D) = l7(D-1) + l1(D) - l1(D-7)      l28(D) = l28(D-1) + l1(D) - l1(D-28)

Three partitions are read instead of 28 and one is written, in place, so a run
can be repeated. Events must arrive on their day; those that come late for a day
already built are taken in by ``late.repair``, which builds the touched accounts
again from their first touched day on. Building a day leaves later ones as they
are, so until they are built again they still stand for the old state of that day.

A day is not built on a gap: without the partition of the day before, accounts
would be lost, and without those of 7 and 28 days before, activity would never
leave its window.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import age_bucket, calendar_day
from plumbline.operators.timeline import place_by
from plumbline.plans import active_users
from plumbline.plans.lifecycle import (
    DATELIST_COLUMNS,
    DEFAULT_EDGES,
    PRECEDENCE,
    Sources,
    _event_rank,
    _opens,
)
from plumbline.sources.storage import write_manifest


def next_day(
    history: DataFrame, sources: Sources, day: dt.date, edges: Sequence[int] = DEFAULT_EDGES
) -> DataFrame:
    """The partition of ``day``, from the history before it and the events of that day.

    Everything is keyed by account and reduced by one aggregate over one union:
    a single shuffle, partially aggregated, instead of a join per input.
    """
    yesterday, week_ago, month_ago = (day - dt.timedelta(days=n) for n in (1, 7, 28))
    first, after = F.lit(day), F.date_add(F.lit(day), 1)
    snapshot = F.col("snapshot_date")

    def from_yesterday(column: str):
        return F.when(snapshot == F.lit(yesterday), F.col(column)).alias(column)

    past = history.where(snapshot.isin(yesterday, week_ago, month_ago)).select(
        "account_id",
        *(
            from_yesterday(c)
            for c in ("user_id", "account_type", "created_date", "is_open", "l7", "l28")
        ),
        F.when(snapshot == F.lit(week_ago), F.col("l1")).alias("left_7"),
        F.when(snapshot == F.lit(month_ago), F.col("l1")).alias("left_28"),
    )

    def on_the_day(rows: DataFrame, column: str) -> DataFrame:
        return rows.where((F.col(column) >= first) & (F.col(column) < after))

    created = (
        on_the_day(sources.created, "created_ts")
        .where(F.col("account_type").isNotNull())
        .select(
            "account_id",
            "user_id",
            "account_type",
            calendar_day("created_ts").alias("created_date"),
            _event_rank("created_ts", F.lit(PRECEDENCE["created"])).alias("creation_rank"),
        )
    )
    changes = [
        on_the_day(rows, ts).select(
            "account_id", _event_rank(ts, F.lit(PRECEDENCE[kind])).alias("change_rank")
        )
        for kind, rows, ts in (
            ("closed", sources.closed, "closed_ts"),
            ("reopened", sources.reopened, "reopened_ts"),
        )
    ]
    activity = on_the_day(sources.transactions, "txn_date").select(
        "account_id", F.col("txn_count").cast("long").alias("txn_count")
    )
    everything = past
    for part in (created, *changes, activity):
        everything = everything.unionByName(part, allowMissingColumns=True)

    accounts = everything.groupBy("account_id").agg(
        F.max("user_id").alias("user_id"),
        F.max("account_type").alias("account_type"),
        F.min("created_date").alias("created_date"),
        F.max("is_open").alias("was_open"),
        F.max("l7").alias("l7"),
        F.max("l28").alias("l28"),
        F.max("left_7").alias("left_7"),
        F.max("left_28").alias("left_28"),
        F.min("creation_rank").alias("creation_rank"),
        F.max("change_rank").alias("change_rank"),
        F.sum("txn_count").alias("txn_count"),
    )
    # An account that existed yesterday is not created again: only its changes count.
    is_new = F.col("was_open").isNull()
    rank = F.when(is_new, F.greatest("creation_rank", "change_rank")).otherwise(
        F.col("change_rank")
    )
    zero = F.lit(0)
    l1 = F.when(F.col("txn_count").isNotNull(), 1).otherwise(0)

    def rolled(window: str, left: str):
        return F.coalesce(window, zero) + l1 - F.coalesce(left, zero)

    age = F.date_diff(F.lit(day), F.col("created_date"))
    return (
        accounts.where(F.col("created_date").isNotNull())
        .select(
            F.lit(day).alias("snapshot_date"),
            "account_id",
            "user_id",
            "account_type",
            "created_date",
            age.alias("account_age"),
            age_bucket(age, edges).alias("account_age_bucket"),
            F.coalesce(_opens(rank), F.col("was_open")).alias("is_open"),
            l1.alias("l1"),
            rolled("l7", "left_7").alias("l7"),
            rolled("l28", "left_28").alias("l28"),
            F.coalesce("txn_count", zero).alias("txn_count"),
        )
        .select(*DATELIST_COLUMNS)
    )


class MissingDay(RuntimeError):
    """A partition that a day is built from is not in the store. Nothing was written."""


def require_days(history: DataFrame, day: dt.date) -> None:
    """Raise unless the store holds what ``day`` is built from: the day before, and those 7 and 28
    days before where the store goes back that far.

    Brings at most three dates and the first stored one to the driver, read from the partitions.
    """
    before = [day - dt.timedelta(days=n) for n in (1, 7, 28)]
    date = F.col("snapshot_date").cast("date")
    found = history.agg(F.min(date).alias("first"), F.collect_set(F.when(date.isin(*before), date)).alias("days")).first()
    needed = [d for d in before if d == before[0] or (found.first is not None and d >= found.first)]
    missing = sorted(set(needed) - set(found.days))
    if missing:
        raise MissingDay(f"{day} needs the partitions of {', '.join(map(str, missing))}: build them first")


def build_day(
    spark: SparkSession,
    path: str,
    sources: Sources,
    day: dt.date,
    edges: Sequence[int] = DEFAULT_EDGES,
) -> None:
    """Write the partition of ``day`` into the store at ``path``, replacing only that partition."""
    history = spark.read.parquet(path)
    require_days(history, day)
    partition = next_day(history, sources, day, edges)
    (
        partition.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("snapshot_date")
        .parquet(path)
    )
    write_manifest(spark, path)


def day_stretches(history: DataFrame, unit: str = "month") -> DataFrame:
    """The stored days of ``history`` as stretches of one day, for ``active_users.active_user_cube``.

    A day's partition has every account there is, so it says all about its users: their open accounts,
    their activity and the period of the first of their accounts.
    """
    group = ("user_id", "account_type", "account_age_bucket", F.col("snapshot_date").cast("date").alias("start_day"))
    flag = {f: F.max((F.col(c) > 0).cast("int")).alias(f) for f, c in zip(active_users.FLAGS, ("l1", "l7", "l28"))}
    by_group = history.groupBy(*group).agg(
        F.max("is_open").alias("is_open"), F.min("created_date").alias("_created"), *flag.values()
    )
    placed = place_by(by_group, "user_id")
    first = F.min("_created").over(W.partitionBy("user_id", "start_day"))
    return placed.withColumns({"signup_cohort": F.trunc(first, unit), "end_day": F.col("start_day")}).drop("_created")


def build_cube_days(
    spark: SparkSession, path: str, cube_path: str, days: Sequence[dt.date], unit: str = "month",
    account_types: Sequence[str] | None = None,
) -> None:
    """Write the cube of ``days`` from the history's partitions of these days, replacing only theirs.

    Distinct users cannot be carried from one day's counts to the next without each user's state of
    both. The state of a day is in its partition, so one partition is read for each day and its
    accounts are shuffled once, where taking yesterday's states out and putting today's in would read
    and shuffle two.
    """
    history = spark.read.parquet(path).where(F.col("snapshot_date").cast("date").isin(*days))
    cube = active_users.active_user_cube(day_stretches(history, unit), account_types)
    (
        cube.hint("rebalance", "snapshot_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("snapshot_date")
        .parquet(cube_path)
    )
    write_manifest(spark, cube_path)
