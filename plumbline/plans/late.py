"""Events that arrive after their day was built.

A journal names the touched accounts and, for each, the first day that may change. From that day on the
account is built again from all its events; everything else in the partitions stays as it was stored.
Partitions before the first touched day of all keep their files. The journal is kept beside the history
(``_journal``), so that it can be seen what was built again and a cube can follow.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import calendar_day
from plumbline.plans.lifecycle import DATELIST_COLUMNS, DEFAULT_EDGES, Sources, account_datelist
from plumbline.sources.storage import enter, entries, shared_folder, write_manifest

JOURNAL = "_journal"


def touched_accounts(sources: Sources, late: Sources) -> DataFrame:
    """``account_id, first_day``: what ``late`` rows touch. ``sources`` holds all rows, these included.

    A closure, reopening or activity changes its own day and those after it. A creation may change an
    account's user and type, which stand in all its days: it touches the account from its earliest
    creation on.
    """
    own = [
        rows.select("account_id", calendar_day(day).alias("day"))
        for rows, day in ((late.closed, "closed_ts"), (late.reopened, "reopened_ts"), (late.transactions, "txn_date"))
    ]
    ids = late.created.select("account_id").distinct()
    created = sources.created.join(ids, "account_id", "left_semi").select(
        "account_id", calendar_day("created_ts").alias("day")
    )
    every = created
    for rows in own:
        every = every.unionByName(rows)
    return every.groupBy("account_id").agg(F.min("day").alias("first_day"))


def repair(
    spark: SparkSession,
    path: str,
    sources: Sources,
    late: Sources,
    last_day: dt.date,
    edges: Sequence[int] = DEFAULT_EDGES,
) -> list[dt.date]:
    """Bring the history at ``path``, built up to ``last_day``, to what ``sources`` say now.

    Returns the days whose partitions were replaced, at most one for each stored day. The journal is
    written before anything changes and read back, so all steps see the same accounts; a repair that
    failed can be run again.
    """
    journal = f"{shared_folder(spark, 'journal')}/accounts"
    touched_accounts(sources, late).where(F.col("first_day") <= F.lit(last_day)).write.parquet(journal)
    touched = spark.read.parquet(journal)
    first = touched.agg(F.min("first_day")).first()[0]
    if first is None:
        return []
    enter(touched.withColumn("built_at", F.current_timestamp()), f"{path}/{JOURNAL}")

    def of_touched(rows: DataFrame) -> DataFrame:
        return rows.join(touched.select("account_id"), "account_id", "left_semi")

    own = Sources(*map(of_touched, (sources.created, sources.closed, sources.reopened, sources.transactions)))
    again = account_datelist(own, last_day, edges).join(touched, "account_id")
    again = again.where(F.col("snapshot_date") >= F.col("first_day")).select(*DATELIST_COLUMNS)
    stored = spark.read.parquet(path).withColumn("snapshot_date", F.col("snapshot_date").cast("date"))
    # Only partitions that may change are read, and only these are written.
    stored = stored.where(F.col("snapshot_date").between(F.lit(first), F.lit(last_day))).select(*DATELIST_COLUMNS)
    changes = touched.select(F.col("account_id").alias("_account"), "first_day")
    same = stored.join(
        changes, (F.col("account_id") == F.col("_account")) & (F.col("snapshot_date") >= F.col("first_day")), "left_anti"
    )
    (
        same.unionByName(again)
        .hint("rebalance", "snapshot_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("snapshot_date")
        .parquet(path)
    )
    write_manifest(spark, path)
    return [first + dt.timedelta(days=n) for n in range((last_day - first).days + 1)]


def journal(spark: SparkSession, path: str) -> DataFrame | None:
    """``account_id, first_day, built_at`` of all repairs of a history; none if there were none."""
    return entries(spark, f"{path}/{JOURNAL}")
