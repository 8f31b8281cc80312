"""Quality counters by partition, stored, so that a new day is checked by reading that day.

What a check counts within one partition (repeated keys of a day, missing states, values out of range) adds
up over partitions. The counters of a partition are entered when it is written and again when it is
replaced; the newest entry of a partition stands for it, and the report is a sum over a small table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.storage import enter, entries

#: The check that counts keys which stand in more than one row of their partition.
GRAIN = "grain"


def partition_counters(
    rows: DataFrame, partition: str, keys: Sequence[str], failures: Mapping[str, str]
) -> DataFrame:
    """``partition, check, failures, rows`` of each partition in ``rows``.

    ``failures`` maps a check to the predicate of a failing row; NULL does not fail. ``keys`` identify a
    row within its partition. One shuffle, by partition and key, serves all checks: predicates are summed
    by key in tasks before it. A partition without rows has no counters.
    """
    if GRAIN in failures:
        raise ValueError(f"{GRAIN!r} is the check of the keys")
    counted = {f"_{n}": F.count_if(F.expr(p)) for n, p in enumerate(failures.values())}
    by_key = rows.groupBy(F.col(partition).cast("string").alias("partition"), *keys).agg(
        F.count(F.lit(1)).alias("_rows"), *(c.alias(n) for n, c in counted.items())
    )
    by_partition = by_key.groupBy("partition").agg(
        F.sum("_rows").alias("rows"), F.count_if(F.col("_rows") > 1).alias("_grain"), *(F.sum(n).alias(n) for n in counted)
    )
    checks = F.array(*(
        F.struct(F.lit(check).alias("check"), F.col(column).alias("failures"))
        for check, column in [(GRAIN, "_grain"), *zip(failures, counted)]
    ))
    return by_partition.select("partition", "rows", F.inline(checks)).select("partition", "check", "failures", "rows")


def record(counters: DataFrame, path: str) -> None:
    """Enter the counters of some partitions; they replace what was entered for these before."""
    enter(counters.withColumn("recorded_at", F.current_timestamp()), path)


def state(spark: SparkSession, path: str) -> DataFrame:
    """The newest counters of each partition and check."""
    found = entries(spark, path)
    if found is None:
        raise FileNotFoundError(f"no counters were recorded under {path}")
    newest = F.max_by(F.struct("failures", "rows"), "recorded_at").alias("newest")
    return found.groupBy("partition", "check").agg(newest).select("partition", "check", "newest.failures", "newest.rows")


def merged(spark: SparkSession, path: str) -> DataFrame:
    """``check, failures, rows, partitions, worst_partition``: the report over all partitions. The worst is the
    one with most failures, the first among equals; NULL without failures."""
    worst = F.min_by("partition", F.struct(-F.col("failures"), F.col("partition")))
    return state(spark, path).groupBy("check").agg(
        F.sum("failures").alias("failures"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("partitions"),
        F.when(F.sum("failures") > 0, worst).alias("worst_partition"),
    )
