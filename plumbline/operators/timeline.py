"""Dense and sparse timelines per entity.

The dense operators work on one row per (entity, day). :func:`segments_to_days`
turns the sparse form (one row per stretch of days during which nothing
changes) into the dense one inside the task, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def place_by(rows: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Rows placed by ``keys`` over ``partitions``, by default the session's shuffle partitions.

    For rows that are about to be unfolded. They are few and small before that, so
    adaptive execution would merge them into few tasks, judging by a size that
    is about to grow a hundredfold; a fixed number of partitions is left alone. Choose it
    by unfolded rows: accounts times days, over the rows that a task should hold.
    """
    count = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(count, *keys)


def spine(entities: DataFrame, first: str, last: Column, day: str = "day") -> DataFrame:
    """One row per entity and day from its ``first`` column to ``last``."""
    days = F.sequence(F.col(first), last, F.expr("interval 1 day"))
    return entities.where(F.col(first) <= last).withColumn(day, F.explode(days))


def spine_with_facts(
    entities: DataFrame, facts: DataFrame, key: str, first: str, last: Column,
    fact_day: str, value: str, day: str = "day",
) -> DataFrame:
    """``key, day, value``: the spine of each entity with its fact of the day, or NULL.

    ``facts`` has one row per key and day. They meet their entity before its days are unfolded, as
    a map by day that the calendar bounds, so no dense row is shuffled or broadcast.
    """
    by_day = facts.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct(fact_day, value))).alias("_facts")
    )
    met = place_by(entities.select(key, first), key).join(by_day, key, "left")
    return spine(met, first, last, day).select(key, day, F.col("_facts")[F.col(day)].alias(value))


def segments_to_days(segments: DataFrame, start: str, end: str, day: str) -> DataFrame:
    """Unfold ``[start, end]`` stretches into days, dropping the two bounds."""
    days = F.sequence(F.col(start), F.col(end), F.expr("interval 1 day"))
    kept = [c for c in segments.columns if c not in (start, end)]
    return segments.select(F.explode(days).alias(day), *kept)


def carry_forward(
    rows: DataFrame, keys: Sequence[str], order: str, value: str, name: str
) -> DataFrame:
    """The last non-NULL ``value`` up to and including each row."""
    upto = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(upto))


def rolling_sum(
    rows: DataFrame, keys: Sequence[str], order: str, value: str, size: int, name: str
) -> DataFrame:
    """Sum over the last ``size`` rows; partial at the start of a timeline."""
    last = W.partitionBy(*keys).orderBy(order).rowsBetween(1 - size, W.currentRow)
    return rows.withColumn(name, F.sum(value).over(last))


def rolling_mean_full(
    rows: DataFrame, keys: Sequence[str], order: str, value: str, size: int, name: str
) -> DataFrame:
    """Mean over the last ``size`` rows; NULL until that many exist.

    Without ``keys`` all rows meet in one task: only for a series with one row
    per calendar day, whose length the calendar bounds.
    """
    last = W.partitionBy(*keys).orderBy(order).rowsBetween(1 - size, W.currentRow)
    mean = F.when(F.count(F.lit(1)).over(last) == size, F.avg(value).over(last))
    return rows.withColumn(name, mean)


def last_event_per_day(
    events: DataFrame, keys: Sequence[str], day: str, order: Sequence[Column]
) -> DataFrame:
    """The last event of each (entity, day) by an arbitrary ordering, whole rows kept."""
    newest = W.partitionBy(*keys, day).orderBy(*order)
    return (
        events.withColumn("_position", F.row_number().over(newest))
        .where("_position = 1")
        .drop("_position")
    )
