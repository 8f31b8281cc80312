"""Daily counts with a smoothed line."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import calendar_day
from plumbline.operators.timeline import rolling_mean_full


def daily_counts(rows: DataFrame, ts: str, day: str, name: str) -> DataFrame:
    """Rows per calendar day, in date order."""
    return rows.groupBy(calendar_day(ts).alias(day)).agg(F.count(F.lit(1)).alias(name)).orderBy(day)


def smoothed_daily_counts(
    rows: DataFrame,
    ts: str,
    day: str,
    name: str,
    first: dt.date,
    last: dt.date,
    size: int = 7,
) -> DataFrame:
    """Daily counts from ``first`` to ``last`` and their mean over ``size`` days.

    The window is not partitioned. It runs on the counts, whose number the two
    bounds fix, never on the rows. The clip is on the timestamp itself so that
    it reaches the scan.
    """
    inside = rows.where((F.col(ts) >= F.lit(first)) & (F.col(ts) < F.date_add(F.lit(last), 1)))
    counts = inside.groupBy(calendar_day(ts).alias(day)).agg(F.count(F.lit(1)).alias(name))
    return rolling_mean_full(counts, (), day, name, size, f"{name}_{size}d_avg").orderBy(day)
