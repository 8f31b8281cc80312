"""Retention of signup cohorts, read off the cube."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import calendar_months_between
from plumbline.plans.active_users import cube_slice


def cohort_retention(cube: DataFrame, rate: str = "active_users_7d_rate") -> DataFrame:
    """Month-end rate and open users per cohort and months since signup.

    The month-end value is the one on the last snapshot of the month, found by
    the aggregate itself: no sort per group.
    """
    cohort = F.to_date("signup_cohort")
    rows = cube_slice(cube, ("signup_cohort",)).withColumn(
        "months_since_signup", calendar_months_between(cohort, F.col("snapshot_date"))
    )
    return rows.groupBy("signup_cohort", "months_since_signup").agg(
        F.max_by(rate, "snapshot_date").alias("rate"),
        F.max_by("open_users", "snapshot_date").alias("open_users"),
    )


def cohort_matrix(retention: DataFrame, months: Sequence[int]) -> DataFrame:
    """Cohorts by months since signup; NULL where a cohort has not got that far.

    The months are given, so the columns do not depend on a pass over the data.
    """
    return (
        retention.groupBy("signup_cohort")
        .pivot("months_since_signup", list(months))
        .agg(F.first("rate"))
        .select("signup_cohort", *(F.col(f"`{m}`").alias(f"m{m}") for m in months))
        .orderBy("signup_cohort")
    )
