"""Active-user rates: account segments to user segments to a cube.

A user may own many accounts. The changes of all of them are summed per (user,
type, age bucket, day) before they are sorted, with a map-side partial step, so
a user with a third of all accounts reaches a task as a few rows per day. Days
are unfolded only after the rows are placed by user; every later step up to the
counts per day stays in that task.

``user_stretches`` is the common input: what a user's accounts of one type and
age bucket do over a stretch of days. The daily tables unfold it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import safe_divide
from plumbline.operators.timeline import place_by, segments_to_days

ROLLED_UP = "ALL"  # fixed value: marks a dimension that a row of the cube is not split by

FLAGS = ("active_1d", "active_7d", "active_28d")


def signup_cohorts(accounts: DataFrame, unit: str = "month") -> DataFrame:
    """The period of each user's first account."""
    return accounts.groupBy("user_id").agg(
        F.trunc(F.min("created_date"), unit).alias("signup_cohort")
    )


def user_stretches(segments: DataFrame, last_day: Column, unit: str = "month") -> DataFrame:
    """Stretches of constant state per user, account type and age bucket.

    ``is_open`` and the activity flags hold if any of the user's accounts of
    that type and bucket has them. ``signup_cohort`` is the period of the
    user's first day.
    """
    counters = ("accounts", "open", "a1", "a7", "a28")
    history = W.partitionBy("account_id").orderBy("start_day")
    state = segments.selectExpr(
        "account_id",
        "user_id",
        "account_type",
        "account_age_bucket AS bucket",
        "start_day",
        "int(is_open) + 2 * int(l1 > 0) + 4 * int(l7 > 0) + 8 * int(l28 > 0) AS state",
    ).withColumns(
        {"old_bucket": F.lag("bucket").over(history), "old_state": F.lag("state").over(history)}
    )
    # Where an account changes, its new state is added and its old one taken away. The two
    # meet in the map-side aggregate and leave the difference.
    group = ("user_id", "account_type", "account_age_bucket")
    deltas = (
        state.where("old_state IS NULL OR state <> old_state OR bucket <> old_bucket")
        .withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1))))
        .where("sign > 0 OR old_state IS NOT NULL")
        .selectExpr(
            "user_id",
            "account_type",
            "if(sign > 0, bucket, old_bucket) AS account_age_bucket",
            "start_day AS day",
            "sign",
            "if(sign > 0, state, old_state) AS state",
        )
        .groupBy(*group, "day")
        .agg(
            F.sum("sign").alias(counters[0]),
            *(
                F.expr(f"sum(sign * ((state >> {bit}) & 1))").alias(c)
                for bit, c in enumerate(counters[1:])
            ),
        )
        .where(" OR ".join(f"{c} <> 0" for c in counters))
    )

    # Placed by user alone: the running sums per group, the cohort per user, and the
    # per-day aggregation of the caller all find their rows in place.
    placed = place_by(deltas, "user_id")
    by_day = W.partitionBy(*group).orderBy("day")
    upto = by_day.rowsBetween(W.unboundedPreceding, W.currentRow)
    running = placed.select(
        *group,
        F.col("day").alias("start_day"),
        F.coalesce(F.date_sub(F.lead("day").over(by_day), 1), last_day).alias("end_day"),
        *(F.sum(c).over(upto).alias(c) for c in counters),
    )
    first_day = F.min("start_day").over(W.partitionBy("user_id"))
    return (
        running.withColumn("signup_cohort", F.trunc(first_day, unit))
        .where("accounts > 0")
        .select(
            *group,
            "signup_cohort",
            "start_day",
            "end_day",
            (F.col("open") > 0).alias("is_open"),
            *((F.col(c) > 0).cast("int").alias(f) for c, f in zip(counters[2:], FLAGS)),
        )
    )


def user_days(stretches: DataFrame) -> DataFrame:
    """One row per user, type, age bucket and day; partitioned by user."""
    return segments_to_days(stretches, "start_day", "end_day", "snapshot_date")


def user_daily(days: DataFrame) -> DataFrame:
    """Activity of each user per day over all accounts, open or not."""
    return days.groupBy("snapshot_date", "user_id").agg(*(F.max(f).alias(f) for f in FLAGS))


def user_days_with_flags(days: DataFrame) -> DataFrame:
    """The bridge with the user's activity of the day beside it.

    The flags are a maximum over the rows of a user and day, in the task that holds the user.
    """
    whole = W.partitionBy("user_id", "snapshot_date")
    flagged = days.withColumns({f: F.max(f).over(whole) for f in FLAGS})
    return flagged.where("is_open").select(
        "snapshot_date", "user_id", "account_type", "account_age_bucket", "signup_cohort", *FLAGS
    )


def user_daily_bridge(days: DataFrame) -> DataFrame:
    """Each user with an open account, per day and dimension of those accounts.

    Rows are distinct already: a user has one stretch per type, bucket and day.
    """
    return days.where("is_open").select(
        "snapshot_date", "user_id", "account_type", "account_age_bucket", "signup_cohort"
    )


# The cells of the cube, by grouping set: all, cohort, type, age bucket, type by age bucket.
ALL_SET, COHORT_SET, TYPE_SET, BUCKET_SET, BOTH_SET = range(5)

PAIRS = "array<struct<account_type: string, account_age_bucket: string>>"


def active_user_cube(
    stretches: DataFrame,
    account_types: Sequence[str] | None = None,
) -> DataFrame:
    """Open users, active users and their rates per day over five grouping sets:
    everything, type, age bucket, cohort, and type by age bucket.

    A user counts once per cell. What a user contributes on a day depends only on
    the user's *state*: the open (type, bucket) pairs, the activity flags, the
    cohort. A user is looked at on the days its state changes and on no other: the
    old state loses the user and the new one gains it, both are summed per
    state, and only then spread over the cells. Running sums over the calendar bring
    the counts back, and the days between two changes of a cell are unfolded last.
    So the cost follows changes, and the shuffles carry states, not users.

    With ``account_types`` given, any number of them, a type outside them is an
    error, as it is for the quality gate; without them any type is taken.
    """
    if account_types is not None:
        message = F.concat(F.lit("unknown account type: "), F.coalesce("account_type", F.lit("NULL")))
        known = F.coalesce(F.col("account_type").isin(*account_types), F.lit(False))
        checked = F.when(known, F.col("account_type")).otherwise(F.raise_error(message))
        stretches = stretches.withColumn("account_type", checked)
    cell = ("grouping_set", "account_type", "account_age_bucket", "signup_cohort")
    numbers = ("users", *FLAGS)
    moved = (
        _cells(state_changes(stretches))
        .withColumn(
            "signup_cohort",
            F.when(F.col("grouping_set") == COHORT_SET, F.col("cohort").cast("string")).otherwise(ROLLED_UP),
        )
        .groupBy(*cell, "day")
        .agg(F.sum("users").alias("users"), *(F.sum(F.col(f) * F.col("users")).alias(f) for f in FLAGS))
        .where(" OR ".join(f"{n} <> 0" for n in numbers))
    )
    # One row per cell and day of the calendar at most.
    by_day = W.partitionBy(*cell).orderBy("day")
    upto = by_day.rowsBetween(W.unboundedPreceding, W.currentRow)
    level = moved.select(
        *cell,
        F.col("day").alias("start_day"),
        F.date_sub(F.lead("day").over(by_day), 1).alias("end_day"),
        *(F.sum(n).over(upto).alias(n) for n in numbers),
    ).where("users > 0")
    counts = segments_to_days(level, "start_day", "end_day", "snapshot_date")
    return counts.select(
        "snapshot_date",
        "account_type",
        "account_age_bucket",
        "signup_cohort",
        F.col("users").alias("open_users"),
        *(F.col(f).alias(f"{_users(f)}_count") for f in FLAGS),
        *(safe_divide(F.col(f), F.col("users")).alias(f"{_users(f)}_rate") for f in FLAGS),
    )


def state_changes(stretches: DataFrame) -> DataFrame:
    """``cohort, pairs, active_1d, active_7d, active_28d, day, users``: by how much the number of users
    in a state changes on a day. ``pairs`` are the open (type, bucket) pairs; the state without any is
    left out. After the last day of all stretches the number in each state is zero again.

    Every step up to the count per state is keyed by user first and finds its rows in place where
    the stretches are placed by user.
    """
    user = ("user_id", "cohort")
    ends = F.array(
        F.struct(F.col("start_day").alias("day"), F.lit(1).alias("sign")),
        F.struct(F.date_add("end_day", 1).alias("day"), F.lit(-1).alias("sign")),
    )
    # A stretch that ends the day before the next of its group begins cancels out in all that stays.
    moves = (
        stretches.select(
            "user_id", F.col("signup_cohort").alias("cohort"), "account_type", "account_age_bucket",
            "is_open", *FLAGS, F.inline(ends),
        )
        .groupBy(*user, "account_type", "account_age_bucket", "day")
        .agg(
            F.sum(F.col("sign") * F.col("is_open").cast("int")).alias("opened"),
            *(F.sum(F.col("sign") * F.col(f)).alias(f) for f in FLAGS),
        )
    )

    turn = F.struct(F.struct("account_type", "account_age_bucket").alias("pair"), "opened")
    by_day = moves.groupBy(*user, "day").agg(
        F.collect_list(F.when(F.col("opened") != 0, turn)).alias("turns"), *(F.sum(f).alias(f) for f in FLAGS)
    )
    # A user's history in one row holds a day at most once, so the calendar bounds it. Openings and
    # closings are few beside changes of activity; the open pairs after each come from a fold over them.
    history = by_day.groupBy(*user).agg(
        F.collect_list(F.when(F.size("turns") > 0, F.struct("day", "turns"))).alias("turned"),
        F.collect_list(F.struct("day", *FLAGS)).alias("activity"),
    )
    none = F.array().cast(f"array<struct<day: date, pairs: {PAIRS}>>")

    def of(turns: Column, sign: int) -> Column:
        return F.transform(F.filter(turns, lambda t: t.opened == sign), lambda t: t.pair)

    def after(done: Column, x: Column) -> Column:
        before = F.coalesce(F.try_element_at(done, F.lit(-1)).pairs, F.array().cast(PAIRS))
        pairs = F.array_sort(F.array_except(F.array_union(before, of(x.turns, 1)), of(x.turns, -1)))
        return F.concat(done, F.array(F.struct(x.day.alias("day"), pairs.alias("pairs"))))

    open_pairs = F.aggregate(F.array_sort("turned"), none, after)
    rows = F.concat(
        F.transform(
            "activity",
            lambda a: F.struct(a.day.alias("day"), *(a[f].alias(f) for f in FLAGS), F.lit(None).cast(PAIRS).alias("pairs")),
        ),
        F.transform(
            open_pairs,
            lambda a: F.struct(a.day.alias("day"), *(F.lit(0).cast("long").alias(f) for f in FLAGS), a.pairs.alias("pairs")),
        ),
    )
    # Rows of one day are peers and get the same state, so only the first of them is a change.
    per_user = W.partitionBy(*user).orderBy("day")
    so_far = per_user.rangeBetween(W.unboundedPreceding, W.currentRow)
    state = history.select(*user, F.inline(rows)).select(
        *user, "day",
        F.struct(
            F.last("pairs", True).over(so_far).alias("pairs"),
            *((F.sum(f).over(so_far) > 0).cast("int").alias(f) for f in FLAGS),
        ).alias("state"),
    ).withColumn("old", F.lag("state").over(per_user))
    both = F.array(
        F.struct(F.lit(1).alias("sign"), F.col("state")), F.struct(F.lit(-1).alias("sign"), F.col("old").alias("state"))
    )
    return (
        state.where("old IS NULL OR state <> old")
        .select("cohort", "day", F.inline(both))
        .where(F.size("state.pairs") > 0)
        .select("cohort", "day", "sign", "state.*")
        .groupBy("cohort", "pairs", *FLAGS, "day")
        .agg(F.sum("sign").alias("users"))
        .where("users <> 0")
    )


def _cells(states: DataFrame) -> DataFrame:
    """``cohort, day, users``, the flags and the cell, for each cell that a state is in."""

    def cell(grouping_set: int, kind: Column | None = None, bucket: Column | None = None) -> Column:
        rolled_up = F.lit(ROLLED_UP)
        return F.struct(
            F.lit(grouping_set).alias("grouping_set"),
            (rolled_up if kind is None else kind).alias("account_type"),
            (rolled_up if bucket is None else bucket).alias("account_age_bucket"),
        )

    cells = F.concat(
        F.array(cell(ALL_SET), cell(COHORT_SET)),
        F.array_distinct(F.transform("pairs", lambda x: cell(TYPE_SET, x.account_type))),
        F.array_distinct(F.transform("pairs", lambda x: cell(BUCKET_SET, None, x.account_age_bucket))),
        F.transform("pairs", lambda x: cell(BOTH_SET, x.account_type, x.account_age_bucket)),
    )
    return states.select("cohort", "day", "users", *FLAGS, F.inline(cells))


def cube_slice(cube: DataFrame, split_by: Sequence[str] = ()) -> DataFrame:
    """The rows of one grouping set: split by ``split_by``, rolled up elsewhere, in date order."""
    for name in ("account_type", "account_age_bucket", "signup_cohort"):
        rolled_up = F.col(name) == ROLLED_UP
        cube = cube.where(~rolled_up if name in split_by else rolled_up)
    return cube.orderBy("snapshot_date", *split_by)


def headline_rate(cube: DataFrame) -> DataFrame:
    """The overall series."""
    return cube_slice(cube).select(
        "snapshot_date",
        "open_users",
        *(f"{_users(f)}_count" for f in FLAGS),
        *(f"{_users(f)}_rate" for f in FLAGS),
    )


def cube_latest(cube: DataFrame, last_day: Column) -> DataFrame:
    """Type by age bucket on ``last_day``, the last of the cube: every account is there to the end."""
    split = ("account_type", "account_age_bucket")
    rows = cube_slice(cube.where(F.col("snapshot_date") == last_day), split)
    return rows.select(
        *split, "open_users", "active_users_7d_count", "active_users_7d_rate"
    ).orderBy(*split)


def _users(flag: str) -> str:
    return flag.replace("active", "active_users")
