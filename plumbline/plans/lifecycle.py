"""Account lifecycle: events to state to a daily history.

Inputs (any location, any size):

* ``created(account_id, user_id, account_type, created_ts)``, repeats allowed
* ``closed(account_id, closed_ts)``, ``reopened(account_id, reopened_ts)``
* ``transactions(account_id, txn_date, txn_count)``, one row per active day

The history has one row per account and day, which is far more rows than the
inputs have. So state and rolling activity are computed on *segments*, stretches
of days during which nothing about an account changes, and the days are
unfolded last, inside the task that holds the segments. Only input-sized data
is shuffled or sorted. An account has at most a few rows per day in that
shuffle, however many events it had, because events are first reduced to one
row per account and day with a map-side partial aggregate.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import age_bucket, calendar_day
from plumbline.operators.timeline import place_by, segments_to_days

# On the same instant the later entry wins; two of them leave an account open.
PRECEDENCE = {"created": 1, "closed": 2, "reopened": 3}
OPENING = ("created", "reopened")

DEFAULT_EDGES = (30, 90, 365)

DATELIST_COLUMNS = (
    "snapshot_date",
    "account_id",
    "user_id",
    "account_type",
    "created_date",
    "account_age",
    "account_age_bucket",
    "is_open",
    "l1",
    "l7",
    "l28",
    "txn_count",
)


@dataclass(frozen=True)
class Sources:
    """The four inputs of the account model."""

    created: DataFrame
    closed: DataFrame
    reopened: DataFrame
    transactions: DataFrame

    def up_to(self, day: dt.date) -> "Sources":
        """Only what was known at the end of ``day``."""
        before = F.date_add(F.lit(day), 1)
        return Sources(
            self.created.where(F.col("created_ts") < before),
            self.closed.where(F.col("closed_ts") < before),
            self.reopened.where(F.col("reopened_ts") < before),
            self.transactions.where(F.col("txn_date") < before),
        )


def staged_accounts(created: DataFrame) -> DataFrame:
    """One row per account: earliest creation, greatest user and type; untyped rows dropped."""
    return (
        created.where(F.col("account_type").isNotNull())
        .groupBy("account_id")
        .agg(
            F.max("user_id").alias("user_id"),
            F.max("account_type").alias("account_type"),
            F.min("created_ts").alias("created_ts"),
        )
        .withColumn("created_date", calendar_day("created_ts"))
    )


def staged_transactions(sources: Sources) -> DataFrame:
    """Activity of modelled accounts, from the day of their creation on."""
    accounts = staged_accounts(sources.created).select("account_id", "created_date")
    return (
        sources.transactions.join(accounts, "account_id")
        .where(F.col("txn_date") >= F.col("created_date"))
        .select("account_id", "txn_date", "txn_count")
    )


def account_events(sources: Sources) -> DataFrame:
    """The lifecycle stream: one creation per account, every closure and reopening."""
    streams = {
        "created": (staged_accounts(sources.created), "created_ts"),
        "closed": (sources.closed, "closed_ts"),
        "reopened": (sources.reopened, "reopened_ts"),
    }
    tagged = [
        rows.select("account_id", F.col(ts).alias("event_ts"), F.lit(kind).alias("event_type"))
        for kind, (rows, ts) in streams.items()
    ]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def _event_rank(event_ts: Column | str, precedence: Column) -> Column:
    """Instant and precedence as one number.

    The greatest rank is the last event. A long keeps the aggregate in a hash
    aggregate; ``max_by`` over a struct would sort the events.
    """
    ts = F.col(event_ts) if isinstance(event_ts, str) else event_ts
    epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    return F.timestamp_diff("MICROSECOND", epoch, ts) * 4 + precedence


def _opens(rank: Column) -> Column:
    return F.pmod(rank, F.lit(4)).isin(*(PRECEDENCE[kind] for kind in OPENING))


def account_status_events(events: DataFrame) -> DataFrame:
    """The status each account is left in by the last event of a day."""
    precedence = F.lit(0)
    for kind, value in PRECEDENCE.items():
        precedence = F.when(F.col("event_type") == kind, value).otherwise(precedence)
    return (
        events.groupBy("account_id", calendar_day("event_ts").alias("event_date"))
        .agg(F.max(_event_rank("event_ts", precedence)).alias("_rank"))
        .select(
            "account_id",
            "event_date",
            F.when(_opens(F.col("_rank")), "open").otherwise("closed").alias("status_after"),
        )
    )


def latest_day(sources: Sources) -> DataFrame:
    """The last calendar day in any source, as one row ``d``. Never the wall clock."""
    days = [
        sources.created.agg(F.max(calendar_day("created_ts")).alias("d")),
        sources.closed.agg(F.max(calendar_day("closed_ts")).alias("d")),
        sources.reopened.agg(F.max(calendar_day("reopened_ts")).alias("d")),
        sources.transactions.agg(F.max("txn_date").alias("d")),
    ]
    union = days[0]
    for one in days[1:]:
        union = union.unionAll(one)
    return union.agg(F.max("d").alias("d"))


def _known_until(sources: Sources, as_of: dt.date | None) -> tuple[Sources, Column]:
    """The sources and the last day of the history. The day is a scalar subquery
    over the sources unless the caller fixes it."""
    if as_of is None:
        return sources, latest_day(sources).scalar()
    return sources.up_to(as_of), F.lit(as_of)


def account_segments(
    sources: Sources, as_of: dt.date | None = None, edges: Sequence[int] = DEFAULT_EDGES
) -> DataFrame:
    """Stretches ``[start_day, end_day]`` of constant state per account.

    A stretch ends where the status can change, where a day of activity starts
    or leaves a rolling window, and where the account moves to the next age
    bucket. A day with transactions is a stretch of its own.
    """
    sources, last_day = _known_until(sources, as_of)
    creation = staged_accounts(sources.created).select(
        "account_id",
        F.col("created_date").alias("day"),
        _event_rank("created_ts", F.lit(PRECEDENCE["created"])).alias("rank"),
        F.lit(None).cast("long").alias("txns"),
        "user_id",
        "account_type",
        "created_date",
    )
    no_account = [
        F.lit(None).cast(creation.schema[c].dataType).alias(c)
        for c in ("user_id", "account_type", "created_date")
    ]
    changes = sources.closed.select(
        "account_id",
        calendar_day("closed_ts").alias("day"),
        _event_rank("closed_ts", F.lit(PRECEDENCE["closed"])).alias("rank"),
    ).unionAll(
        sources.reopened.select(
            "account_id",
            calendar_day("reopened_ts").alias("day"),
            _event_rank("reopened_ts", F.lit(PRECEDENCE["reopened"])).alias("rank"),
        )
    )
    lifecycle = (
        changes.groupBy("account_id", "day")
        .agg(F.max("rank").alias("rank"))
        .select("account_id", "day", "rank", F.lit(None).cast("long").alias("txns"), *no_account)
    )
    activity = sources.transactions.select(
        "account_id",
        F.col("txn_date").alias("day"),
        F.lit(None).cast("long").alias("rank"),
        F.col("txn_count").cast("long").alias("txns"),
        *no_account,
    )

    # One pass in day order hands the account's attributes from its creation row to
    # everything that follows. What comes before the creation, and what belongs to
    # no modelled account, finds none and drops out: no join is needed.
    seen = (
        W.partitionBy("account_id")
        .orderBy("day", F.col("created_date").isNull())
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    is_creation = F.col("created_date").isNotNull()
    facts = creation.unionAll(lifecycle).unionAll(activity).where(F.col("day").isNotNull())
    facts = place_by(facts, "account_id").select(
        "account_id",
        "day",
        "rank",
        "txns",
        is_creation.alias("is_creation"),
        *(
            F.last(c, ignorenulls=True).over(seen).alias(c)
            for c in ("user_id", "account_type", "created_date")
        ),
    ).where("created_date IS NOT NULL")

    # The days on which a fact changes something, now or later.
    def days_after(*offsets: int) -> Column:
        return F.array(*(F.date_add("day", n) for n in offsets))

    changes_on = (
        F.when(F.col("is_creation"), days_after(0, *(edge + 1 for edge in edges)))
        .when(F.col("txns").isNotNull(), days_after(0, 1, 7, 28))
        .otherwise(days_after(0))
    )
    now = F.col("start_day") == F.col("day")
    account = ("account_id", "user_id", "account_type", "created_date")
    points = (
        facts.withColumn("start_day", F.explode(changes_on))
        .where(F.col("start_day") <= last_day)
        .select(
            *account,
            "start_day",
            F.when(now, F.col("rank")).alias("rank"),
            F.when(now, F.col("txns")).alias("txns"),
        )
        .groupBy(*account, "start_day")
        .agg(F.max("rank").alias("rank"), F.sum("txns").alias("txns"))
    )

    by_day = W.partitionBy("account_id").orderBy("start_day")
    active = F.when(F.col("txns").isNotNull(), 1).otherwise(0)

    def active_days(size: int) -> Column:
        return F.expr(
            "int(sum(l1) OVER (PARTITION BY account_id ORDER BY start_day "
            f"RANGE BETWEEN {size - 1} PRECEDING AND CURRENT ROW))"
        )

    upto = by_day.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        points.withColumn("l1", active)
        .select(
            *account,
            "start_day",
            F.coalesce(F.date_sub(F.lead("start_day").over(by_day), 1), last_day).alias("end_day"),
            age_bucket(F.date_diff("start_day", "created_date"), edges).alias(
                "account_age_bucket"
            ),
            _opens(F.last("rank", ignorenulls=True).over(upto)).alias("is_open"),
            "l1",
            active_days(7).alias("l7"),
            active_days(28).alias("l28"),
            F.coalesce("txns", F.lit(0)).alias("txn_count"),
        )
    )


def datelist_of(segments: DataFrame) -> DataFrame:
    """The daily history a set of segments stands for."""
    days = segments_to_days(segments, "start_day", "end_day", "snapshot_date")
    return days.withColumn("account_age", F.date_diff("snapshot_date", "created_date")).select(
        *DATELIST_COLUMNS
    )


def account_datelist(
    sources: Sources, as_of: dt.date | None = None, edges: Sequence[int] = DEFAULT_EDGES
) -> DataFrame:
    """One row per account and day since creation: age, status, activity over 1, 7, 28 days."""
    return datelist_of(account_segments(sources, as_of, edges))
