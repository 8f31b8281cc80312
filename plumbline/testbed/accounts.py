"""Queries for the account model: stages, history, cube and what is read off it."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import calendar_day
from plumbline.operators import timeline
from plumbline.plans import active_users, cohorts, lifecycle
from plumbline.testbed import oracle, views
from plumbline.testbed.catalog import register

EDGES, UNIT = views.EDGES, views.COHORT_UNIT
sources = views.accounts_raw


def _segments(spark, sf):
    return lifecycle.account_segments(sources(spark, sf), edges=EDGES)


def _datelist(spark, sf):
    return lifecycle.account_datelist(sources(spark, sf), edges=EDGES)


def _stretches(spark, sf):
    src = sources(spark, sf)
    segments = lifecycle.account_segments(src, edges=EDGES)
    return active_users.user_stretches(segments, lifecycle.latest_day(src).scalar(), UNIT)


def _days(spark, sf):
    return active_users.user_days(_stretches(spark, sf))


def _cube(spark, sf):
    return active_users.active_user_cube(_stretches(spark, sf), views.ACCOUNT_TYPES)


def _acct(body: str) -> str:
    return f"WITH {oracle.ACCOUNTS} {body}"


def _dense(body: str) -> str:
    return f"WITH {oracle.DATELIST} {body}"


def _cubed(body: str) -> str:
    return f"WITH {oracle.CUBE} {body}"


# ---- stages


@register("agg_min_max_dedup", _acct("SELECT * FROM stg_created"))
def agg_min_max_dedup(spark, sf):
    return lifecycle.staged_accounts(sources(spark, sf).created)


@register("join_inner_using_nonequi", _acct("SELECT * FROM stg_transactions"))
def join_inner_using_nonequi(spark, sf):
    return lifecycle.staged_transactions(sources(spark, sf))


@register("agg_global_max_over_union", _acct("SELECT d FROM last_day"))
def agg_global_max_over_union(spark, sf):
    return lifecycle.latest_day(sources(spark, sf))


@register("account_events", _acct("SELECT * FROM account_events"))
def account_events(spark, sf):
    return lifecycle.account_events(sources(spark, sf))


@register(
    "union_all_events",
    _acct("SELECT event_type, count(*) AS n, min(event_ts) AS first_ts, max(event_ts) AS last_ts"
          " FROM account_events GROUP BY 1"),
)
def union_all_events(spark, sf):
    return lifecycle.account_events(sources(spark, sf)).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("event_ts").alias("first_ts"),
        F.max("event_ts").alias("last_ts"),
    )


@register(
    "agg_count_by_kind",
    _acct("SELECT event_type, count(*) AS n FROM account_events GROUP BY 1 ORDER BY 2 DESC"),
)
def agg_count_by_kind(spark, sf):
    counts = lifecycle.account_events(sources(spark, sf)).groupBy("event_type")
    return counts.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type")


@register("account_status_events", _acct("SELECT * FROM account_status_events"))
def account_status_events(spark, sf):
    return lifecycle.account_status_events(lifecycle.account_events(sources(spark, sf)))


@register("win_row_number_last_event", _acct("SELECT * FROM account_status_events"))
def win_row_number_last_event(spark, sf):
    """The same by ``row_number``. It keeps whole events, and so has to sort them; the
    model itself uses the aggregate. Events of one account and day meet in one task,
    so they are first reduced to one row per kind, which is all the ordering needs."""
    kinds = {"created": 1, "closed": 2, "reopened": 3}
    precedence = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    events = (
        lifecycle.account_events(sources(spark, sf))
        .groupBy("account_id", calendar_day("event_ts").alias("event_date"), "event_type")
        .agg(F.max("event_ts").alias("event_ts"))
    )
    last = timeline.last_event_per_day(
        events,
        ["account_id"],
        "event_date",
        [F.desc("event_ts"), precedence[F.col("event_type")].desc()],
    )
    status = F.when(F.col("event_type") == "closed", "closed").otherwise("open")
    return last.select("account_id", "event_date", status.alias("status_after"))


# ---- the dense formulation, step by step


def _spine_with(spark, sf, facts, day, value):
    src = sources(spark, sf)
    accounts = lifecycle.staged_accounts(src.created)
    last = lifecycle.latest_day(src).scalar()
    return timeline.spine_with_facts(
        accounts, facts, "account_id", "created_date", last, day, value, "snapshot_date"
    )


def _spine_with_events(spark, sf):
    events = lifecycle.account_status_events(lifecycle.account_events(sources(spark, sf)))
    return _spine_with(spark, sf, events, "event_date", "status_after")


def _spine_with_activity(spark, sf):
    activity = lifecycle.staged_transactions(sources(spark, sf))
    return (
        _spine_with(spark, sf, activity, "txn_date", "txn_count")
        .withColumn("l1", F.when(F.col("txn_count").isNull(), 0).otherwise(1))
        .withColumn("txn_count", F.coalesce("txn_count", F.lit(0)))
    )


@register(
    "join_left_spine_events",
    _dense("SELECT a.account_id, a.day AS snapshot_date, e.status_after FROM account_days a"
           " LEFT JOIN account_status_events e ON e.account_id = a.account_id"
           " AND e.event_date = a.day"),
)
def join_left_spine_events(spark, sf):
    return _spine_with_events(spark, sf)


@register(
    "join_left_spine_activity",
    _dense("SELECT account_id, snapshot_date, l1, txn_count FROM account_datelist"),
)
def join_left_spine_activity(spark, sf):
    return _spine_with_activity(spark, sf)


@register(
    "win_last_value_ignore_nulls",
    _dense("SELECT account_id, snapshot_date, CASE WHEN is_open THEN 'open' ELSE 'closed' END"
           " AS status FROM account_datelist"),
)
def win_last_value_ignore_nulls(spark, sf):
    rows = timeline.carry_forward(
        _spine_with_events(spark, sf), ["account_id"], "snapshot_date", "status_after", "status"
    )
    return rows.drop("status_after")


def _rolling(size):
    @register(
        f"win_rolling_sum_{size}",
        _dense(f"SELECT account_id, snapshot_date, l{size} FROM account_datelist"),
    )
    def build(spark, sf):
        rows = timeline.rolling_sum(
            _spine_with_activity(spark, sf), ["account_id"], "snapshot_date", "l1", size,
            f"l{size}",
        )
        return rows.select(
            "account_id", "snapshot_date", F.col(f"l{size}").cast("int").alias(f"l{size}")
        )


_rolling(7)
_rolling(28)


# ---- history, users, cube


@register("account_datelist", _dense("SELECT * FROM account_datelist"))
def account_datelist(spark, sf):
    return _datelist(spark, sf)


@register(
    "sample_entity_history",
    _dense("SELECT snapshot_date, account_id, is_open, l1, l7, l28, txn_count"
           " FROM account_datelist WHERE account_id = (SELECT min(account_id)"
           " FROM account_datelist WHERE l28 > 2) ORDER BY snapshot_date DESC LIMIT 6"),
)
def sample_entity_history(spark, sf):
    """The newest six days of one account, picked by a join with one row before days unfold."""
    segments = _segments(spark, sf)
    chosen = segments.where("l28 > 2").agg(F.min("account_id").alias("account_id"))
    history = lifecycle.datelist_of(segments.join(chosen, "account_id", "left_semi"))
    return history.orderBy(F.desc("snapshot_date")).limit(6).select(
        "snapshot_date", "account_id", "is_open", "l1", "l7", "l28", "txn_count"
    )


@register("agg_signup_cohort", _cubed("SELECT * FROM user_signup"))
def agg_signup_cohort(spark, sf):
    return active_users.signup_cohorts(lifecycle.staged_accounts(sources(spark, sf).created), UNIT)


@register(
    "agg_flag_max",
    _dense("SELECT snapshot_date, user_id, max(CASE WHEN l1 > 0 THEN 1 ELSE 0 END) AS active_1d,"
           " max(CASE WHEN l7 > 0 THEN 1 ELSE 0 END) AS active_7d,"
           " max(CASE WHEN l28 > 0 THEN 1 ELSE 0 END) AS active_28d"
           " FROM account_datelist GROUP BY 1, 2"),
)
def agg_flag_max(spark, sf):
    """Flags per user and day, aggregated where the user's stretches are unfolded."""
    return _days(spark, sf).groupBy("snapshot_date", "user_id").agg(
        *(F.max(f).alias(f) for f in active_users.FLAGS)
    )


@register("user_daily", _cubed("SELECT * FROM user_daily"))
def user_daily(spark, sf):
    return active_users.user_daily(_days(spark, sf))


@register("user_daily_bridge", _cubed("SELECT * FROM user_daily_bridge"))
def user_daily_bridge(spark, sf):
    return active_users.user_daily_bridge(_days(spark, sf))


@register("join_bridge_distinct", _cubed("SELECT * FROM user_daily_bridge"))
def join_bridge_distinct(spark, sf):
    """Open stretches joined to cohorts, then unfolded: distinct as they are."""
    cohort = active_users.signup_cohorts(
        lifecycle.staged_accounts(sources(spark, sf).created), UNIT
    )
    stretches = _stretches(spark, sf).where("is_open").drop("signup_cohort").join(cohort, "user_id")
    return active_users.user_days(stretches).select(
        "snapshot_date", "user_id", "account_type", "account_age_bucket", "signup_cohort"
    )


@register(
    "join_using_composite",
    _cubed("SELECT b.*, u.active_1d, u.active_7d, u.active_28d FROM user_daily_bridge b"
           " JOIN user_daily u ON b.snapshot_date = u.snapshot_date AND b.user_id = u.user_id"),
)
def join_using_composite(spark, sf):
    return active_users.user_days_with_flags(_days(spark, sf))


@register(
    "agg_distinct_filtered",
    _cubed("SELECT b.snapshot_date, b.account_type, count(DISTINCT b.user_id) AS open_users,"
           " count(DISTINCT b.user_id) FILTER (WHERE active_1d = 1) AS active_1d,"
           " count(DISTINCT b.user_id) FILTER (WHERE active_7d = 1) AS active_7d,"
           " count(DISTINCT b.user_id) FILTER (WHERE active_28d = 1) AS active_28d"
           " FROM user_daily_bridge b JOIN user_daily u ON b.snapshot_date = u.snapshot_date"
           " AND b.user_id = u.user_id GROUP BY 1, 2"),
)
def agg_distinct_filtered(spark, sf):
    """Filtered distinct counts without one copy of the rows per filter: a flag holds for a
    user and day as a whole, so users are made distinct once and then summed."""
    flags = active_users.FLAGS
    users = (
        active_users.user_days_with_flags(_days(spark, sf))
        .groupBy("snapshot_date", "account_type", "user_id")
        .agg(*(F.max(f).alias(f) for f in flags))
    )
    return users.groupBy("snapshot_date", "account_type").agg(
        F.count(F.lit(1)).alias("open_users"), *(F.sum(f).cast("long").alias(f) for f in flags)
    )


@register("active_user_cube", _cubed("SELECT * FROM active_user_cube"))
def active_user_cube(spark, sf):
    return _cube(spark, sf)


@register("active_user_cube_any_types", _cubed("SELECT * FROM active_user_cube"))
def active_user_cube_any_types(spark, sf):
    """The same when the set of account types is not known beforehand."""
    return active_users.active_user_cube(_stretches(spark, sf))


@register(
    "headline_rate",
    _cubed("SELECT snapshot_date, open_users, active_users_1d_count, active_users_7d_count,"
           " active_users_28d_count, active_users_1d_rate, active_users_7d_rate,"
           " active_users_28d_rate FROM active_user_cube WHERE account_type = 'ALL'"
           " AND account_age_bucket = 'ALL' AND signup_cohort = 'ALL'"),
)
def headline_rate(spark, sf):
    return active_users.headline_rate(_cube(spark, sf))


def _slice(name, split_by, where):
    @register(name, _cubed(f"SELECT * FROM active_user_cube WHERE {where}"))
    def build(spark, sf):
        return active_users.cube_slice(_cube(spark, sf), split_by)


_slice("cube_slice", ("account_type",),
       "account_type <> 'ALL' AND account_age_bucket = 'ALL' AND signup_cohort = 'ALL'")
_slice("cube_slice_by_age", ("account_age_bucket",),
       "account_type = 'ALL' AND account_age_bucket <> 'ALL' AND signup_cohort = 'ALL'")


@register(
    "cube_latest_slice",
    _cubed("SELECT account_type, account_age_bucket, open_users, active_users_7d_count,"
           " active_users_7d_rate FROM active_user_cube WHERE account_type <> 'ALL'"
           " AND account_age_bucket <> 'ALL' AND signup_cohort = 'ALL'"
           " AND snapshot_date = (SELECT max(snapshot_date) FROM active_user_cube)"),
)
def cube_latest_slice(spark, sf):
    last = lifecycle.latest_day(sources(spark, sf)).scalar()
    return active_users.cube_latest(_cube(spark, sf), last)


# ---- retention, on years of history and monthly cohorts


def _monthly(body: str) -> str:
    return f"WITH {oracle.LONG_CUBE} {body}"


def _monthly_cube(spark, sf):
    src = views.accounts_long(spark, sf)
    last = lifecycle.latest_day(src).scalar()
    stretches = active_users.user_stretches(lifecycle.account_segments(src), last)
    return active_users.active_user_cube(stretches, views.ACCOUNT_TYPES)


@register("active_user_cube_monthly", _monthly("SELECT * FROM active_user_cube"))
def active_user_cube_monthly(spark, sf):
    """Default age buckets and monthly cohorts over years of history."""
    return _monthly_cube(spark, sf)


_RETENTION = """
SELECT signup_cohort, CAST(date_diff('month', CAST(signup_cohort AS DATE), snapshot_date) AS INTEGER)
         AS months_since_signup,
       arg_max(active_users_7d_rate, snapshot_date) AS rate, arg_max(open_users, snapshot_date) AS open_users
FROM active_user_cube WHERE signup_cohort <> 'ALL' GROUP BY 1, 2
"""


@register("cohort_retention", _monthly(_RETENTION))
def cohort_retention(spark, sf):
    return cohorts.cohort_retention(_monthly_cube(spark, sf))


MONTHS = range(13)


@register(
    "cohort_matrix",
    _monthly("SELECT signup_cohort, {} FROM ({}) GROUP BY 1".format(
        ", ".join(f"max(rate) FILTER (WHERE months_since_signup = {m}) AS m{m}" for m in MONTHS),
        _RETENTION,
    )),
)
def cohort_matrix(spark, sf):
    cube = _monthly_cube(spark, sf)
    return cohorts.cohort_matrix(cohorts.cohort_retention(cube), MONTHS)


# ---- six and a half years of history, summarised so that the check stays readable

_LONG = f"""
WITH {oracle.LONG_DATELIST}
SELECT account_type, account_age_bucket, year(snapshot_date) AS year, count(*) AS days,
       count(*) FILTER (WHERE is_open) AS open_days, CAST(sum(l1) AS BIGINT) AS l1,
       CAST(sum(l7) AS BIGINT) AS l7, CAST(sum(l28) AS BIGINT) AS l28
FROM account_datelist GROUP BY 1, 2, 3
"""


@register("account_datelist_long", _LONG)
def account_datelist_long(spark, sf):
    """The default age buckets over years of daily history."""
    history = lifecycle.account_datelist(views.accounts_long(spark, sf))
    return history.groupBy(
        "account_type", "account_age_bucket", F.year("snapshot_date").cast("long").alias("year")
    ).agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if("is_open").alias("open_days"),
        *(F.sum(c).alias(c) for c in ("l1", "l7", "l28")),
    )
