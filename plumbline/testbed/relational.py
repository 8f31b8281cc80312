"""Queries for scans, filters, joins, aggregates, windows, sorts, sets and functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import (
    bytes_to_gib,
    calendar_day,
    calendar_months_between,
    estimated_usd,
    gib_to_bytes,
    human_bytes,
    safe_divide,
    shard_suffix,
)
from plumbline.functions.scalars import age_bucket
from plumbline.operators import profile, timeline
from plumbline.plans.daily import daily_counts, smoothed_daily_counts
from plumbline.sources.parquet import parameterized, scan
from plumbline.sources.storage import publish
from plumbline.testbed import oracle, views
from plumbline.testbed.catalog import register, rounded
from plumbline.testbed.views import table

# ---- scans and projections


@register(
    "scan_parquet_projected",
    "SELECT event_id, CAST(ts AS DATE) AS event_date, user_id AS account_id, value AS amount"
    " FROM events",
)
def scan_parquet_projected(spark, sf):
    rows = scan(spark, f"{sf}/events.parquet",
                {"event_id": "event_id", "ts": "event_ts", "user_id": "account_id",
                 "value": "amount"})
    return rows.select("event_id", calendar_day("event_ts").alias("event_date"), "account_id",
                       "amount")


@register(
    "scan_table_projected",
    "SELECT c_custkey, c_name, c_mktsegment FROM customer",
)
def scan_table_projected(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("plumbline_customer")
    return spark.table("plumbline_customer").select("c_custkey", "c_name", "c_mktsegment")


@register(
    "project_alias",
    "SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_day,"
    " o_totalprice AS amount FROM orders",
)
def project_alias(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        calendar_day("o_orderdate").alias("order_day"),
        F.col("o_totalprice").alias("amount"),
    )


@register(
    "param_query",
    "SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS line_numbers"
    " FROM lineitem WHERE l_quantity >= 24.5 AND l_linenumber <= 5 AND l_linestatus = 'O'"
    " AND (TRUE OR l_tax > 0) GROUP BY 1",
)
def param_query(spark, sf):
    return parameterized(
        spark,
        "SELECT l_returnflag, count(1) AS n, sum(l_linenumber) AS line_numbers FROM {lines}"
        " WHERE l_quantity >= :low AND l_linenumber <= :most AND l_linestatus = :status"
        " AND (:everything OR l_tax > 0) GROUP BY l_returnflag",
        {"low": 24.5, "most": 5, "status": "O", "everything": True},
        lines=table(spark, sf, "lineitem"),
    )


# ---- filters


def stored_trends(spark, sf, name="top_terms"):
    """The table as a store partitioned by its refresh date."""
    rows = views.trends(spark, sf)[name]
    return spark.read.parquet(
        views.stored(spark, sf, name, lambda path: publish(rows, path, "refresh_date"))
    )


@register(
    "filter_eq_literal_date",
    f"WITH {oracle.TRENDS} SELECT term, week, rank FROM top_terms"
    " WHERE refresh_date = DATE '1998-06-01'",
)
def filter_eq_literal_date(spark, sf):
    return (
        stored_trends(spark, sf)
        .where(F.col("refresh_date") == F.lit(dt.date(1998, 6, 1)))
        .select("term", "week", "rank")
    )


@register(
    "filter_cmp_between_in_null",
    f"WITH {oracle.TRENDS} SELECT country_code, region_code, term, rank, score"
    " FROM international_top_rising_terms WHERE rank <= 20 AND rank > 2"
    " AND nullif(percent_gain, 0) IS NOT NULL"
    " AND rank BETWEEN 3 AND 18 AND country_code IN ('US', 'C1')"
    " AND (region_name IS NULL OR region_code = '' OR score IS NULL)",
)
def filter_cmp_between_in_null(spark, sf):
    rank = F.col("rank")
    return (
        views.trends(spark, sf)["international_top_rising_terms"]
        .where(F.nullif("percent_gain", F.lit(0)).isNotNull())
        .where((rank <= 20) & (rank > 2) & rank.between(3, 18))
        .where(F.col("country_code").isin("US", "C1"))
        .where(
            F.col("region_name").isNull() | (F.col("region_code") == "") | F.col("score").isNull()
        )
        .select("country_code", "region_code", "term", "rank", "score")
    )


@register(
    "filter_latest_snapshot",
    f"WITH {oracle.TRENDS} SELECT dma_name, term, week, rank FROM top_terms"
    " WHERE refresh_date = (SELECT max(refresh_date) FROM top_terms"
    " WHERE refresh_date <= DATE '1999-09-20') AND rank <= 10",
)
def filter_latest_snapshot(spark, sf):
    """Top ten of the newest refresh at or before a day."""
    latest = profile.latest_snapshot(
        stored_trends(spark, sf), "refresh_date", F.lit(dt.date(1999, 9, 20))
    )
    return latest.where("rank <= 10").select("dma_name", "term", "week", "rank").orderBy(
        "dma_name", "rank", "term", "week"
    )


@register(
    "clip_date_range",
    "SELECT count(*) FILTER (WHERE d BETWEEN DATE '1996-01-01' AND DATE '1999-11-30') AS kept,"
    " count(*) FILTER (WHERE d NOT BETWEEN DATE '1996-01-01' AND DATE '1999-11-30') AS dropped"
    " FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem GROUP BY 1)",
)
def clip_date_range(spark, sf):
    days = table(spark, sf, "lineitem").groupBy(calendar_day("l_shipdate").alias("day")).count()
    return profile.clip_report(
        days, "day", F.lit(dt.date(1996, 1, 1)), F.lit(dt.date(1999, 11, 30))
    )


# ---- joins on plain tables


@register(
    "join_dim_lookup",
    f"WITH {oracle.TAXI} SELECT z.borough, z.zone_name, t.fhv_trips FROM"
    " (SELECT location_id, count(*) AS fhv_trips FROM fhv_trips GROUP BY 1) t"
    " JOIN taxi_zones z ON z.zone_id = CAST(t.location_id AS VARCHAR)",
)
def join_dim_lookup(spark, sf):
    """Zones are joined after aggregation. No broadcast is forced: both sides are
    small by then, and the planner broadcasts only what its statistics prove small."""
    taxi = views.taxi(spark, sf)
    trips = taxi["fhv_trips"].groupBy("location_id").agg(F.count(F.lit(1)).alias("fhv_trips"))
    zone = F.col("location_id").cast("string") == F.col("zone_id")
    return trips.join(taxi["taxi_zones"], zone).select("borough", "zone_name", "fhv_trips")


# ---- aggregates


@register(
    "agg_daily_count",
    f"WITH {oracle.TAXI} SELECT CAST(pickup_datetime AS DATE) AS trip_date, count(*) AS trips"
    " FROM yellow_trips GROUP BY 1",
)
def agg_daily_count(spark, sf):
    return daily_counts(views.taxi(spark, sf)["yellow_trips"], "pickup_datetime", "trip_date",
                        "trips")


@register(
    "agg_distinct",
    f"WITH {oracle.TAXI} SELECT suffix, count(DISTINCT pickup_datetime) AS pickup_times"
    " FROM yellow_trips GROUP BY 1",
)
def agg_distinct(spark, sf):
    rows = views.taxi(spark, sf)["yellow_trips"]
    return rows.groupBy("suffix").agg(F.count_distinct("pickup_datetime").alias("pickup_times"))


@register(
    "agg_distinct_approx",
    f"WITH {oracle.WEB} SELECT deviceCategory, count(DISTINCT visitor) AS users,"
    " TRUE AS within_three_sigma FROM sessions GROUP BY 1",
)
def agg_distinct_approx(spark, sf):
    """The sketch, which is mergeable, so a hot group costs no more than any other, held against the
    exact count: within three times its stated relative error."""
    return (
        views.web_sessions(spark, sf)
        .groupBy("device.deviceCategory")
        .agg(
            F.approx_count_distinct("fullVisitorId", 0.02).alias("about"),
            F.count_distinct("fullVisitorId").alias("users"),
        )
        .select("deviceCategory", "users",
                (F.abs(F.col("about") - F.col("users")) <= 0.06 * F.col("users")).alias("within_three_sigma"))
    )


@register(
    "agg_ratio_nullif",
    f"WITH {oracle.BIKES} SELECT bike_id, CAST(count(*) FILTER (WHERE bike_model = 'CLASSIC')"
    " AS DOUBLE) / nullif(count(*) FILTER (WHERE bike_model <> ''), 0) AS classic_rate"
    " FROM cycle_hire GROUP BY 1",
)
def agg_ratio_nullif(spark, sf):
    hires = views.bikes(spark, sf)["cycle_hire"].groupBy("bike_id").agg(
        F.count_if(F.col("bike_model") == "CLASSIC").alias("a"),
        F.count_if(F.col("bike_model") != "").alias("b"),
    )
    rate = F.col("a").cast("double") / F.nullif("b", F.lit(0))
    return hires.select("bike_id", rate.alias("classic_rate"))


@register(
    "agg_grouping_sets",
    "SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'ALL' ELSE l_returnflag END AS returnflag,"
    " CASE WHEN grouping(l_linestatus) = 1 THEN 'ALL' ELSE l_linestatus END AS linestatus,"
    " CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS n,"
    " CAST(sum(l_linenumber) AS BIGINT) AS line_numbers"
    " FROM lineitem GROUP BY CAST(date_trunc('month', l_shipdate) AS DATE),"
    " GROUPING SETS ((), (l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))",
)
def agg_grouping_sets(spark, sf):
    """Rolled up by ``grouping``, never by NULL: NULL may be a value of the dimension.

    The finest set is aggregated first. What Expand then copies per set is
    one row per cell, not the table.
    """
    month = F.trunc("l_shipdate", "month")
    cells = (
        table(spark, sf, "lineitem")
        .groupBy(month.alias("month"), "l_returnflag", "l_linestatus")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("line_numbers"))
    )
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    date = F.col("month")
    sets = [[date], [date, flag], [date, status], [date, flag, status]]
    return cells.groupingSets(sets, date, flag, status).agg(
        F.when(F.grouping("l_returnflag") == 1, "ALL").otherwise(flag).alias("returnflag"),
        F.when(F.grouping("l_linestatus") == 1, "ALL").otherwise(status).alias("linestatus"),
        F.sum("n").alias("n_rows"),
        F.sum("line_numbers").alias("lines"),
    ).select("returnflag", "linestatus", "month", F.col("n_rows").alias("n"),
             F.col("lines").alias("line_numbers"))


@register(
    "agg_having_dups",
    f"WITH {oracle.TRENDS} SELECT dma_id, term, week, count(*) AS n FROM top_terms"
    " GROUP BY 1, 2, 3 HAVING count(*) > 1",
)
def agg_having_dups(spark, sf):
    rows = views.trends(spark, sf)["top_terms"].groupBy("dma_id", "term", "week")
    return rows.agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@register(
    "agg_any_value",
    "SELECT o_custkey, min(o_orderdate) AS first_order, any_value(c_name) AS name"
    " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
)
def agg_any_value(spark, sf):
    """The orders are reduced to one row per customer before the join, not after."""
    firsts = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first_order")
    )
    joined = firsts.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("o_custkey").agg(
        F.any_value("first_order").alias("first_order"), F.any_value("c_name").alias("name")
    )


_PROFILED = ("vendor_id", "pickup_datetime", "dropoff_datetime", "passenger_count",
             "trip_distance", "rate_code", "payment_type", "fare_amount", "mta_tax", "tip_amount",
             "airport_fee", "total_amount", "pickup_location_id", "dropoff_location_id")


@register(
    "agg_null_profile",
    f"WITH {oracle.TAXI} SELECT count(*) AS total_rows, "
    + ", ".join(f"count(*) - count({c}) AS null_{c}" for c in _PROFILED)
    + " FROM yellow_trips",
)
def agg_null_profile(spark, sf):
    return profile.null_profile(views.taxi(spark, sf)["yellow_trips"], _PROFILED)


_DMA = ("dma_name", "dma_id")
_COUNTRY = ("country_code", "country_name", "region_code", "region_name")


def _trend_profile(name, grain, columns):
    @register(
        f"grain_profile_{name}",
        f"WITH {oracle.TRENDS} SELECT count(*) AS total_rows,"
        f" count(DISTINCT row({', '.join(grain)})) AS distinct_grain, "
        + ", ".join(f"count(*) - count({c}) AS null_{c}" for c in columns)
        + f" FROM {name}",
    )
    def build(spark, sf):
        return profile.null_profile(views.trends(spark, sf)[name], columns, grain)


_trend_profile("top_terms", ("dma_id", "term", "week"), ("week", "score", "rank", *_DMA, "term"))
_trend_profile("top_rising_terms", ("dma_id", "term", "week"),
               ("week", "score", "rank", "percent_gain", *_DMA, "term"))
_trend_profile("international_top_terms", ("country_code", "region_code", "term", "week"),
               ("week", "score", "rank", *_COUNTRY, "term"))
_trend_profile("international_top_rising_terms", ("country_code", "region_code", "term", "week"),
               ("week", "score", "rank", "percent_gain", *_COUNTRY, "term"))

_K1 = ("vendor_id", "pickup_datetime", "dropoff_datetime", "pickup_location_id",
       "dropoff_location_id")
_K2 = (*_K1, "passenger_count", "trip_distance", "fare_amount", "total_amount", "airport_fee")


@register(
    "agg_candidate_key",
    f"WITH {oracle.TAXI} SELECT count(*) AS total_rows,"
    f" count(DISTINCT row({', '.join(_K1)})) AS distinct_k1,"
    f" count(DISTINCT row({', '.join(_K2)})) AS distinct_k2 FROM yellow_trips",
)
def agg_candidate_key(spark, sf):
    return profile.candidate_keys(
        views.taxi(spark, sf)["yellow_trips"], {"k1": _K1, "k2": _K2}
    )


@register(
    "agg_null_rate_by_group",
    f"WITH {oracle.TRENDS} SELECT rank, count(*) AS row_count,"
    " count(*) - count(score) AS null_score,"
    " CAST(count(*) - count(score) AS DOUBLE) / count(*) AS null_rate,"
    " min(score) AS min_score, max(score) AS max_score FROM top_terms GROUP BY 1",
)
def agg_null_rate_by_group(spark, sf):
    return profile.null_rate_by_group(views.trends(spark, sf)["top_terms"], ["rank"], "score")


@register(
    "null_rate_by_week",
    f"WITH {oracle.TRENDS} SELECT week, count(*) AS row_count,"
    " count(*) - count(score) AS null_score,"
    " CAST(count(*) - count(score) AS DOUBLE) / count(*) AS null_rate FROM top_terms GROUP BY 1",
)
def null_rate_by_week(spark, sf):
    return profile.null_rate_by_group(views.trends(spark, sf)["top_terms"], ["week"], "score",
                                      bounds=False)


@register(
    "null_rate_empty_strings",
    f"WITH {oracle.TRENDS} SELECT rank, count(*) AS row_count,"
    " count(*) - count(score) AS null_score,"
    " CAST(count(*) - count(score) AS DOUBLE) / count(*) AS null_rate,"
    " count(*) FILTER (WHERE region_code = '') AS empty_region_code,"
    " count(*) - count(region_name) AS null_region_name"
    " FROM international_top_terms GROUP BY 1",
)
def null_rate_empty_strings(spark, sf):
    rows = views.trends(spark, sf)["international_top_terms"]
    return rows.groupBy("rank").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("score").isNull()).alias("null_score"),
        safe_divide(F.count_if(F.col("score").isNull()), F.count(F.lit(1))).alias("null_rate"),
        F.count_if(F.col("region_code") == "").alias("empty_region_code"),
        F.count_if(F.col("region_name").isNull()).alias("null_region_name"),
    ).orderBy("rank")


@register(
    "agg_conditional_rate",
    f"WITH {oracle.TRENDS} SELECT rank,"
    " count(*) FILTER (WHERE week >= DATE '1998-05-31') AS recent_rows,"
    " CAST(count(*) FILTER (WHERE week >= DATE '1998-05-31' AND score IS NULL) AS DOUBLE)"
    " / nullif(count(*) FILTER (WHERE week >= DATE '1998-05-31'), 0) AS recent_null_rate,"
    " count(*) FILTER (WHERE week < DATE '1998-05-31') AS older_rows,"
    " CAST(count(*) FILTER (WHERE week < DATE '1998-05-31' AND score IS NULL) AS DOUBLE)"
    " / nullif(count(*) FILTER (WHERE week < DATE '1998-05-31'), 0) AS older_null_rate"
    " FROM top_terms GROUP BY 1",
)
def agg_conditional_rate(spark, sf):
    recent = F.col("week") >= F.lit(dt.date(1998, 5, 31))
    return profile.conditional_null_rate(
        views.trends(spark, sf)["top_terms"], ["rank"], "score", recent, ("recent", "older")
    )


@register(
    "agg_null_cooccurrence",
    f"WITH {oracle.TAXI} SELECT vendor_id, payment_type, mta_tax IS NULL AS mta_tax_is_null,"
    " count(*) AS row_count, count(*) - count(airport_fee) AS null_airport_fee,"
    " round(avg(fare_amount), 2) AS avg_fare, round(avg(trip_distance), 2) AS avg_distance"
    " FROM yellow_trips GROUP BY 1, 2, 3",
)
def agg_null_cooccurrence(spark, sf):
    return profile.null_cooccurrence(
        views.taxi(spark, sf)["yellow_trips"],
        "mta_tax",
        ["vendor_id", "payment_type"],
        ["airport_fee"],
        {"avg_fare": "fare_amount", "avg_distance": "trip_distance"},
    )


@register(
    "agg_partition_inventory",
    f"WITH {oracle.TRENDS} "
    + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, max(refresh_date) AS latest_partition,"
        f" count(*) AS rows_all_partitions FROM {t}"
        for t in ("top_terms", "top_rising_terms", "international_top_terms",
                  "international_top_rising_terms")
    ),
)
def agg_partition_inventory(spark, sf):
    return profile.partition_inventory(views.trends(spark, sf), "refresh_date")


@register(
    "agg_last_per_group",
    "SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,"
    " arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_price FROM orders GROUP BY 1, 2",
)
def agg_last_per_group(spark, sf):
    return (
        table(spark, sf, "orders")
        .groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("month"))
        .agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("last_price"))
    )


# ---- windows


@register(
    "win_rolling_mean_full",
    "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)"
    " SELECT day, n, CASE WHEN count(*) OVER w = 7 THEN avg(n) OVER w END AS n_7d_avg FROM d"
    " WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)",
)
def win_rolling_mean_full(spark, sf):
    counts = daily_counts(table(spark, sf, "orders"), "o_orderdate", "day", "n")
    return timeline.rolling_mean_full(counts, (), "day", "n", 7, "n_7d_avg")


@register(
    "daily_trips_smoothed",
    f"WITH {oracle.TAXI}, d AS (SELECT CAST(pickup_datetime AS DATE) AS trip_date,"
    " count(*) AS trips FROM yellow_trips GROUP BY 1)"
    " SELECT trip_date, trips, CASE WHEN count(*) OVER w = 7 THEN avg(trips) OVER w END"
    " AS trips_7d_avg FROM d WHERE trip_date BETWEEN DATE '1997-01-01' AND DATE '1997-11-30'"
    " WINDOW w AS (ORDER BY trip_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)",
)
def daily_trips_smoothed(spark, sf):
    return smoothed_daily_counts(
        views.taxi(spark, sf)["yellow_trips"], "pickup_datetime", "trip_date", "trips",
        dt.date(1997, 1, 1), dt.date(1997, 11, 30),
    )


# ---- sorts


def _numbered(ordered):
    """The place of each row as it comes: an id that increases over sorted partitions, ranked again.
    In one task, so only for rows that are as few as nations."""
    place = W.orderBy("_id")
    return ordered.withColumn("_id", F.monotonically_increasing_id()).withColumn(
        "position", F.row_number().over(place).cast("long")
    ).drop("_id")


@register(
    "sort_asc",
    "SELECT c_nationkey, count(*) AS n, row_number() OVER (ORDER BY c_nationkey) AS position"
    " FROM customer GROUP BY 1",
)
def sort_asc(spark, sf):
    counts = table(spark, sf, "customer").groupBy("c_nationkey")
    return _numbered(counts.agg(F.count(F.lit(1)).alias("n")).orderBy("c_nationkey"))


@register(
    "sort_desc",
    "SELECT l_suppkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1"
    " ORDER BY 2 DESC, 1",
)
def sort_desc(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.sum("l_extendedprice").alias("revenue")
    )
    return rounded(sums, 2, "revenue").orderBy(F.desc("revenue"), "l_suppkey")


@register(
    "sort_multi",
    "SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier ORDER BY 1, 3 DESC, 2",
)
def sort_multi(spark, sf):
    rows = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return rows.orderBy("s_nationkey", F.desc("s_acctbal"), "s_suppkey")


@register(
    "topk_metric",
    "SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1"
    " ORDER BY 2 DESC, 1 LIMIT 15",
)
def topk_metric(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").cast("long").alias("quantity")
    )
    return sums.orderBy(F.desc("quantity"), "l_partkey").limit(15)


# ---- sets


@register("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def select_distinct(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_linenumber"
    ).dropDuplicates()


@register("union_distinct", "SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer")
def union_distinct(spark, sf):
    """Each side is made distinct on the map side by the same aggregate: one shuffle."""
    ids = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return ids.unionByName(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    ).distinct()


# ---- scalar functions


def _function(name, tbl, sql, columns):
    """A projection of one table; ``sql`` is its select list, or a whole statement."""

    @register(name, sql if sql.startswith("SELECT") else f"SELECT {sql} FROM {tbl}")
    def build(spark, sf):
        return table(spark, sf, tbl).select(
            *(F.col(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in columns().items())
        )


_function("fn_cast_date", "events", "event_id, CAST(ts AS DATE) AS day",
          lambda: dict(event_id="event_id", day=calendar_day("ts")))
_function("fn_cast", "lineitem",
          "l_orderkey, CAST(trunc(l_quantity) AS INTEGER) AS whole,"
          " CAST(l_linenumber AS DOUBLE) AS wide, CAST(l_partkey AS VARCHAR) AS text",
          lambda: dict(l_orderkey="l_orderkey", whole=F.col("l_quantity").cast("int"),
          wide=F.col("l_linenumber").cast("double"), text=F.col("l_partkey").cast("string")))
_function("fn_date_sub", "orders",
          "o_orderkey, CAST(o_orderdate AS DATE) - 30 AS month_before",
          lambda: dict(o_orderkey="o_orderkey", month_before=F.date_sub(calendar_day("o_orderdate"), 30)))
_function("fn_format_date", "orders",
          "o_orderkey, strftime(o_orderdate, '%Y%m%d') AS daily, strftime(o_orderdate, '%Y')"
          " AS yearly",
          lambda: dict(o_orderkey="o_orderkey", daily=shard_suffix("o_orderdate"),
          yearly=shard_suffix("o_orderdate", "yyyy")))
_function("fn_timestamp_diff", "events",
          "event_id, CAST(trunc(epoch(ts) - epoch(TIMESTAMP '2024-01-10 12:00:00')) AS BIGINT)"
          " AS seconds",
          lambda: dict(event_id="event_id", seconds=F.timestamp_diff(
              "SECOND", F.expr("TIMESTAMP_NTZ '2024-01-10 12:00:00'"), F.col("ts"))))
_function("fn_datediff", "lineitem",
          "l_orderkey, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))"
          " AS INTEGER) AS days",
          lambda: dict(l_orderkey="l_orderkey",
          days=F.date_diff(calendar_day("l_shipdate"), F.lit(dt.date(1995, 1, 1)))))
_function("fn_date_trunc", "orders",
          "o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,"
          " CAST(date_trunc('week', o_orderdate) AS DATE) AS week",
          lambda: dict(o_orderkey="o_orderkey", month=F.trunc("o_orderdate", "month"),
          week=F.trunc("o_orderdate", "week")))
_function("fn_months_since", "lineitem",
          "l_orderkey, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 3 AS INTEGER)"
          " AS months",
          lambda: dict(l_orderkey="l_orderkey",
          months=calendar_months_between(F.lit(dt.date(1995, 3, 31)), F.col("l_shipdate"))))
_function("fn_substring_year_month", "orders",
          "o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y,"
          " CAST(month(o_orderdate) AS INTEGER) AS m,"
          " substr(o_orderpriority, 1, 1) AS priority",
          lambda: dict(o_orderkey="o_orderkey", y=F.year("o_orderdate"), m=F.month("o_orderdate"),
          priority=F.substring("o_orderpriority", 1, 1)))
_function("fn_age_bucket", "lineitem",
          "SELECT l_orderkey, CASE WHEN d <= 30 THEN '0-30 (new)' WHEN d <= 90 THEN '31-90'"
          " WHEN d <= 365 THEN '91-365' ELSE '366+ (established)' END AS bucket FROM (SELECT"
          " l_orderkey, date_diff('day', DATE '1998-01-01', CAST(l_shipdate AS DATE)) AS d"
          " FROM lineitem)",
          lambda: dict(l_orderkey="l_orderkey", bucket=age_bucket(
              F.date_diff(calendar_day("l_shipdate"), F.lit(dt.date(1998, 1, 1))))))
_function("fn_case_if", "orders",
          "o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'done' END AS state,"
          " CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS large",
          lambda: dict(o_orderkey="o_orderkey",
          state=F.when(F.col("o_orderstatus") == "O", "open").otherwise("done"),
          large=F.when(F.col("o_totalprice") > 100000, 1).otherwise(0)))
_function("fn_coalesce_nullif", "lineitem",
          "l_orderkey, nullif(l_linenumber, 1) AS later, coalesce(nullif(l_linenumber, 1), 0)"
          " AS filled",
          lambda: dict(l_orderkey="l_orderkey", later=F.nullif("l_linenumber", F.lit(1)),
          filled=F.coalesce(F.nullif("l_linenumber", F.lit(1)), F.lit(0))))
_function("fn_safe_divide", "lineitem",
          "l_orderkey, CAST(l_quantity AS DOUBLE) / nullif(l_linenumber - 1, 0) AS ratio",
          lambda: dict(l_orderkey="l_orderkey",
          ratio=safe_divide("l_quantity", F.col("l_linenumber") - 1)))
_function("fn_round", "part",
          "p_partkey, round(p_retailprice, 2) AS price",
          lambda: dict(p_partkey="p_partkey", price=F.round("p_retailprice", 2)))
_function("fn_gib_bytes_usd", "orders",
          "o_orderkey, CAST(o_custkey * 1073741824 AS BIGINT) AS bytes,"
          " o_orderkey / 1073741824.0::DOUBLE AS gib,"
          " o_orderkey / 1099511627776.0::DOUBLE * 6.25::DOUBLE AS usd",
          lambda: dict(o_orderkey="o_orderkey", bytes=gib_to_bytes("o_custkey"),
          gib=bytes_to_gib("o_orderkey"), usd=estimated_usd("o_orderkey")))
@register(
    "fn_struct_access",
    f"WITH {oracle.WEB} SELECT k AS visit, deviceCategory = 'mobile' AS mobile, pagePath AS page"
    " FROM hits",
)
def fn_struct_access(spark, sf):
    """Fields of a struct, and of structs in an array of structs."""
    visits = views.web_sessions(spark, sf).select(
        F.col("visitId").alias("visit"), F.col("device.isMobile").alias("mobile"), F.col("hits.page").alias("pages")
    )
    return visits.select("visit", "mobile", F.explode("pages.pagePath").alias("page"))


_function("fn_human_bytes", "orders",
          "SELECT o_orderkey, CASE WHEN b IS NULL THEN 'unknown'"
          " WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B'"
          " WHEN b < 1048576 THEN printf('%.2f KiB', b / 1024.0)"
          " WHEN b < 1073741824 THEN printf('%.2f MiB', b / 1048576.0)"
          " WHEN b < 1099511627776 THEN printf('%.2f GiB', b / 1073741824.0)"
          " ELSE printf('%.2f TiB', b / 1099511627776.0) END AS size FROM (SELECT o_orderkey,"
          " nullif(o_orderkey, 3) * o_custkey * o_custkey * 40 AS b FROM orders)",
          lambda: dict(o_orderkey="o_orderkey",
          # a product of three keys soon exceeds a long
          size=human_bytes(F.nullif("o_orderkey", F.lit(3)).cast("decimal(38,0)")
                           * F.col("o_custkey") * F.col("o_custkey") * 40)))


@register(
    "fn_sequence_explode",
    "SELECT o_orderkey, CAST(unnest(generate_series(CAST(date_trunc('week', o_orderdate)"
    " AS TIMESTAMP), CAST(o_orderdate AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM orders",
)
def fn_sequence_explode(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.trunc("o_orderdate", "week").alias("monday"),
        calendar_day("o_orderdate").alias("last"))
    return timeline.spine(orders, "monday", F.col("last")).select("o_orderkey", "day")


@register(
    "fn_grouping",
    "SELECT o_orderstatus, grouping(o_orderstatus) AS rolled_up, count(*) AS n FROM orders"
    " GROUP BY GROUPING SETS ((), (o_orderstatus))",
)
def fn_grouping(spark, sf):
    status = F.col("o_orderstatus")
    return table(spark, sf, "orders").groupingSets([[], [status]], status).agg(
        F.grouping("o_orderstatus").cast("long").alias("rolled_up"),
        F.count(F.lit(1)).alias("n"),
    )


@register(
    "fn_struct_key",
    "SELECT count(DISTINCT row(score, term)) AS keys FROM (SELECT nullif(CAST(l_quantity AS BIGINT)"
    " % 10, 0) AS score, l_partkey AS term FROM lineitem)",
)
def fn_struct_key(spark, sf):
    """A key with a NULL part still counts."""
    rows = table(spark, sf, "lineitem").select(
        F.nullif(F.col("l_quantity").cast("long") % 10, F.lit(0)).alias("score"),
        F.col("l_partkey").alias("term"),
    )
    return rows.agg(F.count_distinct(F.struct("score", "term")).alias("keys"))
