"""Queries for the metric layer: every metric, every segment, every kind of window."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline.operators.governance import Dataset, Segment, Table, check_against
from plumbline.operators.metric import UnboundedScan, metric_query, unnest
from plumbline.operators.search import TextSource, text_search
from plumbline.operators.window import TimeWindow
from plumbline.plans.library import ACCOUNTS, BIKES, REGISTRY, TAXI, TRENDS, WEB
from plumbline.testbed import oracle, views
from plumbline.testbed.catalog import register, rounded

#: A narrow window, for the guard.
WINDOW = TimeWindow(start="1995-03-01", end="1999-10-31")

_VIEWS = {
    WEB.name: lambda spark, sf: {"sessions": views.web_sessions(spark, sf)},
    TRENDS.name: views.trends,
    BIKES.name: views.bikes,
    TAXI.name: views.taxi,
    ACCOUNTS.name: views.account_tables,
}
_CTES = {
    WEB.name: oracle.WEB,
    TRENDS.name: oracle.TRENDS,
    BIKES.name: oracle.BIKES,
    TAXI.name: oracle.TAXI,
}
#: What the anchors of the views are taken from.
_ANCHORS = {
    WEB.name: ("orders", "o_orderdate"),
    TRENDS.name: ("lineitem", "trunc(l_shipdate, 'month')"),
    TAXI.name: ("lineitem", "l_shipdate"),
}


def whole(spark, sf, dataset: Dataset) -> TimeWindow:
    """The window that an anchored view spans, which a request must name."""
    name, day = _ANCHORS[dataset.name]
    return TimeWindow.spanning(views.table(spark, sf, name), F.expr(day))


def _metric(name, dataset: Dataset, metric, sql, digits=None, **request):
    anchored = dataset.table(dataset.metric(metric).table).anchor

    @register(name, f"WITH {_CTES[dataset.name]} {sql}")
    def build(spark, sf):
        tables = _VIEWS[dataset.name](spark, sf)
        window = request.get("window") or (whole(spark, sf, dataset) if anchored else None)
        df = metric_query(tables, dataset, metric, **{**request, "window": window})
        return df if digits is None else rounded(df, digits, metric)


# ---- web sessions
_metric("metric_sessions", WEB, "sessions", dimensions=["channelGrouping"],
        sql="SELECT channelGrouping, count(*) AS sessions FROM sessions GROUP BY 1")
_metric("metric_users", WEB, "users", dimensions=["device.deviceCategory"],
        sql="SELECT deviceCategory, count(DISTINCT visitor) AS users FROM sessions GROUP BY 1")
_metric("metric_pageviews", WEB, "pageviews", dimensions=["geoNetwork.country"],
        sql="SELECT country, CAST(sum(pageviews) AS BIGINT) AS pageviews FROM sessions GROUP BY 1")
_metric("metric_pages_per_session", WEB, "pages_per_session", dimensions=["channelGrouping"],
        sql="SELECT channelGrouping, CAST(sum(pageviews) AS DOUBLE) / count(*)"
            " AS pages_per_session FROM sessions GROUP BY 1")
_metric("metric_bounce_rate", WEB, "bounce_rate", dimensions=["channelGrouping"],
        sql="SELECT channelGrouping, CAST(sum(bounces) AS DOUBLE) / count(*) AS bounce_rate"
            " FROM sessions GROUP BY 1")
_metric("metric_avg_session_duration", WEB, "avg_session_duration",
        dimensions=["trafficSource.medium"],
        sql="SELECT medium, CAST(sum(timeOnSite) AS DOUBLE) / count(*) AS avg_session_duration"
            " FROM sessions GROUP BY 1")
_metric("metric_transactions", WEB, "transactions", dimensions=["date"],
        sql="SELECT suffix AS date, CAST(sum(transactions) AS BIGINT) AS transactions"
            " FROM sessions GROUP BY 1")
_metric("metric_transaction_revenue", WEB, "transaction_revenue", dimensions=["channelGrouping"],
        sql="SELECT channelGrouping, CAST(sum(revenue) AS DOUBLE) / 1000000"
            " AS transaction_revenue FROM sessions GROUP BY 1")
_metric("metric_ecommerce_conversion_rate", WEB, "ecommerce_conversion_rate",
        dimensions=["geoNetwork.country", "device.deviceCategory"],
        sql="SELECT country, deviceCategory, CAST(sum(transactions) AS DOUBLE) / count(*)"
            " AS ecommerce_conversion_rate FROM sessions GROUP BY 1, 2")
_metric("metric_hit_pageviews", WEB, "hit_pageviews", dimensions=["hits.page.pagePath"],
        sql="SELECT pagePath, count(*) FILTER (WHERE type = 'PAGE') AS hit_pageviews"
            " FROM hits GROUP BY 1")
_metric("metric_product_revenue", WEB, "product_revenue", dimensions=["product.v2ProductName"],
        sql="SELECT v2ProductName, CAST(sum(productRevenue) AS DOUBLE) / 1000000"
            " AS product_revenue FROM products GROUP BY 1")
_metric("metric_product_qty_sold", WEB, "product_qty_sold", dimensions=["product.v2ProductName"],
        sql="SELECT v2ProductName, CAST(sum(CASE WHEN action_type = '6' THEN productQuantity"
            " ELSE 0 END) AS BIGINT) AS product_qty_sold FROM products GROUP BY 1")

# ---- search trends
_metric("metric_avg_score", TRENDS, "avg_score", dimensions=["term"], digits=6,
        sql="SELECT term, round(avg(score), 6) AS avg_score FROM top_terms"
            " WHERE score IS NOT NULL GROUP BY 1")
_metric("metric_term_appearances", TRENDS, "term_appearances", dimensions=["term"],
        sql="SELECT term, count(*) AS term_appearances FROM top_terms GROUP BY 1")
_metric("metric_distinct_terms", TRENDS, "distinct_terms", dimensions=["week"],
        sql="SELECT week, count(DISTINCT term) AS distinct_terms FROM top_terms GROUP BY 1")
_metric("metric_avg_percent_gain", TRENDS, "avg_percent_gain", dimensions=["dma_id"], digits=6,
        sql="SELECT dma_id, round(avg(percent_gain), 6) AS avg_percent_gain"
            " FROM top_rising_terms GROUP BY 1")
_metric("metric_intl_avg_score", TRENDS, "intl_avg_score",
        dimensions=["country_code", "region_code"], digits=6,
        sql="SELECT country_code, region_code, round(avg(score), 6) AS intl_avg_score"
            " FROM international_top_terms WHERE score IS NOT NULL GROUP BY 1, 2")

# ---- bikes
_metric("metric_hires", BIKES, "hires", dimensions=["to_date(start_date) AS day"],
        sql="SELECT CAST(start_date AS DATE) AS day, count(*) AS hires FROM cycle_hire GROUP BY 1")
_metric("metric_avg_duration_min", BIKES, "avg_duration_min", dimensions=["start_station_id"],
        digits=6,
        sql="SELECT start_station_id, round(avg(duration) / 60, 6) AS avg_duration_min"
            " FROM cycle_hire WHERE duration > 0 AND start_station_id IS NOT NULL GROUP BY 1")
_metric("metric_total_duration_hours", BIKES, "total_duration_hours", dimensions=["bike_model"],
        sql="SELECT bike_model, CAST(sum(duration) AS DOUBLE) / 3600 AS total_duration_hours"
            " FROM cycle_hire WHERE duration > 0 AND start_station_id IS NOT NULL GROUP BY 1")
_metric("metric_unique_bikes", BIKES, "unique_bikes", dimensions=["end_station_id"],
        sql="SELECT end_station_id, count(DISTINCT bike_id) AS unique_bikes"
            " FROM cycle_hire GROUP BY 1")
_metric("metric_ebike_share", BIKES, "ebike_share", dimensions=["start_station_id"],
        sql="SELECT start_station_id, CAST(count(*) FILTER (WHERE bike_model = 'PBSC_EBIKE')"
            " AS DOUBLE) / nullif(count(*) FILTER (WHERE bike_model IN ('CLASSIC', 'PBSC_EBIKE'))"
            ", 0) AS ebike_share FROM cycle_hire GROUP BY 1")
_metric("metric_stations", BIKES, "stations", dimensions=["installed"],
        sql="SELECT installed, count(*) AS stations FROM cycle_stations GROUP BY 1")
_metric("metric_total_docks", BIKES, "total_docks", dimensions=["installed"],
        sql="SELECT installed, CAST(sum(docks_count) AS BIGINT) AS total_docks"
            " FROM cycle_stations GROUP BY 1")
_metric("metric_bikes_available", BIKES, "bikes_available", dimensions=["installed"],
        sql="SELECT installed, CAST(sum(bikes_count) AS BIGINT) AS bikes_available"
            " FROM cycle_stations GROUP BY 1")

# ---- taxis
_metric("metric_trips", TAXI, "trips", dimensions=["pickup_location_id"],
        sql="SELECT pickup_location_id, count(*) AS trips FROM yellow_trips GROUP BY 1")
_metric("metric_avg_fare", TAXI, "avg_fare", dimensions=["payment_type"],
        segments=["valid_trip"], digits=4,
        sql="SELECT payment_type, round(avg(fare_amount), 4) AS avg_fare FROM yellow_trips"
            " WHERE fare_amount > 0 AND trip_distance > 0 GROUP BY 1")
_metric("metric_avg_total", TAXI, "avg_total", dimensions=["rate_code"], digits=4,
        sql="SELECT rate_code, round(avg(total_amount), 4) AS avg_total"
            " FROM yellow_trips GROUP BY 1")
_metric("metric_total_revenue", TAXI, "total_revenue", dimensions=["suffix"], digits=3,
        sql="SELECT suffix, round(sum(total_amount), 3) AS total_revenue"
            " FROM yellow_trips GROUP BY 1")
_metric("metric_avg_trip_distance", TAXI, "avg_trip_distance", digits=6,
        dimensions=["pickup_location_id"],
        sql="SELECT pickup_location_id, round(avg(trip_distance), 6) AS avg_trip_distance"
            " FROM yellow_trips GROUP BY 1")
_metric("metric_avg_passengers", TAXI, "avg_passengers", dimensions=["vendor_id"], digits=6,
        sql="SELECT vendor_id, round(avg(passenger_count), 6) AS avg_passengers"
            " FROM yellow_trips GROUP BY 1")
_metric("metric_tip_pct", TAXI, "tip_pct", dimensions=["vendor_id"], digits=8,
        sql="SELECT vendor_id, round(sum(tip_amount) / nullif(sum(fare_amount), 0), 8) AS tip_pct"
            " FROM yellow_trips WHERE payment_type = '1' GROUP BY 1")
_metric("metric_avg_speed_mph", TAXI, "avg_speed_mph", dimensions=["passenger_count"], digits=6,
        sql="SELECT passenger_count, round(sum(trip_distance) /"
            " nullif(sum(date_diff('second', pickup_datetime, dropoff_datetime)) / 3600.0, 0), 6)"
            " AS avg_speed_mph FROM yellow_trips GROUP BY 1")
_metric("metric_green_trips", TAXI, "green_trips", dimensions=["pickup_location_id"],
        sql="SELECT pickup_location_id, count(*) AS green_trips FROM green_trips GROUP BY 1")
_metric("metric_green_avg_fare", TAXI, "green_avg_fare", dimensions=["payment_type"], digits=4,
        sql="SELECT payment_type, round(avg(fare_amount), 4) AS green_avg_fare"
            " FROM green_trips GROUP BY 1")
_metric("metric_green_total_revenue", TAXI, "green_total_revenue", dimensions=["suffix"],
        digits=3,
        sql="SELECT suffix, round(sum(total_amount), 3) AS green_total_revenue"
            " FROM green_trips GROUP BY 1")
_metric("metric_fhv_trips", TAXI, "fhv_trips", dimensions=["location_id"],
        sql="SELECT location_id, count(*) AS fhv_trips FROM fhv_trips GROUP BY 1")

# ---- segments
for _name, _where in {
    "mobile": "deviceCategory = 'mobile'",
    "desktop": "deviceCategory = 'desktop'",
    "organic": "medium = 'organic'",
    "paid": "medium = 'cpc'",
    "direct": "channelGrouping = 'Direct'",
    "us_sessions": "country = 'United States'",
    "converted": "transactions >= 1",
}.items():
    _metric(f"segment_{_name}", WEB, "sessions", dimensions=["date"], segments=[_name],
            sql=f"SELECT suffix AS date, count(*) AS sessions FROM sessions WHERE {_where}"
                " GROUP BY 1")
for _name, _where in {
    "purchase_hits": "action_type = '6'",
    "page_hits": "type = 'PAGE'",
}.items():
    _metric(f"segment_{_name}", WEB, "product_revenue", dimensions=["channelGrouping"],
            segments=[_name],
            sql="SELECT channelGrouping, CAST(sum(productRevenue) AS DOUBLE) / 1000000"
                f" AS product_revenue FROM products WHERE {_where} GROUP BY 1")
for _name, _where in {"top_10": "rank <= 10", "top_5": "rank <= 5",
                      "nonnull_score": "score IS NOT NULL"}.items():
    _metric(f"segment_{_name}", TRENDS, "term_appearances", dimensions=["dma_name", "week"],
            segments=[_name],
            sql="SELECT dma_name, week, count(*) AS term_appearances FROM top_terms"
                f" WHERE {_where} GROUP BY 1, 2")
_metric("segment_country_us", TRENDS, "intl_avg_score", dimensions=["term"], digits=6,
        segments=["country_us"],
        sql="SELECT term, round(avg(score), 6) AS intl_avg_score FROM international_top_terms"
            " WHERE score IS NOT NULL AND country_code = 'US' GROUP BY 1")
for _name, _where in {
    "valid_trip": "duration > 0 AND start_station_id IS NOT NULL",
    "round_trip": "start_station_id = end_station_id",
    "model_recorded": "bike_model IN ('CLASSIC', 'PBSC_EBIKE')",
    "ebike": "bike_model = 'PBSC_EBIKE'",
    "classic": "bike_model = 'CLASSIC'",
}.items():
    _metric(f"segment_bike_{_name}", BIKES, "unique_bikes", segments=[_name],
            dimensions=["to_date(start_date) AS day"],
            sql="SELECT CAST(start_date AS DATE) AS day, count(DISTINCT bike_id) AS unique_bikes"
                f" FROM cycle_hire WHERE {_where} GROUP BY 1")
for _name, _where in {
    "valid_trip": "fare_amount > 0 AND trip_distance > 0",
    "credit_card": "payment_type = '1'",
    "cash": "payment_type = '2'",
    "jfk_trips": "rate_code = '2.0'",
    "multi_passenger": "passenger_count > 1",
    "tipped": "tip_amount > 0",
}.items():
    _metric(f"segment_taxi_{_name}", TAXI, "trips", segments=[_name],
            dimensions=["suffix", "pickup_location_id"],
            sql="SELECT suffix, pickup_location_id, count(*) AS trips FROM yellow_trips"
                f" WHERE {_where} GROUP BY 1, 2")

# ---- the request itself
_metric("metric_query", TAXI, "tip_pct", digits=8, limit=7,
        dimensions=["pickup_location_id", "rate_code"], segments=["valid_trip", "tipped"],
        window=TimeWindow(start="1996-03-01", end="1999-06-30"),
        sql="SELECT pickup_location_id, rate_code,"
            " round(sum(tip_amount) / nullif(sum(fare_amount), 0), 8) AS tip_pct"
            " FROM yellow_trips WHERE suffix BETWEEN '1996' AND '1999' AND payment_type = '1'"
            " AND fare_amount > 0 AND trip_distance > 0 AND tip_amount > 0"
            " GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 7")
_metric("metric_topk", TRENDS, "term_appearances", dimensions=["term"], limit=10,
        sql="SELECT term, count(*) AS term_appearances FROM top_terms GROUP BY 1"
            " ORDER BY 2 DESC, 1 LIMIT 10")
_metric("metric_bottomk", TRENDS, "distinct_terms", dimensions=["week"], limit=5,
        descending=False,
        sql="SELECT week, count(DISTINCT term) AS distinct_terms FROM top_terms GROUP BY 1"
            " ORDER BY 2, 1 LIMIT 5")
_metric("metric_global", TRENDS, "distinct_terms",
        sql="SELECT count(DISTINCT term) AS distinct_terms FROM top_terms")
_metric("metric_unnest", WEB, "hit_pageviews", segments=["mobile"],
        dimensions=["channelGrouping", "hits.eCommerceAction.action_type"],
        sql="SELECT channelGrouping, action_type, count(*) FILTER (WHERE type = 'PAGE')"
            " AS hit_pageviews FROM hits WHERE deviceCategory = 'mobile' GROUP BY 1, 2")
_metric("segment_filter", BIKES, "avg_duration_min", digits=6,
        dimensions=["end_station_id"], segments=["valid_trip", "ebike", "round_trip"],
        sql="SELECT end_station_id, round(avg(duration) / 60, 6) AS avg_duration_min"
            " FROM cycle_hire WHERE duration > 0 AND start_station_id IS NOT NULL"
            " AND bike_model = 'PBSC_EBIKE' AND start_station_id = end_station_id GROUP BY 1")

# ---- windows
_metric("window_last_n_days", TRENDS, "term_appearances", dimensions=["refresh_date"],
        window=TimeWindow(last_n_days=400), as_of=dt.date(1998, 6, 15),
        sql="SELECT refresh_date, count(*) AS term_appearances FROM top_terms"
            " WHERE refresh_date >= DATE '1998-06-15' - 400 GROUP BY 1")
_metric("window_between", BIKES, "hires", dimensions=["bike_model"],
        window=TimeWindow(start="2024-01-08", end="2024-01-14"),
        sql="SELECT bike_model, count(*) AS hires FROM cycle_hire"
            " WHERE start_date >= DATE '2024-01-08' AND start_date < DATE '2024-01-15' GROUP BY 1")
_metric("window_fallback_time_column", BIKES, "unique_bikes", dimensions=["end_station_id"],
        window=TimeWindow(last_n_days=10), as_of=dt.date(2024, 1, 25),
        sql="SELECT end_station_id, count(DISTINCT bike_id) AS unique_bikes FROM cycle_hire"
            " WHERE start_date >= DATE '2024-01-15' GROUP BY 1")


# ---- a table-wide hygiene filter
_CLEAN = Dataset(
    name="clean_trips",
    tables=(
        Table("yellow_trips", "one trip", shard_suffix="suffix", shard_pattern="yyyy",
              hygiene_filter="fare_amount > 0 AND passenger_count < 7"),
    ),
    segments=(Segment("long_or_shared", "trip_distance > 30 OR passenger_count > 3"),),
    metrics=(TAXI.metric("avg_trip_distance"),),
)


@register(
    "hygiene_filter",
    f"WITH {oracle.TAXI} SELECT payment_type, round(avg(trip_distance), 6) AS avg_trip_distance"
    " FROM yellow_trips WHERE fare_amount > 0 AND passenger_count < 7"
    " AND (trip_distance > 30 OR passenger_count > 3) GROUP BY 1",
)
def hygiene_filter(spark, sf):
    df = metric_query(views.taxi(spark, sf), _CLEAN, "avg_trip_distance", ["payment_type"],
                      ["long_or_shared"], whole(spark, sf, TAXI))
    return rounded(df, 6, "avg_trip_distance")


@register(
    "full_scan_guard",
    f"WITH {oracle.TAXI_WINDOW} SELECT suffix, count(*) AS trips FROM yellow_trips GROUP BY 1",
)
def full_scan_guard(spark, sf):
    """The anchored table refuses a request without a window, and one on another column."""
    tables = views.taxi(spark, sf)
    for window in (None, TimeWindow(start="1996-01-01", column="pickup_datetime")):
        try:
            metric_query(tables, TAXI, "trips", ["suffix"], window=window)
        except UnboundedScan:
            continue
        raise AssertionError("an unbounded scan was accepted")
    return metric_query(tables, TAXI, "trips", ["suffix"], window=WINDOW)


@register(
    "spec_reference_check",
    f"WITH {oracle.TAXI} SELECT count(*) AS trips FROM yellow_trips",
)
def spec_reference_check(spark, sf):
    """Every metric of every dataset resolves against its table before one of them runs."""
    for dataset in REGISTRY.datasets:
        check_against(dataset, _VIEWS[dataset.name](spark, sf))
    return metric_query(views.taxi(spark, sf), TAXI, "trips", window=whole(spark, sf, TAXI))


@register(
    "join_lateral_unnest",
    f"WITH {oracle.WEB} SELECT k AS visitId, i AS hitNumber, v2ProductName, productQuantity"
    " FROM products",
)
def join_lateral_unnest(spark, sf):
    rows = unnest(views.web_sessions(spark, sf), ["hits", "hits.product"])
    return rows.select("visitId", "hits.hitNumber", "product.v2ProductName",
                       "product.productQuantity")


_SEARCH_SQL = """
SELECT 'part' AS kind, CAST(p_partkey AS VARCHAR) AS name FROM part
WHERE contains(lower(p_name), '{q}') OR contains(lower(p_brand), '{q}')
   OR contains(lower(p_type), '{q}')
UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR) FROM supplier
WHERE contains(lower(s_name), '{q}')
UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR) FROM documents
WHERE contains(lower(text), '{q}') OR contains(lower(source), '{q}')
"""


@register("text_search", _SEARCH_SQL.format(q="er"))
def search(spark, sf):
    sources = [
        TextSource("part", views.table(spark, sf, "part"), "p_partkey",
                   ("p_name", "p_brand", "p_type")),
        TextSource("supplier", views.table(spark, sf, "supplier"), "s_suppkey", ("s_name",)),
        TextSource("document", views.table(spark, sf, "documents"), "doc_id", ("text", "source")),
    ]
    return text_search(sources, " ER ")


@register(
    "fn_timestamp_seconds",
    "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS posix, CAST(o_orderdate AS DATE)"
    " AS day, CAST(o_orderdate AS DATE) AS parsed FROM orders",
)
def fn_timestamp_seconds(spark, sf):
    """POSIX seconds and 'YYYYMMDD' text, the two ways sessions store a date."""
    epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    rows = views.table(spark, sf, "orders").select(
        "o_orderkey",
        F.timestamp_diff("SECOND", epoch, F.col("o_orderdate")).alias("posix"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("text"),
    )
    return rows.select(
        "o_orderkey",
        "posix",
        F.date_add(F.lit(dt.date(1970, 1, 1)), F.expr("int(posix div 86400)")).alias("day"),
        F.to_date("text", "yyyyMMdd").alias("parsed"),
    )
