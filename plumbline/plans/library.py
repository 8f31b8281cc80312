"""The curated datasets: 37 metrics and 24 segments, as data.

Fixed values: the names, predicates and aggregate definitions below are the
contract that reports rely on. Expressions are Spark SQL.
"""

from __future__ import annotations

from plumbline.operators.governance import Dataset, Metric, Registry, Segment, Table

WEB = Dataset(
    name="web_analytics",
    description="Sessions of an online shop with their hits and products, one shard per day.",
    tables=(
        Table(
            name="sessions",
            grain="one visit: (fullVisitorId, visitId)",
            shard_suffix="suffix",
            shard_pattern="yyyyMMdd",
            time_column="date",
            join_keys=("fullVisitorId", "visitId"),
            columns={
                "fullVisitorId": "string",
                "visitId": "bigint",
                "date": "string",
                "channelGrouping": "string",
                "totals": "struct<pageviews:bigint,timeOnSite:bigint,bounces:bigint,"
                "transactions:bigint,totalTransactionRevenue:bigint>",
                "trafficSource": "struct<medium:string>",
                "device": "struct<deviceCategory:string,isMobile:boolean>",
                "geoNetwork": "struct<country:string>",
                "hits": "array<struct<type:string,hitNumber:int,page:struct<pagePath:string>,"
                "eCommerceAction:struct<action_type:string>,product:array<struct<"
                "v2ProductName:string,productRevenue:bigint,productQuantity:bigint>>>>",
            },
        ),
    ),
    segments=(
        Segment("mobile", "device.isMobile", "visits from phones"),
        Segment("desktop", "device.deviceCategory = 'desktop'", "visits from desktops"),
        Segment("organic", "trafficSource.medium = 'organic'", "unpaid search"),
        Segment("paid", "trafficSource.medium = 'cpc'", "paid search"),
        Segment("direct", "channelGrouping = 'Direct'", "direct channel"),
        Segment("us_sessions", "geoNetwork.country = 'United States'", "US visits"),
        Segment("converted", "totals.transactions >= 1", "visits that bought something"),
        Segment("purchase_hits", "hits.eCommerceAction.action_type = '6'", "after unnesting hits"),
        Segment("page_hits", "hits.type = 'PAGE'", "after unnesting hits"),
    ),
    metrics=(
        Metric("sessions", "sessions", "count(1)"),
        Metric("users", "sessions", "count(DISTINCT fullVisitorId)"),
        Metric("pageviews", "sessions", "sum(totals.pageviews)"),
        Metric("pages_per_session", "sessions", "try_divide(sum(totals.pageviews), count(1))"),
        Metric("bounce_rate", "sessions", "try_divide(sum(totals.bounces), count(1))"),
        Metric("avg_session_duration", "sessions", "try_divide(sum(totals.timeOnSite), count(1))"),
        Metric("transactions", "sessions", "sum(totals.transactions)"),
        Metric(
            "transaction_revenue",
            "sessions",
            "try_divide(sum(totals.totalTransactionRevenue), 1000000)",
        ),
        Metric(
            "ecommerce_conversion_rate",
            "sessions",
            "try_divide(sum(totals.transactions), count(1))",
        ),
        Metric("hit_pageviews", "sessions", "count_if(hits.type = 'PAGE')", unnest=("hits",)),
        Metric(
            "product_revenue",
            "sessions",
            "try_divide(sum(product.productRevenue), 1000000)",
            unnest=("hits", "hits.product"),
        ),
        Metric(
            "product_qty_sold",
            "sessions",
            "sum(CASE WHEN hits.eCommerceAction.action_type = '6' "
            "THEN product.productQuantity ELSE 0 END)",
            unnest=("hits", "hits.product"),
        ),
    ),
    notes=(
        "Totals are NULL, not 0, where nothing happened: a rate divides a sum by the row count.",
        "Revenue is stored in millionths of the currency unit.",
        "A session metric must not run on unnested rows: every session would count once per hit.",
    ),
)

_TREND_COLUMNS = {
    "term": "string",
    "week": "date",
    "score": "bigint",
    "rank": "bigint",
    "refresh_date": "date",
}
_DMA = {"dma_id": "bigint", "dma_name": "string"}
_COUNTRY = {
    "country_name": "string",
    "country_code": "string",
    "region_name": "string",
    "region_code": "string",
}


def _trend_table(name: str, place: dict[str, str], rising: bool) -> Table:
    columns = {**place, **_TREND_COLUMNS}
    if rising:
        columns["percent_gain"] = "bigint"
    keys = tuple(k for k in place if not k.endswith("_name"))
    return Table(
        name=name,
        grain=f"one ({', '.join(keys)}, term, week) as reported on refresh_date",
        partition_column="refresh_date",
        time_column="refresh_date",
        join_keys=(*keys, "week", "refresh_date"),
        columns=columns,
    )


TRENDS = Dataset(
    name="search_trends",
    description="Top and rising search terms per place and week, one partition per refresh.",
    tables=(
        _trend_table("top_terms", _DMA, rising=False),
        _trend_table("top_rising_terms", _DMA, rising=True),
        _trend_table("international_top_terms", _COUNTRY, rising=False),
        _trend_table("international_top_rising_terms", _COUNTRY, rising=True),
    ),
    segments=(
        Segment("top_10", "rank <= 10", "ranks 1 to 10"),
        Segment("top_5", "rank <= 5", "ranks 1 to 5"),
        Segment("nonnull_score", "score IS NOT NULL", "rows with a score: a biased part"),
        Segment("country_us", "country_code = 'US'", "international tables only"),
    ),
    metrics=(
        Metric("avg_score", "top_terms", "avg(score)", ("nonnull_score",)),
        Metric("term_appearances", "top_terms", "count(1)"),
        Metric("distinct_terms", "top_terms", "count(DISTINCT term)"),
        Metric("avg_percent_gain", "top_rising_terms", "avg(percent_gain)"),
        Metric("intl_avg_score", "international_top_terms", "avg(score)", ("nonnull_score",)),
    ),
    notes=(
        "A week is reported again under later refresh dates: keep the latest one.",
        "Scores are mostly NULL and not missing at random.",
    ),
)

BIKES = Dataset(
    name="bike_share",
    description="Bike hires and a snapshot of the docking stations. No table is partitioned.",
    tables=(
        Table(
            name="cycle_hire",
            grain="one hire",
            time_column="start_date",
            join_keys=("start_station_id", "end_station_id"),
            columns={
                "rental_id": "bigint",
                "duration": "bigint",
                "bike_id": "bigint",
                "bike_model": "string",
                "start_date": "timestamp_ntz",
                "start_station_id": "bigint",
                "end_station_id": "bigint",
            },
        ),
        Table(
            name="cycle_stations",
            grain="one docking station, as of now",
            join_keys=("id",),
            columns={
                "id": "bigint",
                "name": "string",
                "bikes_count": "bigint",
                "docks_count": "bigint",
                "installed": "boolean",
            },
        ),
    ),
    segments=(
        Segment("valid_trip", "duration > 0 AND start_station_id IS NOT NULL", "clean durations"),
        Segment("round_trip", "start_station_id = end_station_id", "returned where taken"),
        Segment("model_recorded", "bike_model IN ('CLASSIC', 'PBSC_EBIKE')", "model known"),
        Segment("ebike", "bike_model = 'PBSC_EBIKE'", "electric bikes"),
        Segment("classic", "bike_model = 'CLASSIC'", "other bikes"),
    ),
    metrics=(
        Metric("hires", "cycle_hire", "count(1)"),
        Metric("avg_duration_min", "cycle_hire", "avg(duration) / 60", ("valid_trip",)),
        Metric("total_duration_hours", "cycle_hire", "sum(duration) / 3600", ("valid_trip",)),
        Metric("unique_bikes", "cycle_hire", "count(DISTINCT bike_id)"),
        Metric(
            "ebike_share",
            "cycle_hire",
            "try_divide(count_if(bike_model = 'PBSC_EBIKE'), "
            "count_if(bike_model IN ('CLASSIC', 'PBSC_EBIKE')))",
        ),
        Metric("stations", "cycle_stations", "count(1)"),
        Metric("total_docks", "cycle_stations", "sum(docks_count)"),
        Metric("bikes_available", "cycle_stations", "sum(bikes_count)"),
    ),
    notes=("Durations can be zero, negative or NULL and stations missing: see valid_trip.",),
)

_TRIP_COLUMNS = {
    "pickup_datetime": "timestamp_ntz",
    "dropoff_datetime": "timestamp_ntz",
    "passenger_count": "int",
    "trip_distance": "double",
    "rate_code": "string",
    "payment_type": "string",
    "fare_amount": "double",
    "tip_amount": "double",
    "total_amount": "double",
    "pickup_location_id": "string",
}


def _trip_table(name: str, columns: dict[str, str], key: str) -> Table:
    return Table(
        name=name,
        grain="one trip",
        shard_suffix="suffix",
        shard_pattern="yyyy",
        time_column="pickup_datetime",
        join_keys=(key,),
        columns=columns,
    )


TAXI = Dataset(
    name="taxi_trips",
    description="Taxi trips in yearly shards, and the zones they start in.",
    tables=(
        _trip_table("yellow_trips", _TRIP_COLUMNS, "pickup_location_id"),
        _trip_table("green_trips", _TRIP_COLUMNS, "pickup_location_id"),
        _trip_table(
            "fhv_trips",
            {"pickup_datetime": "timestamp_ntz", "location_id": "bigint", "borough": "string"},
            "location_id",
        ),
        Table(
            name="taxi_zones",
            grain="one zone",
            join_keys=("zone_id",),
            columns={"zone_id": "string", "zone_name": "string", "borough": "string"},
        ),
    ),
    segments=(
        Segment("valid_trip", "fare_amount > 0 AND trip_distance > 0", "paid trips that moved"),
        Segment("credit_card", "payment_type = '1'", "card trips: the only ones with tips"),
        Segment("cash", "payment_type = '2'", "cash trips"),
        Segment("jfk_trips", "rate_code = '2.0'", "airport flat rate"),
        Segment("multi_passenger", "passenger_count > 1", "more than one passenger"),
        Segment("tipped", "tip_amount > 0", "a tip was recorded"),
    ),
    metrics=(
        Metric("trips", "yellow_trips", "count(1)"),
        Metric("avg_fare", "yellow_trips", "avg(fare_amount)"),
        Metric("avg_total", "yellow_trips", "avg(total_amount)"),
        Metric("total_revenue", "yellow_trips", "sum(total_amount)"),
        Metric("avg_trip_distance", "yellow_trips", "avg(trip_distance)"),
        Metric("avg_passengers", "yellow_trips", "avg(passenger_count)"),
        Metric(
            "tip_pct",
            "yellow_trips",
            "try_divide(sum(tip_amount), sum(fare_amount))",
            ("credit_card",),
        ),
        Metric(
            "avg_speed_mph",
            "yellow_trips",
            "try_divide(sum(trip_distance), try_divide("
            "sum(timestampdiff(SECOND, pickup_datetime, dropoff_datetime)), 3600))",
        ),
        Metric("green_trips", "green_trips", "count(1)"),
        Metric("green_avg_fare", "green_trips", "avg(fare_amount)"),
        Metric("green_total_revenue", "green_trips", "sum(total_amount)"),
        Metric("fhv_trips", "fhv_trips", "count(1)"),
    ),
    notes=(
        "Zone ids are strings in the trip tables but numbers in fhv_trips: cast before joining.",
        "Join zones after aggregating, when the trips are down to one row per zone.",
    ),
)

_TYPE = "as it was when created; NULL rows are not modelled"

ACCOUNTS = Dataset(
    name="accounts",
    description="The life of accounts: four event tables, from which the daily history is built.",
    tables=(
        Table(
            name="account_created",
            grain="one creation; an account may be created more than once",
            time_column="created_ts",
            join_keys=("account_id", "user_id"),
            columns={
                "account_id": "bigint",
                "user_id": "bigint",
                "account_type": "string",
                "created_ts": "timestamp_ntz",
            },
            comments={"user_id": "a user has one account or more", "account_type": _TYPE},
        ),
        Table(
            name="account_closed",
            grain="one closure",
            time_column="closed_ts",
            join_keys=("account_id",),
            columns={"account_id": "bigint", "closed_ts": "timestamp_ntz"},
        ),
        Table(
            name="account_reopened",
            grain="one reopening",
            time_column="reopened_ts",
            join_keys=("account_id",),
            columns={"account_id": "bigint", "reopened_ts": "timestamp_ntz"},
        ),
        Table(
            name="account_transactions",
            grain="one account and day with transactions",
            time_column="txn_date",
            join_keys=("account_id",),
            columns={"account_id": "bigint", "txn_date": "date", "txn_count": "bigint"},
            comments={"txn_count": "transactions of the day; days without any have no row"},
        ),
    ),
    notes=(
        "Activity before the creation of its account is left out of the history.",
        "On the same instant a reopening wins over a closure, and both over a creation.",
    ),
)

REGISTRY = Registry((WEB, TRENDS, BIKES, TAXI, ACCOUNTS))
