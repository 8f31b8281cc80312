"""Views that give the given tables the shapes the analyses expect.

Each is a narrow projection (or a partial aggregate) of one table, so a query
on a view still prunes columns and pushes filters down to the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.lifecycle import Sources
from plumbline.sources.storage import shared_folder

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

# The events span 30 days, so ages are cut finer and cohorts are weeks.
EDGES = (3, 7, 14)
COHORT_UNIT = "week"
ACCOUNT_TYPES = ("retail", "pot", "joint")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_STORES: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf: str, name: str, write: Callable[[str], None]) -> str:
    """The path of a table that queries read from storage, written once in a session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORES:
        path = shared_folder(spark, name)
        write(path)
        _STORES[key] = path
    return _STORES[key]


class Views(Mapping[str, DataFrame]):
    """Named views, each built when it is asked for."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]):
        self._builders = builders

    def __getitem__(self, name: str) -> DataFrame:
        return self._builders[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def year_suffix(day: str) -> Column:
    return F.year(day).cast("string")


def day_suffix(day: str) -> Column:
    """``yyyyMMdd`` by arithmetic, which is cheaper per row than a formatter."""
    return F.expr(f"string(year({day}) * 10000 + month({day}) * 100 + day({day}))")


def accounts_raw(spark: SparkSession, sf: str) -> Sources:
    """Account sources from ``events``, repeats and NULL types included."""
    events = table(spark, sf, "events")
    kind = F.when(F.col("user_id") % 41 == 40, None)
    for number, name in enumerate(ACCOUNT_TYPES):
        kind = kind.when(F.col("user_id") % 3 == number, name)
    created = events.where(
        (F.col("event_type") == "signup") & (F.dayofmonth("ts") > F.col("user_id") % 21)
    ).select(
        F.col("user_id").alias("account_id"),
        (F.col("user_id") % 50).alias("user_id"),
        kind.alias("account_type"),
        F.col("ts").alias("created_ts"),
    )
    closed = events.where("event_type = 'error'").select(
        F.col("user_id").alias("account_id"), F.col("ts").alias("closed_ts")
    )
    reopened = events.where("event_type = 'view'").select(
        F.col("user_id").alias("account_id"), F.col("ts").alias("reopened_ts")
    )
    transactions = (
        events.where("event_type = 'purchase' AND value > 20")
        .groupBy(F.col("user_id").alias("account_id"), F.to_date("ts").alias("txn_date"))
        .agg(F.count(F.lit(1)).alias("txn_count"))
    )
    return Sources(created, closed, reopened, transactions)


def account_tables(spark: SparkSession, sf: str) -> Views:
    """The same four tables under their governed names."""
    def one(part: str) -> Callable[[], DataFrame]:
        return lambda: getattr(accounts_raw(spark, sf), part)

    return Views({f"account_{p}": one(p) for p in ("created", "closed", "reopened", "transactions")})


def accounts_long(spark: SparkSession, sf: str) -> Sources:
    """Account sources from ``orders``: 6.5 years, one account per customer."""
    orders = table(spark, sf, "orders")
    account = F.col("o_custkey").alias("account_id")
    created = orders.select(
        account,
        (F.col("o_custkey") % 1000).alias("user_id"),
        F.when(F.col("o_custkey") % 3 == 0, "retail")
        .when(F.col("o_custkey") % 3 == 1, "pot")
        .otherwise("joint")
        .alias("account_type"),
        F.col("o_orderdate").alias("created_ts"),
    )
    closed = orders.where("o_orderstatus = 'F' AND o_orderpriority = '5-LOW'").select(
        account, F.col("o_orderdate").alias("closed_ts")
    )
    reopened = orders.where("o_orderpriority = '1-URGENT'").select(
        account, F.col("o_orderdate").alias("reopened_ts")
    )
    transactions = (
        orders.where("o_orderstatus <> 'P'")
        .groupBy(account, F.to_date("o_orderdate").alias("txn_date"))
        .agg(F.count(F.lit(1)).alias("txn_count"))
    )
    return Sources(created, closed, reopened, transactions)


def web_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions from ``orders``: one per order, with 0 to 3 hits of 0 to 2 products each."""
    product = (
        "named_struct('v2ProductName', concat('item ', (o_custkey + i + p) % 11),"
        " 'productRevenue', bigint((floor(o_totalprice) + p) * 10000),"
        " 'productQuantity', bigint(p + i))"
    )
    hit = (
        "named_struct('type', if(i % 2 = 1, 'PAGE', 'EVENT'), 'hitNumber', i,"
        " 'page', named_struct('pagePath', concat('/p/', o_custkey % 7 + i)),"
        " 'eCommerceAction', named_struct('action_type',"
        " if(o_orderkey % 3 = 0 AND i = o_orderkey % 4, '6', '2')),"
        f" 'product', transform(slice(array(1, 2), 1, int((o_orderkey + i) % 3)), p -> {product}))"
    )
    return table(spark, sf, "orders").select(
        day_suffix("o_orderdate").alias("suffix"),
        day_suffix("o_orderdate").alias("date"),
        F.expr("string(o_custkey) AS fullVisitorId"),
        F.expr("o_orderkey AS visitId"),
        F.expr(
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'Direct' WHEN '2-HIGH' THEN 'Organic Search'"
            " WHEN '3-MEDIUM' THEN 'Paid Search' ELSE 'Referral' END AS channelGrouping"
        ),
        F.expr(
            "named_struct('pageviews', nullif(o_orderkey % 6, 0),"
            " 'timeOnSite', nullif(floor(o_totalprice) % 600, 0),"
            " 'bounces', if(o_orderkey % 4 = 0, 1L, NULL),"
            " 'transactions', if(o_orderkey % 3 = 0, 1L, NULL),"
            " 'totalTransactionRevenue', if(o_orderkey % 3 = 0, floor(o_totalprice) * 1000000L,"
            " NULL)) AS totals"
        ),
        F.expr(
            "named_struct('medium', CASE o_orderpriority WHEN '1-URGENT' THEN '(none)'"
            " WHEN '2-HIGH' THEN 'organic' WHEN '3-MEDIUM' THEN 'cpc' ELSE 'referral' END)"
            " AS trafficSource"
        ),
        F.expr(
            "named_struct('deviceCategory', CASE o_orderstatus WHEN 'O' THEN 'desktop'"
            " WHEN 'F' THEN 'mobile' ELSE 'tablet' END, 'isMobile', o_orderstatus = 'F') AS device"
        ),
        F.expr(
            "named_struct('country', if(o_custkey % 5 = 0, 'United States',"
            " concat('Country ', o_custkey % 5))) AS geoNetwork"
        ),
        F.expr(f"transform(slice(array(1, 2, 3), 1, int(o_orderkey % 4)), i -> {hit}) AS hits"),
    )


def _trend(spark: SparkSession, sf: str, name: str) -> DataFrame:
    place = (
        ("country_name", "country_code", "region_name", "region_code")
        if name.startswith("international")
        else ("dma_name", "dma_id")
    )
    rising = "rising" in name
    expressions = {
        "dma_id": "l_suppkey % 20",
        "dma_name": "concat('DMA ', l_suppkey % 20)",
        "country_code": "if(l_suppkey % 4 = 0, 'US', concat('C', l_suppkey % 4))",
        "country_name": "concat('Country ', l_suppkey % 4)",
        "region_code": "if(l_linenumber = 1, '', concat('R', l_suppkey % 20))",
        "region_name": "if(l_linenumber > 1, concat('Region ', l_suppkey % 20), NULL)",
        "term": "concat('term ', l_partkey % 500)",
        "week": "trunc(l_shipdate, 'week')",
        "score": "nullif(bigint(l_quantity) % 10, 0)",
        "percent_gain": "bigint(round(l_discount * 1000))",
        "rank": "l_orderkey % 25 + 1",
        "refresh_date": "trunc(l_shipdate, 'month')",
    }
    gain = ("percent_gain",) if rising else ()
    columns = (*place, "term", "week", "score", *gain, "rank", "refresh_date")
    rows = table(spark, sf, "lineitem").where(f"l_linestatus = '{'F' if rising else 'O'}'")
    return rows.selectExpr(*(f"{expressions[c]} AS {c}" for c in columns))


def trends(spark: SparkSession, sf: str) -> Views:
    """The four trend tables from ``lineitem``."""
    names = ("top_terms", "top_rising_terms", "international_top_terms",
             "international_top_rising_terms")
    return Views({name: lambda name=name: _trend(spark, sf, name) for name in names})


def bikes(spark: SparkSession, sf: str) -> Views:
    """Hires from ``events``, stations from ``supplier``."""

    def hires() -> DataFrame:
        return table(spark, sf, "events").selectExpr(
            "event_id AS rental_id",
            "floor((value - 5) * 60) AS duration",
            "user_id AS bike_id",
            "CASE event_type WHEN 'view' THEN 'CLASSIC' WHEN 'click' THEN 'PBSC_EBIKE'"
            " WHEN 'error' THEN '' END AS bike_model",
            "ts AS start_date",
            "nullif(user_id % 25, 0) AS start_station_id",
            "event_id % 25 AS end_station_id",
        )

    def stations() -> DataFrame:
        return table(spark, sf, "supplier").selectExpr(
            "s_suppkey AS id",
            "s_name AS name",
            "s_suppkey % 17 AS bikes_count",
            "s_suppkey % 17 + s_nationkey + 3 AS docks_count",
            "s_acctbal > 0 AS installed",
        )

    return Views({"cycle_hire": hires, "cycle_stations": stations})


def _trips(spark: SparkSession, sf: str, columns: tuple[str, ...]) -> DataFrame:
    expressions = {
        "suffix": "string(year(l_shipdate))",
        "vendor_id": "if(l_linenumber % 2 = 0, '2', '1')",
        "pickup_datetime": "l_shipdate",
        "dropoff_datetime": "timestampadd(SECOND, int(l_quantity) * 60 + l_linenumber, l_shipdate)",
        "passenger_count": "l_linenumber",
        "trip_distance": "l_quantity",
        "rate_code": "concat(l_linenumber, '.0')",
        "payment_type": "CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '2' ELSE '3' END",
        "fare_amount": "l_extendedprice",
        "tip_amount": "l_extendedprice * l_discount",
        "total_amount": "l_extendedprice * (l_tax + 1)",
        "mta_tax": "nullif(l_tax, 0)",
        "airport_fee": "nullif(l_discount, 0)",
        "pickup_location_id": "string(l_suppkey % 25)",
        "dropoff_location_id": "string(l_partkey % 25)",
        "location_id": "l_suppkey % 25",
        "borough": "concat('Borough ', l_suppkey % 5)",
        "l_linestatus": "l_linestatus",
    }
    return table(spark, sf, "lineitem").selectExpr(*(f"{expressions[c]} AS {c}" for c in columns))


def taxi(spark: SparkSession, sf: str) -> Views:
    """Trips from ``lineitem`` (green and fhv split by status), zones from ``nation``."""
    green = ("suffix", "pickup_datetime", "dropoff_datetime", "passenger_count", "trip_distance",
             "rate_code", "payment_type", "fare_amount", "tip_amount", "total_amount",
             "pickup_location_id", "dropoff_location_id")
    yellow = (*green, "vendor_id", "mta_tax", "airport_fee")

    def split(status: str, *columns: str) -> DataFrame:
        rows = _trips(spark, sf, (*columns, "l_linestatus"))
        return rows.where(F.col("l_linestatus") == status).drop("l_linestatus")

    def zones() -> DataFrame:
        region = F.col("n_regionkey") == F.col("r_regionkey")
        return table(spark, sf, "nation").join(table(spark, sf, "region"), region).selectExpr(
            "string(n_nationkey) AS zone_id", "n_name AS zone_name", "r_name AS borough"
        )

    return Views(
        {
            "yellow_trips": lambda: _trips(spark, sf, yellow),
            "green_trips": lambda: split("O", *green),
            "fhv_trips": lambda: split("F", "suffix", "pickup_datetime", "location_id", "borough"),
            "taxi_zones": zones,
        }
    )
