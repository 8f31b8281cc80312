"""Queries that write: shards, extracts, models, telemetry; and what reads metadata only.

What is written goes to a new folder under the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline.operators import quality
from plumbline.operators.governance import Dataset, Metric, Table
from plumbline.operators.metric import metric_query
from plumbline.operators.window import TimeWindow
from plumbline.plans import incremental, lifecycle
from plumbline.plans.library import TAXI
from plumbline.sources import catalog, cost
from plumbline.sources.parquet import read_shard, read_shards, union_shards, write_shards
from plumbline.sources.storage import (
    append_telemetry,
    freeze,
    pass_rates,
    publish,
    publish_gated,
    published,
    shared_folder,
)
from plumbline.streaming import append_closed_days, daily_activity
from plumbline.testbed import oracle, views
from plumbline.testbed.accounts import EDGES, _datelist, _dense, sources
from plumbline.testbed.catalog import register, rounded
from plumbline.testbed.metrics import whole
from plumbline.testbed.quality import GRADES_SQL, grade
from plumbline.testbed.views import table

# ---- shards

YEARLY = Table("orders", "one order", shard_suffix="suffix", shard_pattern="yyyy",
               time_column="o_orderdate")
DAILY = Table("events", "one event", shard_suffix="suffix", shard_pattern="yyyyMMdd",
              time_column="ts")
SHARDED = Dataset(
    "sharded",
    tables=(YEARLY, DAILY),
    metrics=(
        Metric("n_orders", "orders", "count(1)"),
        Metric("n_users", "events", "count(DISTINCT user_id)"),
    ),
)


_ORDERS = "o_orderkey long, o_orderdate timestamp_ntz"
_EVENTS = "event_type string, user_id long"


def _yearly(spark, sf):
    orders = table(spark, sf, "orders").withColumn("suffix", F.date_format("o_orderdate", "yyyy"))
    return views.stored(spark, sf, "orders-by-year", lambda path: write_shards(orders, path, "suffix"))


def _daily(spark, sf):
    events = table(spark, sf, "events").drop("props").withColumn("suffix", F.date_format("ts", "yyyyMMdd"))
    return views.stored(spark, sf, "events-by-day", lambda path: write_shards(events, path, "suffix"))


@register(
    "scan_shards",
    "SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y') AS suffix FROM orders"
    " WHERE year(o_orderdate) BETWEEN 1996 AND 1998",
)
def scan_shards(spark, sf):
    window = TimeWindow(start="1996-05-01", end="1998-02-01")
    rows = read_shards(spark, _yearly(spark, sf), YEARLY, window)
    return rows.select("o_orderkey", "o_totalprice", "suffix")


@register(
    "window_shard_yearly",
    "SELECT suffix, count(*) AS n_orders FROM (SELECT strftime(o_orderdate, '%Y') AS suffix"
    " FROM orders) WHERE suffix BETWEEN '1997' AND '1999' GROUP BY 1",
)
def window_shard_yearly(spark, sf):
    """Bounds inside a year take in the whole year: a shard is read or not."""
    window = TimeWindow(start="1997-06-01", end="1999-08-31")
    orders = spark.read.schema(f"{_ORDERS}, suffix string").parquet(_yearly(spark, sf))
    return metric_query({"orders": orders}, SHARDED, "n_orders", ["suffix"], window=window)


@register(
    "window_shard_daily",
    "SELECT suffix, event_type, count(DISTINCT user_id) AS n_users FROM (SELECT *,"
    " strftime(ts, '%Y%m%d') AS suffix FROM events) WHERE suffix BETWEEN '20240108'"
    " AND '20240121' GROUP BY 1, 2",
)
def window_shard_daily(spark, sf):
    window = TimeWindow(start="2024-01-08", end="2024-01-21")
    events = spark.read.schema(f"{_EVENTS}, suffix string").parquet(_daily(spark, sf))
    return metric_query(
        {"events": events}, SHARDED, "n_users", ["suffix", "event_type"], window=window
    )


@register(
    "window_shard_last_n_days",
    "SELECT suffix, count(DISTINCT user_id) AS n_users FROM (SELECT *, strftime(ts, '%Y%m%d')"
    " AS suffix FROM events) WHERE suffix >= '20240118' GROUP BY 1",
)
def window_shard_last_n_days(spark, sf):
    window = TimeWindow(last_n_days=7)
    events = spark.read.schema(f"{_EVENTS}, suffix string").parquet(_daily(spark, sf))
    return metric_query({"events": events}, SHARDED, "n_users", ["suffix"], window=window,
                        as_of=dt.date(2024, 1, 25))


@register(
    "scan_explicit_shard",
    "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders"
    " WHERE year(o_orderdate) = 1997 GROUP BY 1",
)
def scan_explicit_shard(spark, sf):
    rows = read_shard(spark, _yearly(spark, sf), "suffix", "1997", ["o_orderdate"])
    return rows.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "scan_drifting_shards",
    "SELECT strftime(o_orderdate, '%Y') AS suffix, o_orderkey,"
    " CASE WHEN year(o_orderdate) = 1999 THEN o_orderpriority END AS o_orderpriority FROM orders"
    " WHERE year(o_orderdate) IN (1998, 1999)",
)
def scan_drifting_shards(spark, sf):
    """Two shards of which only the later one has a column."""
    path = _yearly(spark, sf)
    return union_shards(
        [
            read_shard(spark, path, "suffix", "1998", ["o_orderkey"]),
            read_shard(spark, path, "suffix", "1999", ["o_orderkey", "o_orderpriority"]),
        ]
    )


# ---- extracts and models


@register(
    "freeze_extract",
    f"WITH {oracle.TAXI} SELECT pickup_location_id, rate_code, round(avg(fare_amount), 4)"
    " AS avg_fare FROM yellow_trips WHERE fare_amount > 0 AND trip_distance > 0 GROUP BY 1, 2",
)
def freeze_extract(spark, sf):
    """The second request is served from the extract: its build would raise."""
    window = whole(spark, sf, TAXI)
    request = {
        "metric": "avg_fare",
        "dimensions": ["pickup_location_id", "rate_code"],
        "segments": ["valid_trip"],
        "window": [window.start, window.end],
        "source": sf,
    }

    def build():
        df = metric_query(views.taxi(spark, sf), TAXI, "avg_fare", request["dimensions"],
                          request["segments"], window)
        return rounded(df, 4, "avg_fare")

    def unexpected():
        raise AssertionError("the extract was built twice")

    base = shared_folder(spark, "extracts")
    freeze(spark, base, request, build)
    return freeze(spark, base, request, unexpected)


@register("publish_model", _dense("SELECT * FROM account_datelist"))
def publish_model(spark, sf):
    path = f"{shared_folder(spark, 'models')}/account_datelist"
    publish(_datelist(spark, sf), path, "snapshot_date")
    return spark.read.parquet(path).select(*lifecycle.DATELIST_COLUMNS)


@register("publish_gated", _dense("SELECT * FROM account_datelist"))
def gated(spark, sf):
    """The history as readers see it after a gated run; a failed gate raises. Accounts that were never
    created are no part of the history: they are published beside it, and only warn."""
    path = shared_folder(spark, "gated")
    src = sources(spark, sf)

    def check(models):
        checks = quality.account_checks(
            src, models["account_datelist"], views.ACCOUNT_TYPES, set_apart=models["account_orphans"]
        )
        return quality.quality_report(checks)

    models = {
        "account_datelist": (_datelist(spark, sf), "snapshot_date"),
        "account_orphans": (quality.account_orphans(src), None),
    }
    publish_gated(spark, models, check, path)
    return published(spark, path, "account_datelist").select(*lifecycle.DATELIST_COLUMNS)


@register("incremental_datelist", _dense("SELECT * FROM account_datelist"))
def incremental_datelist(spark, sf):
    """History up to three days before the end, then three days built one by one, the
    last of them twice. The result is the full history."""
    src = sources(spark, sf)
    last = lifecycle.latest_day(src).first().d
    path = f"{shared_folder(spark, 'incremental')}/account_datelist"
    history = lifecycle.account_datelist(src, last - dt.timedelta(days=3), EDGES)
    publish(history, path, "snapshot_date")
    for back in (2, 1, 0, 0):
        incremental.build_day(spark, path, src, last - dt.timedelta(days=back), EDGES)
    return spark.read.parquet(path).select(*lifecycle.DATELIST_COLUMNS)


@register(
    "telemetry_append",
    f"SELECT version, count(*) AS cases, count(*) FILTER (WHERE passed) AS passed_cases,"
    f" CAST(count(*) FILTER (WHERE passed) AS DOUBLE) / count(*) AS pass_rate"
    f" FROM ({GRADES_SQL}) g, (SELECT unnest(['1.0', '1.1']) AS version) v GROUP BY 1",
)
def telemetry_append(spark, sf):
    path = shared_folder(spark, "telemetry")
    for version in ("1.0", "1.1"):
        append_telemetry(grade(spark, sf), path, run_ts="2024-01-30T00:00:00", version=version,
                         git_sha="unknown", wall_ms=0.0)
    return pass_rates(spark.read.parquet(path))


@register(
    "stream_daily_activity",
    "SELECT user_id, CAST(ts AS DATE) AS txn_date, count(*) AS txn_count FROM events"
    " WHERE event_type = 'purchase' AND CAST(ts AS DATE) + INTERVAL 1 DAY <="
    " (SELECT max(ts) - INTERVAL 1 DAY FROM events WHERE event_type = 'purchase') GROUP BY 1, 2",
)
def stream_daily_activity(spark, sf):
    """The activity panel from a stream that waits a day for late events: closed days only."""
    schema = table(spark, sf, "events").schema
    events = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
        .where("event_type = 'purchase'")
    )
    folder = shared_folder(spark, "stream")
    activity = daily_activity(events, "user_id", "ts", "1 day")
    append_closed_days(activity, f"{folder}/panel", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/panel")


# ---- metadata


@register(
    "catalog_tables",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, 1 AS files, count(*) AS rows FROM {t}" for t in views.TABLES
    ),
)
def catalog_tables(spark, sf):
    found = catalog.catalog_tables(spark, sf, views.TABLES)
    return found.select("table_name", "files", "rows")


@register(
    "catalog_table_sizes",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS rows, TRUE AS sized FROM {t}" for t in views.TABLES
    ),
)
def catalog_table_sizes(spark, sf):
    """Sizes are positive and agree with one another; the bytes themselves are the files' own."""
    found = catalog.catalog_tables(spark, sf, views.TABLES)
    agree = (F.col("bytes") > 0) & (F.col("gib") == F.round(F.col("bytes") / 1024**3, 3))
    return found.select("table_name", "rows", (agree & F.col("modified").isNotNull()).alias("sized"))


@register(
    "describe_table",
    """SELECT column_name AS "column", CAST(ordinal_position - 1 AS INTEGER) AS position,
       (SELECT count(*) FROM lineitem) AS rows, 'NULLABLE' AS mode, TRUE AS sized,
       CASE column_name WHEN 'l_tax' THEN 'share of the price' END AS description,
       CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
            WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS type
       FROM information_schema.columns WHERE table_name = 'lineitem'""",
)
def describe_table(spark, sf):
    comments = {"l_tax": "share of the price"}
    described = catalog.describe_table(spark, f"{sf}/lineitem.parquet", comments=comments)
    sized = (F.col("bytes") > 0).alias("sized")
    return described.select("column", "position", "rows", "mode", sized, "description", "type")


# The tables of the customers, as if each order were a file of as many bytes as it cost cents.
_INVENTORY = """
SELECT o_orderstatus, bytes, bytes / 1073741824.0::DOUBLE AS gib, bytes / 1099511627776.0::DOUBLE * 6.25::DOUBLE AS est_usd,
       bytes > 5368709120 AS over_soft, bytes > 107374182400 AS over_hard
FROM (SELECT o_orderstatus, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) * 100 AS BIGINT) AS bytes FROM orders {where} GROUP BY 1)
"""


@register("scan_estimate", _INVENTORY.format(where=""))
def scan_estimate(spark, sf):
    """The estimate over an inventory of files that a table holds."""
    inventory = table(spark, sf, "orders").select(
        "o_orderstatus", (F.floor("o_totalprice") * 100).alias("length")
    )
    return cost.estimate_of(inventory, ["o_orderstatus"], soft_gib=5.0, hard_gib=100.0)


@register("scan_estimate_shards", _INVENTORY.format(where="WHERE year(o_orderdate) BETWEEN 1996 AND 1998"))
def scan_estimate_shards(spark, sf):
    """The same, of the shards that a window touches."""
    window = TimeWindow(start="1996-01-01", end="1998-12-31")
    inventory = table(spark, sf, "orders").select(
        "o_orderstatus", (F.floor("o_totalprice") * 100).alias("length"),
        F.date_format("o_orderdate", "yyyy").alias("suffix"),
    )
    pruned = inventory.where(window.predicate(YEARLY))
    return cost.estimate_of(pruned, ["o_orderstatus"], soft_gib=5.0, hard_gib=100.0)


@register(
    "capped_run",
    "SELECT l_returnflag, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1",
)
def capped_run(spark, sf):
    path, columns = f"{sf}/lineitem.parquet", ["l_returnflag", "l_quantity"]
    estimate = cost.scan_estimate(spark, path, columns=columns)

    def build():
        rows = spark.read.parquet(path).select(*columns)
        return rows.groupBy("l_returnflag").agg(
            F.sum("l_quantity").cast("long").alias("quantity")
        )

    try:
        cost.capped_run(cost.scan_estimate(spark, path, hard_gib=0.0), build)
    except cost.ScanTooLarge:
        return cost.capped_run(estimate, build)
    raise AssertionError("a scan over the cap was run")


@register(
    "provenance",
    "SELECT 'semantic layer' AS source, 'high' AS confidence, 'MAX(l_shipdate) = ' ||"
    " strftime(max(l_shipdate), '%Y-%m-%d') AS freshness, 'warehouse' AS owner,"
    " 'no' AS reviewed FROM lineitem",
)
def provenance(spark, sf):
    path = f"{sf}/lineitem.parquet"
    newest = spark.read.parquet(path).agg(F.to_date(F.max("l_shipdate")).alias("MAX(l_shipdate)"))
    row = cost.provenance(
        "semantic layer", "high", cost.scan_estimate(spark, path), newest, "warehouse"
    )
    return row.select("source", "confidence", "freshness", "owner", "reviewed")


@register(
    "provenance_footer",
    "SELECT 'curated table' AS source, 'medium' AS confidence, o_orderkey AS bytes_scanned,"
    " '> **Source:** curated table · **Confidence:** medium · **Bytes scanned:** ' || o_orderkey ||"
    " ' B (~$0.0000) · **Reviewed:** no' AS footer FROM orders WHERE o_orderkey < 1024",
)
def provenance_footer(spark, sf):
    """The footer of scans whose sizes a table holds (those below a KiB, as text)."""
    sizes = table(spark, sf, "orders").where("o_orderkey < 1024").select(F.col("o_orderkey").alias("bytes"))
    row = cost.provenance("curated table", "medium", sizes)
    return row.select("source", "confidence", "bytes_scanned", "footer")
