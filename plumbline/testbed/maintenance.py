"""Queries that keep stored things up: caps while running, manifests, cubes by day, late events, sketches,
keys."""

from __future__ import annotations

import datetime as dt
from itertools import combinations

from pyspark.sql import functions as F

from plumbline.operators import check_state
from plumbline.operators.keys import minimal_keys
from plumbline.operators.search import TextSource, text_search
from plumbline.operators.sketches import LG_K, daily_sketches, rolling_distinct, standard_error
from plumbline.operators.text_index import index_text, narrowed
from plumbline.plans import incremental, late, lifecycle
from plumbline.sources import manifest, metering
from plumbline.sources.cost import ScanTooLarge
from plumbline.sources.parquet import write_shards
from plumbline.sources.storage import publish, shared_folder, write_manifest
from plumbline.streaming import account_history
from plumbline.testbed import views
from plumbline.testbed.accounts import EDGES, UNIT, _cubed, _datelist, _dense, sources
from plumbline.testbed.catalog import register
from plumbline.testbed.views import table


@register(
    "metered_run",
    "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1, 2",
)
def metered_run(spark, sf):
    """The same query under a cap that it passes while it runs, and under one that it keeps."""

    def build():
        rows = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus")
        return rows.agg(F.sum("l_quantity").cast("long").alias("quantity"))

    try:
        metering.metered_run(spark, build, hard_gib=1024 / 1024**3)
    except ScanTooLarge:
        return metering.metered_run(spark, build, hard_gib=100.0)
    raise AssertionError("a query read more than its cap")


def _yearly_orders(spark, sf):
    orders = table(spark, sf, "orders").withColumn("year", F.date_format("o_orderdate", "yyyy"))

    def write(path):
        write_shards(orders, path, "year")
        write_manifest(spark, path)

    return views.stored(spark, sf, "orders-with-manifest", write)


_MANIFEST_COLUMNS = {"o_orderkey": "long", "o_custkey": "long", "o_orderstatus": "text", "o_totalprice": "double"}


@register(
    "table_manifest",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls,
        CAST({f"min({c})" if k == "long" else "NULL"} AS BIGINT) AS min_long, CAST({f"max({c})" if k == "long" else "NULL"} AS BIGINT) AS max_long,
        CAST({f"min({c})" if k == "double" else "NULL"} AS DOUBLE) AS min_double, CAST({f"max({c})" if k == "double" else "NULL"} AS DOUBLE) AS max_double,
        CAST({f"min({c})" if k == "text" else "NULL"} AS VARCHAR) AS min_text, CAST({f"max({c})" if k == "text" else "NULL"} AS VARCHAR) AS max_text,
        TRUE AS sized FROM orders"""
        for c, k in _MANIFEST_COLUMNS.items()
    ),
)
def table_manifest(spark, sf):
    """Rows, nulls and bounds of columns of a sharded table, from its manifest alone."""
    entries = manifest.read_manifest(spark, _yearly_orders(spark, sf))
    ends = [f(f"{f.__name__}_{k}").alias(f"{f.__name__}_{k}") for k in ("long", "double", "text") for f in (F.min, F.max)]
    return entries.where(F.col("column").isin(*_MANIFEST_COLUMNS)).groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), *ends, (F.min("bytes") > 0).alias("sized")
    )


@register(
    "scan_estimate_columns",
    "SELECT count(DISTINCT year(o_orderdate)) FILTER (WHERE o_orderdate >= DATE '1996-05-01' AND o_orderdate < DATE '1998-03-01') AS shards_read,"
    " count(DISTINCT year(o_orderdate)) FILTER (WHERE year(o_orderdate) NOT IN (1996, 1997, 1998)) AS shards_left_out,"
    " 'exact' AS method, TRUE AS fewer_bytes FROM orders",
)
def scan_estimate_columns(spark, sf):
    """Two columns of the orders of a range of days: shards outside are known by their bounds, without
    a filter on the partition column."""
    path = _yearly_orders(spark, sf)
    days = {"o_orderdate": (dt.datetime(1996, 5, 1), dt.datetime(1998, 2, 28, 23, 59, 59, 999999))}
    row = manifest.manifest_estimate(spark, path, ["o_orderkey", "o_orderdate"], ranges=days)
    whole = manifest.manifest_estimate(spark, path)
    # A shard of any size may be several files; those are counted by their folders.
    entries = manifest.read_manifest(spark, path).where("column = 'o_orderdate'")
    low, high = (manifest.slot(d)[1] for d in days["o_orderdate"])
    inside = (F.col("max_long") >= low) & (F.col("min_long") <= high)
    shard = F.regexp_extract("path", r"year=(\d+)", 1)
    counted = entries.agg(
        F.count_distinct(F.when(inside, shard)).alias("shards_read"),
        (F.count_distinct(shard) - F.count_distinct(F.when(inside, shard))).alias("shards_left_out"),
        F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"),
    )
    checked = row.select("files", "files_left_out", "method", F.col("bytes").alias("some")).join(
        whole.select(F.col("bytes").alias("all")), F.lit(True)
    )
    agrees = (F.col("some") < F.col("all")) & (F.col("files") == F.col("inside")) & (F.col("files_left_out") == F.col("outside"))
    return counted.join(checked, F.lit(True)).select("shards_read", "shards_left_out", "method", agrees.alias("fewer_bytes"))


@register("incremental_cube", _cubed("SELECT * FROM active_user_cube"))
def incremental_cube(spark, sf):
    """History and cube up to three days before the end, then three days built one by one."""
    src = sources(spark, sf)
    last = lifecycle.latest_day(src).first().d
    folder = shared_folder(spark, "incremental")
    history, cube = f"{folder}/account_datelist", f"{folder}/active_user_cube"
    until = last - dt.timedelta(days=3)
    publish(lifecycle.account_datelist(src, until, EDGES), history, "snapshot_date")
    first = spark.read.parquet(history).agg(F.min(F.col("snapshot_date").cast("date"))).first()[0]
    stored = [first + dt.timedelta(days=n) for n in range((until - first).days + 1)]
    incremental.build_cube_days(spark, history, cube, stored, UNIT, views.ACCOUNT_TYPES)
    for back in (2, 1, 0):
        day = last - dt.timedelta(days=back)
        incremental.build_day(spark, history, src, day, EDGES)
        incremental.build_cube_days(spark, history, cube, [day], UNIT, views.ACCOUNT_TYPES)
    rows = spark.read.parquet(cube).withColumn("snapshot_date", F.col("snapshot_date").cast("date"))
    return rows.select(_cube_columns(spark, sf))


def _cube_columns(spark, sf):
    rates = [f"active_users_{w}_{k}" for k in ("count", "rate") for w in ("1d", "7d", "28d")]
    return ["snapshot_date", "account_type", "account_age_bucket", "signup_cohort", "open_users", *rates]


def _split_late(src, last, days=10):
    """Sources as they were known at the end of ``last`` if some rows of the ten days before arrived only
    later, and those rows."""
    first = F.lit(last - dt.timedelta(days=days))

    def is_late(day, *key):
        return (F.col(day).cast("date") > first) & (F.pmod(F.xxhash64(*key), F.lit(3)) == 0)

    def parts(rows, day):
        own = is_late(day, "account_id", day)
        return rows.where(~own), rows.where(own)

    pairs = [parts(src.created, "created_ts"), parts(src.closed, "closed_ts"), parts(src.reopened, "reopened_ts"),
             parts(src.transactions, "txn_date")]
    return lifecycle.Sources(*(p[0] for p in pairs)), lifecycle.Sources(*(p[1] for p in pairs))


@register("late_events", _dense("SELECT * FROM account_datelist"))
def late_events(spark, sf):
    """A third of the events of the last ten days arrive after the history was built; then it is repaired."""
    src = sources(spark, sf)
    last = lifecycle.latest_day(src).first().d
    known, arrived = _split_late(src, last)
    path = f"{shared_folder(spark, 'late')}/account_datelist"
    publish(lifecycle.account_datelist(known, last, EDGES), path, "snapshot_date")
    late.repair(spark, path, src, arrived, last, EDGES)
    return spark.read.parquet(path).select(*lifecycle.DATELIST_COLUMNS)


@register(
    "agg_distinct_sketch",
    """
WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS day, event_type, user_id FROM events),
ends AS (SELECT DISTINCT w.days, d.day + CAST(n AS INTEGER) AS day, event_type, user_id
         FROM days d, (VALUES (7), (28)) w(days), range(28) r(n) WHERE n < w.days)
SELECT day, days AS window_days, event_type, count(*) AS users, TRUE AS close
FROM ends WHERE day <= (SELECT max(day) FROM days) GROUP BY 1, 2, 3
""",
)
def agg_distinct_sketch(spark, sf):
    """Users of 7 and 28 days by kind of event from stored daily sketches, beside exact counts; ``close``
    is within three standard errors."""
    events = table(spark, sf, "events")
    path = f"{shared_folder(spark, 'sketches')}/users"
    publish(daily_sketches(events, "ts", "user_id", ["event_type"]), path)
    sketches = spark.read.parquet(path)
    days = events.select(F.to_date("ts").alias("day"), "event_type", "user_id").distinct()
    last = sketches.agg(F.max("day")).scalar()
    out = None
    for window in (7, 28):
        ends = F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda n: F.date_add("day", n))
        exact = days.select(F.explode(ends).alias("day"), "event_type", "user_id").where(F.col("day") <= last)
        exact = exact.groupBy("day", "event_type").agg(F.count_distinct("user_id").alias("users"))
        near = rolling_distinct(sketches, window, ["event_type"]).select("day", "event_type", F.col("users").alias("near"))
        # Small sets are held one by one, with an error below one item.
        slack = F.greatest(F.lit(3 * standard_error(LG_K)) * F.col("users"), F.lit(0.5))
        rows = exact.join(near, ["day", "event_type"], "full").select(
            "day", F.lit(window).alias("window_days"), "event_type", "users",
            F.coalesce(F.abs(F.col("near") - F.col("users")) <= slack, F.lit(False)).alias("close"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


_CHECKS = {"large": ("l_quantity > 40", "l_quantity > 40"), "untaxed": ("l_tax = 0", "l_tax = 0"),
           "late_half": ("month(l_shipdate) > 6", "month(l_shipdate) > 6")}

_BY_PARTITION = " UNION ALL ".join(
    [f"SELECT year, '{c}' AS \"check\", count(*) FILTER (WHERE {sql}) AS failures, count(*) AS rows FROM items GROUP BY year"
     for c, (_, sql) in _CHECKS.items()]
    + ["SELECT year, 'grain', count(*) FILTER (WHERE n > 1), sum(n) FROM"
       " (SELECT year, l_orderkey, l_suppkey, count(*) AS n FROM items GROUP BY ALL) GROUP BY year"]
)


@register(
    "dq_partition_state",
    f"""
WITH items AS (SELECT *, CAST(year(l_shipdate) AS VARCHAR) AS year FROM lineitem), counted AS ({_BY_PARTITION})
SELECT "check", CAST(sum(failures) AS BIGINT) AS failures, CAST(sum(rows) AS BIGINT) AS rows, count(*) AS partitions,
       CASE WHEN sum(failures) > 0 THEN arg_min(year, (-failures, year)) END AS worst_partition
FROM counted GROUP BY 1
""",
)
def dq_partition_state(spark, sf):
    """Counters of all years but the last entered first, then those of the last, then one year again."""
    items = table(spark, sf, "lineitem").withColumn("year", F.date_format("l_shipdate", "yyyy"))
    path = views.stored(spark, sf, "lineitem-by-year", lambda p: write_shards(items, p, "year"))
    rows = spark.read.schema(items.schema).parquet(path)
    last = rows.agg(F.max("year")).first()[0]
    folder = f"{shared_folder(spark, 'checks')}/lineitem"
    for part in (F.col("year") < last, F.col("year") == last, F.col("year") == "1995"):
        failing = {check: predicate for check, (predicate, _) in _CHECKS.items()}
        counters = check_state.partition_counters(rows.where(part), "year", ["l_orderkey", "l_suppkey"], failing)
        check_state.record(counters, folder)
    return check_state.merged(spark, folder)


_KEYED = {
    "lineitem": (
        "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag "
        "l_linestatus l_shipdate"
    ).split(),
    "events": "event_id user_id ts event_type".split(),
}


def _keys_sql(name: str, columns: list[str]) -> str:
    """Every set of up to three columns counted by itself; sets that hold a smaller key left out."""
    counted = " UNION ALL ".join(
        f"SELECT {list(c)!r} AS key, count(DISTINCT ({', '.join(c)},)) = count(*) AS is_key FROM {name}"
        for size in (1, 2, 3) for c in combinations(columns, size)
    )
    return f"""WITH counted AS ({counted}), keys AS (SELECT key FROM counted WHERE is_key)
SELECT '{name}' AS table_name, array_to_string(key, ',') AS key FROM keys k
WHERE NOT EXISTS (SELECT 1 FROM keys s WHERE len(s.key) < len(k.key) AND list_has_all(k.key, s.key))"""


def _register_keys(name: str, columns: list[str]) -> None:
    @register(f"key_discovery_{name}", _keys_sql(name, columns))
    def build(spark, sf):
        found = minimal_keys(table(spark, sf, name), columns)
        return spark.createDataFrame([(name, ",".join(k)) for k in found], "table_name string, key string")


for _name, _columns in _KEYED.items():
    _register_keys(_name, _columns)


_NEEDLES = ("er", "the ", "toothpaste", "n.\nA", "password", "src1")


def _needles_sql() -> str:
    def quoted(text):
        return "'" + text.lower().strip().replace("\n", "' || chr(10) || '") + "'"

    return " UNION ALL ".join(
        f"SELECT {quoted(q)} AS needle, 'document' AS kind, CAST(doc_id AS VARCHAR) AS name FROM documents"
        f" WHERE contains(lower(text), {quoted(q)}) OR contains(lower(source), {quoted(q)})"
        for q in _NEEDLES
    )


@register("text_search_indexed", _needles_sql())
def text_search_indexed(spark, sf):
    """Needles looked up in an index of trigrams by file, which was made when half of the documents were
    there, and again after the others came, but for a last part that is not in it."""
    documents = table(spark, sf, "documents")
    fields = ["text", "source"]

    def write(path):
        for part in range(3):
            rows = documents.where(F.pmod(F.xxhash64("source"), F.lit(3)) == part)
            rows.write.mode("append").parquet(f"{path}/documents")
            if part < 2:
                index_text(spark, f"{path}/documents", fields, f"{path}/index")

    path = views.stored(spark, sf, "documents-with-index", write)
    out = None
    for needle in _NEEDLES:
        rows = narrowed(spark, f"{path}/documents", fields, f"{path}/index", needle)
        hits = text_search([TextSource("document", rows, "doc_id", tuple(fields))], needle)
        hits = hits.select(F.lit(needle.lower().strip()).alias("needle"), "kind", "name")
        out = hits if out is None else out.unionByName(hits)
    return out


@register("stream_account_history", _dense("SELECT * FROM account_datelist"))
def stream_account_history(spark, sf):
    """Events arrive day by day, a third of the last three days two days late; late ones are kept apart,
    and taken in at the end."""
    src = sources(spark, sf)
    last = lifecycle.latest_day(src).first().d
    day = F.col("ts").cast("date")
    behind = F.date_diff(F.lit(last), day)
    delay = F.when(F.pmod(F.xxhash64("account_id", "ts", "kind"), F.lit(3)) == 0, 2).otherwise(0)
    arrival = F.when(behind >= 3, 0).otherwise(3 - behind + delay)
    events = account_history.account_events(src).withColumn("arrival", arrival)
    folder = shared_folder(spark, "history-stream")
    for n in range(6):
        rows = events.where(F.col("arrival") == n).drop("arrival")
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/arrivals")
    stream = (
        spark.readStream.schema(account_history.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arrivals")
    )
    path = f"{folder}/store"
    account_history.keep_history(stream, path, f"{folder}/checkpoint", 0, EDGES).awaitTermination()
    account_history.close_through(spark, path, last, EDGES)
    account_history.repair_late(spark, path, EDGES)
    return account_history.history(spark, path).select(*lifecycle.DATELIST_COLUMNS)
