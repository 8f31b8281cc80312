import datetime as dt
import math
import os
from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plumbline.functions import bytes_to_gib, estimated_usd, gib_to_bytes, human_bytes
from plumbline.functions.scalars import TIB, bucket_labels
from plumbline.operators.governance import Table
from plumbline.operators.window import TimeWindow
from plumbline.sources import catalog, cost
from plumbline.sources.parquet import parameterized, read_shard, read_shards, union_shards, write_shards
from plumbline.sources.storage import (
    append_telemetry,
    freeze,
    is_complete,
    pass_rates,
    request_key,
    shared_folder,
)
from plumbline.streaming import append_closed_days, daily_activity
from plumbline.testbed import QUERIES

YEARLY = Table("orders", "one order", shard_suffix="suffix", shard_pattern="yyyy")


@pytest.fixture(scope="module")
def shards(spark, sf):
    path = shared_folder(spark, "shards")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    write_shards(orders.withColumn("suffix", F.date_format("o_orderdate", "yyyy")), path, "suffix")
    return path


def test_shards_are_pruned(spark, shards, plan):
    window = TimeWindow(start="1996-06-01", end="1997-01-31")
    rows = read_shards(spark, shards, YEARLY, window).select("o_orderkey")
    text = plan(rows)
    assert "PartitionFilters: [isnotnull(suffix" in text and "o_custkey" not in text
    years = {r.y for r in read_shards(spark, shards, YEARLY, window).selectExpr(
        "year(o_orderdate) AS y").distinct().collect()}
    assert years == {1996, 1997}


def test_one_shard_and_drift(spark, shards):
    a = read_shard(spark, shards, "suffix", "1996", ["o_orderkey"])
    b = read_shard(spark, shards, "suffix", "1997", ["o_orderkey", "o_orderpriority"])
    both = union_shards([a, b])
    assert both.where("suffix = '1996' AND o_orderpriority IS NOT NULL").count() == 0
    assert both.count() == a.count() + b.count()


def test_estimate_prunes_and_counts_columns(spark, shards, sf):
    whole = cost.scan_estimate(spark, shards, partitions="suffix string").first().bytes
    window = TimeWindow(start="1996-01-01", end="1996-12-31")
    one = cost.scan_estimate(spark, shards, window.predicate(YEARLY), partitions="suffix string")
    folder = f"{shards}/suffix=1996"
    size = sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.endswith(".parquet"))
    assert one.first().bytes == size < whole
    path = f"{sf}/lineitem.parquet"
    size = os.path.getsize(path)
    share = catalog.column_share(spark.read.parquet(path).schema, ["l_tax", "l_quantity"])
    estimate = cost.scan_estimate(spark, path, columns=["l_tax", "l_quantity"]).first()
    assert 0 < share < 0.5 and estimate.bytes == math.ceil(size * share) and not estimate.over_soft
    with pytest.raises(KeyError, match="l_nothing"):
        cost.scan_estimate(spark, path, columns=["l_nothing"])


def test_a_scan_at_the_cap_runs_and_one_over_it_does_not(spark, sf):
    path = f"{sf}/lineitem.parquet"
    size = os.path.getsize(path)
    exact = cost.scan_estimate(spark, path, hard_gib=size / 1024**3, soft_gib=0.0)
    warnings = []
    assert cost.capped_run(exact, lambda: spark.range(3), warnings.append).count() == 3
    assert "soft" in warnings[0]
    over = cost.scan_estimate(spark, path, hard_gib=(size - 1) / 1024**3)
    with pytest.raises(cost.ScanTooLarge, match="hard cap"):
        cost.capped_run(over, lambda: pytest.fail("it ran"))


def test_catalog_and_description(spark, sf):
    rows = {r.table_name: r for r in catalog.catalog_tables(spark, sf).collect()}
    assert rows["orders"].rows == spark.read.parquet(f"{sf}/orders.parquet").count()
    assert rows["orders"].bytes == os.path.getsize(f"{sf}/orders.parquet")
    assert set(r.table_name for r in catalog.catalog_tables(spark, sf, ["part"]).collect()) == {"part"}
    lineitem = pq.read_metadata(f"{sf}/lineitem.parquet")
    assert rows["lineitem"].rows == lineitem.num_rows
    columns = catalog.describe_table(spark, f"{sf}/nation.parquet").collect()
    assert [c.column for c in columns] == ["n_nationkey", "n_name", "n_regionkey"]
    assert columns[0].rows == 25


def test_catalog_of_odd_paths(spark):
    base = f"{shared_folder(spark, 'odd')}/a b+(c"
    spark.range(10).write.parquet(f"{base}/t 1%20+x")
    spark.range(0).write.parquet(f"{base}/empty")
    rows = {r.table_name: (r.files, r.rows) for r in catalog.catalog_tables(spark, base).collect()}
    assert rows["t 1%20+x"][1] == 10 and rows["empty"][1] == 0
    assert catalog.describe_table(spark, f"{base}/t 1%20+x").first().rows == 10


def test_byte_math_and_sizes(spark):
    row = spark.range(1).select(
        gib_to_bytes(F.lit(5)).alias("b"), bytes_to_gib(F.lit(1024**3)).alias("g"),
        estimated_usd(F.lit(TIB)).alias("usd")).first()
    assert tuple(row) == (5 * 1024**3, 1.0, 6.25)
    sizes = {0: "0 B", 1023: "1023 B", 1536: "1.50 KiB", 1024**3: "1.00 GiB", 1024**4: "1.00 TiB",
             3 * 1024**5: "3072.00 TiB", None: "unknown"}
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    assert [r[0] for r in df.select(human_bytes("n")).collect()] == list(sizes.values())
    assert bucket_labels((30, 90, 365)) == ["0-30 (new)", "31-90", "91-365", "366+ (established)"]


def test_sizes_beyond_a_long(spark, tmp_path):
    """A tie goes to the even neighbour; what is a little above or below a half is no tie."""
    sizes = {2**40 + 2**37: "1.12 TiB", 2**40 * 3 + 2**37 * 3: "3.38 TiB", 2**41 - 1: "2.00 TiB",
             174420708791117315160: "158634710.53 TiB", 206223680016365351800: "187559344.35 TiB",
             10**24: f"{10**24 / 2**40:.2f} TiB"}
    df = spark.createDataFrame([(Decimal(n),) for n in sizes], "n decimal(38,0)")
    assert [r[0] for r in df.select(human_bytes("n")).collect()] == list(sizes.values())
    big = 8 * 10**7
    rows = [(1, 2), (3, 5), (big, big), (None, 1)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.size for r in QUERIES["fn_human_bytes"](spark, str(tmp_path)).collect()}
    assert got == {1: "160 B", 3: "unknown", None: "unknown", big: f"{big**3 * 40 / 2**40:.2f} TiB"}


def test_parameters_are_values(spark):
    row = parameterized(spark, "SELECT :a a, :b b, :c c, :d d",
                        {"a": 1, "b": "x' OR '1", "c": 1.5, "d": True})
    assert [f.dataType.simpleString() for f in row.schema] == ["bigint", "string", "double", "boolean"]
    assert row.first().b == "x' OR '1"


def test_freeze_runs_once_per_request(spark):
    base, calls = shared_folder(spark, "freeze"), []

    def build():
        calls.append(1)
        return spark.range(5)

    request = {"metric": "m", "dimensions": ["a"], "days": 7}
    assert freeze(spark, base, request, build).count() == 5
    assert freeze(spark, base, dict(reversed(request.items())), build).count() == 5
    assert len(calls) == 1
    freeze(spark, base, {**request, "dimensions": ["b"]}, build)
    assert len(calls) == 2


def test_an_unfinished_extract_is_built_again(spark):
    base, request = shared_folder(spark, "half"), {"x": 1}
    path = f"{base}/extract-{request_key(request)}/_current"
    os.makedirs(path)
    assert not is_complete(spark, path)
    assert freeze(spark, base, request, lambda: spark.range(2)).count() == 2


def test_provenance_text(spark, sf):
    path = f"{sf}/lineitem.parquet"
    newest = spark.range(1).select(F.lit("2026-06-09").alias("MAX(refresh_date)"))
    size = spark.createDataFrame([(1024**3,)], "bytes long")
    row = cost.provenance("curated table", "high", size, newest, "Owner").first()
    assert row.footer == ("> **Source:** curated table · **Confidence:** high · **Bytes scanned:** "
                          "1.00 GiB (~$0.0061) · **Freshness:** MAX(refresh_date) = 2026-06-09 · "
                          "**Owner:** Owner · **Reviewed:** no")
    bare = cost.provenance("semantic layer", "high", spark.createDataFrame([(None,)], "bytes long"))
    assert bare.first().footer == ("> **Source:** semantic layer · **Confidence:** high · "
                                   "**Reviewed:** no")
    assert cost.provenance("raw", "low", cost.scan_estimate(spark, path)).first().bytes_scanned > 0


def test_telemetry_accumulates(spark):
    path = shared_folder(spark, "telemetry")
    for version, passed in (("1", False), ("1", True), ("2", True)):
        results = spark.createDataFrame([("c", passed)], "case_id string, passed boolean")
        append_telemetry(results, path, version=version, run_ts="t", wall_ms=1.0)
    rates = {r.version: r.pass_rate for r in pass_rates(spark.read.parquet(path)).collect()}
    assert rates == {"1": 0.5, "2": 1.0}


def test_stream_emits_closed_days_once_and_resumes(spark):
    folder = shared_folder(spark, "stream")
    schema = "user_id long, ts timestamp_ntz"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def run():
        events = spark.readStream.schema(schema).parquet(f"{folder}/in")
        activity = daily_activity(events, "user_id", "ts", "1 hour")
        append_closed_days(activity, f"{folder}/out", f"{folder}/state").awaitTermination()
        return sorted((r.user_id, r.txn_date.day, r.txn_count)
                      for r in spark.read.parquet(f"{folder}/out").collect())

    t = dt.datetime
    arrive((1, t(2024, 1, 1, 5)), (1, t(2024, 1, 1, 23)), (2, t(2024, 1, 2, 0, 30)))
    assert run() == []  # the first day may still get events
    arrive((1, t(2024, 1, 1, 23, 59)), (2, t(2024, 1, 2, 3)))
    assert run() == [(1, 1, 3)]
    arrive((1, t(2024, 1, 1, 12)), (3, t(2024, 1, 4, 0)))  # the first one is too late
    assert run() == [(1, 1, 3), (2, 2, 2)]
