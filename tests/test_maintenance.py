"""Caps while running, manifests, concurrent entries, cubes by day, late events, sketches, keys."""

import datetime as dt
import glob
import os
import random
import threading
from collections import defaultdict
from itertools import combinations

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_accounts import EDGES, TYPES, as_sources, random_inputs, rows_of, simulate, simulate_cube

from plumbline.operators import check_state, keys, sketches
from plumbline.plans import incremental, late, lifecycle
from plumbline.sources import manifest, metering
from plumbline.sources.cost import ScanTooLarge, scan_estimate
from plumbline.sources.storage import enter, entries, freeze, publish, publish_gated, published, shared_folder

# ---- a cap that holds while a query runs


@pytest.fixture(scope="module")
def many_files(spark):
    path = shared_folder(spark, "many")
    text = F.sha2(F.col("id").cast("string"), 512)
    spark.range(0, 160_000, 1, 160).select("id", F.concat(text, F.reverse(text)).alias("text")).write.parquet(path)
    return path


def _slow(spark, path):
    # Each row takes a while, each file is a task, so reading goes on for some seconds.
    burn = F.aggregate(F.sequence(F.lit(1), F.lit(1_500)), F.length("text").cast("long"), lambda a, x: (a * 31 + x) % 1009)
    return spark.read.option("maxPartitionBytes", "1k").parquet(path).agg(F.sum(burn).alias("total"))


def test_a_query_is_cancelled_while_it_reads_too_much(spark, many_files):
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    try:
        size = sum(map(os.path.getsize, glob.glob(f"{many_files}/*.parquet")))
        cheap = scan_estimate(spark, many_files, columns=["id"], hard_gib=100.0)
        with pytest.raises(ScanTooLarge, match="cancelled"):
            metering.metered_run(spark, lambda: _slow(spark, many_files), cheap, hard_gib=size / 20 / 1024**3)
        meter = metering.Meter(spark, size // 20)
        with pytest.raises(ScanTooLarge):
            with meter:
                _slow(spark, many_files).collect()
        assert size // 20 < meter.read < size * 0.7
        with metering.Meter(spark, 10 * size) as whole:
            _slow(spark, many_files).collect()
        assert whole.read > size * 0.8
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_query_below_its_cap_returns_its_rows_and_its_own_errors(spark, many_files):
    rows = metering.metered_run(spark, lambda: spark.read.parquet(many_files).where("id < 5").select("id"), hard_gib=1.0)
    assert sorted(r.id for r in rows.collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        metering.metered_run(spark, lambda: spark.range(3).selectExpr("1 div (id - id) AS x"), hard_gib=1.0)
    over = scan_estimate(spark, many_files, hard_gib=0.0)
    with pytest.raises(ScanTooLarge, match="hard cap"):
        metering.metered_run(spark, lambda: pytest.fail("it ran"), over)


def test_meters_do_not_see_other_queries(spark, many_files):
    with metering.Meter(spark, 1 << 40) as meter:
        spark.range(10).count()
    spark.read.parquet(many_files).agg(F.max("text")).collect()
    assert meter.read == metering.bytes_read(spark, meter.tag) == 0


# ---- manifests


def _chunk_bytes(path, columns):
    total = 0
    for file in glob.glob(f"{path}/**/*.parquet", recursive=True):
        if "/_" in file.removeprefix(path):
            continue
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.row_group(g).num_columns):
                chunk = meta.row_group(g).column(c)
                if chunk.path_in_schema.split(".")[0] in columns:
                    total += chunk.total_compressed_size
    return total


@pytest.fixture(scope="module")
def model(spark):
    path = shared_folder(spark, "manifested")
    rows = spark.range(0, 4000).select(
        F.expr("date_add(DATE '2024-01-01', int(id div 1000))").alias("day"), "id",
        F.expr("if(id % 7 = 0, NULL, id * 0.5)").alias("price"), F.expr("id * 0.5e0").alias("twice"), F.expr("repeat(string(id), 20)").alias("text"),
        F.expr("CAST(NULL AS INT)").alias("nothing"), F.expr("array(struct(id AS a, 'x' AS b))").alias("hits"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, int(id))").alias("at"),
    )
    publish(rows, path, "day")
    return path


@pytest.mark.parametrize("columns", [["id", "price"], ["text"], ["hits"], ["nothing", "at"], None])
def test_an_estimate_is_the_size_of_the_column_chunks(spark, model, columns):
    row = manifest.manifest_estimate(spark, model, columns).first()
    assert row.method == "exact" and row.files_left_out == 0
    assert row.bytes == _chunk_bytes(model, columns or ["id", "price", "twice", "text", "nothing", "hits", "at"])


@pytest.mark.parametrize("ranges, days", [
    ({"id": (1500, 2500)}, {"2024-01-02", "2024-01-03"}),
    ({"id": (None, 999)}, {"2024-01-01"}),
    ({"price": (1900.0, None)}, {"2024-01-04"}),
    ({"at": (dt.datetime(2024, 1, 2, 1, 0), dt.datetime(2024, 1, 2, 17, 40))}, {"2024-01-02", "2024-01-03"}),
    ({"twice": (1900.0, None)}, {"2024-01-04"}),
    ({"nothing": (1, None)}, set()),
    ({"text": ("9", None), "id": (None, 10)}, set()),
])
def test_files_outside_a_range_are_left_out(spark, model, ranges, days):
    row = manifest.manifest_estimate(spark, model, ["id"], ranges=ranges).first()
    inside = [f for f in glob.glob(f"{model}/day=*/*.parquet") if f.split("day=")[1][:10] in days]
    # Text of all days begins with any digit, so only the other range may leave files out there.
    if "text" in ranges:
        assert row.files <= 4
    else:
        assert row.files == len(inside)
    pruned = manifest.manifest_estimate(spark, model, ["id"], F.col("day") == "2024-01-02", partitions="day string").first()
    assert pruned.files == len(glob.glob(f"{model}/day=2024-01-02/*.parquet")) and pruned.method == "exact"


def test_without_a_manifest_it_is_called_an_estimate(spark, many_files, model):
    row = manifest.manifest_estimate(spark, many_files, ["id"]).first()
    assert row.method == "estimate" and row.bytes == scan_estimate(spark, many_files, columns=["id"]).first().bytes
    with pytest.raises(KeyError):
        manifest.manifest_estimate(spark, model, ["id"], ranges={"other": (1, 2)})


def test_replaced_files_have_new_entries(spark):
    path = shared_folder(spark, "replaced")
    publish(spark.range(1000).selectExpr("id", "id % 2 AS part"), path, "part")
    publish(spark.range(500).selectExpr("id + 5000 AS id", "id % 2 AS part"), path, "part")
    row = manifest.manifest_estimate(spark, path, ["id"]).first()
    assert row.method == "exact" and row.bytes == _chunk_bytes(path, ["id"])
    assert manifest.manifest_estimate(spark, path, ["id"], ranges={"id": (0, 4000)}).first().files == 0
    frozen = freeze(spark, shared_folder(spark, "frozen"), {"x": 1}, lambda: spark.range(10))
    folder = os.path.dirname(frozen.inputFiles()[0].removeprefix("file://"))
    assert manifest.manifest_estimate(spark, folder, ["id"]).first().method == "exact"


# ---- two writers at once


def test_writers_at_once_lose_nothing(spark):
    folder, errors = shared_folder(spark, "entries"), []

    def write(n):
        try:
            for k in range(3):
                enter(spark.range(1).select(F.lit(n * 10 + k).alias("n")), folder)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and sorted(r.n for r in entries(spark, folder).collect()) == [n * 10 + k for n in range(4) for k in range(3)]


def test_two_runs_publish_at_once(spark):
    path = shared_folder(spark, "gated")
    report = spark.createDataFrame([("c", True, 0, "pass")], "category string, blocking boolean, failures long, result string")

    def run(n):
        publish_gated(spark, {"m": (spark.range(n), None)}, lambda written: report, path)

    threads = [threading.Thread(target=run, args=(n,)) for n in (3, 5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert entries(spark, f"{path}/_published").count() == 2
    assert published(spark, path, "m").count() in (3, 5)
    with pytest.raises(FileNotFoundError):
        published(spark, path, "other")


# ---- cube by day, late events


def test_ten_days_of_the_cube_equal_the_rebuild(spark):
    inputs = random_inputs(21)
    sources = as_sources(spark, inputs)
    folder = shared_folder(spark, "cube")
    last = max(r[0] for r in simulate(inputs))
    day = last - dt.timedelta(days=10)
    publish(lifecycle.account_datelist(sources, day, EDGES), f"{folder}/history", "snapshot_date")
    for _ in range(10):
        day += dt.timedelta(days=1)
        incremental.build_day(spark, f"{folder}/history", sources, day, EDGES)
        incremental.build_cube_days(spark, f"{folder}/history", f"{folder}/cube", [day], "week", TYPES)
    incremental.build_cube_days(spark, f"{folder}/history", f"{folder}/cube", [day], "week", TYPES)  # again: no change
    cube = spark.read.parquet(f"{folder}/cube")
    columns = [c for c in cube.columns if c != "snapshot_date"]
    got = rows_of(cube.select(F.col("snapshot_date").cast("date"), *columns))
    assert got == [r for r in simulate_cube(simulate(inputs)) if r[0] > last - dt.timedelta(days=10)]


def _late(inputs, seed, days=10):
    """Inputs without some rows of the last days, and those rows."""
    rng = random.Random(seed)
    moments = [c[3].date() for c in inputs[0]] + [t[1] for t in inputs[3]]
    first = max(moments) - dt.timedelta(days=days)

    def day(row, at):
        return row[at].date() if isinstance(row[at], dt.datetime) else row[at]

    known, arrived = [], []
    for rows, at in zip(inputs, (3, 1, 1, 1)):
        own = [day(r, at) > first and rng.random() < 0.4 for r in rows]
        known.append([r for r, o in zip(rows, own) if not o])
        arrived.append([r for r, o in zip(rows, own) if o])
    return known, arrived, first


@pytest.mark.parametrize("seed", range(3))
def test_late_events_give_the_history_of_a_rebuild(spark, seed):
    inputs = random_inputs(seed + 40)
    known, arrived, first = _late(inputs, seed)
    path = shared_folder(spark, "late")
    last = max(r[0] for r in simulate(inputs))
    publish(lifecycle.account_datelist(as_sources(spark, known), last, EDGES), path, "snapshot_date")
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/snapshot_date=*/*.parquet")}
    changed = late.repair(spark, path, as_sources(spark, inputs), as_sources(spark, arrived), last, EDGES)
    history = spark.read.parquet(path).withColumn("snapshot_date", F.col("snapshot_date").cast("date"))
    assert rows_of(history.select(*lifecycle.DATELIST_COLUMNS)) == simulate(inputs)
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/snapshot_date=*/*.parquet")}
    day_of = lambda f: dt.date.fromisoformat(f.split("snapshot_date=")[1][:10])
    untouched = [f for f in before if day_of(f) < changed[0]]
    assert untouched and all(after[f] == before[f] for f in untouched)
    assert {day_of(f) for f in after if after[f] != before.get(f)} == set(changed)
    touched = {r.account_id: r.first_day for r in late.journal(spark, path).collect()}
    assert min(touched.values()) == changed[0] and set(touched) >= {r[0] for r in arrived[3]}
    assert manifest.manifest_estimate(spark, path, ["account_id"]).first().method == "exact"


def test_a_late_second_creation_changes_all_days_of_its_account(spark):
    day = lambda n: dt.datetime(2024, 1, n, 6)
    known = ([(1, 5, "pot", day(2)), (2, 5, "pot", day(3))], [], [], [(1, day(4).date(), 2)])
    arrived = ([(1, 9, "retail", day(8))], [], [], [])
    inputs = tuple(a + b for a, b in zip(known, arrived))
    path, last = shared_folder(spark, "again"), dt.date(2024, 1, 10)
    publish(lifecycle.account_datelist(as_sources(spark, known), last, EDGES), path, "snapshot_date")
    late.repair(spark, path, as_sources(spark, inputs), as_sources(spark, arrived), last, EDGES)
    history = spark.read.parquet(path).withColumn("snapshot_date", F.col("snapshot_date").cast("date"))
    assert rows_of(history.select(*lifecycle.DATELIST_COLUMNS)) == simulate(inputs, last)
    none = tuple([] for _ in known)
    assert late.repair(spark, path, as_sources(spark, inputs), as_sources(spark, none), last, EDGES) == []


# ---- sketches


@pytest.mark.parametrize("window", [1, 5, 7, 28])
def test_rolling_sketches_are_close_to_exact_counts(spark, window):
    rng = random.Random(6)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=min(rng.randrange(60), rng.randrange(60))), rng.choice("ab"),
             rng.choice([None, *range(int(5000 * rng.random()) + 1)])) for _ in range(30_000)]
    rows = [r for r in rows if r[0] != dt.date(2024, 1, 9)]
    table = spark.createDataFrame(rows, "at date, kind string, who long")
    daily = sketches.daily_sketches(table, "at", "who", ["kind"])
    exact, counted, last = defaultdict(set), defaultdict(int), max(r[0] for r in rows)
    for at, kind, who in rows:
        for n in range(window):
            end = at + dt.timedelta(days=n)
            if end <= last:
                counted[end, kind] += 1
                exact[end, kind] |= {who} - {None}
    got = {(r.day, r.kind): r for r in sketches.rolling_distinct(daily, window, ["kind"]).collect()}
    assert {k: r.rows for k, r in got.items()} == counted
    assert all(abs(got[k].users - len(v)) <= max(3 * sketches.standard_error() * len(v), 0.5) for k, v in exact.items())
    assert abs(sketches.united(daily).select(F.hll_sketch_estimate("sketch")).first()[0] - len({r[2] for r in rows} - {None})) < 250


def test_windows_read_the_sketches_only(spark, plan):
    path = shared_folder(spark, "sketched")
    publish(sketches.daily_sketches(spark.range(100).selectExpr("DATE '2024-01-01' AS at", "id"), "at", "id"), path)
    text = plan(sketches.rolling_distinct(spark.read.parquet(path), 28))
    assert text.count("FileScan") <= 2 and "sketch" in text  # the table, and its last day


# ---- keys


def _brute_keys(rows, names, size):
    found = []
    for n in range(1, size + 1):
        for at in combinations(range(len(names)), n):
            if any(set(k) <= set(at) for k in found):
                continue
            if len({tuple(r[i] for i in at) for r in rows}) == len(rows):
                found.append(at)
    return [tuple(names[i] for i in k) for k in found]


@pytest.mark.parametrize("seed", range(4))
def test_minimal_keys_equal_all_subsets_counted(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "odd name", "d", "e.f"]
    width = [3, 8, 20, 60, 400][:: rng.choice([1, -1])]
    rows = list({tuple(rng.choice([None, *range(w)]) for w in width) for _ in range(120)})
    table = spark.createDataFrame(rows, ", ".join(f"`{n}` int" for n in names))
    expected = _brute_keys(rows, names, 3)
    assert keys.minimal_keys(table) == expected
    assert keys.minimal_keys(table, samples=(10, 40)) == expected
    assert keys.minimal_keys(table, samples=()) == expected


def test_near_keys_do_not_shuffle_all_rows(spark, monkeypatch):
    """A near key that the samples leave is refuted by a slice of its hashes; only keys are hashed whole."""
    n = F.col("id")
    table = spark.range(4000).select(n.alias("k"), (n % 3500).alias("near"), F.lit(1).alias("one"))
    whole, compared, real, exact = [], [], keys.repeated_hashes, keys.is_key

    def hashed(rows, n_rows, candidates, slices=1):
        whole.extend(candidates if slices == 1 else [])
        return real(rows, n_rows, candidates, slices)

    monkeypatch.setattr(keys, "_HASHES_IN_TASK", 1000)
    monkeypatch.setattr(keys, "repeated_hashes", hashed)
    monkeypatch.setattr(keys, "is_key", lambda rows, c: compared.append(c) or exact(rows, c))
    assert keys.minimal_keys(table, max_columns=2, samples=(20,)) == [("k",)]
    assert whole == [("k",)] and compared == []


def test_equal_hashes_of_unequal_values_are_no_repeat(spark, monkeypatch):
    table = spark.createDataFrame([(a, b) for a in (None, 0, 1) for b in (None, 0, 1)], "a int, b int")
    monkeypatch.setattr(keys, "_hash", lambda columns: F.xxhash64(F.lit(7)))
    assert keys.keys_among(table, 9, [("a",), ("b",), ("a", "b")], (2, 1)) == [("a", "b")]


def test_keys_of_hardly_any_rows(spark):
    table = spark.createDataFrame([(1, None)], "a int, b int")
    assert keys.minimal_keys(table) == [()] == keys.minimal_keys(table.limit(0))
    assert keys.minimal_keys(table.union(table)) == []
    assert keys.minimal_keys(table.union(spark.createDataFrame([(2, None)], "a int, b int"))) == [("a",)]


# ---- check state by partition

FAILING = {"no_state": "state IS NULL", "range": "n NOT BETWEEN 1 AND 5"}


def _full_report(rows):
    seen = defaultdict(int)
    for day, account, _, _ in rows:
        seen[day, account] += 1
    failing = {"grain": [d for (d, _), c in seen.items() if c > 1], "no_state": [r[0] for r in rows if r[2] is None],
               "range": [r[0] for r in rows if r[3] is not None and not 1 <= r[3] <= 5]}
    days = {r[0] for r in rows}
    return {c: (len(f), len(rows), len(days), max(sorted(set(f)), key=f.count) if f else None) for c, f in failing.items()}


def test_merged_counters_equal_the_full_report(spark, plan):
    rng = random.Random(9)

    def day_rows(day):
        return [(day, rng.randrange(40), rng.choice([None, "o", "c", "c"]), rng.choice([None, *range(8)])) for _ in range(50)]

    stored = {f"2024-01-{d:02d}": day_rows(f"2024-01-{d:02d}") for d in range(1, 6)}
    path, state = shared_folder(spark, "checked"), shared_folder(spark, "check-state")
    schema = "day string, account long, state string, n long"

    def write(days):
        rows = spark.createDataFrame([r for d in days for r in stored[d]], schema)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

    def check(days):
        rows = spark.read.schema("account long, state string, n long, day string").parquet(path).where(F.col("day").isin(*days))
        counters = check_state.partition_counters(rows, "day", ["account"], FAILING)
        check_state.record(counters, state)
        assert "PartitionFilters: [day" in plan(counters) or "PartitionFilters: [isnotnull(day" in plan(counters)

    def report():
        return {r.check: (r.failures, r.rows, r.partitions, r.worst_partition) for r in check_state.merged(spark, state).collect()}

    with pytest.raises(FileNotFoundError):
        check_state.merged(spark, state)
    write(list(stored)[:4])
    check(list(stored)[:4])
    write(list(stored)[4:])
    check(list(stored)[4:])
    assert report() == _full_report([r for rows in stored.values() for r in rows])
    # A day is replaced: only it is checked again, with violations seeded in it.
    stored["2024-01-02"] = [("2024-01-02", 7, None, 99)] * 3
    write(["2024-01-02"])
    check(["2024-01-02"])
    assert report() == _full_report([r for rows in stored.values() for r in rows])
    with pytest.raises(ValueError):
        check_state.partition_counters(spark.range(1), "id", ["id"], {"grain": "true"})
