"""The account model against a plain day-by-day simulation, on random inputs."""

import datetime as dt
import random
from collections import defaultdict

import check
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from plumbline.plans import active_users, cohorts, incremental, lifecycle
from plumbline.sources.storage import publish, shared_folder
from plumbline.testbed import oracle, views

EDGES = (3, 7, 14)
LABELS = ["0-3 (new)", "4-7", "8-14", "15+ (established)"]
START = dt.datetime(2024, 1, 1)
TYPES = ["retail", "pot", "joint"]


def random_inputs(seed, accounts=30, days=45):
    rng = random.Random(seed)

    def moment():
        return START + dt.timedelta(days=rng.randrange(days), hours=rng.choice([0, 6, 6, 23]))

    created, closed, reopened, panel = [], [], [], {}
    for account in range(accounts):
        for _ in range(rng.choice([1, 1, 1, 2])):
            kind = None if account % 11 == 10 else TYPES[account % 3]
            created.append((account, account % 7 if account > 9 else 0, kind, moment()))
        closed += [(account, moment()) for _ in range(rng.choice([0, 0, 1, 3]))]
        reopened += [(account, moment()) for _ in range(rng.choice([0, 0, 1, 2]))]
        for _ in range(rng.choice([0, 1, 5, 40])):
            panel[account, moment().date()] = rng.randrange(1, 9)
    orphans = [(900 + n, moment()) for n in range(3)]
    panel[901, START.date()] = 4
    txns = [(a, d, n) for (a, d), n in panel.items()]
    return created, closed + orphans, reopened, txns


def as_sources(spark, inputs):
    created, closed, reopened, txns = inputs
    return lifecycle.Sources(
        spark.createDataFrame(
            created, "account_id long, user_id long, account_type string, created_ts timestamp_ntz"
        ),
        spark.createDataFrame(closed, "account_id long, closed_ts timestamp_ntz"),
        spark.createDataFrame(reopened, "account_id long, reopened_ts timestamp_ntz"),
        spark.createDataFrame(txns, "account_id long, txn_date date, txn_count long"),
    )


def simulate(inputs, until=None):
    """Walk every account through every day."""
    created, closed, reopened, txns = inputs
    moments = [c[3].date() for c in created] + [x[1].date() for x in closed + reopened]
    last = until or max(moments + [t[1] for t in txns])
    accounts = {}
    for account, user, kind, ts in created:
        if kind is None or ts.date() > last:
            continue
        a = accounts.setdefault(account, [user, kind, ts])
        accounts[account] = [max(a[0], user), max(a[1], kind), min(a[2], ts)]
    events = defaultdict(list)
    for account, (_, _, ts) in accounts.items():
        events[account].append((ts, 1))
    for order, rows in ((2, closed), (3, reopened)):
        for account, ts in rows:
            events[account].append((ts, order))
    panel = {(a, d): n for a, d, n in txns}
    rows = []
    for account, (user, kind, ts) in accounts.items():
        day, status, active = ts.date(), None, []
        while day <= last:
            today = [e for e in events[account] if e[0].date() == day]
            if today:
                status = max(today)[1] != 2
            count = panel.get((account, day), 0)
            active.append(int(count > 0))
            age = (day - ts.date()).days
            label = LABELS[sum(age > edge for edge in EDGES)]
            rows.append((day, account, user, kind, ts.date(), age, label, status, active[-1],
                         sum(active[-7:]), sum(active[-28:]), count))
            day += dt.timedelta(days=1)
    return sorted(rows)


def simulate_cube(history):
    first = {}
    for row in history:
        first[row[2]] = min(first.get(row[2], row[4]), row[4])
    flags, dims = defaultdict(lambda: [0, 0, 0]), defaultdict(set)
    for row in history:
        key = (row[0], row[2])
        flags[key] = [max(f, int(x > 0)) for f, x in zip(flags[key], row[8:11])]
        if row[7]:
            dims[key].add((row[3], row[6]))
    cells = defaultdict(lambda: [0, 0, 0, 0])
    for (day, user), pairs in dims.items():
        monday = first[user] - dt.timedelta(days=first[user].weekday())
        mine = {("ALL", "ALL", "ALL"), ("ALL", "ALL", str(monday))}
        for kind, label in pairs:
            mine |= {(kind, "ALL", "ALL"), ("ALL", label, "ALL"), (kind, label, "ALL")}
        for cell in mine:
            counts = cells[(day, *cell)]
            counts[0] += 1
            for n in range(3):
                counts[n + 1] += flags[day, user][n]
    return sorted((*k, *v, *(c / v[0] for c in v[1:])) for k, v in cells.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(4))
def test_history_and_cube_match_the_simulation(spark, seed):
    inputs = random_inputs(seed)
    expected = simulate(inputs)
    sources = as_sources(spark, inputs)
    segments = lifecycle.account_segments(sources, edges=EDGES)
    assert rows_of(lifecycle.datelist_of(segments)) == expected
    last = lifecycle.latest_day(sources).scalar()
    stretches = active_users.user_stretches(segments, last, "week")
    cube = simulate_cube(expected)
    assert rows_of(active_users.active_user_cube(stretches, TYPES)) == cube
    assert rows_of(active_users.active_user_cube(stretches)) == cube


def test_history_up_to_a_day_ignores_what_came_later(spark):
    inputs, day = random_inputs(7), dt.date(2024, 1, 20)
    history = lifecycle.account_datelist(as_sources(spark, inputs), day, EDGES)
    assert rows_of(history) == simulate(inputs, day)


def test_days_built_one_by_one_equal_the_rebuild(spark):
    inputs = random_inputs(11)
    sources = as_sources(spark, inputs)
    path = shared_folder(spark, "days")
    day = dt.date(2024, 1, 5)
    publish(lifecycle.account_datelist(sources, day, EDGES), path, "snapshot_date")
    for _ in range(8):
        day += dt.timedelta(days=1)
        incremental.build_day(spark, path, sources, day, EDGES)
        incremental.build_day(spark, path, sources, day, EDGES)  # repeating changes nothing
        built = spark.read.parquet(path).where(F.col("snapshot_date") == F.lit(day))
        rebuilt = [row for row in simulate(inputs, day) if row[0] == day]
        assert rows_of(built.select(*lifecycle.DATELIST_COLUMNS)) == rebuilt


def _built_until(spark, day):
    sources = as_sources(spark, random_inputs(5))
    path = shared_folder(spark, "gaps")
    publish(lifecycle.account_datelist(sources, day, EDGES), path, "snapshot_date")
    return sources, path


def test_a_day_is_not_built_on_a_gap(spark):
    day = dt.date(2024, 1, 20)
    sources, path = _built_until(spark, day)
    with pytest.raises(incremental.MissingDay, match="2024-01-21"):
        incremental.build_day(spark, path, sources, dt.date(2024, 1, 22), EDGES)
    assert spark.read.parquet(path).agg(F.max("snapshot_date")).first()[0] == day


@pytest.mark.parametrize("back", [7, 28])
def test_a_missing_day_of_a_window_is_an_error(spark, back):
    last = dt.date(2024, 2, 5)
    inputs = random_inputs(5)
    sources = as_sources(spark, inputs)
    day = last + dt.timedelta(days=1)
    gone = day - dt.timedelta(days=back)
    history = lifecycle.account_datelist(sources, last, EDGES)
    assert history.where(F.col("snapshot_date") < F.lit(gone)).count()
    path = shared_folder(spark, "window")
    publish(history.where(F.col("snapshot_date") != F.lit(gone)), path, "snapshot_date")
    with pytest.raises(incremental.MissingDay, match=str(gone)):
        incremental.build_day(spark, path, sources, day, EDGES)


def test_late_events_need_the_days_after_them_built_again(spark):
    inputs, day = random_inputs(5), dt.date(2024, 1, 20)
    sources, path = _built_until(spark, day)
    account = simulate(inputs, day)[-1][1]
    late = (*inputs[:3], [*(r for r in inputs[3] if r[:2] != (account, day - dt.timedelta(days=1))),
                          (account, day - dt.timedelta(days=1), 4)])
    changed = as_sources(spark, late)
    incremental.build_day(spark, path, changed, day - dt.timedelta(days=1), EDGES)

    def stored():
        rows = spark.read.parquet(path).select(*lifecycle.DATELIST_COLUMNS)
        return [r for r in rows_of(rows) if r[0] >= day - dt.timedelta(days=1)]

    expected = [r for r in simulate(late, day) if r[0] >= day - dt.timedelta(days=1)]
    assert stored() != expected  # the day after still stands for the old state
    incremental.build_day(spark, path, changed, day, EDGES)
    assert stored() == expected


def test_build_of_a_day_touches_three_partitions(spark, plan):
    path = shared_folder(spark, "three")
    sources = as_sources(spark, random_inputs(3))
    publish(lifecycle.account_datelist(sources, dt.date(2024, 1, 20), EDGES), path, "snapshot_date")
    text = plan(incremental.next_day(spark.read.parquet(path), sources, dt.date(2024, 1, 21)))
    assert "PartitionFilters: [snapshot_date" in text
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1


def test_reopening_wins_a_tie_and_creation_loses_it(spark):
    noon = dt.datetime(2024, 1, 1, 12)
    inputs = ([(1, 1, "pot", noon), (2, 2, "pot", noon)], [(1, noon), (2, noon)], [(1, noon)], [])
    history = lifecycle.account_datelist(as_sources(spark, inputs), edges=EDGES)
    assert {r.account_id: r.is_open for r in history.collect()} == {1: True, 2: False}


def test_unknown_type_is_an_error_when_types_are_declared(spark):
    sources = as_sources(spark, ([(1, 1, "gold", START)], [], [], []))
    segments = lifecycle.account_segments(sources, edges=EDGES)
    stretches = active_users.user_stretches(segments, lifecycle.latest_day(sources).scalar())
    with pytest.raises(Exception, match="unknown account type"):
        active_users.active_user_cube(stretches, TYPES).collect()
    with pytest.raises(Exception, match="unknown account type"):
        active_users.active_user_cube(stretches, [f"type{n}" for n in range(20)]).collect()
    assert active_users.active_user_cube(stretches).count() == 5


def test_a_type_called_like_the_rollup_marker_keeps_its_own_rows(spark):
    sources = as_sources(spark, ([(1, 1, "ALL", START), (2, 2, "it's", START)], [], [], []))
    segments = lifecycle.account_segments(sources, edges=EDGES)
    stretches = active_users.user_stretches(segments, lifecycle.latest_day(sources).scalar())
    listed = rows_of(active_users.active_user_cube(stretches))
    assert rows_of(active_users.active_user_cube(stretches, ["ALL", "it's"])) == listed
    assert sorted(r[4] for r in listed if r[1:4] == ("ALL", "ALL", "ALL")) == [1, 2]


def test_history_is_unfolded_after_the_last_shuffle(spark, plan):
    text = plan(lifecycle.account_datelist(as_sources(spark, random_inputs(1)), edges=EDGES))
    lines = text.splitlines()
    unfold = next(n for n, line in enumerate(lines) if "explode(sequence(" in line)
    shuffles = [n for n, line in enumerate(lines) if "Exchange" in line]
    assert min(shuffles) > unfold
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_dense_rows_of_the_cube_are_never_shuffled(spark, plan):
    sources = as_sources(spark, random_inputs(1))
    segments = lifecycle.account_segments(sources, edges=EDGES)
    stretches = active_users.user_stretches(segments, lifecycle.latest_day(sources).scalar())
    lines = plan(active_users.active_user_cube(stretches, TYPES)).splitlines()
    unfold = next(n for n, line in enumerate(lines) if "explode(sequence(" in line)
    by_user = [n for n, line in enumerate(lines[:unfold]) if "Exchange hashpartitioning(user_id" in line]
    assert by_user == []


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
@pytest.mark.parametrize(
    "name", ["join_left_spine_events", "win_rolling_sum_7", "join_using_composite", "agg_distinct_filtered",
             "agg_flag_max", "join_bridge_distinct"],
)
def test_dense_rows_are_neither_shuffled_nor_broadcast(spark, sf, plan, name, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        lines = plan(contract.queries()[name](spark, sf)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    unfold = next(n for n, line in enumerate(lines) if "explode(sequence(" in line)
    moved = [line for line in lines[:unfold] if "Exchange" in line]
    # What is counted per day may move, once it is counted.
    assert all("snapshot_date" in line and "user_id" not in line and "account_id" not in line for line in moved)


def test_a_cohort_that_closes_before_the_month_ends_keeps_its_latest_snapshot(spark, sf):
    src = views.accounts_long(spark, sf)
    last = lifecycle.latest_day(src).scalar()
    stretches = active_users.user_stretches(lifecycle.account_segments(src), last)
    cube = active_users.active_user_cube(stretches)
    got = rows_of(cohorts.cohort_retention(cube))
    # The last row of each cohort and month, whatever its day.
    latest = f"""
        WITH {oracle.LONG_CUBE}, monthly AS (
          SELECT *, CAST(date_diff('month', CAST(signup_cohort AS DATE), snapshot_date) AS INTEGER) AS months
          FROM active_user_cube WHERE signup_cohort <> 'ALL')
        SELECT signup_cohort, months, arg_max(active_users_7d_rate, snapshot_date),
               arg_max(open_users, snapshot_date), max(snapshot_date) = last_day(max(snapshot_date))
                 OR max(snapshot_date) = (SELECT d FROM last_day) AS at_end
        FROM monthly GROUP BY 1, 2"""
    expected = sorted(check.oracle(sf).execute(latest).fetchall())
    assert any(not row[4] for row in expected)  # such cohorts are there
    assert got == [row[:4] for row in expected]


def test_cube_counts_each_day_as_the_unfolded_days_do(spark):
    """Users with several accounts, gaps, repeated openings, closed but active accounts and one-day stretches."""
    rng = random.Random(5)
    start, rows = dt.date(2024, 1, 1), []
    for user in range(30):
        for kind in ("a", "b"):
            for bucket in ("x", "y"):
                day = rng.randrange(20)
                while day < 60 and rng.random() < 0.9:
                    length = rng.choice((1, 1, 3, 9))
                    flags = sorted(rng.randrange(2) for _ in range(3))
                    first, last = (start + dt.timedelta(days=n) for n in (day, day + length - 1))
                    rows.append((user, kind, bucket, dt.date(2024, 1 + user % 3, 1), first, last, rng.random() < 0.6, *flags))
                    day += length + rng.choice((0, 0, 4))
    stretches = spark.createDataFrame(
        rows, "user_id long, account_type string, account_age_bucket string, signup_cohort date, start_day date,"
        " end_day date, is_open boolean, active_1d int, active_7d int, active_28d int",
    )
    days = active_users.user_days_with_flags(active_users.user_days(stretches)).collect()
    expected = {}
    for r in days:
        split = ((), (0,), (1,), (0, 1), (2,))
        named = (r.account_type, r.account_age_bucket, str(r.signup_cohort))
        for s in split:
            cell = (r.snapshot_date, *(named[i] if i in s else "ALL" for i in range(3)))
            expected.setdefault(cell, {})[r.user_id] = (r.active_1d, r.active_7d, r.active_28d)
    found = {tuple(r[:4]): tuple(r[4:8]) for r in active_users.active_user_cube(stretches).collect()}
    assert found == {c: (len(u), *map(sum, zip(*u.values()))) for c, u in expected.items()}
    empty = active_users.active_user_cube(stretches.where("user_id < 0"))
    assert empty.count() == 0
