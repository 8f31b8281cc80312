import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import profile, quality
from plumbline.operators.grading import grade_texts
from plumbline.operators.skew import left_join_hot_keys
from plumbline.plans import lifecycle
from plumbline.sources.storage import publish_gated, published, shared_folder
from plumbline.testbed import QUERIES
from test_accounts import EDGES, START, TYPES, as_sources

CLEAN = (
    [(a, a, TYPES[a % 3], START + dt.timedelta(days=a)) for a in range(6)],
    [(2, START + dt.timedelta(days=9))],
    [],
    [(a, START.date() + dt.timedelta(days=a + 1), 2) for a in range(6)],
)


def violated(checks):
    return {r.check for r in checks.collect() if r.violations > 0}


def history(spark, inputs=CLEAN):
    return lifecycle.account_datelist(as_sources(spark, inputs), edges=EDGES)


def test_clean_data_passes(spark):
    checks = quality.account_checks(as_sources(spark, CLEAN), history(spark), TYPES)
    assert violated(checks) == set()
    assert {r.result for r in quality.quality_report(checks).collect()} == {"pass"}


def _with(position, *rows):
    return tuple([*part, *rows] if n == position else part for n, part in enumerate(CLEAN))


@pytest.mark.parametrize(
    "inputs, check",
    [
        (_with(0, (8, 8, None, START)), "null_account_type"),
        (_with(1, (77, START + dt.timedelta(days=1))), "orphans"),
        (_with(3, (5, START.date(), 3)), "transactions_before_creation"),
        (_with(3, (1, START.date() + dt.timedelta(days=8), 1001)), "txn_count_out_of_range"),
        (_with(3, CLEAN[3][0]), "duplicate_activity"),
        (_with(0, (8, 8, "gold", START)), "unknown_account_types"),
    ],
)
def test_each_bad_source_trips_its_own_check(spark, inputs, check):
    checks = quality.account_checks(as_sources(spark, inputs), history(spark, inputs), TYPES)
    assert violated(checks) == {check}


def test_each_bad_history_trips_its_own_check(spark):
    good, sources = history(spark), as_sources(spark, CLEAN)
    one_day = good.where("account_id = 3").limit(1)
    middle = F.lit(START.date() + dt.timedelta(days=7))
    cases = {
        "duplicate_days": good.unionAll(one_day),
        "broken_spines": good.where(~((F.col("account_id") == 3) & (F.col("snapshot_date") == middle))),
        "unreconciled_accounts": good.where("account_id <> 3"),
        "null_state": good.withColumn("is_open", F.when(F.col("account_id") != 3, F.col("is_open"))),
    }
    for check, bad in cases.items():
        found = violated(quality.account_checks(sources, bad, TYPES))
        # a repeated day also makes its spine one day too long
        assert found - ({"broken_spines"} if check == "duplicate_days" else set()) == {check}


def test_advisory_checks_warn_and_blocking_ones_fail(spark):
    rows = [("a", "x", False, 3), ("b", "x", True, 0), ("c", "y", True, 1), ("d", "z", True, 0)]
    checks = spark.createDataFrame(rows, "check string, category string, blocking boolean, violations long")
    report = {r.category: r.result for r in quality.quality_report(checks).collect()}
    assert report == {"x": "warn", "y": "fail", "z": "pass"}


def test_gate_publishes_all_or_nothing(spark):
    sources, path = as_sources(spark, CLEAN), shared_folder(spark, "gate")

    def check(models):
        return quality.quality_report(quality.account_checks(sources, models["h"], TYPES))

    publish_gated(spark, {"h": (history(spark), "snapshot_date")}, check, path)
    good = published(spark, path, "h").count()
    assert good == history(spark).count()
    bad = history(spark).where("account_id <> 3")
    with pytest.raises(quality.QualityGateFailed, match="unreconciled"):
        publish_gated(spark, {"h": (bad, "snapshot_date")}, check, path)
    assert published(spark, path, "h").count() == good


def test_orphans_published_beside_the_history_only_warn(spark):
    inputs = _with(1, (77, START + dt.timedelta(days=1)))
    sources, path = as_sources(spark, inputs), shared_folder(spark, "gate")

    def run(apart):
        def check(models):
            checks = quality.account_checks(sources, models["h"], TYPES, set_apart=models["orphans"])
            return quality.quality_report(checks)

        models = {"h": (history(spark, inputs), "snapshot_date"), "orphans": (apart, None)}
        return publish_gated(spark, models, check, path)

    found = quality.account_orphans(sources)
    with pytest.raises(quality.QualityGateFailed, match="orphans=1"):
        run(found.where("account_id <> 77"))
    report = {r.category: (r.result, r.detail) for r in run(found).collect()}
    assert report.pop(quality.INTEGRITY) == ("warn", "orphans=0, orphans_set_apart=1")
    assert {result for result, _ in report.values()} == {"pass"}
    assert [r.account_id for r in published(spark, path, "orphans").collect()] == [77]
    assert published(spark, path, "h").count() == history(spark, inputs).count()


def test_gated_history_of_events_with_an_orphan(spark, tmp_path):
    at = dt.datetime(2024, 1, 28)
    rows = [(1, "signup", at), (1, "view", at + dt.timedelta(days=1)), (5, "error", at + dt.timedelta(days=2))]
    events = spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp_ntz")
    events.withColumn("value", F.lit(30.0)).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["publish_gated"](spark, str(tmp_path)).collect()
    assert sorted((r.account_id, r.snapshot_date.day) for r in got) == [(1, 28), (1, 29), (1, 30)]


def test_orphans_survive_a_null_in_the_parent(spark):
    child = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    parent = spark.createDataFrame([(1,), (None,)], "id long")
    assert [r.id for r in quality.orphans([child, child], parent, "id").collect()] == [2]


def test_both_sides_of_the_orphan_join_are_reduced_before_the_shuffle(spark, sf, plan):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(quality.orphans([events], events, "id")).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = [n for n, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 2 and all("HashAggregate" in lines[n + 1] for n in shuffles)


def test_repeated_assertions_count_as_often_as_they_are_made(spark):
    texts = spark.createDataFrame([("a", "x y")], "case_id string, text string")
    rows = [("a", "contains", "x")] * 500 + [("a", "absent", f"n{i}") for i in range(300)] + [("a", "absent", "y")]
    asserted = spark.createDataFrame(rows, "case_id string, kind string, needle string")
    assert [tuple(r) for r in grade_texts(texts, asserted, rows_per_chunk=50).collect()] == [("a", 801, 800, False)]


def test_staleness(spark):
    def items(rows):
        return spark.createDataFrame(rows, "item string, modified int")

    result = quality.staleness(items([("a", 5), ("b", 5), ("c", 5)]),
                               items([("a", 9), ("b", 1), ("b", 2)]), "item", "modified")
    assert sorted(map(tuple, result.collect())) == [("b", "stale"), ("c", "missing")]


def test_grading_counts_missing_texts_and_unasserted_cases(spark):
    texts = spark.createDataFrame([("a", "SELECT x"), ("b", "y"), ("c", None)],
                                  "case_id string, text string")
    asserted = spark.createDataFrame(
        [("a", "contains", "SELECT"), ("a", "absent", "*"), ("a", "contains", "z"),
         ("c", "absent", "q"), ("gone", "absent", "q")],
        "case_id string, kind string, needle string")
    graded = {r.case_id: (r.n_assert, r.n_passed, r.passed)
              for r in grade_texts(texts, asserted).collect()}
    assert graded == {"a": (3, 2, False), "b": (0, 0, True), "c": (1, 0, False),
                      "gone": (1, 0, False)}


def test_hot_keys_join_like_any_other(spark):
    many = spark.range(2000).selectExpr("if(id % 3 = 0, 0, id % 50) AS k", "cast(id AS string) AS v")
    one = spark.range(40).selectExpr("id AS k", "concat('t', id) AS t")
    plain = many.join(one, "k", "left")
    split = left_join_hot_keys(many, one, "k", "v", rows_per_chunk=100)
    assert sorted(map(repr, split.select("k", "v", "t").collect())) == sorted(
        map(repr, plain.select("k", "v", "t").collect()))


def test_candidate_keys_count_nulls_and_need_not_nest(spark):
    rows = spark.createDataFrame([(1, None, 1), (1, None, 2), (2, 5, 1), (None, None, 1)],
                                 "a int, b int, c int")
    nested = profile.candidate_keys(rows, {"a": ["a"], "ab": ["a", "b"], "abc": ["a", "b", "c"]})
    assert nested.first().asDict() == {"total_rows": 4, "distinct_a": 3, "distinct_ab": 3,
                                       "distinct_abc": 4}
    apart = profile.candidate_keys(rows, {"a": ["a"], "c": ["c"]})
    assert apart.first().asDict() == {"total_rows": 4, "distinct_a": 3, "distinct_c": 2}
    empty = profile.candidate_keys(rows.where("false"), {"a": ["a"]})
    assert empty.first().asDict() == {"total_rows": 0, "distinct_a": 0}


def test_latest_snapshot_and_clip(spark):
    day = [dt.date(2024, 1, n) for n in (1, 2, 3)]
    rows = spark.createDataFrame([(day[0], 1), (day[2], 2), (day[2], 3), (None, 4)], "d date, x int")
    assert [r.x for r in profile.latest_snapshot(rows, "d", F.lit(day[1])).collect()] == [1]
    assert sorted(r.x for r in profile.latest_snapshot(rows, "d").collect()) == [2, 3]
    clip = profile.clip_report(rows, "d", F.lit(day[0]), F.lit(day[1])).first()
    assert (clip.kept, clip.dropped) == (1, 3)
