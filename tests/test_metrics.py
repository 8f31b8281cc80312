import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import __spark_entry__ as contract
from plumbline.operators.governance import (
    Dataset,
    Metric,
    Segment,
    Table,
    UnknownName,
    check_against,
)
from plumbline.operators.metric import UnboundedScan, metric_query
from plumbline.operators.search import TextSource, text_search
from plumbline.operators.window import TimeWindow
from plumbline.plans.library import REGISTRY, TAXI, TRENDS, WEB
from plumbline.testbed import metrics as metric_queries
from plumbline.testbed import relational

EVENTS = Table("events", "one event", partition_column="refresh_date", hygiene_filter="is_valid",
               time_column="refresh_date")
DEMO = Dataset(
    "demo",
    (EVENTS,),
    (Metric("avg_score", "events", "avg(score)"),),
    (Segment("top_10", "rank <= 10"), Segment("either", "rank = 1 OR rank = 30")),
)


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        ("a", 90, 1, True, dt.date(2024, 1, 8)),
        ("a", 70, 2, True, dt.date(2024, 1, 9)),
        ("b", 80, 3, True, dt.date(2024, 1, 10)),
        ("b", 10, 30, True, dt.date(2024, 1, 10)),
        ("c", 99, 1, False, dt.date(2024, 1, 10)),
        ("d", None, 4, True, dt.date(2024, 1, 2)),
    ]
    schema = "term string, score int, rank int, is_valid boolean, refresh_date date"
    return {"events": spark.createDataFrame(rows, schema)}


def test_unknown_fields_are_refused():
    with pytest.raises(TypeError):
        Metric("m", "t", "count(1)", surprise=1)


def test_references_are_checked():
    with pytest.raises(ValueError, match="unknown table"):
        Dataset("d", (EVENTS,), (Metric("m", "nope", "count(1)"),))
    with pytest.raises(ValueError, match="unknown segment"):
        Dataset("d", (EVENTS,), (Metric("m", "events", "count(1)", ("ghost",)),))
    with pytest.raises(UnknownName):
        DEMO.metric("ghost")


def test_one_cost_anchor_only():
    with pytest.raises(ValueError, match="not both"):
        Table("t", "row", partition_column="d", shard_suffix="s")


def test_segment_hygiene_window_order_and_limit(events):
    df = metric_query(events, DEMO, "avg_score", ["term"], ["top_10"],
                      TimeWindow(last_n_days=7), limit=2, as_of=dt.date(2024, 1, 10))
    assert [tuple(r) for r in df.collect()] == [("a", 80.0), ("b", 80.0)]


def test_ascending_puts_missing_values_first(events):
    df = metric_query(events, DEMO, "avg_score", ["term"], window=TimeWindow(start="2024-01-01",
                      end="2024-01-31"), descending=False)
    assert [r.term for r in df.collect()] == ["d", "b", "a"]


def test_or_in_a_segment_stays_inside_it(events):
    window = TimeWindow(start="2024-01-10", end="2024-01-10")
    df = metric_query(events, DEMO, "avg_score", ["term"], ["either"], window)
    assert [tuple(r) for r in df.collect()] == [("b", 10.0)]


def test_guard_needs_a_window_on_the_anchor(events):
    with pytest.raises(UnboundedScan, match="window"):
        metric_query(events, DEMO, "avg_score")
    with pytest.raises(UnboundedScan):
        metric_query(events, DEMO, "avg_score",
                     window=TimeWindow(start="2024-01-01", column="other"))


def test_no_dimensions_gives_one_row(events):
    df = metric_query(events, DEMO, "avg_score", window=TimeWindow(start="2024-01-01",
                      end="2024-01-31"))
    assert df.count() == 1 and df.columns == ["avg_score"]


def test_window_modes():
    for bad in ({}, {"last_n_days": 7, "start": "2024-01-01"}, {"last_n_days": 0},
                {"last_n_days": 7, "end": "2024-01-01"}, {"start": "01.02.2024"},
                {"start": "2024-01-01'; --"}):
        with pytest.raises(ValueError):
            TimeWindow(**bad)


def test_the_last_day_is_inside_to_its_end(spark):
    hires = Dataset("h", (Table("hires", "one", time_column="ts"),),
                    (Metric("hires", "hires", "count(1)"),))
    rows = spark.sql("SELECT explode(array(TIMESTAMP_NTZ '2024-01-02 23:59:59',"
                     " TIMESTAMP_NTZ '2024-01-03 00:00:00')) AS ts")
    df = metric_query({"hires": rows}, hires, "hires", window=TimeWindow(start="2024-01-01",
                      end="2024-01-02"))
    assert df.first().hires == 1


def test_window_without_any_time_column():
    with pytest.raises(ValueError, match="no column"):
        TimeWindow(last_n_days=1).predicate(Table("t", "row"))


def test_daily_and_yearly_suffixes(spark):
    daily = Table("t", "row", shard_suffix="suffix")
    yearly = Table("t", "row", shard_suffix="suffix", shard_pattern="yyyy")
    window = TimeWindow(start="2015-06-01", end="2016-08-31")
    days = spark.createDataFrame([("20150531",), ("20150601",), ("20160831",), ("20160901",)],
                                 "suffix string")
    years = spark.createDataFrame([("2014",), ("2015",), ("2016",), ("2017",)], "suffix string")
    assert [r.suffix for r in days.where(window.predicate(daily)).collect()] == [
        "20150601", "20160831"]
    assert [r.suffix for r in years.where(window.predicate(yearly)).collect()] == ["2015", "2016"]


def test_empty_arrays_vanish_and_hit_segments_need_hits(spark, sf):
    sessions = spark.sql(
        "SELECT * FROM VALUES ('20240101', array(named_struct('type', 'PAGE'))),"
        " ('20240101', array()), ('20240101', NULL) AS t(suffix, hits)"
    )
    day = TimeWindow(start="2024-01-01", end="2024-01-01")
    df = metric_query({"sessions": sessions}, WEB, "hit_pageviews", window=day)
    assert df.first().hit_pageviews == 1
    with pytest.raises(AnalysisException):
        metric_query({"sessions": sessions}, WEB, "sessions", [], ["page_hits"], day).collect()


def test_library_is_complete_and_resolves(spark, sf):
    assert sum(len(d.metrics) for d in REGISTRY.datasets) == 37
    assert sum(len(d.segments) for d in REGISTRY.datasets) == 24
    for dataset in REGISTRY.datasets:
        tables = metric_queries._VIEWS[dataset.name](spark, sf)
        check_against(dataset, tables)
        for table in dataset.tables:
            assert set(table.columns) <= set(tables[table.name].columns)


def test_a_wrong_expression_is_found_before_it_runs(spark, events):
    broken = Dataset("b", (EVENTS,), (Metric("m", "events", "avg(nothing)"),))
    with pytest.raises(AnalysisException):
        check_against(broken, events)


def test_metric_reads_only_its_columns(spark, sf, plan):
    tables = metric_queries._VIEWS[TAXI.name](spark, sf)
    text = plan(metric_query(tables, TAXI, "avg_fare", ["payment_type"],
                             window=metric_queries.WINDOW))
    schema = text[text.index("ReadSchema"):]
    assert "l_extendedprice" in schema and "l_partkey" not in schema and "l_tax" not in schema


def test_topk_does_not_sort_everything(spark, sf, plan):
    tables = metric_queries._VIEWS[TAXI.name](spark, sf)
    df = metric_query(tables, TAXI, "trips", ["rate_code"], window=metric_queries.WINDOW, limit=3)
    assert "TakeOrderedAndProject" in plan(df)


def test_search_is_case_blind_and_skips_empty_fields(spark):
    rows = spark.createDataFrame([("1", "Blue RING"), ("2", ""), ("3", None), ("4", "cup")],
                                 "id string, text string")
    source = [TextSource("thing", rows, "id", ("text",))]
    assert [r.name for r in text_search(source, " ring").collect()] == ["1"]
    assert sorted(r.name for r in text_search(source, "").collect()) == ["1", "4"]
    assert text_search(source, "RING").select(F.first("kind")).first()[0] == "thing"


def test_partitions_of_a_store_are_pruned(spark, sf, plan):
    queries = contract.queries()
    for name in ("filter_eq_literal_date", "filter_latest_snapshot"):
        assert "PartitionFilters: [isnotnull(refresh_date" in plan(queries[name](spark, sf)), name
    stored = {"top_terms": relational.stored_trends(spark, sf)}
    window = TimeWindow(start="1997-01-01", end="1997-06-30")
    for metric in ("term_appearances", "distinct_terms"):
        text = plan(metric_query(stored, TRENDS, metric, ["term"], window=window))
        assert "PartitionFilters: [isnotnull(refresh_date" in text and ">= 1997-01-01" in text, metric


def test_a_segment_that_fits_no_metric_is_found(spark):
    bad = Dataset("d", (Table("t", "one row"),), (Metric("n", "t", "count(1)"),), (Segment("s", "nothing > 1"),))
    with pytest.raises(Exception, match="nothing"):
        check_against(bad, {"t": spark.range(1)})
