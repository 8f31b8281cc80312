"""Time the headline queries. Prints one JSON line.

    BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)

Each query is planned and run to the end without bringing rows to the driver.
The first run of each warms the JVM and is reported apart; the value is the
best of the following two.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from plumbline.plans import active_users, lifecycle  # noqa: E402
from plumbline.testbed import QUERIES, views  # noqa: E402

HEADLINE = (
    "active_user_cube",
    "account_datelist",
    "cohort_retention",
    "metric_trips",
    "metric_tip_pct",
    "metric_distinct_terms",
    "metric_product_revenue",
    "metric_users",
    "metric_query",
    "agg_null_profile",
    "agg_candidate_key",
    "agg_grouping_sets",
    "dq_report",
    "daily_trips_smoothed",
    "filter_latest_snapshot",
    "text_search",
    "grade_texts",
    "dq_staleness",
)


def long_datelist(spark, sf):
    """6.5 years of daily history: 32 million rows at sf0.1."""
    return lifecycle.account_datelist(views.accounts_long(spark, sf))


def long_cube(spark, sf):
    src = views.accounts_long(spark, sf)
    segments = lifecycle.account_segments(src)
    stretches = active_users.user_stretches(segments, lifecycle.latest_day(src).scalar())
    return active_users.active_user_cube(stretches, views.ACCOUNT_TYPES)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = {name: QUERIES[name] for name in HEADLINE}
    chosen["account_datelist_6y"] = long_datelist
    chosen["active_user_cube_6y"] = long_cube

    def once(build) -> float:
        start = time.perf_counter()
        build(spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    cold, warm = {}, {}
    for name, build in chosen.items():
        cold[name] = round(once(build), 3)
        warm[name] = round(min(once(build), once(build)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": sf,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
