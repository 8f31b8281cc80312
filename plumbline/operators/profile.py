"""Profiles: how complete and how unique a table is. Each is one pass over it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import safe_divide


def null_counts(columns: Sequence[str]) -> list[Column]:
    return [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns]


def null_profile(
    rows: DataFrame, columns: Sequence[str] | None = None, grain: Sequence[str] = ()
) -> DataFrame:
    """Row count, NULLs per column and, with ``grain``, the number of distinct keys.

    A key that holds NULLs is a key: ``count(DISTINCT a, b)`` would skip it, a
    struct does not.
    """
    measures = [F.count(F.lit(1)).alias("total_rows")]
    if grain:
        measures.append(F.count_distinct(F.struct(*grain)).alias("distinct_grain"))
    return rows.agg(*measures, *null_counts(columns or rows.columns))


def candidate_keys(rows: DataFrame, keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """``total_rows`` and ``distinct_<name>`` for each key. Equal numbers: the key is unique.

    Keys that widen one another are counted as a chain, the widest first and each
    narrower one on what is left of it. That is one partial aggregate per key
    instead of one copy of every row per key. Keys that do not nest are counted
    by Spark's own distinct aggregation.
    """
    chain = sorted(keys.items(), key=lambda item: len(item[1]), reverse=True)
    nested = all(set(a[1]) >= set(b[1]) for a, b in zip(chain, chain[1:]))
    if not nested:
        return rows.agg(
            F.count(F.lit(1)).alias("total_rows"),
            *(F.count_distinct(F.struct(*k)).alias(f"distinct_{n}") for n, k in keys.items()),
        )
    measures: list[Column] = [F.count(F.lit(1)).alias("total_rows")]
    names = ["total_rows"]
    for name, key in chain:
        rows = rows.groupBy(*key).agg(*measures)
        names.append(f"distinct_{name}")
        measures = [F.sum(n).alias(n) for n in names[:-1]]
        measures.append(F.count(F.lit(1)).alias(names[-1]))
    return rows.agg(*measures).select(
        *(F.coalesce(n, F.lit(0)).alias(n) for n in ["total_rows", *(f"distinct_{k}" for k in keys)])
    )


def null_rate_by_group(
    rows: DataFrame, keys: Sequence[str], column: str, bounds: bool = True
) -> DataFrame:
    """Rows, NULLs and NULL rate of ``column`` per group, with its range if ``bounds``."""
    measures = [
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col(column).isNull()).alias(f"null_{column}"),
    ]
    if bounds:
        measures += [F.min(column).alias(f"min_{column}"), F.max(column).alias(f"max_{column}")]
    result = rows.groupBy(*keys).agg(*measures)
    return result.withColumn("null_rate", safe_divide(f"null_{column}", "row_count")).orderBy(*keys)


def conditional_null_rate(
    rows: DataFrame, keys: Sequence[str], column: str, split: Column, names: tuple[str, str]
) -> DataFrame:
    """NULL rate per group, apart for rows where ``split`` holds and where it does not."""
    yes, no = names
    missing = F.col(column).isNull()
    return (
        rows.groupBy(*keys)
        .agg(
            F.count_if(split).alias(f"{yes}_rows"),
            F.count_if(split & missing).alias("_yes"),
            F.count_if(~split).alias(f"{no}_rows"),
            F.count_if(~split & missing).alias("_no"),
        )
        .select(
            *keys,
            f"{yes}_rows",
            safe_divide("_yes", f"{yes}_rows").alias(f"{yes}_null_rate"),
            f"{no}_rows",
            safe_divide("_no", f"{no}_rows").alias(f"{no}_null_rate"),
        )
        .orderBy(*keys)
    )


def null_cooccurrence(
    rows: DataFrame,
    column: str,
    keys: Sequence[str],
    others: Sequence[str],
    averages: Mapping[str, str],
) -> DataFrame:
    """Whether ``others`` go missing together with ``column``, and what those rows look like."""
    result = rows.groupBy(*keys, F.col(column).isNull().alias(f"{column}_is_null")).agg(
        F.count(F.lit(1)).alias("row_count"),
        *null_counts(others),
        *(F.round(F.avg(c), 2).alias(name) for name, c in averages.items()),
    )
    return result.orderBy(F.desc("row_count"), *keys, f"{column}_is_null")


def partition_inventory(tables: Mapping[str, DataFrame], partition: str) -> DataFrame:
    """Latest partition and rows over all partitions, one row per table.

    Counted per partition first: on a partitioned store this reads no data column.
    """
    parts = [
        rows.groupBy(F.col(partition).alias("partition_id"))
        .count()
        .agg(
            F.max("partition_id").alias("latest_partition"),
            F.sum("count").alias("rows_all_partitions"),
        )
        .select(F.lit(name).alias("table_name"), "latest_partition", "rows_all_partitions")
        for name, rows in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("table_name")


def latest_snapshot(rows: DataFrame, column: str, bound: Column | None = None) -> DataFrame:
    """Rows of the newest snapshot, at or before ``bound`` if given.

    The newest value is a scalar subquery, so the outer scan is still filtered
    on a single value and prunes partitions at run time.
    """
    eligible = rows if bound is None else rows.where(F.col(column) <= bound)
    newest = eligible.agg(F.max(column).alias("newest")).scalar()
    return rows.where(F.col(column) == newest)


def clip_report(rows: DataFrame, column: str, first: Column, last: Column) -> DataFrame:
    """How many rows a clip to ``[first, last]`` keeps and drops. A NULL is dropped."""
    inside = F.col(column).between(first, last)
    return rows.agg(
        F.count_if(inside).alias("kept"),
        F.count_if(~F.coalesce(inside, F.lit(False))).alias("dropped"),
    )
