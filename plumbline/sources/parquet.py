"""Reading columnar data with explicit columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.governance import Table
from plumbline.operators.window import TimeWindow

Scalar = bool | int | float | str


def scan(spark: SparkSession, path: str, columns: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """The named columns of a parquet location, renamed if a mapping says so. Never all of them."""
    if not isinstance(columns, Mapping):
        columns = {c: c for c in columns}
    return spark.read.parquet(path).select(*(F.col(a).alias(b) for a, b in columns.items()))


def parameterized(
    spark: SparkSession, sql: str, params: Mapping[str, Scalar], **tables: DataFrame
) -> DataFrame:
    """SQL with named scalars (``:name``) and DataFrames (``{name}``).

    A bool stays a bool, a whole number becomes a bigint, a fraction a double
    and anything else a string: parameters are values, never pasted text.
    """

    def literal(value: Scalar) -> Column:
        if isinstance(value, int) and not isinstance(value, bool):
            return F.expr(f"{value}L")
        return F.lit(value if isinstance(value, bool | float) else str(value))

    return spark.sql(sql, args={k: literal(v) for k, v in params.items()}, **tables)


def write_shards(rows: DataFrame, path: str, suffix: str) -> None:
    """One directory per shard.

    ``rebalance`` lets the engine size the files: it merges small shards into few
    tasks and splits a shard that holds much of the table over several.
    """
    rows.hint("rebalance", suffix).write.mode("overwrite").partitionBy(suffix).option(
        "compression", "zstd"
    ).parquet(path)


def read_shards(
    spark: SparkSession,
    path: str,
    table: Table,
    window: TimeWindow,
    as_of: dt.date | None = None,
    merge_schema: bool = False,
) -> DataFrame:
    """The shards a window touches.

    The suffix stays text (its declared type wins over inference) and the filter
    is on the bare column, so it becomes a partition filter: only the shards inside are read.
    The shard directories are all listed. ``merge_schema`` reconciles shards whose columns differ,
    and opens footers of shards outside the window too; name shards with ``read_shard`` to avoid that.
    """
    reader = spark.read.option("mergeSchema", str(merge_schema).lower())
    rows = reader.parquet(path)
    if rows.schema[table.shard_suffix].dataType.typeName() != "string":
        stored = rows.drop(table.shard_suffix).schema.add(table.shard_suffix, "string")
        rows = spark.read.schema(stored).parquet(path)
    return rows.where(window.predicate(table, as_of))


def read_shard(
    spark: SparkSession, path: str, suffix_column: str, suffix: str, columns: Sequence[str]
) -> DataFrame:
    """One named shard with its own schema; the suffix is added as a column."""
    rows = scan(spark, f"{path}/{suffix_column}={suffix}", columns)
    return rows.withColumn(suffix_column, F.lit(suffix))


def union_shards(shards: Sequence[DataFrame]) -> DataFrame:
    """Shards with different columns as one table; a column a shard lacks is NULL there."""
    result = shards[0]
    for shard in shards[1:]:
        result = result.unionByName(shard, allowMissingColumns=True)
    return result
