"""Scan estimates before a query runs, and the caps they are held to."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import bytes_to_gib, estimated_usd, human_bytes
from plumbline.functions.scalars import GIB
from plumbline.sources.catalog import column_share, files

SOFT_GIB = float(os.environ.get("PLUMBLINE_SOFT_GIB", "1.0"))
HARD_GIB = float(os.environ.get("PLUMBLINE_HARD_GIB", "5.0"))


class ScanTooLarge(RuntimeError):
    """A query that would read more than the hard cap and was not run, or that did and was cancelled."""


def scan_estimate(
    spark: SparkSession,
    root: str,
    where: Column | None = None,
    columns: Sequence[str] | None = None,
    partitions: str = "",
    soft_gib: float = SOFT_GIB,
    hard_gib: float = HARD_GIB,
) -> DataFrame:
    """One row: bytes a scan of ``root`` would read, GiB, price, and whether that is over a cap.

    ``where`` is the filter on the partition columns, applied to the listing, so
    the estimate prunes as the scan will. With ``columns`` a file counts by the
    share of a row that they make up, by the widths of their types: an estimate,
    as compression differs by column. A scan exactly at a cap is not over it.
    """
    listing = files(spark, root, where, partitions)
    share = 1.0
    if columns is not None:
        share = column_share(spark.read.parquet(root).schema, columns)
    counted = listing.select(F.col("length"))
    if share < 1:
        counted = listing.select(F.ceil(F.col("length") * F.lit(share)).alias("length"))
    return estimate_of(counted, (), soft_gib, hard_gib)


def estimate_of(
    inventory: DataFrame, keys: Sequence[str] = (), soft_gib: float = SOFT_GIB, hard_gib: float = HARD_GIB
) -> DataFrame:
    """The estimate over an inventory of files (``length``), one row for each of ``keys``."""
    size = inventory.groupBy(*keys).agg(F.sum("length").cast("long").alias("bytes"))
    return size.select(*keys, F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes")).select(
        *keys,
        "bytes",
        bytes_to_gib("bytes").alias("gib"),
        estimated_usd("bytes").alias("est_usd"),
        (F.col("bytes") > F.lit(int(soft_gib * GIB))).alias("over_soft"),
        (F.col("bytes") > F.lit(int(hard_gib * GIB))).alias("over_hard"),
    )


def capped_run(
    estimate: DataFrame, build: Callable[[], DataFrame], warn: Callable[[str], None] | None = None
) -> DataFrame:
    """The query, unless its estimate is over the hard cap.

    The estimate is the one row that comes to the driver. This is a check before the query;
    ``metering.metered_run`` also holds a cap while it runs.
    """
    row = estimate.withColumn("size", human_bytes("bytes")).first()
    text = f"the scan reads {row['size']} (~${row.est_usd:.4f})"
    if row.over_hard:
        raise ScanTooLarge(f"{text}, over the hard cap: narrow the window or the columns")
    if row.over_soft and warn is not None:
        warn(f"{text}, over the soft threshold")
    return build()


def provenance(
    source: str,
    confidence: str,
    estimate: DataFrame,
    freshness: DataFrame | None = None,
    owner: str | None = None,
    reviewed: str = "no",
) -> DataFrame:
    """One row that says where a result came from, to be stored next to it.

    ``freshness`` is a one-row frame whose only column is the newest time seen.
    """
    newest = F.lit(None).cast("string")
    if freshness is not None:
        column = freshness.columns[0]
        newest = F.concat(
            F.lit(f"{column} = "), freshness.select(F.col(column).cast("string")).scalar()
        )
    row = estimate.select(
        F.lit(source).alias("source"),
        F.lit(confidence).alias("confidence"),
        F.col("bytes").alias("bytes_scanned"),
        newest.alias("freshness"),
        F.lit(owner).cast("string").alias("owner"),
        F.lit(reviewed).alias("reviewed"),
    )
    cost = F.format_string(" (~$%.4f)", estimated_usd("bytes_scanned"))
    size = F.concat(human_bytes("bytes_scanned"), cost)

    def part(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"**{label}:** "), value)

    footer = F.concat_ws(
        " · ",
        part("Source", F.col("source")),
        part("Confidence", F.col("confidence")),
        part("Bytes scanned", F.when(F.col("bytes_scanned").isNotNull(), size)),
        part("Freshness", F.col("freshness")),
        part("Owner", F.col("owner")),
        part("Reviewed", F.col("reviewed")),
    )
    return row.withColumn("footer", F.concat(F.lit("> "), footer))
