"""What a written table holds, by file and column, for exact scan sizes and file skipping.

``_manifest`` beside the data has a row for each file and column: compressed bytes of the column's
chunks, nulls, least and greatest value. It is filled from the footers of new files after each
publish or freeze; footers are read in tasks, a few KB a file, and rows never come to the driver.
Rows of files that were replaced stay and meet no file: a file is known by its path and length.

Where a footer cannot be opened from a task (a store that only Spark's readers reach), the file has
no row, and an estimate over it is called one.
"""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import uuid
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.catalog import column_share, files
from plumbline.sources.cost import HARD_GIB, SOFT_GIB, estimate_of
from plumbline.sources.storage import committed

# Executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FOLDER = "_manifest"
SCHEMA = (
    "path string, length long, rows long, column string, bytes long, nulls long, "
    "min_long long, max_long long, min_double double, max_double double, min_text string, max_text string"
)
_EPOCH = dt.datetime(1970, 1, 1)


def slot(value: Any) -> tuple[str, Any]:
    """The manifest's kind of a value, and the value as that: whole numbers, days and microseconds are
    ``long``, fractions ``double``, text ``text``."""
    if isinstance(value, bool | int):
        return "long", int(value)
    if isinstance(value, dt.datetime):
        naive = value.astimezone(dt.UTC).replace(tzinfo=None) if value.tzinfo else value
        return "long", (naive - _EPOCH) // dt.timedelta(microseconds=1)
    if isinstance(value, dt.date):
        return "long", value.toordinal() - _EPOCH.toordinal()
    if isinstance(value, float | decimal.Decimal):
        return "double", float(value)  # rounding keeps the order, so no file is left out by it
    if isinstance(value, str):
        return "text", value
    raise TypeError(f"no statistics are kept for {type(value).__name__}")


def footer_rows(path: str, length: int, source) -> list[tuple]:
    """Manifest rows of one parquet file. A nested column counts as its outermost one."""
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(source).metadata
    sums: dict[str, list] = {}
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            chunk = group.column(c)
            name, _, inner = chunk.path_in_schema.partition(".")
            own = sums.setdefault(name, [0, 0, None, None, True])
            own[0] += chunk.total_compressed_size
            stats = chunk.statistics
            if inner or stats is None or not stats.has_null_count:
                own[1], own[4] = None, False
                continue
            own[1] = own[1] + stats.null_count if own[1] is not None else None
            if not stats.has_min_max:
                own[4] &= stats.null_count == chunk.num_values  # only nulls: there is no value
            elif own[4]:
                own[2] = stats.min if own[2] is None else min(own[2], stats.min)
                own[3] = stats.max if own[3] is None else max(own[3], stats.max)
    out = []
    for name, (size, nulls, least, most, known) in sums.items():
        values: dict[str, tuple] = {}
        if known and least is not None:
            try:
                values[slot(least)[0]] = slot(least)[1], slot(most)[1]
            except TypeError:
                pass
        slots = [v for kind in ("long", "double", "text") for v in values.get(kind, (None, None))]
        out.append((path, length, meta.num_rows, name, size, nulls, *slots))
    return out or [(path, length, meta.num_rows, None, 0, 0, *[None] * 6)]


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    names = [f.split()[0] for f in SCHEMA.split(", ")]
    long, text, double = pa.int64(), pa.string(), pa.float64()
    kinds = [text, long, long, text, long, long, long, long, double, double, text, text]
    for batch in batches:
        for path, length in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                if path.startswith("file:"):
                    system, inner = fs.LocalFileSystem(), path.removeprefix("file:").replace("//", "/")
                else:
                    system, inner = fs.FileSystem.from_uri(path)
                with system.open_input_file(inner) as source:
                    rows = footer_rows(path, length, source)
            except (OSError, ValueError, NotImplementedError, ImportError):
                continue
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """The manifest of a table; none if it has none."""
    runs = committed(spark, f"{root}/{FOLDER}")
    return spark.read.schema(SCHEMA).parquet(*runs) if runs else None


def write_manifest(spark: SparkSession, root: str) -> None:
    """Enter the files that are not in the manifest yet, in a folder of this run's own."""
    new = files(spark, root).select("path", "length")
    known = read_manifest(spark, root)
    if known is not None:
        new = new.join(known.select("path", "length").distinct(), ["path", "length"], "left_anti")
    rows = new.mapInArrow(_footers, SCHEMA)
    rows.write.option("compression", "zstd").parquet(f"{root}/{FOLDER}/run-{uuid.uuid4().hex}")


def manifest_estimate(
    spark: SparkSession,
    root: str,
    columns: Sequence[str] | None = None,
    where: Column | None = None,
    ranges: Mapping[str, tuple[Any, Any]] | None = None,
    partitions: str = "",
    soft_gib: float = SOFT_GIB,
    hard_gib: float = HARD_GIB,
) -> DataFrame:
    """One row: what a scan of ``columns`` reads, with ``files``, ``files_left_out`` and ``method``.

    ``where`` prunes partitions, as in ``scan_estimate``. ``ranges`` are inclusive bounds of a column,
    either of them None; a file whose values all lie outside one is left out. ``method`` is ``exact``
    if the manifest knows every file that counts, else ``estimate``: unknown files count by the share
    of a row that the columns make up.
    """
    listing = files(spark, root, where, partitions).select("path", "length")
    schema = spark.read.parquet(root).schema
    share = 1.0 if columns is None else column_share(schema, columns)
    entries = read_manifest(spark, root)
    if entries is None:
        entries = spark.createDataFrame([], SCHEMA)
    outside = F.lit(False)
    for name, bounds in (ranges or {}).items():
        if name not in schema.names:
            raise KeyError(f"no column {name}")
        beyond = F.col("nulls") == F.col("rows")  # no value compares with a bound
        for bound, side in zip(bounds, ("max", "min")):
            if bound is not None:
                kind, value = slot(bound)
                stored = F.col(f"{side}_{kind}")
                beyond = beyond | F.coalesce(stored < value if side == "max" else stored > value, F.lit(False))
        outside = outside | ((F.col("column") == name) & beyond)
    counted = F.lit(True) if columns is None else F.col("column").isin(*columns)
    by_file = entries.groupBy("path", "length").agg(
        F.coalesce(F.sum(F.when(counted, F.col("bytes"))), F.lit(0)).alias("chunk_bytes"), F.max(outside).alias("outside")
    )
    sized = listing.join(by_file, ["path", "length"], "left").select(
        F.coalesce("outside", F.lit(False)).alias("outside"),
        F.col("chunk_bytes").isNotNull().alias("known"),
        F.when(F.coalesce("outside", F.lit(False)), 0)
        .otherwise(F.coalesce("chunk_bytes", F.ceil(F.col("length") * F.lit(share)))).alias("length"),
    )
    counts = sized.agg(
        F.count_if(~F.col("outside")).alias("files"), F.count_if("outside").alias("files_left_out"),
        F.when(F.coalesce(F.bool_and("known"), F.lit(False)), "exact").otherwise("estimate").alias("method"),
        F.sum("length").alias("length"),
    )
    return estimate_of(counts, ("files", "files_left_out", "method"), soft_gib, hard_gib)
