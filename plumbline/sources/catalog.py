"""What data there is, from file listings and row counts: no data column is read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import DataType, StructType

from plumbline.functions import bytes_to_gib


# Bytes of a value by type; anything else counts as a short text.
WIDTHS = {
    "boolean": 1, "byte": 1, "short": 2, "integer": 4, "date": 4, "float": 4,
    "long": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8, "decimal": 16,
}


def files(
    spark: SparkSession, root: str, where: Column | None = None, partitions: str = ""
) -> DataFrame:
    """Parquet files under ``root``: path, length, modificationTime and partition columns.

    ``where`` on the partition columns prunes directories. ``partitions`` declares
    their types (``"suffix string"``); without it they are inferred. The content
    column of the listing is not requested, so no file is opened.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
    if partitions:
        listing = "path string, modificationTime timestamp, length bigint, content binary"
        reader = reader.schema(f"{listing}, {partitions}")
    found = reader.load(root)
    if where is not None:
        found = found.where(where)
    return found.drop("content")


def row_counts(spark: SparkSession, root: str) -> DataFrame:
    """``(path, num_rows)`` of each file under ``root`` that has rows.

    The files are scanned with an empty schema, so a reader only counts, by its footers. Paths come
    URL-encoded there, and are decoded to those of the listing.
    """
    rows = (
        spark.read.schema(StructType([]))
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .parquet(root)
    )
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return rows.groupBy(F.url_decode(encoded).alias("path")).agg(F.count(F.lit(1)).alias("num_rows"))


def column_share(schema: StructType, columns: Sequence[str]) -> float:
    """The share of a row that ``columns`` make up, by the default widths of their types."""

    def width(kind: DataType) -> int:
        if isinstance(kind, StructType):
            return sum(width(f.dataType) for f in kind)
        return WIDTHS.get(kind.typeName().split("(")[0], 20)

    named = {f.name: width(f.dataType) for f in schema}
    unknown = sorted(set(columns) - set(named))
    if unknown:
        raise KeyError(f"no column {', '.join(unknown)}")
    return sum(named[c] for c in set(columns)) / max(1, sum(named.values()))


def catalog_tables(
    spark: SparkSession, root: str, allowlist: Sequence[str] | None = None
) -> DataFrame:
    """Tables under ``root`` with files, rows, bytes, GiB (3 decimals) and last modification.

    A table is a directory or a single ``<name>.parquet`` file.
    """
    base = root.rstrip("/")
    # What follows the root, whatever characters that has.
    below = F.substring_index("path", f"{base.removeprefix('file:').rstrip('/')}/", -1)
    name = F.regexp_replace(F.substring_index(below, "/", 1), r"\.parquet$", "")
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(base)
        .select("path", "length", "modificationTime", name.alias("table_name"))
    )
    if allowlist is not None:
        listing = listing.where(F.col("table_name").isin(*allowlist))
    return (
        listing.join(row_counts(spark, base), "path", "left")
        .groupBy("table_name")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.coalesce(F.sum("num_rows"), F.lit(0)).alias("rows"),
            F.sum("length").alias("bytes"),
            F.round(bytes_to_gib(F.sum("length")), 3).alias("gib"),
            F.max("modificationTime").alias("modified"),
        )
        .orderBy("table_name")
    )


def describe_table(
    spark: SparkSession,
    path: str,
    partitioned_by: str | None = None,
    comments: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per column: name, type, mode, description, next to the table's rows and size.

    A description is the governed one of ``comments``, or else the comment stored in the file.

    The schema is the driver's own; the sizes come from the listing.
    """
    schema = spark.read.parquet(path).schema
    columns = F.array(
        *(
            F.struct(
                F.lit(position).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.lit("NULLABLE" if f.nullable else "REQUIRED").alias("mode"),
                F.lit((comments or {}).get(f.name, f.metadata.get("comment"))).cast("string").alias("description"),
            )
            for position, f in enumerate(schema)
        )
    )
    listing = files(spark, path)
    counted = spark.read.schema(StructType([])).parquet(path).agg(F.count(F.lit(1)).alias("rows"))
    return listing.agg(
        F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified")
    ).select(
        F.lit(path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet")).alias("table_name"),
        counted.scalar().alias("rows"),
        "bytes",
        F.round(bytes_to_gib("bytes"), 3).alias("gib"),
        F.lit(partitioned_by).cast("string").alias("partitioned_by"),
        "modified",
        F.inline(columns),
    )
