"""Trigrams by file, so that a substring search reads only the files that can hold the needle.

A posting says that some lower-cased text of a file holds three letters in a row. The files that have all
trigrams of a needle are candidates; :func:`narrowed` reads these, and ``text_search`` decides on the rows.
Files that were never entered, or were replaced since, are candidates too, so an index that lags behind
costs time but loses nothing. A needle of fewer than three letters has no trigram and reads everything.

Postings are placed by a hash of the trigram and sorted, so a search opens one folder for each trigram of
the needle and, within it, the row groups that may hold it. There is at most one posting for a file and
trigram: a trigram of all texts has as many as the table has files. A run enters the files that are new
in folders of its own, so runs may go on at the same time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.catalog import files
from plumbline.sources.storage import committed

#: Folders that postings are placed in.
BUCKETS = 64
#: Letters of a long text that are taken apart at once.
PIECE = 1 << 16
_FILES = "path string, length long, fields array<string>, file long"
_POSTINGS = "gram string, file long, bucket int"


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _pieces(text: Column) -> Column:
    """A text as pieces that overlap by two letters, so that no trigram is cut."""
    starts = F.sequence(F.lit(0), F.floor(F.length(text) / PIECE).cast("int"))
    return F.transform(starts, lambda n: F.substring(text, n * PIECE + 1, F.lit(PIECE + 2)))


def _runs(spark: SparkSession, index: str, part: str, schema: str) -> DataFrame | None:
    runs = committed(spark, f"{index}/{part}")
    if not runs:
        return None
    return reduce(DataFrame.unionByName, (spark.read.schema(schema).parquet(run) for run in runs))


def _known(spark: SparkSession, index: str, fields: Sequence[str]) -> DataFrame | None:
    """``path, length, file`` of the files of which all ``fields`` were entered."""
    found = _runs(spark, index, "files", _FILES)
    if found is None:
        return None
    has = reduce(Column.__and__, (F.array_contains("fields", f) for f in fields))
    return found.where(has).select("path", "length", "file").distinct()


def index_text(spark: SparkSession, root: str, fields: Sequence[str], index: str) -> int:
    """Enter the files under ``root`` that ``index`` does not know yet. Returns how many.

    Only names of new files come to the driver, as they do whenever Spark lists a table.
    """
    new = files(spark, root).select("path", "length")
    known = _known(spark, index, fields)
    if known is not None:
        new = new.join(known, ["path", "length"], "left_anti")
    new = new.withColumn("file", F.xxhash64("path", "length"))
    paths = [r.path for r in new.select("path").collect()]
    if not paths:
        return 0
    # File names come URL-encoded from a scan, and plain from a listing.
    rows = spark.read.option("basePath", root).parquet(*paths).select(
        F.xxhash64(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "_metadata.file_size").alias("file"),
        *(F.lower(F.col(f).cast("string")).alias(f"_{n}") for n, f in enumerate(fields)),
    )
    pieces = F.flatten(F.array_compact(F.array(*(_pieces(F.col(f"_{n}")) for n in range(len(fields))))))
    grams = F.array_distinct(F.regexp_extract_all("piece", F.lit("(?s)(?=(...))"), F.lit(1)))
    postings = (
        rows.select("file", F.explode(pieces).alias("piece"))
        .select("file", F.explode(grams).alias("gram"))
        .distinct()
        .withColumn("bucket", _bucket(F.col("gram")))
    )
    run = f"run-{uuid.uuid4().hex}"
    (
        postings.hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "gram")
        .write.option("compression", "zstd")
        .partitionBy("bucket")
        .parquet(f"{index}/postings/{run}")
    )
    # A file counts as known only from here on, when its postings are in place.
    entered = spark.createDataFrame([(p,) for p in paths], "path string").join(new, "path")
    entered.withColumn("fields", F.array(*(F.lit(f) for f in fields))).select("path", "length", "fields", "file").coalesce(
        1
    ).write.parquet(f"{index}/files/{run}")
    return len(paths)


def candidate_files(
    spark: SparkSession, root: str, fields: Sequence[str], index: str, query: str
) -> DataFrame:
    """``path, candidate`` of each file under ``root``: false where no text of ``fields`` can hold ``query``."""
    needle = query.lower().strip()
    grams = sorted({needle[n : n + 3] for n in range(len(needle) - 2)})
    listing = files(spark, root).select("path", "length")
    known = _known(spark, index, fields)
    postings = _runs(spark, index, "postings", _POSTINGS)
    if not grams or known is None or postings is None:
        return listing.select("path", F.lit(True).alias("candidate"))
    buckets = spark.range(1).select(F.array_distinct(F.array(*(_bucket(F.lit(g)) for g in grams)))).first()[0]
    holding = (
        postings.where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
        .groupBy("file")
        .agg(F.count_distinct("gram").alias("found"))
        .where(F.col("found") == len(grams))
    )
    return listing.join(known, ["path", "length"], "left").join(holding, "file", "left").select(
        "path", (F.col("file").isNull() | F.col("found").isNotNull()).alias("candidate")
    )


def narrowed(spark: SparkSession, root: str, fields: Sequence[str], index: str, query: str) -> DataFrame:
    """The table at ``root`` without files that cannot hold ``query``; search it with ``text_search``."""
    whole = spark.read.parquet(root)
    if len(query.strip()) < 3:
        return whole
    found = candidate_files(spark, root, fields, index, query).where("candidate").select("path")
    paths = [r.path for r in found.collect()]
    if not paths:
        return whole.where(F.lit(False))
    return spark.read.schema(whole.schema).option("basePath", root).parquet(*paths)
