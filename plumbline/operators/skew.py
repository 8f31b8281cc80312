"""Joins in which one key may hold much of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_CHUNK = 100_000


def left_join_hot_keys(
    many: DataFrame, one: DataFrame, key: str, spread: str, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """``many`` left join ``one`` (unique on ``key``), with every key split into chunks.

    A key with n rows is divided into ``ceil(n / rows_per_chunk)`` chunks by the hash of
    ``spread``, which should be distinct within a key, and its row on the other side is
    repeated once per chunk. A chunk has about ``rows_per_chunk`` rows whatever the size of
    the data; the result is the plain join, whole.
    """
    chunks = many.groupBy(key).agg(
        F.ceil(F.count(F.lit(1)) / rows_per_chunk).cast("int").alias("_chunks")
    )
    chunk = F.pmod(F.xxhash64(spread), F.coalesce("_chunks", F.lit(1))).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_chunks", F.lit(1)) - 1))
    left = many.join(chunks, key, "left").withColumn("_chunk", chunk).drop("_chunks")
    right = one.join(chunks, key, "left").withColumn("_chunk", copies).drop("_chunks")
    return left.join(right, [key, "_chunk"], "left").drop("_chunk")
