"""Helpers that the operators share: checkpoints, Arrow batches of bounded size, hashing in numpy."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that are handled at once in a task.
BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session may have none set; it gets one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def join_counts(rows: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """``rows`` inner join ``counts``, which were aggregated by ``key`` (a long).

    An aggregate is already dealt by its key, and a join on that alone would read it in place, where
    adaptive execution cannot split a key that holds much of ``rows``. A second key column, which says
    the same, has both sides shuffled for the join, and then it can.
    """
    def again(df: DataFrame) -> DataFrame:
        return df.withColumn("_again", F.col(key).bitwiseXOR(F.lit(0x5BD1E995)))

    return again(rows).join(again(counts), [key, "_again"]).drop("_again")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``; one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, nulls as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def flat_bytes(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a text column, and where each text begins (one entry more than rows)."""
    whole = pc.fill_null(batch.column(column).cast(pa.large_binary()), b"")
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit values one to one."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ..`` of each length, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    lengths = lengths.astype(np.int64)
    first = np.repeat(starts.astype(np.int64) - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return first + np.arange(total)
