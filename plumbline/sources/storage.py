"""Writing: extracts frozen once, published models, run telemetry."""

from __future__ import annotations

import functools
import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.quality import require_passed


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="plumbline-")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that every executor can reach, under ``spark.checkpoint.dir``.

    Only where that is unset and the session is local does a temporary folder do.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = _local_root()
    return f"{root}/plumbline/{purpose}-{uuid.uuid4().hex}"


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was committed. A job that died half-way left no marker."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of this name."""
    at, system = _file_system(spark, path)
    return system.exists(at)


def committed(spark: SparkSession, folder: str) -> list[str]:
    """Folders directly below ``folder`` whose write was committed, in the order of their names."""
    at, system = _file_system(spark, folder)
    if not system.exists(at):
        return []
    below = sorted(str(s.getPath().toString()) for s in system.listStatus(at) if s.isDirectory())
    return [path for path in below if is_complete(spark, path)]


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote."""
    at, system = _file_system(spark, path)
    system.delete(at, True)


def enter(entry: DataFrame, folder: str) -> None:
    """Add rows to a small table of entries. Each entry is a folder of its own: writers that append to
    one folder at a time would share its staging area, and the first commit would empty it."""
    entry.coalesce(1).write.option("compression", "zstd").parquet(f"{folder}/entry={uuid.uuid4().hex}")


def entries(spark: SparkSession, folder: str) -> DataFrame | None:
    """All committed entries; none if there are none."""
    paths = committed(spark, folder)
    return spark.read.parquet(*paths) if paths else None


def request_key(request: Mapping[str, Any]) -> str:
    """A name for a request that changes with any part of it."""
    text = json.dumps(request, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def freeze(
    spark: SparkSession, base: str, request: Mapping[str, Any], build: Callable[[], DataFrame]
) -> DataFrame:
    """Run a query once and keep its result; later calls read what was kept.

    ``request`` must hold all that determines the result (metric, dimensions,
    segments, window, limit, source version): it is the key. ``build`` is not
    called when the extract exists. A run writes a folder of its own and is then entered as the
    current one; of two that build at once both are kept, and the first one entered is read.
    """
    extract = f"{base}/extract-{request_key(request)}"
    if entries(spark, f"{extract}/_current") is None:
        run = f"{extract}/run-{uuid.uuid4().hex}"
        build().write.option("compression", "zstd").parquet(run)
        write_manifest(spark, run)
        pointer = spark.range(1).select(F.lit(run).alias("run"), F.current_timestamp().alias("built_at"))
        enter(pointer, f"{extract}/_current")
    first = F.min_by("run", F.struct("built_at", "run")).alias("run")
    return spark.read.parquet(entries(spark, f"{extract}/_current").agg(first).first().run)


def write_manifest(spark: SparkSession, path: str) -> None:
    from plumbline.sources import manifest

    manifest.write_manifest(spark, path)


def publish(model: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write a model and its manifest. Partitions are rebalanced so that each becomes few, evenly sized
    files."""
    rows = model if partition_by is None else model.hint("rebalance", partition_by)
    writer = rows.write.mode("overwrite").option("compression", "zstd")
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    write_manifest(model.sparkSession, path)


def publish_gated(
    spark: SparkSession,
    models: Mapping[str, tuple[DataFrame, str | None]],
    check: Callable[[Mapping[str, DataFrame]], DataFrame],
    path: str,
) -> DataFrame:
    """Write models, judge what was written, and only then let readers see it.

    Each run writes its own folder, once. ``check`` gets the models as read back
    and returns a quality report, which is kept beside them. If no blocking check
    failed, the run is entered in the small ``_published`` table that
    :func:`published` looks models up in; otherwise ``QualityGateFailed`` is
    raised and readers still find the previous run. Returns the report.
    """
    run = f"{path}/run-{uuid.uuid4().hex}"
    written = {}
    for name, (model, partition_by) in models.items():
        publish(model, f"{run}/{name}", partition_by)
        written[name] = spark.read.parquet(f"{run}/{name}")
    publish(check(written), f"{run}/quality_report")
    report = spark.read.parquet(f"{run}/quality_report")
    require_passed(report)
    pointers = spark.range(1).select(
        F.explode(F.array(*(F.lit(name) for name in models))).alias("model"),
        F.lit(run).alias("run"),
        F.current_timestamp().alias("published_at"),
    )
    enter(pointers, f"{path}/_published")
    return report


def published(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The model as of the last run that passed its checks."""
    runs = entries(spark, f"{path}/_published")
    newest = None
    if runs is not None:
        latest = F.max_by("run", F.struct("published_at", "run")).alias("run")
        newest = runs.where(F.col("model") == model).agg(latest).first()
    if newest is None or newest.run is None:
        raise FileNotFoundError(f"no run of {model!r} was published under {path}")
    return spark.read.parquet(f"{newest.run}/{model}")


def append_telemetry(results: DataFrame, path: str, **run: Any) -> None:
    """Append one row per case, tagged with what the caller knows about the run
    (``run_ts``, ``version``, ``git_sha``, ``wall_ms``). Runs may append at the same time; read them with
    :func:`entries`."""
    enter(results.withColumns({name: F.lit(value) for name, value in run.items()}), path)


def pass_rates(telemetry: DataFrame) -> DataFrame:
    """Pass rate by version."""
    return telemetry.groupBy("version").agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if("passed").alias("passed_cases"),
        (F.count_if("passed") / F.count(F.lit(1))).alias("pass_rate"),
    )
