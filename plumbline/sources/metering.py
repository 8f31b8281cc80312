"""A byte cap that holds while a query runs.

Jobs of a query carry a tag. A thread on the driver adds up what their stages have read so far, from
Spark's own status store, and cancels the tag once that is over the cap. Tasks report what they have
read when they end and with each heartbeat (``spark.executor.heartbeatInterval``), so at most the
tasks that run at that moment go beyond the cap; nothing is started after it. The total is looked
at once more when the query has ended, so whether it fails does not depend on how fast it was.

Parquet's vectored reads are not counted by the file systems' statistics, from which tasks report (of
42 MB read in a test they showed 0.6), so they are off for the session while a query is metered.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.scalars import GIB
from plumbline.sources.cost import HARD_GIB, ScanTooLarge, capped_run
from plumbline.sources.storage import delete, shared_folder


def bytes_read(spark: SparkSession, tag: str) -> int:
    """Bytes of input that the stages of all jobs with ``tag`` have read so far, retries included."""
    context = spark.sparkContext._jsc.sc()
    tracker, store = context.statusTracker(), context.statusStore()
    stages = set()
    for job in tracker.getJobIdsForTag(tag):
        info = tracker.getJobInfo(job)
        if info.isDefined():
            stages.update(info.get().stageIds())
    no_status, no_quantiles = spark._jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    total = 0
    for stage in stages:
        attempts = store.stageData(stage, False, no_status, False, no_quantiles)
        total += sum(attempts.apply(i).inputBytes() for i in range(attempts.size()))
    return total


#: Parquet's own setting, taken from the session when a scan is planned.
_VECTORED = "parquet.hadoop.vectored.io.enabled"


class Meter:
    """Counts what is read inside the block and cancels its jobs beyond ``cap`` bytes.

    Leaving the block raises ``ScanTooLarge`` if the cap was passed, also where the query was faster
    than the count. ``read`` is the count so far.
    """

    def __init__(self, spark: SparkSession, cap: int, every: float = 0.1):
        self.spark, self.cap, self.every = spark, cap, every
        self.tag = f"metered-{uuid.uuid4().hex}"
        self.read = 0
        self.cancelled = False
        self._done = threading.Event()
        self._thread = threading.Thread(target=self._watch, daemon=True)

    def _watch(self) -> None:
        while not self._done.wait(self.every):
            self.read = bytes_read(self.spark, self.tag)
            if self.read > self.cap:
                self.cancelled = True  # again each time: a query has several jobs
                self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def __enter__(self) -> Meter:
        self._vectored = self.spark.conf.get(_VECTORED, None)
        self.spark.conf.set(_VECTORED, "false")
        self.spark.sparkContext.addJobTag(self.tag)
        self._thread.start()
        return self

    def __exit__(self, kind, error, trace) -> None:
        self._done.set()
        self._thread.join()
        self.spark.sparkContext.removeJobTag(self.tag)
        if self._vectored is None:
            self.spark.conf.unset(_VECTORED)
        else:
            self.spark.conf.set(_VECTORED, self._vectored)
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        self.read = bytes_read(self.spark, self.tag)
        if self.read > self.cap and (error is None or self.cancelled):
            state = "was cancelled after" if self.cancelled else "read"
            raise ScanTooLarge(f"the query {state} {self.read} bytes, over the cap of {self.cap}") from error


def metered_run(
    spark: SparkSession,
    build: Callable[[], DataFrame],
    estimate: DataFrame | None = None,
    hard_gib: float = HARD_GIB,
    warn: Callable[[str], None] | None = None,
) -> DataFrame:
    """The result of a query that read at most ``hard_gib``, as a table in the shared folder.

    With an ``estimate`` it is refused before it starts if that is over its own cap, as by
    ``capped_run``. A query that reads more than ``hard_gib`` is cancelled, what it had written is
    removed, and ``ScanTooLarge`` is raised.
    """
    query = build if estimate is None else lambda: capped_run(estimate, build, warn)
    path = shared_folder(spark, "metered")
    try:
        with Meter(spark, int(hard_gib * GIB)):
            query().write.option("compression", "zstd").parquet(path)
    except ScanTooLarge:
        delete(spark, path)
        raise
    return spark.read.parquet(path)
