"""Grading texts against what they must and must not contain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.skew import ROWS_PER_CHUNK, left_join_hot_keys


def grade_texts(
    texts: DataFrame, assertions: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Per case: number of assertions, number that hold, and whether all do.

    ``texts(case_id, text)`` has one row per case; ``assertions(case_id, kind,
    needle)`` has kind ``contains`` or ``absent``. A case without assertions
    passes. An assertion about a case that has no text fails.

    Repeated assertions are counted first, so a case that repeats a needle costs one row.
    A match leaves the join as two numbers, and is summed per case and chunk before the
    cases are put together.
    """
    distinct = assertions.groupBy("case_id", "kind", "needle").agg(F.count(F.lit(1)).alias("n"))
    checked = left_join_hot_keys(distinct, texts, "case_id", "needle", rows_per_chunk)
    found = F.contains("text", "needle")
    holds = F.coalesce(
        F.when(F.col("kind") == "contains", found).when(F.col("kind") == "absent", ~found),
        F.lit(False),
    )
    zero = F.lit(0).cast("long")
    graded = checked.select("case_id", "n", F.when(holds, F.col("n")).otherwise(zero).alias("held"))
    bare = texts.select("case_id", zero.alias("n"), zero.alias("held"))
    return (
        graded.unionByName(bare)
        .groupBy("case_id")
        .agg(F.sum("n").alias("n_assert"), F.sum("held").alias("n_passed"))
        .withColumn("passed", F.col("n_assert") == F.col("n_passed"))
    )
