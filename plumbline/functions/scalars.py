"""Scalar expressions. All of them are built-in Spark functions, so they stay
inside whole-stage code generation and are visible to the optimizer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units, the price of a scan, and the size labels.
GIB = 1024**3
TIB = 1024**4
USD_PER_TIB = 6.25
SIZE_UNITS = ("B", "KiB", "MiB", "GiB", "TiB")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_divide(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient as a double; NULL, not an error, where the denominator is 0."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def calendar_day(ts: Column | str) -> Column:
    """The calendar day of a date or timestamp."""
    return F.to_date(_col(ts))


def shard_suffix(day: Column | str, pattern: str = "yyyyMMdd") -> Column:
    """The shard suffix a day belongs to: ``yyyyMMdd`` for daily, ``yyyy`` for yearly shards."""
    return F.date_format(_col(day), pattern)


def calendar_months_between(start: Column | str, end: Column | str) -> Column:
    """Whole calendar months from ``start`` to ``end``, ignoring the day of month.

    ``months_between`` counts fractions of 31-day months, which is a different thing.
    """
    start, end = _col(start), _col(end)
    return (F.year(end) - F.year(start)) * 12 + (F.month(end) - F.month(start))


def bucket_labels(edges: Sequence[int]) -> list[str]:
    """Labels of the age buckets cut at ``edges`` (inclusive upper bounds in days)."""
    labels = [f"0-{edges[0]} (new)"]
    labels += [f"{low + 1}-{high}" for low, high in zip(edges, edges[1:])]
    return [*labels, f"{edges[-1] + 1}+ (established)"]


def age_bucket(age_days: Column | str, edges: Sequence[int] = (30, 90, 365)) -> Column:
    """The label of the bucket an age in days falls into."""
    age = _col(age_days)
    *closed, last = bucket_labels(edges)
    bucket = F
    for edge, label in zip(edges, closed):
        bucket = bucket.when(age <= edge, label)
    return bucket.otherwise(last)


def gib_to_bytes(gib: Column | str) -> Column:
    return (_col(gib).cast("double") * F.lit(float(GIB))).cast("long")


def bytes_to_gib(n: Column | str) -> Column:
    return _col(n).cast("double") / F.lit(float(GIB))


def estimated_usd(n: Column | str) -> Column:
    """On-demand price of scanning ``n`` bytes."""
    return _col(n).cast("double") / F.lit(float(TIB)) * F.lit(USD_PER_TIB)


def human_bytes(n: Column | str) -> Column:
    """A byte count as text: ``0 B``, ``1.50 KiB`` up to ``TiB``; NULL is ``unknown``.

    Half a hundredth goes to the even neighbour.
    """
    n = _col(n)

    def scaled(power: int) -> Column:
        value = n.cast("double") / F.lit(float(1024**power))
        # of a large number the shortest digits can look like a half where the number is none
        part = value % F.lit(1.0)
        return F.format_string(f"%.2f {SIZE_UNITS[power]}", value - part + F.bround(part, 2))

    text = F.when(n.isNull(), "unknown").when(n < 1024, F.format_string("%d B", n.cast("long")))
    for power in range(1, len(SIZE_UNITS) - 1):
        text = text.when(n < F.lit(1024 ** (power + 1)), scaled(power))
    return text.otherwise(scaled(len(SIZE_UNITS) - 1))
