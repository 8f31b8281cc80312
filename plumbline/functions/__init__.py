"""Column expressions shared by the operators and plans."""

from plumbline.functions.scalars import (
    age_bucket,
    bytes_to_gib,
    calendar_day,
    calendar_months_between,
    estimated_usd,
    gib_to_bytes,
    human_bytes,
    safe_divide,
    shard_suffix,
)

__all__ = [
    "age_bucket",
    "bytes_to_gib",
    "calendar_day",
    "calendar_months_between",
    "estimated_usd",
    "gib_to_bytes",
    "human_bytes",
    "safe_divide",
    "shard_suffix",
]
