"""Time windows: from a request to a filter that prunes."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import shard_suffix
from plumbline.operators.governance import Table


def _day(value: str | dt.date | None) -> dt.date | None:
    if value is None or type(value) is dt.date:
        return value
    return dt.datetime.strptime(value, "%Y-%m-%d").date()


@dataclass(frozen=True)
class TimeWindow:
    """Either the last N days before ``as_of``, or ``start`` to ``end``, both inclusive.

    ``column`` overrides the column the table would be filtered on.
    """

    last_n_days: int | None = None
    start: str | dt.date | None = None
    end: str | dt.date | None = None
    column: str | None = None

    def __post_init__(self):
        if (self.last_n_days is None) == (self.start is None):
            raise ValueError("give exactly one of last_n_days or start[/end]")
        if self.last_n_days is not None:
            if self.last_n_days < 1:
                raise ValueError("last_n_days must be at least 1")
            if self.end is not None:
                raise ValueError("end has no meaning with last_n_days")
        object.__setattr__(self, "start", _day(self.start))
        object.__setattr__(self, "end", _day(self.end))

    @classmethod
    def spanning(cls, rows: DataFrame, column: str | Column) -> TimeWindow:
        """From the first to the last day of ``column`` (a date or time) in ``rows``; one row comes to
        the driver. Rows without a day are in no window, and a table without days has an empty one."""
        day = (F.col(column) if isinstance(column, str) else column).cast("date")
        first, last = rows.agg(F.min(day), F.max(day)).first()
        return cls(start=first or dt.date(1970, 1, 1), end=last or dt.date(1970, 1, 1))

    def target(self, table: Table) -> str:
        column = self.column or table.anchor or table.time_column
        if not column:
            raise ValueError(f"table {table.name!r} has no column a time window could filter")
        return column

    def predicate(self, table: Table, as_of: dt.date | Column | None = None) -> Column:
        """The filter for ``table``. ``as_of`` stands for today when given.

        The filtered column is left bare, so that partition pruning and parquet
        pushdown see ``column <op> literal``. The upper bound is exclusive on the
        next day: a timestamp late on the last day is inside the window.
        """
        if as_of is None:
            as_of = F.current_date()
        elif not isinstance(as_of, Column):
            as_of = F.lit(_day(as_of))
        name = self.target(table)
        column = F.col(name)
        first = F.lit(self.start) if self.start else F.date_sub(as_of, self.last_n_days)
        last = F.lit(self.end) if self.end else as_of
        if name == table.shard_suffix:
            lower = column >= shard_suffix(first, table.shard_pattern)
            if self.start is None:
                return lower
            return lower & (column <= shard_suffix(last, table.shard_pattern))
        if self.start is None:
            return column >= first
        return (column >= first) & (column < F.date_add(last, 1))
