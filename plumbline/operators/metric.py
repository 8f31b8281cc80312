"""Governed metrics: a request becomes one lazy aggregation."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.governance import Dataset
from plumbline.operators.window import TimeWindow


class UnboundedScan(ValueError):
    """A request that would read a cost-anchored table without pruning it."""


def unnest(rows: DataFrame, paths: Sequence[str]) -> DataFrame:
    """One row per element of each repeated field, outermost first.

    The element takes the name of the last path part. Rows whose array is empty
    or NULL disappear, as in an inner lateral join.
    """
    for path in paths:
        rows = rows.withColumn(path.rsplit(".", 1)[-1], F.explode(path))
    return rows


def dimension(text: str) -> Column:
    """A dimension: a column, a path (named by its last part) or any SQL expression."""
    column = F.expr(text)
    if text.replace(".", "").replace("_", "").isalnum() and "." in text:
        return column.alias(text.rsplit(".", 1)[-1])
    return column


def metric_query(
    tables: Mapping[str, DataFrame],
    dataset: Dataset,
    metric: str,
    dimensions: Sequence[str] = (),
    segments: Sequence[str] = (),
    window: TimeWindow | None = None,
    limit: int | None = None,
    descending: bool = True,
    as_of: dt.date | Column | None = None,
) -> DataFrame:
    """``metric`` by ``dimensions`` for the rows inside all segments and the window.

    One scan, one aggregation with a map-side partial step, one ordering; with a
    ``limit`` the ordering is a top-k that never sorts the whole result. Ties are
    broken by the dimensions so that the cut is reproducible.
    """
    wanted = dataset.metric(metric)
    table = dataset.table(wanted.table)
    if table.anchor and (window is None or window.target(table) != table.anchor):
        raise UnboundedScan(
            f"table {table.name!r} is anchored on {table.anchor!r}: "
            "a time window on that column is required"
        )

    rows = tables[table.name]
    if window is not None:
        rows = rows.where(window.predicate(table, as_of))
    if table.hygiene_filter:
        rows = rows.where(table.hygiene_filter)
    rows = unnest(rows, wanted.unnest)
    for name in dict.fromkeys([*wanted.default_segments, *segments]):
        rows = rows.where(F.expr(dataset.segment(name).predicate))

    keys = [dimension(text) for text in dimensions]
    result = rows.groupBy(*keys).agg(F.expr(wanted.expression).alias(wanted.name))
    measure = F.col(wanted.name)
    order = [measure.desc_nulls_last() if descending else measure.asc_nulls_first()]
    order += [F.col(f"`{name}`") for name in result.columns if name != wanted.name]
    result = result.orderBy(*order)
    return result if limit is None else result.limit(limit)
