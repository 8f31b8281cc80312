"""What a dataset promises: its tables, metrics and segments.

The registry is plain data. It knows names, grains and expressions, and checks
that they fit together; it holds no DataFrame. :func:`plumbline.operators.metric.metric_query`
applies it to the DataFrames a session has.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class UnknownName(KeyError):
    """A metric, segment, table or dataset that the registry does not hold."""


@dataclass(frozen=True)
class Table:
    """One governed table.

    ``partition_column`` (a date) or ``shard_suffix`` (a string such as
    ``20240131``) is the cost anchor: a query must filter it so that Spark can
    prune directories. ``shard_pattern`` is the date pattern of the suffix.
    """

    name: str
    grain: str
    columns: dict[str, str] = field(default_factory=dict)
    partition_column: str | None = None
    shard_suffix: str | None = None
    shard_pattern: str = "yyyyMMdd"
    time_column: str | None = None
    hygiene_filter: str | None = None
    join_keys: tuple[str, ...] = ()
    scope_exclusions: str | None = None
    description: str | None = None
    comments: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        stray = sorted(set(self.comments) - set(self.columns))
        if stray:
            raise ValueError(f"table {self.name!r} describes columns it does not have: {stray}")
        if self.partition_column and self.shard_suffix:
            raise ValueError(
                f"table {self.name!r} declares a partition column and a shard suffix; "
                "exactly one of them can be its cost anchor, not both"
            )

    @property
    def anchor(self) -> str | None:
        return self.partition_column or self.shard_suffix


@dataclass(frozen=True)
class Segment:
    """A named population: a boolean Spark SQL expression."""

    name: str
    predicate: str
    description: str = ""


@dataclass(frozen=True)
class Metric:
    """A named aggregate over one table.

    ``unnest`` lists the repeated fields to explode, outermost first; inside
    ``expression``, dimensions and segments each is known by its last path part.
    """

    name: str
    table: str
    expression: str
    default_segments: tuple[str, ...] = ()
    unnest: tuple[str, ...] = ()
    grain: str = ""
    description: str = ""


@dataclass(frozen=True)
class Dataset:
    """Tables, metrics and segments that belong together."""

    name: str
    tables: tuple[Table, ...]
    metrics: tuple[Metric, ...] = ()
    segments: tuple[Segment, ...] = ()
    notes: tuple[str, ...] = ()
    description: str = ""

    def __post_init__(self):
        for metric in self.metrics:
            if metric.table not in self._tables:
                raise ValueError(f"metric {metric.name!r}: unknown table {metric.table!r}")
            for name in metric.default_segments:
                if name not in self._segments:
                    raise ValueError(f"metric {metric.name!r}: unknown segment {name!r}")

    @cached_property
    def _tables(self):
        return {t.name: t for t in self.tables}

    @cached_property
    def _metrics(self):
        return {m.name: m for m in self.metrics}

    @cached_property
    def _segments(self):
        return {s.name: s for s in self.segments}

    def _get(self, kind: str, names: dict, name: str):
        if name not in names:
            raise UnknownName(f"no {kind} {name!r} in dataset {self.name!r}")
        return names[name]

    def table(self, name: str) -> Table:
        return self._get("table", self._tables, name)

    def metric(self, name: str) -> Metric:
        return self._get("metric", self._metrics, name)

    def segment(self, name: str) -> Segment:
        return self._get("segment", self._segments, name)


@dataclass(frozen=True)
class Registry:
    """All datasets of a workspace."""

    datasets: tuple[Dataset, ...]

    def dataset(self, name: str) -> Dataset:
        for dataset in self.datasets:
            if dataset.name == name:
                return dataset
        raise UnknownName(f"no dataset {name!r}")


def check_against(dataset: Dataset, tables: dict[str, DataFrame]) -> None:
    """Resolve every metric and applicable segment against real schemas.

    Analysis is eager and reads no data: a name that the table does not have
    raises ``AnalysisException`` here rather than in the middle of a report.
    """
    from plumbline.operators.metric import unnest

    for table in dataset.tables:
        if table.columns and table.name in tables:
            tables[table.name].select(*table.columns).schema
    reached: dict[str, Exception | None] = {}
    for metric in dataset.metrics:
        table = dataset.table(metric.table)
        rows = tables[metric.table]
        if table.hygiene_filter:
            rows = rows.where(table.hygiene_filter)
        rows = unnest(rows, metric.unnest)
        for name in metric.default_segments:
            rows = rows.where(dataset.segment(name).predicate)
        for segment in dataset.segments:
            _resolve(segment, metric, rows, reached)
        rows.agg(F.expr(metric.expression).alias(metric.name)).schema
    for name, error in reached.items():
        if error is not None:
            raise error


def _resolve(segment: Segment, metric: "Metric", rows: DataFrame, reached: dict) -> None:
    """Note whether ``segment`` fits the rows of a metric. It must fit those of one at least."""
    from pyspark.errors import AnalysisException

    if segment.name in reached and reached[segment.name] is None:
        return
    try:
        rows.where(segment.predicate).schema
        reached[segment.name] = None
    except AnalysisException as error:
        reached[segment.name] = error
