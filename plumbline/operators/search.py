"""Case-insensitive substring search over several tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TextSource:
    """A kind of entity: its rows, the column that names one, the fields to look in."""

    kind: str
    rows: DataFrame
    name: str
    fields: tuple[str, ...]


def text_search(sources: Sequence[TextSource], query: str) -> DataFrame:
    """``(kind, name)`` of every entity with a field that contains ``query``.

    Each source is one scan of the named columns with the match evaluated in
    place; no shuffle. An empty query matches every field that holds some text.
    """
    needle = query.lower().strip()
    hits = []
    for source in sources:
        matches = (
            (F.col(f) != "") & F.contains(F.lower(f), F.lit(needle)) for f in source.fields
        )
        hits.append(
            source.rows.where(reduce(or_, (F.coalesce(m, F.lit(False)) for m in matches))).select(
                F.lit(source.kind).alias("kind"), F.col(source.name).cast("string").alias("name")
            )
        )
    return reduce(DataFrame.unionByName, hits)
