"""Which columns identify a row: a level-wise search for minimal keys.

Level by level, from single columns on, a set of columns is a candidate unless it holds a key that was
found already. Samples of rows refute most candidates: two equal rows among a few are two equal rows
of the table. The rest is decided on all rows, by 64-bit hashes of a candidate's values: if all differ, it
is a key, and rows of one hash are compared by value. Before that, a slice of the hashes refutes what has
more than a few repeats, for it holds each of its values with all rows. As for ``candidate_keys``, NULL is
a value like any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the samples, one after the other; a later one sees only what the earlier left.
SAMPLES = (1_000, 50_000)
#: Candidates of one job, which copies each sampled row as often.
_AT_ONCE = 60
#: One of so many slices of the hashes is looked at first.
SLICES = 32
#: Candidates of one job that hashes all rows: the code for many more is too long to be compiled.
_SLICED_AT_ONCE = 12
#: Candidates of one job over all hashes; what a task writes of them should fit into its memory.
_WHOLE_AT_ONCE = 4
#: Hashes that one task counts.
_HASHES_IN_TASK = 2_000_000


def _chunks(items: list, size: int) -> Iterator[list]:
    return (items[i : i + size] for i in range(0, len(items), size))


def _hash(columns: Sequence[str]) -> Column:
    """Equal for equal values. Each value is hashed by itself first, so that NULL counts where it stands."""
    return F.xxhash64(*(F.xxhash64(F.col(f"`{c}`")) for c in columns))


def refuted(
    sample: DataFrame,
    candidates: Sequence[tuple[str, ...]],
    hashes: Mapping[tuple[str, ...], Sequence[int]] | None = None,
) -> set[tuple[str, ...]]:
    """The candidates with two equal rows in ``sample``; at most their numbers come to the driver. With
    ``hashes``, a candidate's rows are those of its hashes."""
    found: set[tuple[str, ...]] = set()
    for some in _chunks(list(candidates), _AT_ONCE if hashes is None else _SLICED_AT_ONCE):
        tagged = []
        for n, columns in enumerate(some):
            value = F.array(*(F.col(f"`{c}`").cast("string") for c in columns))
            row = F.struct(F.lit(n).alias("n"), value.alias("value"))
            tagged.append(row if hashes is None else F.when(_hash(columns).isin(*hashes[columns]), row))
        rows = sample.select(F.inline(F.array(*tagged))).where("n IS NOT NULL")
        twice = rows.groupBy("n", "value").count().where("count > 1").select("n").distinct()
        found.update(some[r.n] for r in twice.collect())
    return found


def repeated_hashes(
    rows: DataFrame, n_rows: int, candidates: Sequence[tuple[str, ...]], slices: int = 1
) -> dict[tuple[str, ...], list[int]]:
    """The candidates with two rows of one hash, and the lowest and highest such hash of each, among all
    hashes or one slice of them. They are shuffled as they are: next to no two are equal, so a map-side
    aggregate would only hold them all."""
    found: dict[tuple[str, ...], list[int]] = {}
    for some in _chunks(list(candidates), _WHOLE_AT_ONCE if slices == 1 else _SLICED_AT_ONCE):
        tagged = F.array(*(F.struct(F.lit(n).alias("n"), _hash(c).alias("h")) for n, c in enumerate(some)))
        entries = rows.select(F.inline(tagged))
        if slices > 1:
            entries = entries.where(F.pmod("h", F.lit(slices)) == 0)
        tasks = n_rows * len(some) // slices // _HASHES_IN_TASK + 1
        twice = entries.repartition(tasks, "n", "h").groupBy("n", "h").count().where("count > 1")
        ends = twice.groupBy("n").agg(F.min("h").alias("low"), F.max("h").alias("high"))
        found.update((some[r.n], [r.low, r.high]) for r in ends.collect())
    return found


def is_key(rows: DataFrame, columns: Sequence[str]) -> bool:
    """Whether no two of all rows agree in ``columns``."""
    return rows.groupBy(*(F.col(f"`{c}`") for c in columns)).count().where("count > 1").isEmpty()


def keys_among(
    rows: DataFrame, n_rows: int, candidates: Sequence[tuple[str, ...]], slices: Sequence[int] = (SLICES, 1)
) -> list[tuple[str, ...]]:
    """The candidates that no two of all rows agree in. If a candidate's hashes repeat, but not its values
    in those looked at, all its values are compared."""
    open_, hashes = list(candidates), {}
    for some in slices:
        hashes = repeated_hashes(rows, n_rows, open_, some)
        gone = refuted(rows, list(hashes), hashes)
        open_ = [c for c in open_ if c not in gone]
    return [c for c in open_ if c not in hashes or is_key(rows, c)]


def minimal_keys(
    rows: DataFrame,
    columns: Sequence[str] | None = None,
    max_columns: int = 3,
    samples: Sequence[int] = SAMPLES,
    seed: int = 1,
) -> list[tuple[str, ...]]:
    """All sets of at most ``max_columns`` columns that identify a row and lose that without any of them,
    smaller sets first, in the order of the columns. A table of at most one row has the key ``()``."""
    names = list(columns or rows.columns)
    n = rows.select(F.lit(1)).count()
    if n <= 1:
        return [()]
    found: list[tuple[str, ...]] = []
    for size in range(1, max_columns + 1):
        open_ = [c for c in combinations(names, size) if not any(set(k) <= set(c) for k in found)]
        for wanted in samples:
            if open_ and n > wanted:
                sample = rows.select(*(f"`{c}`" for c in names)).sample(min(1.0, wanted / n), seed=seed)
                gone = refuted(sample, open_)
                open_ = [c for c in open_ if c not in gone]
        if open_ and samples and n <= max(samples):
            gone = refuted(rows.select(*(f"`{c}`" for c in names)), open_)
            open_ = [c for c in open_ if c not in gone]
        if open_:
            small = n <= _HASHES_IN_TASK
            found += keys_among(rows, n, open_, (1,) if small else (SLICES, 1))
    return found
