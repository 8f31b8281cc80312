"""Where texts may repeat: runs of windows that share their least hash with other places.

Both exact deduplicators ask which windows of a fixed length (bytes or words) start at two places or
more. A window is named by the least hash of the short pieces inside it; equal windows have equal
names, whatever stands around them. Neighbouring windows mostly share a name, so a text is a sequence
of runs, about two for each window length of text. A name that only one place has cannot repeat;
the other runs, cut out with their text, are dealt by name, and windows that are equal meet.

Texts that are equal as a whole are one class and take part once, in the row with the smallest id,
so a text that a third of all rows share is cut once. Names are counted before the shuffle, and
counts are joined back, which adaptive execution splits where one name is very common.

A name with more than ``HOT`` runs, as of a passage in a third of all texts, is not gathered in one
task. Runs that hold the same are counted with a map-side step; windows of different runs are named one
by one by 128 bits of all they hold, counted likewise, and joined back (``hot_ranges``); the result is
the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import flat_bytes, join_counts, mix, ranges, slices

#: Windows in a run at most; longer runs, of periodic text, are cut.
MAX_RUN = 256
#: Runs of a name that one task may gather, some 0.4 KB each.
HOT = 2_000
#: Text bytes handled at once when names are made: arrays of eight bytes for each.
NAMING_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Unit:
    """Windows of ``window`` units of which ``piece`` at a time are hashed; ``words`` or bytes."""

    words: bool
    window: int
    piece: int


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word of a batch, and the first word of each text (one more entry).

    Words are split at ASCII white space and at the ends of texts.
    """
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begins = inside & np.concatenate(([True], ~inside[:-1] | edge[1:-1]))
    finishes = inside & np.concatenate((~inside[1:] | edge[1:-1], [True]))
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def rolling(values: np.ndarray, length: int) -> np.ndarray:
    """A hash of every ``length`` neighbouring values, by doubling."""
    def power(n: int) -> np.uint64:
        return np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64))

    out, done, step, size = None, 0, values.astype(np.uint64), 1
    with np.errstate(over="ignore"):
        while True:
            if length & size:
                if out is None:
                    out = step
                else:
                    n = max(0, min(len(step), len(out) - size))
                    out = step[:n] * power(done) + out[size : size + n]
                done += size
            if done == length:
                return out[: max(0, len(values) - length + 1)]
            m = max(0, len(step) - size)
            step = step[:m] * power(size) + step[size : size + m]
            size *= 2


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def unit_values(raw: np.ndarray, offsets: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """A value for each unit of a batch, and the first unit of each text."""
    if not unit.words:
        return raw.astype(np.uint64) + np.uint64(1), offsets
    starts, ends, first = word_spans(raw, offsets)
    with np.errstate(over="ignore"):
        # Differences of running sums with growing powers, brought to the same power.
        base = np.uint64(0x9E3779B97F4A7C15)
        up = np.cumprod(np.full(len(raw) + 1, base, np.uint64), dtype=np.uint64)
        inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        down = np.cumprod(np.full(len(raw) + 1, inverse, np.uint64), dtype=np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
        value = (sums[ends] - sums[starts]) * down[starts]
    return mix(value + (ends - starts).astype(np.uint64)), first


def runs(raw: np.ndarray, offsets: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """Text number, name, first window, windows, and whether a name stands at two places or more of
    the run; a run for each stretch of windows with one name."""
    none = np.zeros(0, np.int64)
    empty = none, none.astype(np.uint64), none, none, none.astype(bool)
    values, first = unit_values(raw, offsets, unit)
    if len(values) < unit.window:
        return empty
    hashes = mix(rolling(values, unit.piece))
    width = unit.window - unit.piece + 1
    names = least(hashes, width)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(names)]
    valid = np.arange(len(names)) + unit.window <= first[text + 1]
    at = np.flatnonzero(valid)
    if not len(at):
        return empty
    name, own = names[at], text[at]
    new = np.concatenate(([True], (name[1:] != name[:-1]) | (own[1:] != own[:-1]) | (np.diff(at) != 1)))
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(at)))
    pieces = (size + MAX_RUN - 1) // MAX_RUN
    part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    head = np.repeat(head, pieces) + part * MAX_RUN
    size = np.minimum(np.repeat(size, pieces) - part * MAX_RUN, MAX_RUN)
    place, name, own = at[head], name[head], own[head]
    spread = size + width - 1
    same = hashes[ranges(place, spread)] == np.repeat(name, spread)
    count = np.add.reduceat(same.astype(np.int64), np.cumsum(spread) - spread)
    return own, name, place - first[own], size, count > 1


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, ka, kb``: the keys are a 128-bit hash of the text; null texts are empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("ka"), F.xxhash64(F.lit(1), "text").alias("kb")
    )


def classes(rows: DataFrame) -> DataFrame:
    """``ka, kb, rep_id, copies``: the classes of equal texts, with their smallest id (null first)."""
    return rows.groupBy("ka", "kb").agg(
        F.when(F.count("doc_id") == F.count("*"), F.min("doc_id")).alias("rep_id"), F.count("*").alias("copies")
    )


def _chosen(rows: DataFrame) -> DataFrame:
    """``rows`` with ``chosen``, true in the row that stands for its class; texts are not sorted."""
    named = classes(rows).hint("shuffle_hash")
    return rows.join(named, ["ka", "kb"]).select(
        "ka", "kb", "doc_id", "text", F.col("doc_id").eqNullSafe(F.col("rep_id")).alias("chosen")
    )


def repeated_runs(rows: DataFrame, unit: Unit, hot: int = HOT) -> DataFrame:
    """``ka, kb, runs, any_hot``: of each class the runs ``(name, first, windows, hot)`` whose name is
    not alone."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch.filter(batch.column("chosen"))], limit=NAMING_BYTES):
                own, names, first, size, again = runs(*flat_bytes(part), unit)
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("ka").take(at),
                        part.column("kb").take(at),
                        pa.array(names.view(np.int64)),
                        pa.array(first << 13 | size << 1 | again),
                    ],
                    ["ka", "kb", "name", "place"],
                )

    found = _chosen(rows).mapInArrow(name, "ka long, kb long, name long, place long")
    # Of a place in ``found``: the first window from bit 13, the number of windows from bit 1, and
    # bit 0 if the name stands twice in the run itself.
    often = (
        found.groupBy("name").agg(F.count("*").alias("n"), F.max(F.col("place").bitwiseAND(F.lit(1))).alias("again"))
        .filter((F.col("n") > 1) | (F.col("again") == 1)).select("name", (F.col("n") > hot).alias("hot"))
    )
    run = F.struct(
        "name",
        F.shiftright("place", 13).alias("first"),
        F.shiftright("place", 1).bitwiseAND(F.lit(4095)).cast("int").alias("windows"),
        "hot",
    )
    return join_counts(found, often, "name").groupBy("ka", "kb").agg(
        F.sort_array(F.collect_set(run)).alias("runs"), F.bool_or("hot").alias("any_hot")
    )


def _hot_runs(rows: DataFrame, unit: Unit, hot: int) -> DataFrame:
    """``ka, kb, doc_id, first, ra, rb, wa, wb``: each run with a hot name, the two halves of its own
    name, which says all it holds, and of the names of its windows in order."""
    wanted = repeated_runs(rows, unit, hot).filter("any_hot").hint("shuffle_hash")
    joined = _chosen(rows).join(wanted, ["ka", "kb"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch.filter(batch.column("chosen"))], limit=NAMING_BYTES):
                values, begin = unit_values(*flat_bytes(part), unit)
                lists = part.column("runs")
                own = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                flat = lists.flatten()
                use = flat.field("hot").to_numpy(zero_copy_only=False)
                own, first, windows = own[use], flat.field("first").to_numpy()[use], flat.field("windows").to_numpy()[use]
                if not len(own):
                    continue
                place, step = ranges(begin[own] + first, windows), mix(ranges(np.zeros(len(own)), windows))
                cuts = np.concatenate(([0], np.cumsum(windows))).astype(np.int32)
                of_runs, of_windows = [], []
                for half in (values, mix(values + np.uint64(7))):
                    names = mix(rolling(half, unit.window)[place])
                    of_runs.append(pa.array(np.add.reduceat(mix(names + step), cuts[:-1]).view(np.int64)))
                    of_windows.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(names.view(np.int64))))
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(at) for c in ("ka", "kb", "doc_id")), pa.array(first), *of_runs, *of_windows],
                    ["ka", "kb", "doc_id", "first", "ra", "rb", "wa", "wb"],
                )

    return joined.mapInArrow(
        name, "ka long, kb long, doc_id long, first long, ra long, rb long, wa array<long>, wb array<long>"
    )


def _place(doc_id: str = "doc_id") -> Column:
    return F.struct(F.coalesce(doc_id, F.lit(-(2**63))).alias("doc"), "first")


def _join_names(rows: DataFrame, counted: DataFrame, a: str, b: str) -> DataFrame:
    """``rows`` with what ``counted`` says of their name ``a, b``; its columns must differ otherwise."""
    # Joined by one hash of both halves of the name, and compared by the halves.
    both = F.xxhash64(a, b)
    named = counted.withColumn("both", both).withColumnsRenamed({a: "name_a", b: "name_b"})
    return join_counts(rows.withColumn("both", both), named, "both").filter((F.col(a) == F.col("name_a")) & (F.col(b) == F.col("name_b")))


def hot_windows(rows: DataFrame, unit: Unit, hot: int = HOT) -> DataFrame:
    """``window, ka, kb, doc_id, first, n``: each window of runs with a hot name that stands at
    ``n`` > 1 places."""
    found = _hot_runs(rows, unit, hot).select(
        "ka", "kb", "doc_id", "first", F.posexplode(F.arrays_zip("wa", "wb")).alias("step", "w")
    ).select("w.wa", "w.wb", "ka", "kb", "doc_id", (F.col("first") + F.col("step")).alias("first"))
    counted = found.groupBy("wa", "wb").agg(F.count("*").alias("n")).filter("n > 1")
    near = _join_names(found, counted, "wa", "wb")
    return near.select(F.col("wa").alias("window"), "ka", "kb", "doc_id", "first", "n")


def _islands(steps: str) -> Column:
    """First and last of each stretch of neighbouring numbers in an array of at most ``MAX_RUN``."""
    s = F.col(steps)
    heads = F.filter(s, lambda x: ~F.array_contains(s, x - 1))
    tails = F.filter(s, lambda x: ~F.array_contains(s, x + 1))
    return F.zip_with(heads, tails, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def hot_ranges(rows: DataFrame, unit: Unit, hot: int = HOT, later: bool = False) -> DataFrame:
    """``ka, kb, start, end``: the units covered by windows of runs with a hot name that stand at two
    places or more; with ``later`` without the earliest place of each (by ``doc_id``, null first, and
    place).

    Runs that hold the same are counted first, and windows are compared among different runs only, so
    a passage costs a row for each run of it, not for each window, wherever it stands. A window's
    earliest place is in the earliest place of a run, so a run has two results: there and elsewhere.
    """
    found = _hot_runs(rows, unit, hot)
    distinct = found.groupBy("ra", "rb").agg(
        F.count("*").alias("copies"), F.min(_place()).alias("origin"), F.any_value(F.arrays_zip("wa", "wb")).alias("names")
    )
    each = distinct.select("ra", "rb", "copies", "origin", F.posexplode("names").alias("step", "w")).select(
        "ra", "rb", "copies", "origin", "step", "w.wa", "w.wb",
        F.struct(F.col("origin.doc").alias("doc"), (F.col("origin.first") + F.col("step")).alias("first")).alias("at"),
    )
    counted = each.groupBy("wa", "wb").agg(F.sum("copies").alias("n"), F.min("at").alias("least")).filter("n > 1")
    again = _join_names(each, counted, "wa", "wb")
    steps = again.groupBy("ra", "rb").agg(
        F.any_value("origin").alias("origin"),
        F.collect_list("step").alias("everywhere"),
        F.collect_list(F.when(F.col("at") != F.col("least"), F.col("step"))).alias("beyond"),
    ).select("ra", "rb", "origin", *(F.sort_array(c).alias(c) for c in ("everywhere", "beyond")))
    parts = steps.select("ra", "rb", "origin", *(_islands(c).alias(c) for c in ("everywhere", "beyond")))
    joined = _join_names(found.select("ka", "kb", "doc_id", "first", "ra", "rb"), parts, "ra", "rb")
    own = F.when(F.lit(later) & (_place() == F.col("origin")), F.col("beyond")).otherwise(F.col("everywhere"))
    return joined.select("ka", "kb", "first", F.explode(own).alias("part")).select(
        "ka", "kb", (F.col("first") + F.col("part.a")).alias("start"),
        (F.col("first") + F.col("part.b") + unit.window).alias("end"),
    )


def segments(rows: DataFrame, unit: Unit, hot: int = HOT) -> DataFrame:
    """``name, ka, kb, doc_id, first, windows, segment``: the text of each run that may repeat and is
    not hot, with one byte before it for bytes (none at the start of a text)."""
    wanted = repeated_runs(rows, unit, hot).hint("shuffle_hash")
    joined = _chosen(rows).join(wanted, ["ka", "kb"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch.filter(batch.column("chosen"))]):
                raw, offsets = flat_bytes(part)
                lists = part.column("runs")
                own = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                flat = lists.flatten()
                use = ~flat.field("hot").to_numpy(zero_copy_only=False)
                flat, own = flat.filter(pa.array(use)), own[use]
                first, windows = flat.field("first").to_numpy(), flat.field("windows").to_numpy().astype(np.int64)
                if unit.words:
                    starts, ends, word = word_spans(raw, offsets)
                    a = starts[word[own] + first]
                    b = ends[word[own] + first + windows + unit.window - 2]
                else:
                    a = offsets[own] + np.maximum(first - 1, 0)
                    b = offsets[own] + first + windows + unit.window - 1
                size = b - a
                data = raw[ranges(a, size)]
                ends_ = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                cuts = pa.Array.from_buffers(
                    pa.binary(), len(size), [None, pa.py_buffer(ends_.tobytes()), pa.py_buffer(data.tobytes())]
                )
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        flat.field("name"),
                        *(part.column(c).take(at) for c in ("ka", "kb", "doc_id")),
                        flat.field("first"),
                        flat.field("windows"),
                        cuts,
                    ],
                    ["name", "ka", "kb", "doc_id", "first", "windows", "segment"],
                )

    return joined.mapInArrow(
        cut, "name long, ka long, kb long, doc_id long, first long, windows int, segment binary"
    )


def by_name(cut: DataFrame, solve: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, windows: int) -> DataFrame:
    """Apply ``solve`` to batches of about ``windows`` windows that hold all segments of their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            name = table.column("name").to_numpy()
            stop = len(name) if last else int(np.flatnonzero(name == name[-1])[0])
            held[:] = [table.slice(stop)] if stop < len(name) else []
            if stop:
                yield from solve(table.slice(0, stop))

        for batch in batches:
            if not batch.num_rows:
                continue
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                held.append(part)
                size += int(part.column("windows").to_numpy().sum())
                if size >= windows:
                    yield from whole(False)
                    size = 0
        if held:
            yield from whole(True)

    return cut.repartition("name").sortWithinPartitions("name", "doc_id", "ka", "kb", "first").mapInArrow(run, schema)


def merged(start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of ranges of each owner, as ranges that neither overlap nor touch."""
    if not len(start):
        return start, end, owner
    order = np.lexsort((start, owner))
    start, end, owner = start[order], end[order], owner[order]
    # Owners are set apart, so that one running maximum serves all.
    apart = (int(end.max()) + 2) * np.unique(owner, return_inverse=True)[1]
    reach = np.maximum.accumulate(end + apart)
    new = np.concatenate(([True], start[1:] + apart[1:] > reach[:-1]))
    heads = np.flatnonzero(new)
    last = np.append(heads[1:], len(start)) - 1
    return start[heads], reach[last] - apart[last], owner[heads]


def with_ranges(rows: DataFrame, covered: DataFrame) -> DataFrame:
    """``doc_id, text, rep_id, copies, ranges``: every row with its class and its class's ranges."""
    own = covered.groupBy("ka", "kb").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("ranges"))
    return (
        rows.join(classes(rows).hint("shuffle_hash"), ["ka", "kb"])
        .join(own.hint("shuffle_hash"), ["ka", "kb"], "left")
        .select("doc_id", "text", "rep_id", "copies", "ranges")
    )
