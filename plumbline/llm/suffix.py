"""Repeated byte strings by an enhanced suffix array and its common-prefix interval tree.

A maximal repeat is a string of ``window`` bytes or more that stands at several places and can be
made longer neither to the left nor to the right without losing one. In a sorted suffix array it is
an interval of the common-prefix tree whose suffixes have different bytes to their left. A stack scan
over the common prefixes of neighbours gives all intervals, and an interval gives all occurrences.

Suffixes are dealt to tasks by the name of their first window (``repeats``), so equal ones meet.
There, suffixes whose first window stands alone are left, and so are those whose equals all have the
same byte to their left, since a repeat that starts one byte earlier covers them. What remains is
sorted by content. Where a run begins, the byte before counts as different from all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import flat_bytes, mix
from .repeats import HOT, Unit, by_name, hot_ranges, hot_windows, merged, rolling, segments

#: Windows that are in hand at once.
_WINDOWS = 100_000
GROUPS = "group long, length int, occurrences int, ka long, kb long, doc_id long, start long"


def common_prefix(raw: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a[i]`` and ``b[i]``, ``most[i]`` at most."""
    words = np.lib.stride_tricks.sliding_window_view(np.append(raw, np.zeros(8, np.uint8)), 8)
    length = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    while len(open_):
        here = length[open_]
        x = np.ascontiguousarray(words[a[open_] + here]).view("<u8")[:, 0]
        y = np.ascontiguousarray(words[b[open_] + here]).view("<u8")[:, 0]
        differ = x ^ y
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
        length[open_] = here + same
        open_ = open_[(same == 8) & (here + 8 < most[open_])]
    return np.minimum(length, most)


def intervals(prefix: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last place and depth of each interval of the common-prefix tree with depth ``least``
    or more. ``prefix[i]`` is that of suffixes ``i - 1`` and ``i``; ``prefix[0]`` is zero."""
    first, last, depth = [], [], []
    stack: list[tuple[int, int]] = []
    for i, p in enumerate([*prefix.tolist(), 0]):
        begin = i - 1
        while stack and stack[-1][1] > p:
            begin, d = stack.pop()
            first.append(begin)
            last.append(i - 1)
            depth.append(d)
        if p >= least and (not stack or stack[-1][1] < p):
            stack.append((begin, p))
    return np.array(first, np.int64), np.array(last, np.int64), np.array(depth, np.int64)


def maximal_repeats(raw: np.ndarray, place: np.ndarray, room: np.ndarray, left: np.ndarray, window: int):
    """The maximal repeats among the suffixes at ``place``, of which ``room`` bytes may be read.

    ``left`` is the symbol before each. Returned: order of the suffixes, and first and last place in
    that order and depth of each maximal repeat.
    """
    width = int(room.max())
    padded = np.append(raw, np.zeros(width, np.uint8))
    view = np.lib.stride_tricks.sliding_window_view(padded, width)
    keys = view[place].copy()
    keys[np.arange(width) >= room[:, None]] = 0
    # A suffix that ends comes before those that go on.
    order = np.argsort(room, kind="stable")
    order = order[np.argsort(keys.view(f"S{width}")[order, 0], kind="stable")]
    place, room, left = place[order], room[order], left[order]
    prefix = np.zeros(len(place), np.int64)
    prefix[1:] = common_prefix(raw, place[:-1], place[1:], np.minimum(room[:-1], room[1:]))
    first, last, depth = intervals(prefix, window)
    changes = np.concatenate(([0], np.cumsum(left[1:] != left[:-1])))
    diverse = changes[last] > changes[first]
    return order, first[diverse], last[diverse], depth[diverse]


def repeats_of(batch: pa.RecordBatch, window: int):
    """Suffixes of the segments of ``batch`` that may begin a maximal repeat, and the repeats."""
    raw, offsets = flat_bytes(batch, "segment")
    first = batch.column("first").to_numpy()
    windows = batch.column("windows").to_numpy().astype(np.int64)
    before = (first > 0).astype(np.int64)
    begin, end = offsets[:-1] + before, offsets[1:]
    owner = np.repeat(np.arange(len(first)), windows)
    step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    place = begin[owner] + step
    name = mix(batch.column("name").to_numpy().view(np.uint64))
    hashed = rolling(raw.astype(np.uint64) + np.uint64(1), window)[place] ^ name[owner]
    left = np.where(step > 0, raw[np.maximum(place - 1, 0)].astype(np.int64), 256 + np.arange(len(place)))
    order = np.argsort(hashed, kind="stable")
    sorted_, by = hashed[order], left[order]
    head = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    size = np.diff(np.append(head, len(order)))
    diverse = np.maximum.reduceat(by, head) != np.minimum.reduceat(by, head)
    use = np.repeat((size > 1) & diverse, size)
    chosen = np.sort(order[use])
    place, owner, step, left = place[chosen], owner[chosen], step[chosen], left[chosen]
    room = end[owner] - place
    return raw, place, owner, first[owner] + step, room, left


def maximal_groups(rows: DataFrame, window: int = 200, piece: int = 32, hot: int = HOT) -> DataFrame:
    """Maximal repeats with all occurrences: ``group, length, occurrences, ka, kb, doc_id, start``, a
    row for each occurrence, in bytes of the text with keys ``ka, kb`` (``repeats.keyed``).

    A repeat that is longer than its run (about one window more) comes as several groups, one after
    the other, whose occurrences overlap; one in a hot run comes window by window.
    """
    unit = Unit(False, window, piece)
    cut = segments(rows, unit, hot)
    single = hot_windows(rows, unit, hot).select(
        F.col("window").alias("group"), F.lit(window).alias("length"), F.col("n").cast("int").alias("occurrences"),
        "ka", "kb", "doc_id", F.col("first").alias("start"),
    )

    def solve(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, place, owner, start, room, left = repeats_of(batch, window)
        if not len(place):
            return
        order, first, last, depth = maximal_repeats(raw, place, room, left, window)
        size = last - first + 1
        at = order[np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        group = mix(rolling(raw.astype(np.uint64) + np.uint64(1), window)[place[order[first]]] + depth.astype(np.uint64))
        rows_ = pa.array(owner[at])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(group.view(np.int64), size)),
                pa.array(np.repeat(depth, size).astype(np.int32)),
                pa.array(np.repeat(size, size).astype(np.int32)),
                *(batch.column(c).take(rows_) for c in ("ka", "kb", "doc_id")),
                pa.array(start[at]),
            ],
            ["group", "length", "occurrences", "ka", "kb", "doc_id", "start"],
        )

    return by_name(cut, solve, GROUPS, _WINDOWS).unionByName(single)


def covered(rows: DataFrame, window: int = 200, piece: int = 32, hot: int = HOT) -> DataFrame:
    """``ka, kb, start, end``: the bytes that maximal repeats cover. Of nested groups at one place the
    deepest is enough, so an occurrence gives one range."""
    unit = Unit(False, window, piece)
    cut = segments(rows, unit, hot)

    def solve(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, place, owner, start, room, left = repeats_of(batch, window)
        if not len(place):
            return
        order, first, last, depth = maximal_repeats(raw, place, room, left, window)
        # Intervals are nested: from the shallowest on, deeper ones overwrite.
        deepest = np.zeros(len(place), np.int64)
        for i in np.argsort(depth, kind="stable").tolist():
            deepest[first[i] : last[i] + 1] = depth[i]
        hit = deepest > 0
        at = order[hit]
        a, b, own = merged(start[at], start[at] + deepest[hit], owner[at])
        rows_ = pa.array(own)
        yield pa.RecordBatch.from_arrays(
            [batch.column("ka").take(rows_), batch.column("kb").take(rows_), pa.array(a), pa.array(b)],
            ["ka", "kb", "start", "end"],
        )

    ranges_ = by_name(cut, solve, "ka long, kb long, start long, end long", _WINDOWS)
    return ranges_.unionByName(hot_ranges(rows, unit, hot))
