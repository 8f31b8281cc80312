"""Repeated phrases by sharded Aho-Corasick automata.

A phrase is ``window`` words in a row that stand at two places or more. Windows that may repeat are
dealt by name (``repeats``). Each shard of names confirms which windows recur, word for word,
compiles them into one automaton over word numbers, and streams its texts through it to locate every
occurrence. An occurrence is earlier if its ``doc_id`` is smaller, or, in one document, its start.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import ranges
from .repeats import HOT, Unit, by_name, hot_ranges, merged, segments

#: Windows in a shard, at most about; a phrase has ``window`` nodes of some 60 bytes.
_WINDOWS = 100_000


def recurring(words: np.ndarray, starts: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """Places in ``words`` of one occurrence of each window that stands twice or more.

    Segment ``i`` has the windows from ``starts[i]`` on. ``words`` are big-endian and odd, so rows of
    them are byte strings that do not end in zero and can be compared as such.
    """
    place = ranges(starts, windows)
    rows = np.lib.stride_tricks.sliding_window_view(words, window)[place]
    # Most windows differ in a hash; only those that share one are compared in full.
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(window, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
        hashed = (rows.astype(np.uint64) * powers).sum(1, dtype=np.uint64)
    order = np.argsort(hashed, kind="stable")
    sorted_ = hashed[order]
    near = np.zeros(len(order), bool)
    same = sorted_[1:] == sorted_[:-1]
    near[1:] |= same
    near[:-1] |= same
    some = order[near]
    keys = np.ascontiguousarray(rows[some]).view(f"S{window * rows.itemsize}")[:, 0]
    _, first, count = np.unique(keys, return_index=True, return_counts=True)
    return place[some[first[count > 1]]]


def covered(rows: DataFrame, window: int = 20, piece: int = 5, hot: int = HOT) -> DataFrame:
    """``ka, kb, start, end``: the words covered by phrases that also start earlier."""
    unit = Unit(True, window, piece)
    cut = segments(rows, unit, hot)

    def solve(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        lists = [
            [number.setdefault(w, len(number) + 1) for w in s.split()] for s in batch.column("segment").to_pylist()
        ]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        starts = np.cumsum(size) - size
        words = np.array([w for own in lists for w in own], np.int64)
        wide = ((words << 1) | 1).astype(">u4")
        windows = batch.column("windows").to_numpy().astype(np.int64)
        phrase_at = recurring(wide, starts, windows, window)
        if not len(phrase_at):
            return
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, at in enumerate(phrase_at.tolist()):
            automaton.add_word(tuple(words[at : at + window].tolist()), i)
        automaton.make_automaton()
        owner, end, phrase = [], [], []
        for i, own in enumerate(lists):
            for last, found in automaton.iter(tuple(own)):
                owner.append(i)
                end.append(last)
                phrase.append(found)
        owner, phrase = np.array(owner, np.int64), np.array(phrase, np.int64)
        start = batch.column("first").to_numpy()[owner] + np.array(end, np.int64) - window + 1
        ids = batch.column("doc_id")
        doc = ids.fill_null(-(2**63)).to_numpy()[owner]
        order = np.lexsort((start, doc, phrase))
        phrase, doc, start, owner = phrase[order], doc[order], start[order], owner[order]
        head = np.flatnonzero(np.concatenate(([True], phrase[1:] != phrase[:-1])))
        of = np.repeat(head, np.diff(np.append(head, len(phrase))))
        later = (doc != doc[of]) | (start != start[of])
        a, b, own = merged(start[later], start[later] + window, owner[later])
        at = pa.array(own)
        yield pa.RecordBatch.from_arrays(
            [batch.column("ka").take(at), batch.column("kb").take(at), pa.array(a), pa.array(b)],
            ["ka", "kb", "start", "end"],
        )

    ranges_ = by_name(cut, solve, "ka long, kb long, start long, end long", _WINDOWS)
    return ranges_.unionByName(hot_ranges(rows, unit, hot, later=True))
