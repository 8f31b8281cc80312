"""Benchmark decontamination: passages of documents within a word edit distance of benchmark items.

An item of m words is looked for in windows of m words, at every word of every text. Words are runs
of letters and digits in lower case, so layout and punctuation don't matter.

1. Counting: a window within e edits of an item shares at least m - q + 1 - q * e runs of q words with
   it, for q of 1 to 3. Windows that have fewer such runs of any item, or fewer of items of their
   size, cannot match and are left; none is lost.
2. CGK: a random walk copies a window into a string of 3m symbols, at each step going on to the next
   word or not, by a random bit of step and word. Strings at a small edit distance become strings at
   a small Hamming distance.
3. Bit sampling: each of some walks is sampled at a few places, the sample is the hash key, and
   windows that share a key with an item of their size are candidates. How many repeats a size needs
   for ``target_recall`` is measured with the walks themselves, on copies of its items with all the
   edits they may have. Where it is more than ``MAX_REPEATS``, windows are compared with every item.
4. The word edit distance of each candidate is computed exactly.

Items are taken in blocks of at most ``BLOCK_WORDS`` words, which travel to the tasks; each block is
one pass. Documents are neither shuffled nor collected.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat as repeat_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import mix, slices, texts

#: Words of items that one pass holds in a task.
BLOCK_WORDS = 2_000_000
_WORD = re.compile(r"[^\W_]+")
_SAMPLED = 3
#: Repeats that every size has, however few reach the target.
LEAST_REPEATS = 40
#: Repeats from which comparing a window with all items of its size is no dearer than walking on.
MAX_REPEATS = 200
#: Edited copies of the items of a size on which its repeats are measured.
_COPIES = 1_000
#: Text bytes that are searched at once.
_BATCH = 16 << 20
#: Longest run of words that is counted. Word numbers fit 21 bits, so that a run is one number.
_RUN = 3


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def runs_of(symbols: np.ndarray, q: int) -> np.ndarray:
    """The runs of ``q`` words at each place, as numbers."""
    n = max(0, len(symbols) - q + 1)
    return sum(symbols[i : i + n] << (21 * (q - 1 - i)) for i in range(q))


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted ``table``."""
    return np.append(table, -1)[np.searchsorted(table, values)] == values


def edit_distances(item: np.ndarray, windows: np.ndarray, length: np.ndarray | None = None) -> np.ndarray:
    """Word edit distance of ``item`` to each row of ``windows``, at the best end of the row."""
    width = windows.shape[1]
    steps = np.arange(width + 1)
    row = np.broadcast_to(steps, (len(windows), width + 1)).astype(np.int32)
    for i, symbol in enumerate(item, 1):
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (windows != symbol))
        # Insertions: the least of all earlier places plus the way from there.
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row


def apart(places: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of ``(edits, first word, words)`` the least, and on from there each that overlaps none before it."""
    chosen: list[tuple[int, int, int]] = []
    taken: list[tuple[int, int]] = []
    for edits, first, size in sorted(places):
        at = bisect(taken, (first, 0))
        if (not at or taken[at - 1][1] <= first) and (at == len(taken) or first + size <= taken[at][0]):
            taken.insert(at, (first, first + size))
            chosen.append((edits, first, size))
    return chosen


@dataclass
class Items:
    """A block of benchmark items, ready for tasks."""

    names: list[int]
    symbols: list[np.ndarray]
    vocabulary: dict[str, int]
    max_edit: float
    seed: int
    sizes: dict[int, list[int]] = field(default_factory=dict)
    #: Walks for each size; none where windows are compared with all items of the size.
    repeats: dict[int, int] = field(default_factory=dict)
    #: The sampled walks of the items of a size: a row for each repeat, as ``keys`` gives them.
    walks: dict[int, np.ndarray] = field(default_factory=dict)
    runs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[int, str]], max_edit: float, seed: int) -> Items:
        """Without ``repeats`` and ``walks``, which are made for each size by ``repeats_for``, ``walked``."""
        vocabulary: dict[str, int] = {}
        names, symbols = [], []
        for name, text in rows:
            found = words(text or "")
            if found:
                names.append(name)
                symbols.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in found], np.int64))
        items = cls(names, symbols, vocabulary, max_edit, seed)
        for i, s in enumerate(symbols):
            items.sizes.setdefault(len(s), []).append(i)
        for q in range(1, _RUN + 1):
            for size, members in [(0, range(len(symbols))), *items.sizes.items()]:
                own = [runs_of(symbols[i], q) for i in members if len(symbols[i]) >= q]
                items.runs[size, q] = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)
        return items

    def budget(self, size: int) -> int:
        return int(self.max_edit * size)

    def keys(self, windows: np.ndarray, repeat: int) -> np.ndarray:
        """The sampled symbols of each window's walk, as one number. Rows are windows of one size."""
        size = windows.shape[1]
        rng = np.random.default_rng([self.seed, size, repeat])
        places = np.sort(rng.choice(2 * size, min(_SAMPLED, 2 * size), replace=False)).tolist()
        # Past its end a window goes on with zeros. The bits of 64 steps of a word are one number.
        symbols = np.concatenate((windows, np.zeros((len(windows), 1), windows.dtype)), 1).astype(np.uint64).ravel()
        at = np.arange(len(windows)) * (size + 1)
        last = at + size
        key = np.zeros(len(windows), np.uint64)
        for step in range(places[-1] + 1):
            if step % 64 == 0:
                bits = mix(symbols + rng.integers(0, 2**63, dtype=np.uint64)).view(np.int64)
            if step in places:
                key = mix(key ^ mix(symbols.take(at) + np.uint64(step + 1)))
            at += (bits.take(at) >> (step % 64)) & 1
            np.minimum(at, last, out=at)
        return key

    def edited(self, size: int, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Item numbers, all of ``size`` in turn, and a window of that size for each, ``budget`` edits
        away: changed, added and removed words, the first ones included."""
        which = np.resize(self.sizes[size], n)
        copies = []
        for i in which:
            word = self.symbols[i].tolist()
            for _ in range(self.budget(size)):
                spot, what = int(rng.integers(len(word))), int(rng.integers(3))
                if what == 0:
                    word[spot] = -int(rng.integers(1, 1 << 30))
                elif what == 1:
                    word.insert(spot, -int(rng.integers(1, 1 << 30)))
                elif len(word) > 1:
                    del word[spot]
            copies.append((word + [0] * size)[:size])
        return which, np.array(copies, np.int64)

    def repeats_for(self, size: int, target: float) -> int:
        """How many walks make a share of ``target`` of the edited copies meet their items, or zero for
        more than ``MAX_REPEATS``.

        It is the share of copies that meet in none of the walks which counts, not the mean rate of a
        walk: copies whose edits are early seldom meet. Two standard errors are added to it.
        """
        if not self.budget(size):
            return 1  # equal windows have equal walks
        which, copies = self.edited(size, _COPIES, np.random.default_rng([self.seed, size]))
        members = np.array(self.sizes[size])
        rows = np.stack([self.symbols[i] for i in members])
        allowed = (1 - target) * len(copies)
        for repeat in range(MAX_REPEATS):
            own = dict(zip(members.tolist(), self.keys(rows, repeat).tolist()))
            apart = self.keys(copies, repeat) != np.array([own[i] for i in which.tolist()], np.uint64)
            which, copies = which[apart], copies[apart]
            if len(copies) + 2 * math.sqrt(len(copies)) <= allowed:
                return max(LEAST_REPEATS, repeat + 1)
        return 0

    def walked(self, size: int, repeats: int) -> np.ndarray:
        rows = np.stack([self.symbols[i] for i in self.sizes[size]])
        return np.array([self.keys(rows, r) for r in range(repeats)], np.uint64).reshape(repeats, len(rows))

    def finder(self, every_place: bool = False) -> Callable[[list[str]], list[tuple[int, int, int, int, int]]]:
        """A function of texts to ``(text number, item number, first word, words, edits)``: the best
        place of each item in each text, fewest edits first, then leftmost, then shortest; or with
        ``every_place`` all in that order that do not overlap."""
        margin = max((self.budget(s) for s in self.sizes), default=0)
        number = self.vocabulary.get
        tables = {}
        for size, members in self.sizes.items():
            order = np.argsort(self.walks[size], axis=1, kind="stable")
            sorted_ = np.take_along_axis(self.walks[size], order, 1)
            for repeat in range(self.repeats[size]):
                tables[size, repeat] = sorted_[repeat], np.array(members)[order[repeat]]
        longest = max(self.sizes, default=0)

        def find(batch: list[str]) -> list[tuple[int, int, int, int, int]]:
            symbols, starts = [], [0]
            for t in batch:
                own = list(map(number, words(t), repeat_(0)))
                symbols.append(np.array(own, np.int64))
                symbols.append(np.zeros(margin, np.int64))
                starts.append(starts[-1] + len(own) + margin)
            symbols.append(np.zeros(longest, np.int64))
            flat = np.concatenate(symbols)
            ends = np.array(starts[1:]) - margin
            starts = np.array(starts[:-1])
            # A run can only be an item's if the shorter run at its place is.
            found = flat > 0
            counts = {1: np.concatenate(([0], np.cumsum(found)))}
            for q in range(2, _RUN + 1):
                at = np.flatnonzero(found[: len(flat) - q + 1])
                found = np.zeros(len(flat), bool)
                run = sum(flat[at + i] << (21 * (q - 1 - i)) for i in range(q))
                found[at] = _among(run, self.runs[0, q])
                counts[q] = np.concatenate(([0], np.cumsum(found)))
            total = len(flat) - longest
            candidates: dict[int, list[np.ndarray]] = {}
            for size in self.sizes:
                budget = self.budget(size)
                at = None
                for q in range(min(_RUN, size), 0, -1):
                    width, least = size - q + 1, size - q + 1 - q * budget
                    if at is None:
                        at = np.flatnonzero(counts[q][width : width + total] - counts[q][:total] >= least)
                    else:
                        at = at[counts[q][at + width] - counts[q][at] >= least]
                for a in range(0, len(at), 1 << 16):
                    some = at[a : a + (1 << 16)]
                    for q in range(min(_RUN, size), 0, -1):
                        width = size - q + 1
                        places_ = some[:, None] + np.arange(width)
                        run = sum(flat[places_ + i] << (21 * (q - 1 - i)) for i in range(q))
                        some = some[_among(run, self.runs[size, q]).sum(1) >= width - q * budget]
                    if not len(some):
                        continue
                    if not self.repeats[size]:
                        for item in self.sizes[size]:
                            candidates.setdefault(item, []).append(some)
                        continue
                    windows = flat[some[:, None] + np.arange(size)]
                    # Copies of a passage are walked once.
                    _, first, which = np.unique(
                        windows.view(f"V{8 * size}")[:, 0], return_index=True, return_inverse=True
                    )
                    windows, met = windows[first], set()
                    for repeat in range(self.repeats[size]):
                        keys = self.keys(windows, repeat)
                        table, members = tables[size, repeat]
                        lo = np.searchsorted(table, keys, side="left")
                        hi = np.searchsorted(table, keys, side="right")
                        for k in np.flatnonzero(hi > lo).tolist():
                            met.update((item, k) for item in members[lo[k] : hi[k]].tolist())
                    for item, k in met:
                        candidates.setdefault(item, []).append(some[which == k])
            verified: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
            for item, places in candidates.items():
                symbol = self.symbols[item]
                size, budget = len(symbol), self.budget(len(symbol))
                at = np.unique(np.concatenate(places))
                doc = np.searchsorted(starts, at, side="right") - 1
                for a in range(0, len(at), 1 << 12):
                    some, own = at[a : a + (1 << 12)], doc[a : a + (1 << 12)]
                    width = size + budget
                    places_ = some[:, None] + np.arange(width)
                    outside = places_ >= ends[own][:, None]
                    windows = np.where(outside, -1, flat[np.minimum(places_, len(flat) - 1)])
                    distance = edit_distances(symbol, windows)
                    distance[:, 1:][outside] = size + width
                    end = distance.argmin(1)
                    for k, (d, n) in enumerate(zip(distance[np.arange(len(some)), end].tolist(), end.tolist())):
                        if d <= budget:
                            verified.setdefault((int(own[k]), item), []).append((d, int(some[k] - starts[own[k]]), n))
            return [
                (d, self.names[i], at, n, e)
                for (d, i), places in sorted(verified.items())
                for e, at, n in (apart(places) if every_place else [min(places)])
            ]

        return find


def item_blocks(benchmark: DataFrame, max_edit: float, target_recall: float, seed: int) -> Iterator[Items]:
    """The items in blocks of bounded size. Items that are null or have no word match nothing."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    count = F.size(F.split(F.trim("text"), r"\s+"))
    total = rows.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / BLOCK_WORDS))
    for block in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block)
        items = Items.of(sorted(map(tuple, part.collect()), key=str), max_edit, seed)
        if items.names:
            _measured(benchmark.sparkSession, items, target_recall)
            yield items


def _measured(spark: SparkSession, items: Items, target_recall: float) -> None:
    """Measure the repeats of each size and walk its items, in tasks, once for all searches. A row for
    each size comes back, 8 bytes for each item and repeat of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_pylist()
            repeats = [items.repeats_for(s, target_recall) for s in sizes]
            walks = [items.walked(s, r).tobytes() for s, r in zip(sizes, repeats)]
            columns = [pa.array(sizes, pa.int64()), pa.array(repeats, pa.int64()), pa.array(walks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["size", "repeats", "walks"])

    # One after the other, so that long sizes are spread over the tasks.
    order = sorted(items.sizes)
    tasks = min(len(order), 4 * spark.sparkContext.defaultParallelism)
    numbers = spark.range(0, tasks, 1, tasks).select(
        F.explode(F.array(*(F.array(*map(F.lit, order[t::tasks])) for t in range(tasks)))[F.col("id").cast("int")]).alias("size")
    )
    for size, repeats, walks in numbers.select(F.col("size").cast("long")).mapInArrow(run, "size long, repeats long, walks binary").collect():
        items.repeats[size] = repeats
        items.walks[size] = np.frombuffer(walks, np.uint64).reshape(repeats, len(items.sizes[size]))


_HITS = "doc_id long, item_id long, first_word long, n_words long, edits long"


def leaks(
    docs: DataFrame, benchmark: DataFrame, max_edit: float = 0.2, target_recall: float = 0.98, seed: int = 7,
    every_place: bool = False,
) -> DataFrame:
    """``doc_id, item_id, first_word, n_words, edits``: for each row of ``docs`` and each item that it
    holds within ``max_edit`` edits a word, the best place, or with ``every_place`` all that do not
    overlap. Null and empty texts hold none; repeated rows give repeated results; without documents
    or items there are no rows."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for items in item_blocks(benchmark, max_edit, target_recall, seed):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            find = items.finder(every_place)
            for batch in slices(batches, limit=_BATCH):
                hits = find(texts(batch))
                doc, rest = [h[0] for h in hits], list(zip(*[h[1:] for h in hits])) or [[]] * 4
                ids = batch.column("doc_id").take(pa.array(doc, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(x, pa.int64()) for x in rest)],
                    ["doc_id", "item_id", "first_word", "n_words", "edits"],
                )

        found = rows.mapInArrow(run, _HITS)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], _HITS)


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, max_edit: float = 0.2, target_recall: float = 0.98, seed: int = 7
) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    for items in item_blocks(benchmark, max_edit, target_recall, seed):

        @F.pandas_udf("boolean")
        def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            find = items.finder()
            for text in batches:
                free = np.ones(len(text), bool)
                size, at = 0, 0
                lengths = [len(t or "") for t in text]
                for i, n in enumerate(lengths):
                    size += n
                    if size >= _BATCH or i + 1 == len(lengths):
                        found = find([t or "" for t in text.iloc[at : i + 1]])
                        free[[at + h[0] for h in found]] = False
                        size, at = 0, i + 1
                yield pd.Series(free)

        docs = docs.filter(clean(F.col("text").cast("string")))
    return docs
