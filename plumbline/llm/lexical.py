"""Ranked lexical search by dense blocked multiplication.

A document's score for an item is the sum over the item's terms, repeats included, of the term's
weight times its impact in the document, all of them whole numbers:

* weight ``floor(1000 * ln((2N + 2) / (2df + 1)))``
* impact ``(10^9 * tf) div (1000 * tf + 12 * m)``, ``m = 75 + (25 * n * N) div L``

with ``N`` documents that have a term, ``L`` terms in them, ``n`` in the document, ``df`` documents that
hold the term, ``tf`` times it stands in the document.

1. Items are taken in blocks of at most ``BLOCK_TERMS`` terms. Their vocabulary travels to the tasks,
   so what is broadcast is bounded by the block, not by the documents.
2. One pass over the documents counts ``N``, ``L`` and the ``df`` of the vocabulary, summed in tasks first.
3. A second pass deals documents into tiles. Their impacts stand in a dense matrix whose columns are
   the terms that both the tile and a tile of items have, at most ``TILE_TERMS`` at once; BLAS
   multiplies it with the items' weights in float64. Columns are cut so that no sum of a product
   reaches 2^53, so each partial sum is exact; partial sums are added in 64-bit integers.
4. Each task keeps the ``k`` best documents of each item. A document that equals the worst of them
   displaces it if its id is smaller, so a tile never decides a tie. A window over salted parts and
   one over what they keep pick the ``k`` best of all.

Documents are neither shuffled nor collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import slices

#: Terms of items, repeats included, that one pass over the documents holds in a task.
BLOCK_TERMS = 500_000
#: Items, documents and terms of one multiplication.
TILE_ITEMS, TILE_DOCS, TILE_TERMS = 256, 512, 4096
#: No impact reaches this, as ``12 * m`` is positive.
IMPACT_BOUND = 1_000_000
#: Bytes of one text whose terms are cut at once; longer texts are cut at a gap between terms.
_PIECE = 4 << 20
#: Parts of each item whose best are chosen before the best of all.
_SALTS = 32
_NULL_ID = -(2**63)

# A term is a run of digits, letters and bytes from 0x80; of these only A to Z change.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def pieces(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, as lists for about ``_PIECE`` bytes each."""
    raw = text.encode().translate(_FOLD)
    start = 0
    while len(raw) - start > _PIECE:
        end = raw.find(b" ", start + _PIECE)
        if end < 0:
            break
        yield raw[start:end].split()
        start = end
    yield (raw[start:] if start else raw).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def lengths_m(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """``75 + (25 * n * N) div L``, without overflow."""
    if len(n) and int(n.max()) * 25 * n_docs >= 2**63:
        return np.array([75 + 25 * x * n_docs // n_terms for x in n.tolist()], np.int64)
    return 75 + 25 * n * n_docs // max(n_terms, 1)


@dataclass
class ItemTile:
    """Weights of some items, entry by entry: row, position in ``terms``, weight times repeats."""

    first: int
    rows: int
    terms: np.ndarray
    row: np.ndarray
    at: np.ndarray
    value: np.ndarray


@dataclass
class Block:
    """Items of one pass. Terms are numbered from 1, so that 0 can stand for any other term."""

    item_ids: list[int | None]
    vocabulary: dict[bytes, int]
    counts: list[dict[int, int]]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    n_docs: int = 0
    n_terms: int = 0

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Block:
        block = cls([], {}, [])
        for item_id, text in rows:
            own: dict[int, int] = {}
            for piece in pieces(text or ""):
                for term in piece:
                    number = block.vocabulary.setdefault(term, len(block.vocabulary) + 1)
                    own[number] = own.get(number, 0) + 1
            if own:
                block.item_ids.append(item_id)
                block.counts.append(own)
        return block

    def weigh(self, n_docs: int, n_terms: int, df: dict[int, int]) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weights = np.array([0] + [weight(n_docs, df.get(i, 0)) for i in range(1, len(self.vocabulary) + 1)], np.int64)

    def tiles(self) -> list[ItemTile]:
        out = []
        for first in range(0, len(self.counts), TILE_ITEMS):
            own = self.counts[first : first + TILE_ITEMS]
            size = np.fromiter(map(len, own), np.int64, len(own))
            term = np.fromiter((t for c in own for t in c), np.int64, size.sum())
            repeats = np.fromiter((n for c in own for n in c.values()), np.int64, size.sum())
            terms, at = np.unique(term, return_inverse=True)
            value = self.weights[term] * repeats
            out.append(ItemTile(first, len(own), terms, np.repeat(np.arange(len(own)), size), at, value))
        return out


def exact_cuts(largest: np.ndarray, limit: int = TILE_TERMS) -> list[tuple[int, int]]:
    """Cut columns into runs of at most ``limit`` in which no row's products can sum to 2^53.

    ``largest`` is the largest weight in each column; a row's sum is at most that of these. A single
    column above the bound stands alone, for ``multiply`` to split.
    """
    cuts, start, total = [], 0, 0
    for i, v in enumerate(largest.tolist()):
        if i > start and (i - start >= limit or (total + v) * IMPACT_BOUND >= 2**53):
            cuts.append((start, i))
            start, total = i, 0
        total += v
    cuts.append((start, len(largest)))
    return cuts


def multiply(tile: ItemTile, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, width: int) -> np.ndarray:
    """Scores of the tile's items (rows) for ``n_docs`` documents, from the documents' term entries.

    ``width`` is one more than the largest term number.
    """
    scores = np.zeros((tile.rows, n_docs), np.int64)
    place = np.full(width, -1, np.int64)
    place[tile.terms] = np.arange(len(tile.terms))
    position = place[term]
    held = position >= 0
    doc, impact, position = doc[held], impact[held], position[held]
    used = np.unique(position)
    if not len(used):
        return scores
    # Compact: only terms that both sides have become columns.
    compact = np.full(len(tile.terms), -1, np.int64)
    compact[used] = np.arange(len(used))
    column, item_column = compact[position], compact[tile.at]
    both = item_column >= 0
    row, item_column, value = tile.row[both], item_column[both], tile.value[both]
    largest = np.zeros(len(used), np.int64)
    np.maximum.at(largest, item_column, value)
    for a, b in exact_cuts(largest):
        items = np.zeros((tile.rows, b - a))
        docs = np.zeros((b - a, n_docs))
        inside = (column >= a) & (column < b)
        docs[column[inside] - a, doc[inside]] = impact[inside]
        inside = (item_column >= a) & (item_column < b)
        r, c, rest = row[inside], item_column[inside] - a, value[inside]
        # A weight that is too large for one exact product is added in parts.
        most = (2**53 - 1) // IMPACT_BOUND
        while len(rest):
            items[:] = 0
            items[r, c] = np.minimum(rest, most)
            scores += (items @ docs).astype(np.int64)
            left = rest > most
            r, c, rest = r[left], c[left], rest[left] - most
    return scores


class Best:
    """The ``k`` best documents of each item so far: largest score, then smallest id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.worst_score = np.zeros(items, np.int64)
        self.worst_doc = np.full(items, -(2**63), np.int64)

    def add(self, first: int, scores: np.ndarray, doc_ids: np.ndarray) -> None:
        """``scores`` of items from ``first`` on. Items with fewer than ``k`` take any score above 0."""
        last = first + len(scores)
        bar, tie = self.worst_score[first:last, None], self.worst_doc[first:last, None]
        row, column = np.nonzero((scores > bar) | ((scores == bar) & (bar > 0) & (doc_ids < tie)))
        if not len(row):
            return
        item = np.concatenate((self.item, row + first))
        score = np.concatenate((self.score, scores[row, column]))
        doc = np.concatenate((self.doc, doc_ids[column]))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        heads = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
        rank = np.arange(len(item)) - np.repeat(heads, np.diff(np.append(heads, len(item))))
        keep = rank < self.k
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]
        full = np.flatnonzero(rank[keep] == self.k - 1)
        self.worst_score[self.item[full]], self.worst_doc[self.item[full]] = self.score[full], self.doc[full]


def blocks(items: DataFrame) -> Iterator[Block]:
    """The items in blocks of about ``BLOCK_TERMS`` terms, by a hash of the row."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    count = F.size(F.split("text", r"[^0-9A-Za-z\u0080-\x{10FFFF}]+"))
    total = rows.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / BLOCK_TERMS))
    for number in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == number)
        block = Block.of(sorted(map(tuple, part.collect()), key=lambda r: (str(r[0]), r[1] or "")))
        if block.counts:
            yield block


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> dict[int, int]:
    """Documents that hold each term of the vocabulary; at -1 those with a term, at -2 their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        df = np.zeros(len(vocabulary) + 1, np.int64)
        n_docs = n_terms = 0
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                held: set[int] = set()
                n = 0
                for terms in pieces(text or ""):
                    n += len(terms)
                    held.update(filter(None, map(number, terms)))
                n_docs += n > 0
                n_terms += n
                df[list(held)] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, -2, *some.tolist()], pa.int64()), pa.array([n_docs, n_terms, *df[some].tolist()], pa.int64())],
            ["term", "n"],
        )

    counts = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in counts.collect()}


def _scored(docs: DataFrame, block: Block, k: int) -> DataFrame:
    """``item, item_id, doc_id, score``: of each task the ``k`` best of each item of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, width = block.vocabulary.get, len(block.vocabulary) + 1
        tiles = block.tiles()
        best = Best(len(block.counts), k)
        for batch in slices(batches):
            ids = batch.column("doc_id").fill_null(_NULL_ID).to_numpy()
            all_texts = batch.column("text").to_pylist()
            for a in range(0, len(ids), TILE_DOCS):
                size, terms, owner = [], [], []
                for d, text in enumerate(all_texts[a : a + TILE_DOCS]):
                    n = 0
                    for piece in pieces(text or ""):
                        n += len(piece)
                        own = list(filter(None, map(number, piece)))
                        terms += own
                        owner.append((d, len(own)))
                    size.append(n)
                if not terms:
                    continue
                doc, held = np.array(owner, np.int64).T
                entry = np.repeat(doc, held) * width + np.array(terms, np.int64)
                entry, tf = np.unique(entry, return_counts=True)
                doc, term = entry // width, entry % width
                m = lengths_m(np.array(size, np.int64), block.n_docs, block.n_terms)
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
                for tile in tiles:
                    best.add(tile.first, multiply(tile, doc, term, impact, len(size), width), ids[a : a + TILE_DOCS])
        item_id = pa.array([block.item_ids[i] for i in best.item.tolist()], pa.int64())
        doc_id = pa.array(best.doc, pa.int64(), mask=best.doc == _NULL_ID)
        columns = [pa.array(best.item), item_id, doc_id, pa.array(best.score)]
        yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "doc_id", "score"])

    return docs.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item with a score above 0, the
    largest score first, ties by ascending ``doc_id`` (null, or -2^63, first).

    Null and empty texts have no term and are not counted. Each row of ``docs`` is a document and each
    row of ``items`` an item of its own, repeated or not; other columns are ignored. Without documents
    or items there are no rows. Texts are read twice for each block of items.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    best_first = [F.desc("score"), F.asc_nulls_first("doc_id")]
    out = None
    for block in blocks(items):
        counts = _counted(docs, block.vocabulary)
        if not counts.get(-1):
            break
        block.weigh(counts.pop(-1), counts.pop(-2), counts)
        rows = _scored(docs, block, k).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)))
        for keys in (["item", "part"], ["item"]):
            rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best_first)))
            rows = rows.filter(F.col("rank") <= k)
        rows = rows.select("item_id", "rank", "doc_id", "score")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
