"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector is turned by a random rotation, after padding to ``BITS_PER_DIM`` times its length, and the
signs are kept: packed bits, and two scalars that correct the estimate and bound its error. A query,
turned likewise and held to four bits a component, meets a code in bit counts alone. The estimate is
unbiased; it is off by more than ``confidence`` standard errors only by rare chance. Original vectors
are read for those whose estimate plus bound reaches the k-th best exact product so far.

The index covers every vector. Equal vectors are one entry with their smallest ids, so a vector that
a third of all rows share is searched once. Entries are dealt to slots of bounded size; each slot
streams all queries past its codes in blocks and gives back its own k best, so the set of queries
grows with the data without being collected or broadcast.

Vectors that are null, zero, or hold null or non-finite components take no part; nor do rows without
id. Repeated ids count once, with the smallest of their vectors. Vectors of another length than the
query's are no candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS_PER_DIM = 4
#: Entries in a slot, at most about; about 0.1 GB of a task at 64 components.
SLOT_ROWS = 262_144
_QUERIES, _CODES = 64, 8192


def usable(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, embedding`` (doubles) of the vectors that take part, one row for each id."""
    v = F.col("embedding")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & good & F.exists(v, lambda x: x != 0))
    return kept.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def rotation(dim: int, seed: int) -> np.ndarray:
    """Orthonormal columns: the part of a random rotation of padded vectors that meets no zeros."""
    bits = 64 * math.ceil(BITS_PER_DIM * dim / 64)
    normal = np.random.default_rng([seed, dim]).normal(size=(bits, dim))
    q, r = np.linalg.qr(normal)
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, the scale of the estimate, and its standard error for a query of length one."""
    bits = len(turn)
    length = np.sqrt((x * x).sum(1))
    z = (x / length[:, None]) @ turn.T
    align = np.abs(z).sum(1) / np.sqrt(bits)
    codes = np.packbits(z > 0, axis=1, bitorder="little").view("<u8")
    error = length * np.sqrt(np.maximum(1 - align**2, 0)) / align / np.sqrt(bits - 1)
    return codes, length / align, error


def estimate(q: np.ndarray, turn: np.ndarray, codes: np.ndarray, scale: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries and codes, and their standard errors."""
    bits = len(turn)
    z = q @ turn.T
    low = z.min(1)
    step = np.maximum((z.max(1) - low) / 15, 1e-300)
    level = np.rint((z - low[:, None]) / step[:, None]).astype(np.uint8)
    counted = np.zeros((len(q), len(codes)), np.float32)
    for j in range(4):
        plane = np.packbits((level >> j) & 1, axis=1, bitorder="little").view("<u8")
        ones = np.zeros((len(q), len(codes)), np.uint16)
        for w in range(codes.shape[1]):
            ones += np.bitwise_count(plane[:, w, None] & codes[None, :, w])
        counted += ones * np.float32(1 << j)
    set_bits = np.bitwise_count(codes).sum(1)
    all_ = low * bits + step * level.sum(1)
    product = 2 * (low[:, None] * set_bits + step[:, None] * counted) - all_[:, None]
    length = np.sqrt((q * q).sum(1))
    spread = np.sqrt((length[:, None] * error) ** 2 + (step[:, None] / np.sqrt(12) * scale) ** 2)
    return product / np.sqrt(bits) * scale, spread


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in doubles, added from the first component to the last."""
    return np.cumsum(a * b, axis=1)[:, -1]


def best_of(query: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's ``k`` best: largest score, then smallest name."""
    order = np.lexsort((name, -score, query))
    owner = query[order]
    heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else owner
    nth = np.arange(len(owner)) - np.repeat(heads, np.diff(np.append(heads, len(owner))))
    return order[nth < k]


def search_slot(q: np.ndarray, vectors: np.ndarray, names: np.ndarray, coded: tuple, turn: np.ndarray, k: int, confidence: float):
    """Query number, name and exact score of each query's ``k`` best in one slot."""
    own, score, name = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    least = np.full(len(q), -np.inf)
    codes, scale, error = coded
    for at in range(0, len(vectors), _CODES):
        part = slice(at, at + _CODES)
        guess, spread = estimate(q, turn, codes[part], scale[part], error[part])
        first = np.zeros(guess.shape, bool)
        if np.isneginf(least).any():
            n = min(2 * k, guess.shape[1])
            likely = np.argpartition(-guess, n - 1, axis=1)[:, :n]
            np.put_along_axis(first, likely, True, axis=1)
            qi, vi = np.nonzero(first)
            exact = products(vectors[part][vi], q[qi])
            own, score, name = np.append(own, qi), np.append(score, exact), np.append(name, names[part][vi])
            kept = best_of(own, score, name, k)
            own, score, name = own[kept], score[kept], name[kept]
            full = np.bincount(own, minlength=len(q)) >= k
            least = np.where(full, _least(own, score, len(q)), -np.inf)
        qi, vi = np.nonzero((guess + confidence * spread >= least[:, None]) & ~first)
        if len(qi):
            exact = products(vectors[part][vi], q[qi])
            use = exact >= least[qi]
            own, score, name = np.append(own, qi[use]), np.append(score, exact[use]), np.append(name, names[part][vi[use]])
            kept = best_of(own, score, name, k)
            own, score, name = own[kept], score[kept], name[kept]
            full = np.bincount(own, minlength=len(q)) >= k
            least = np.where(full, _least(own, score, len(q)), -np.inf)
    return own, name, score


def _least(own: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, np.inf)
    np.minimum.at(out, own, score)
    return out


def build_index(vectors: DataFrame, keep: int, seed: int = 17) -> DataFrame:
    """``entry, ids, dim, code, scale, error, embedding``: an entry for each distinct vector of
    ``usable`` rows, named by its smallest id, with its ``keep`` smallest ids."""
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    entries = (
        vectors.withColumn("nth", nth).filter(F.col("nth") <= keep)
        .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .select(F.col("ids")[0].alias("entry"), "ids", F.size("embedding").alias("dim"), "embedding")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            for d in np.unique(dim).tolist():
                part = batch.take(pa.array(np.flatnonzero(dim == d)))
                x = part.column("embedding").flatten().to_numpy().reshape(-1, d)
                turn = turns.setdefault(d, rotation(d, seed) if d not in turns else None)
                codes, scale, error = encode(x, turn)
                code = pa.array([c.tobytes() for c in codes], pa.binary())
                columns = [part.column(c) for c in ("entry", "ids", "dim")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, code, pa.array(scale), pa.array(error), part.column("embedding")],
                    ["entry", "ids", "dim", "code", "scale", "error", "embedding"],
                )

    return entries.mapInArrow(
        run, "entry long, ids array<long>, dim int, code binary, scale double, error double, embedding array<double>"
    )


def search(index: DataFrame, queries: DataFrame, k: int, seed: int = 17, confidence: float = 3.0, slots: int | None = None) -> DataFrame:
    """``query, entry, score``: the ``k`` best entries of ``index`` for each of the distinct vectors
    ``queries`` (``query``, ``embedding``), in no order."""
    spark = index.sparkSession
    if slots is None:
        slots = max(math.ceil(index.count() / SLOT_ROWS), 2 * spark.sparkContext.defaultParallelism)
    code = index.select(
        F.pmod(F.xxhash64("entry"), F.lit(slots)).alias("slot"), F.lit(0).alias("kind"), "dim",
        F.col("entry").alias("name"), "code", "scale", "error", "embedding",
    )
    asked = queries.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot"), F.lit(1).alias("kind"),
        F.size("embedding").alias("dim"), F.col("query").alias("name"), F.lit(None).cast("binary").alias("code"),
        F.lit(0.0).alias("scale"), F.lit(0.0).alias("error"), "embedding",
    )
    schema = "query long, entry long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, waiting, turn = None, [], [], None
        slot = None

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal slot
            if held and waiting:
                d = key[0]
                if slot is None:
                    names = np.concatenate([h[0] for h in held])
                    coded = tuple(np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
                    slot = np.concatenate([h[4] for h in held]), names, coded
                names = np.concatenate([w[0] for w in waiting])
                q = np.concatenate([w[1] for w in waiting]).reshape(-1, d)
                for at in range(0, len(q), _QUERIES):
                    own, entry, score = search_slot(q[at : at + _QUERIES], *slot, turn, k, confidence)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[at : at + _QUERIES][own]), pa.array(entry), pa.array(score)], ["query", "entry", "score"]
                    )
            waiting.clear()

        for batch in batches:
            keys = list(zip(batch.column("dim").to_pylist(), batch.column("slot").to_pylist(), batch.column("kind").to_pylist()))
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(keys)]):
                part, (d, s, kind) = batch.slice(a, b - a), keys[a]
                if (d, s) != key:
                    yield from answer()
                    if key is None or key[0] != d:
                        turn = rotation(d, seed)
                    key, slot = (d, s), None
                    held.clear()
                names = part.column("name").to_numpy()
                x = part.column("embedding").flatten().to_numpy()
                if kind == 0:
                    packed = np.frombuffer(b"".join(part.column("code").to_pylist()), "<u8").reshape(len(names), -1)
                    held.append((names, packed, part.column("scale").to_numpy(), part.column("error").to_numpy(), x.reshape(-1, d)))
                else:
                    waiting.append((names, x))
                    if sum(len(w[0]) for w in waiting) >= 8 * _QUERIES:
                        yield from answer()
        yield from answer()

    # Codes come before queries in each slot.
    dealt = code.unionByName(asked).repartition(slots, "dim", "slot").sortWithinPartitions("dim", "slot", "kind")
    found = dealt.mapInArrow(run, schema)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    return found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k).drop("nth")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, seed: int = 17, confidence: float = 3.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` (``vec_id``, ``embedding``; both
    sides as of ``usable``) the ``k`` nearest of ``vectors`` besides itself, ties to the smaller id."""
    index = build_index(vectors, k + 1, seed)
    asked = queries.groupBy("embedding").agg(F.min("vec_id").alias("query"))
    found = search(index, asked, k + 1, seed, confidence)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ids = (
        found.join(index.select("entry", "ids"), "entry")
        .select("query", "score", F.explode("ids").alias("vec_id"))
        .withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1).drop("nth")
    )
    members = queries.select(F.col("vec_id").alias("query_id"), "embedding").join(asked, "embedding").select("query_id", "query")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        members.join(ids, "query").filter("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
