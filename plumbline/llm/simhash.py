"""Near-duplicates by SimHash: a binary trie self-join finds the fingerprints that lie close.

A fingerprint bit is 1 where over half the shingle hashes have it. Fingerprints at ``max_bits``
differing bits or fewer are linked; a group is what links reach.

The self-join walks pairs of trie nodes together, adds up the bits in which they differ, and leaves
a pair as soon as the budget is exceeded. To deal the trie out, 64 bits are cut into
``max_bits + 2`` blocks. Two linked fingerprints agree in two blocks at least, so each pair of
blocks heads one trie, whose first levels spend no budget: the value of the two blocks names a
subtree, and subtrees are what tasks get. Subtrees hold distinct fingerprints of 8 bytes, about one
in two million of all, and grow with no single text, source or group of copies.

A task gives back a spanning forest of each subtree, not all its pairs. Node pairs that are known to
be connected are left as well, so a dense ball of near copies costs little.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .frames import checkpoint, join_counts, slices, texts

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Rows that are walked at once, and node pairs.
_ROWS, _PAIRS = 1 << 16, 1 << 20


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned. Words are split at ASCII white space after A-Z went to a-z; no words: zero."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())]
    array = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(array), 1 << 16):
        part = array[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(array)).tolist())


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp`` of each row; ``fp`` is the fingerprint as a signed long. Null text: empty.
    ``keep`` names further columns, all long, that are handed through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle, seed) for t in texts(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fps.view(np.int64)), *(batch.column(c) for c in keep)],
                ["doc_id", "fp", *keep],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep)
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *keep)))


def _blocks(n: int) -> list[tuple[int, int]]:
    """Width and lowest bit of ``n`` blocks that make up 64 bits."""
    cuts = [64 * i // n for i in range(n + 1)]
    return [(b - a, a) for a, b in zip(cuts, cuts[1:])]


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of ``a[i]`` and ``b[i]``; a class is named by its smallest index."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        np.minimum.at(label, np.maximum(la, lb)[open_], np.minimum(la, lb)[open_])
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def trie_forest(keys: np.ndarray, values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all values within ``max_bits`` of one another under the same key.

    ``values`` are distinct under a key. Returned are index pairs, a spanning forest.
    """
    order = np.lexsort((values, keys))
    value, key = values[order], keys[order]
    n = len(value)
    label = np.arange(n)
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    ends = np.concatenate((heads[1:], [n]))
    roots = np.stack((heads, ends, heads, ends), 1)[ends - heads > 1]
    ones: dict[int, np.ndarray] = {}

    def split(lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
        if level not in ones:
            bit = (value >> np.uint64(63 - level)) & np.uint64(1)
            ones[level] = np.concatenate(([0], np.cumsum(bit.astype(np.int64))))
        return hi - (ones[level][hi] - ones[level][lo])

    for budget in range(1, max_bits + 1):
        if not len(roots):
            break
        changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        stack = [(0, roots, np.zeros(len(roots), np.int64))]
        found_a, found_b = [], []
        while stack:
            level, node, spent = stack.pop()
            if len(node) > _PAIRS:
                half = len(node) // 2
                stack += [(level, node[:half], spent[:half]), (level, node[half:], spent[half:])]
                continue
            a, a_end, b, b_end = node.T
            joined = (label[a] == label[b]) & (changes[a_end - 1] == changes[a]) & (changes[b_end - 1] == changes[b])
            single = (a_end - a == 1) & (b_end - b == 1)
            leaf = single & ~joined
            if leaf.any():
                near = np.bitwise_count(value[a[leaf]] ^ value[b[leaf]]) <= budget
                found_a.append(a[leaf][near])
                found_b.append(b[leaf][near])
            go = ~(joined | single)
            if not go.any() or level > 63:
                continue
            a, a_end, b, b_end, spent = a[go], a_end[go], b[go], b_end[go], spent[go]
            a_mid, b_mid = split(a, a_end, level), split(b, b_end, level)
            same = (a == b) & (a_end == b_end)
            parts, costs = [], []
            for x, x_end, y, y_end, cost, keep in (
                (a, a_mid, b, b_mid, 0, None),
                (a_mid, a_end, b_mid, b_end, 0, None),
                (a, a_mid, b_mid, b_end, 1, None),
                (a_mid, a_end, b, b_mid, 1, ~same),
            ):
                use = (x < x_end) & (y < y_end) & (spent + cost <= budget)
                use &= ~((x == y) & (x_end - x == 1))
                if keep is not None:
                    use &= keep
                parts.append(np.stack((x, x_end, y, y_end), 1)[use])
                costs.append(spent[use] + cost)
            if sum(map(len, parts)):
                stack.append((level + 1, np.concatenate(parts), np.concatenate(costs)))
        if found_a:
            label = _unite(label, np.concatenate(found_a), np.concatenate(found_b))
    child = np.flatnonzero(label != np.arange(n))
    return order[child], order[label[child]]


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """``src, dst``: links between the distinct values of ``fps.fp`` that leave no pair at
    ``max_bits`` or fewer differing bits unconnected. Every link returned is a true one, or follows
    from true ones."""
    if not 1 <= max_bits <= 8:
        raise ValueError("max_bits must be from 1 to 8")
    blocks = _blocks(max_bits + 2)
    fp = F.col("fp")
    heads = []
    for number, pair in enumerate(combinations(blocks, 2)):
        key = F.lit(number).cast("long")
        for width, low in pair:
            bits = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key = F.shiftleft(key, width).bitwiseOR(bits)
        heads.append(key)
    dealt = fps.select("fp").distinct().select("fp", F.explode(F.array(*heads)).alias("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def walk(whole: bool) -> Iterator[pa.RecordBatch]:
            head = np.concatenate([h for h, _ in held])
            value = np.concatenate([v for _, v in held])
            stop = len(head) if whole else int(np.searchsorted(head, head[-1], side="left"))
            held[:] = [(head[stop:], value[stop:])]
            if stop:
                a, b = trie_forest(head[:stop], value[:stop], max_bits)
                pairs = [pa.array(value[x].view(np.int64)) for x in (a, b)]
                yield pa.RecordBatch.from_arrays(pairs, ["src", "dst"])

        size = 0
        for batch in batches:
            head = batch.column("head").to_numpy(zero_copy_only=False)
            value = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            held.append((head, value))
            size += len(head)
            if size >= _ROWS:
                yield from walk(False)
                size = 0
        if held:
            yield from walk(True)

    # Sorted by head, so that a subtree comes in one run however the batches are cut.
    spread = dealt.repartition(F.col("head")).sortWithinPartitions("head")
    return spread.mapInArrow(run, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per row of ``docs``.

    ``fingerprint`` is 16 hex digits; ``component_id`` the smallest ``doc_id`` that links reach (null
    if no row of the group has one). Null and empty texts have fingerprint zero and are linked like
    others. Repeated rows come back as often as they went in; other columns are ignored.
    """
    return _grouped(docs, shingle, max_bits).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _grouped(docs: DataFrame, shingle: int, max_bits: int, keep: tuple[str, ...] = ()) -> DataFrame:
    rows = checkpoint(fingerprints(docs, shingle, keep=keep))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    labels = components(links(classes, max_bits))
    named = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("component", "fp")
    )
    # One row per distinct fingerprint: a group of very many is split by ``join_counts``.
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = join_counts(named, smallest, "root").select("fp", "root", "component_id")
    return rows.join(ids, "fp")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs``, one of each group: that with the smallest ``doc_id`` (null last), among
    repeated ids that with the smallest text hash. All columns stay as they are.

    Rows are told apart by their id and 128 bits of their text; rows that agree in both are repeats.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row_key = {"_id": F.col("doc_id").cast("long"), "_ta": F.xxhash64(text), "_tb": F.xxhash64(F.lit(1), text)}
    grouped = _grouped(docs.select("doc_id", "text", *(c.alias(n) for n, c in row_key.items())), shingle, max_bits, tuple(row_key))
    order = F.struct(F.col("_id").isNull().alias("no_id"), *row_key)
    chosen = grouped.groupBy("root").agg(F.min(order).alias("kept")).select(
        *(F.col(f"kept.{n}").alias(f"kept{n}") for n in row_key)
    )
    whole = docs.select(F.struct("*").alias("row"), *(c.alias(n) for n, c in row_key.items()))
    same = [F.col(n).eqNullSafe(F.col(f"kept{n}")) for n in row_key]
    found = whole.join(chosen, same, "left_semi")
    nth = F.row_number().over(Window.partitionBy(*row_key).orderBy("_ta"))
    return found.withColumn("nth", nth).filter("nth = 1").select("row.*")
