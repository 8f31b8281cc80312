"""Spelling variants by permuterm rotations.

The rotations of a word, marked with a terminator, are ``w[j:] + "$" + w[:j]``. Take the rotation that
starts behind the letter ``x`` of ``a x c``: it is ``c $ a x``, so all words that differ from it only in
``x`` share the prefix ``c $ a`` at the same length, and the word without ``x`` has ``c $ a`` as a whole
rotation. Replacements and single insertions or deletions thus are prefix ranges that skip the letter.

Each rotation is entered whole and without its last letter. Spark deals the entries by their text and
sorts them, and one scan of each group gives every word its number of neighbours there and the most
frequent of them, without writing pairs. A group has at most one word for each letter of the alphabet
and one without. A word that can be deleted from at several places of a run of one letter meets the
shorter word in several groups; it counts at the first of them.

Texts of entries up to ``TEXT_KEY`` code points are compared themselves. Those of longer words, whose
rotations would grow with the square of the word, are compared by a polynomial hash modulo the prime
2^127 - 1, a few steps for each rotation.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import checkpoint

#: Entries up to this many code points are kept as text.
TEXT_KEY = 101
_PRIME = (1 << 127) - 1
_BASE = 0x2545F4914F6CDD1D9E3779B97F4A7C15
_ROWS = 20_000
_ENTRY = "key string, id long, n long, leads boolean"


def words(docs: DataFrame, min_length: int = 7, min_count: int = 2, noise: int = 31) -> DataFrame:
    """``word, n``: the runs of letters of all texts, A to Z in lower case, with their occurrences.

    Where ``noise`` divides the crc32 of ``<doc_id>:<run>``, the run loses the code point at crc32
    modulo its length; ``noise`` 0 leaves all as they are. A null ``doc_id`` is written as nothing.
    """
    run = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{min_length},}}"), F.lit(0))
    # A shorter run cannot become longer, and a longer one is never matched in part.
    runs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(run).alias("run"))
    word = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    rows = runs.select("doc_id", word.alias("word"))
    if noise:
        rows = rows.withColumn("h", F.crc32(F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":"), F.col("word"))))
        at = F.expr("CAST(h % char_length(word) AS INT)")
        less = F.concat(F.substring("word", F.lit(1), at), F.expr("substring(word, 2 + CAST(h % char_length(word) AS INT))"))
        rows = rows.select(F.when(F.col("h") % noise == 0, less).otherwise(F.col("word")).alias("word"))
    rows = rows.filter(F.char_length("word") >= min_length)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def rotations(numbered: DataFrame) -> DataFrame:
    """``key, id, n, leads``: whole rotations (``leads`` null) and rotations without their last letter,
    with whether that letter differs from the one before it in the word."""
    size = F.char_length("word")
    turned = numbered.filter(size <= TEXT_KEY).select(
        "id", "n", size.alias("size"), "word", F.explode(F.sequence(F.lit(0), size)).alias("j")
    )
    turned = turned.withColumn("rotation", F.expr("concat(substring(word, j + 1), '$', substring(word, 1, j))"))
    entry = F.array(
        F.when(F.col("size") < TEXT_KEY, F.struct(F.col("rotation").alias("key"), F.lit(None).cast("boolean").alias("leads"))),
        F.when(
            F.col("j") > 0,
            F.struct(
                F.expr("substring(rotation, 1, size)").alias("key"),
                F.expr("substring(rotation, -1, 1) <> substring(rotation, -2, 1)").alias("leads"),
            ),
        ),
    )
    short = turned.select("id", "n", F.explode(entry).alias("e")).filter("e IS NOT NULL").select("e.key", "id", "n", "e.leads")
    long = numbered.filter(size >= TEXT_KEY).select("word", "id", "n").mapInArrow(_hashed, _ENTRY)
    return short.unionByName(long)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of over ``TEXT_KEY`` code points, by hash."""
    for batch in batches:
        for word, own, n in zip(*(c.to_pylist() for c in batch.columns)):
            size = len(word)
            codes = [*map(ord, word)]
            upto, power = [0], [1]
            for c in codes:
                upto.append((upto[-1] * _BASE + c) % _PRIME)
                power.append(power[-1] * _BASE % _PRIME)

            def name(head: int, tail: int) -> str:
                """Of ``word[tail:] + "$" + word[:head]``."""
                back = upto[size] - upto[tail] * power[size - tail]
                value = ((back * _BASE + 36) * power[head] + upto[head]) % _PRIME
                return f"{size - tail + head + 1}#{value:032x}"

            def entries() -> Iterator[tuple[str, bool | None]]:
                for j in range(size + 1):
                    yield name(j, j), None
                    if j and size > TEXT_KEY:
                        yield name(j - 1, j), j < 2 or codes[j - 1] != codes[j - 2]

            found = entries()
            while some := [e for _, e in zip(range(_ROWS), found)]:
                key, leads = zip(*some)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key, pa.string()), pa.array([own] * len(key), pa.int64()),
                        pa.array([n] * len(key), pa.int64()), pa.array(leads, pa.bool_()),
                    ],
                    ["key", "id", "n", "leads"],
                )


def neighbours(numbered: DataFrame) -> DataFrame:
    """``id, n_near, best_n, best_id``: for each word with a near one how many it has, and of them the
    one with the largest ``n``, then the smallest ``id``. ``id`` must ascend with ``word``."""
    group = Window.partitionBy("key")
    ranked = group.orderBy(F.desc("n"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rotations(numbered).select(
        "id", "n", "leads",
        F.count(F.lit(1)).over(ranked).alias("members"),
        F.count("leads").over(ranked).alias("longer"),
        F.count_if("leads").over(ranked).alias("leading"),
        F.first(F.struct("n", "id")).over(ranked).alias("one"),
        F.nth_value(F.struct("n", "id"), 2).over(ranked).alias("two"),
    ).filter("members > 1")
    own = F.when(F.col("leads").isNull(), F.col("leading")).otherwise(
        F.col("longer") - 1 + F.when(F.col("leads"), F.col("members") - F.col("longer")).otherwise(0)
    )
    best = F.when(F.col("one.id") == F.col("id"), F.col("two")).otherwise(F.col("one"))
    rows = rows.select("id", own.alias("near"), (-best["n"]).alias("less"), best["id"].alias("best"))
    return rows.groupBy("id").agg(
        F.sum("near").alias("n_near"), F.min(F.struct("less", "best")).alias("best")
    ).select("id", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.best").alias("best_id"))


def roots(forms: DataFrame, largest: int, ratio: int) -> DataFrame:
    """``id, root``: the last of each chain of forms. Each form is ``ratio`` times as frequent as its
    word, so chains are short; each join doubles the steps that have been taken."""
    steps = 1
    while ratio**steps <= largest:
        steps += 1
    reached = forms.select("id", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        further = reached.select(F.col("id").alias("root"), F.col("root").alias("next"))
        reached = reached.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    return reached


def variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, noise: int = 31, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of ``words``.

    Two words are near if one code point inserted, deleted or replaced makes one of the other. The form
    of a word is its near word of largest ``n``, the smallest in code-point order among equals, where
    that is ``ratio`` times its own ``n`` or more. Null and empty texts have no word; repeated rows count
    again; other columns are ignored; without words there are no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 at least, or chains of forms might not end")
    # Numbers that ascend with the words; written once, so that they stay the same.
    numbered = checkpoint(
        words(docs, min_length, min_count, noise).orderBy("word").withColumn("id", F.monotonically_increasing_id())
    )
    found = numbered.join(neighbours(numbered), "id", "left")
    has_form = F.col("best_n") >= ratio * F.col("n")
    found = checkpoint(
        found.select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(has_form, F.col("best_id")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n"),
        )
    )
    largest = found.agg(F.max("n")).first()[0] or 0
    forms = found.filter("form IS NOT NULL").select("id", "form")
    chains = forms.join(roots(forms, largest, ratio), "id")
    name = numbered.select("id", "word")
    chains = chains.join(name.select(F.col("id").alias("form"), F.col("word").alias("form_word")), "form")
    chains = chains.join(name.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
    return found.join(chains.select("id", "form_word", "root_word"), "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )
