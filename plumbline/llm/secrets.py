"""Secret scan behind a trigram inverted index.

Each rule is a regular expression. From its parse tree comes a Boolean query over trigrams that every
match must satisfy: AND of what must follow one another, OR of alternatives. ``build_index`` writes,
for each segment of the corpus (one Arrow batch of a scan task), the postings of the trigrams that
the rules ask for. ``candidates`` evaluates the queries on postings alone, by intersections and
unions in each segment. ``scan`` verifies the candidates with the real expressions. A rule whose
query is empty, because it has no mandatory trigram, is verified on every text.

Postings are cut by segment, so a trigram that is in every text still has no list longer than a
batch, and no group is larger than one segment's postings of the rules' trigrams.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser as sre_parse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import flat_bytes, slices, texts


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if ``group`` has ``min_length`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1


#: The rules of the contract, in its order. Fixed values.
BASE = (
    Rule(
        "assign",
        r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Kinds beside the contract's. Each begins at the start of a run and gives nothing back, so time grows
#: with the text.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("signed_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", 0, 40),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("url_login", r"(?<![a-z])[a-z]++://[^/\s:@]++:[^/\s:@]++@"),
)
RULES = BASE + MORE

# A query is True (anything may match), a trigram, or ("and" | "or", parts).
_MOST_STRINGS = 64


def _fold(code: int) -> str:
    return chr(code + 32) if 65 <= code <= 90 else chr(code)


def _all_of(parts) -> object:
    flat: list = []
    for p in parts:
        flat += p[1] if isinstance(p, tuple) and p[0] == "and" else [] if p is True else [p]
    flat = list(dict.fromkeys(flat))
    return True if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _any_of(parts) -> object:
    parts = list(dict.fromkeys(parts))
    if not parts or True in parts:
        return True
    # A way that asks for more than another one adds nothing.
    parts = [p for p in parts if not any(_asks(q) < _asks(p) for q in parts)]
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _asks(query: object) -> set[str]:
    """The trigrams of a plain AND; for comparison only."""
    plain = isinstance(query, str) or all(isinstance(p, str) for p in query[1]) and query[0] == "and"
    return {query} if isinstance(query, str) else set(query[1]) if plain else {str(query)}


def _of_strings(strings: set[str]) -> object:
    """What a text that holds one of ``strings`` must hold."""
    return _any_of([_all_of([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(tokens) -> list:
    """The parse tree as a sequence of sets of folded strings (exact), queries, and gaps (None)."""
    out: list = []
    for op, arg in tokens:
        if op is sre.LITERAL and arg < 128:
            out.append({_fold(arg)})
        elif op is sre.IN:
            members: set[str] = set()
            for kind, value in arg:
                if kind is sre.LITERAL and value < 128:
                    members.add(_fold(value))
                elif kind is sre.RANGE and value[1] < 128:
                    members |= {_fold(c) for c in range(value[0], value[1] + 1)}
                else:
                    members = set()
                    break
            out.append(members if 0 < len(members) <= 8 else None)
        elif op is sre.SUBPATTERN:
            out += _walk(arg[3])
        elif op is sre.BRANCH:
            ways = [_walk(way) for way in arg[1]]
            exact = [_exact(way) for way in ways]
            if all(x is not None for x in exact) and sum(map(len, exact)) <= _MOST_STRINGS:
                out.append(set().union(*exact))
            else:
                out += [None, ("query", _any_of([_query(way) for way in ways])), None]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, inner = arg
            once = _walk(inner)
            exact = _exact(once)
            if exact is not None and most == 1:
                out.append(exact | {""})
            elif least:
                out += once * min(least, 3) + ([] if least == most and least <= 3 else [None])
            else:
                out.append(None)
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        else:
            out.append(None)
    return out


def _exact(parts: list) -> set[str] | None:
    whole = {""}
    for p in parts:
        if not isinstance(p, set) or len(whole) * len(p) > _MOST_STRINGS:
            return None
        whole = {a + b for a in whole for b in p}
    return whole


def _query(parts: list) -> object:
    found, run = [], {""}
    for p in [*parts, None]:
        if isinstance(p, set) and len(run) * len(p) <= _MOST_STRINGS:
            run = {a + b for a in run for b in p}
            continue
        found.append(_of_strings(run))
        run = p if isinstance(p, set) else {""}
        if isinstance(p, tuple):
            found.append(p[1])
    return _all_of(found)


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query of a regular expression; True if it has no mandatory trigram.

    Trigrams are of ASCII characters with A-Z as a-z, so one index serves either case.
    """
    return _query(_walk(sre_parse.parse(pattern)))


def trigrams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def build_index(docs: DataFrame, wanted: set[str]) -> DataFrame:
    """``segment, trigram, doc_ids``: postings of the ``wanted`` trigrams. Null text: empty.

    A segment is numbered by scan task and batch, the same at each attempt.
    """
    code = {t: int.from_bytes(t.encode(), "big") for t in sorted(wanted)}
    names = {c: t for t, c in code.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = np.zeros(1 << 24, bool)
        lookup[list(names)] = True
        fold = np.arange(256, dtype=np.uint32)
        fold[65:91] += 32
        first = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(slices(batches)):
            raw, offsets = flat_bytes(batch)
            b = fold[raw]
            at = np.zeros(0, np.int64)
            if len(b) > 2:
                codes = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
                at = np.flatnonzero(lookup[codes])
            row = np.searchsorted(offsets, at, side="right") - 1
            inside = at + 3 <= offsets[row + 1]
            at, row = at[inside], row[inside]
            pairs = np.unique(codes[at].astype(np.int64) << 32 | row) if len(at) else at
            tri, rows = pairs >> 32, pairs & 0xFFFFFFFF
            cuts = np.flatnonzero(np.concatenate(([True], tri[1:] != tri[:-1]))) if len(tri) else tri
            lists = pa.ListArray.from_arrays(
                pa.array(np.append(cuts, len(rows)).astype(np.int32)),
                batch.column("doc_id").take(pa.array(rows)),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(cuts), first + number)),
                    pa.array([names[c] for c in tri[cuts].tolist()], pa.string()),
                    lists,
                ],
                ["segment", "trigram", "doc_ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "segment long, trigram string, doc_ids array<long>")


def candidates(index: DataFrame, queries: dict[str, object]) -> DataFrame:
    """``doc_id, kinds``: the rules whose query a text satisfies, by the index alone."""
    lists = index.groupBy("segment").agg(
        F.map_from_entries(F.collect_list(F.struct("trigram", "doc_ids"))).alias("postings")
    )
    none = F.array().cast("array<bigint>")

    def found(query: object) -> Column:
        if isinstance(query, str):
            return F.coalesce(F.col("postings")[query], none)
        join = F.array_intersect if query[0] == "and" else F.array_union
        return reduce(join, map(found, query[1]))

    asked = {kind: q for kind, q in queries.items() if q is not True}
    hits = F.array(*(F.struct(F.lit(k).alias("kind"), found(q).alias("ids")) for k, q in asked.items()))
    return (
        lists.select(F.explode(hits).alias("hit"))
        .select("hit.kind", F.explode("hit.ids").alias("doc_id"))
        .groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))
    )


def with_kinds(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``row`` (all columns of ``docs``), ``text`` and ``kinds``, the rules to be verified there."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    always = F.array(*(F.lit(k) for k, q in queries.items() if q is True)).cast("array<string>")
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    wanted = set().union(*map(trigrams, queries.values()))
    if not wanted:
        return rows.withColumn("kinds", always)
    picked = candidates(build_index(docs, wanted), queries).withColumnRenamed("doc_id", "id")
    # The candidates are the side that is hashed: texts are streamed past, not sorted.
    joined = rows.join(picked.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    empty = F.array().cast("array<string>")
    return joined.select("row", "doc_id", "text", F.concat(always, F.coalesce("kinds", empty)).alias("kinds"))


def finder(rules: tuple[Rule, ...] = RULES) -> Callable[[str, set[str]], list[tuple[int, int, int]]]:
    """A function of a text and the kinds to verify, to ``(start, rule number, end)`` in order."""
    # A single greedy class of characters has its length in the expression: shorter runs end sooner.
    ready = []
    for number, rule in enumerate(rules):
        pattern = rule.pattern
        if re.fullmatch(r"\[[^\]\\]+\]\+", pattern) and rule.group == 0:
            pattern = f"{pattern[:-1]}{{{rule.min_length},}}"
        ready.append((number, rule, re.compile(pattern)))

    def find(text: str, kinds: set[str]) -> list[tuple[int, int, int]]:
        spans = []
        for number, rule, expression in ready:
            if rule.kind in kinds:
                for m in expression.finditer(text):
                    a, b = m.span(rule.group)
                    if b - a >= rule.min_length:
                        spans.append((m.start(), number, m.end()))
        return sorted(spans)

    return find


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans`` for each row of ``docs``; spans are structs of kind, start and end in code
    points, end exclusive, in order of start and rule. Matches of a rule do not overlap and are
    found from the left. Null and empty texts have none; repeated rows come back as often."""
    kinds_of = [r.kind for r in rules]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(rules)
        for batch in slices(batches):
            out = [
                [{"kind": kinds_of[k], "start": a, "end": b} for a, k, b in find(t, set(kinds))]
                for t, kinds in zip(texts(batch), batch.column("kinds").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out, pa.list_(span))], ["doc_id", "spans"]
            )

    rows = with_kinds(docs, rules).select("doc_id", "text", "kinds")
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """The rows of ``docs`` with every span that ``scan`` finds replaced by ``mark``; overlapping
    spans are replaced together. ``n_chars``, if there, is counted anew in changed rows."""

    @F.pandas_udf("string")
    def cleaned(text, kinds):
        find = finder(rules)

        def clean(t, k):
            if t is None:
                return None
            parts, at = [], 0
            for a, _, b in find(t, set(k)):
                if a >= at:
                    parts += [t[at:a], mark]
                at = max(at, b)
            return "".join([*parts, t[at:]]) if at else t

        return pd.Series([clean(t, k) for t, k in zip(text, kinds)], dtype=object)

    rows = with_kinds(docs, rules).withColumn("clean", cleaned("text", "kinds"))
    columns = []
    for field in docs.schema.fields:
        old = F.col("row").getField(field.name)
        if field.name == "text":
            columns.append(F.col("clean").cast(field.dataType).alias("text"))
        elif field.name == "n_chars":
            changed = ~F.col("clean").eqNullSafe(F.col("text"))
            columns.append(F.when(changed, F.length("clean").cast(field.dataType)).otherwise(old).alias("n_chars"))
        else:
            columns.append(old.alias(field.name))
    return rows.select(*columns)
