"""Language identification by Bayesian fusion of independent evidence.

For each row and language the log probabilities of four sources are added:

* text: a multinomial model of letter trigrams, fitted on labelled documents. Its weight is held to
  ``TEXT_WEIGHT`` trigrams, since neighbouring trigrams are not independent.
* declared: the language that the markup declares, read from the whole page. How far declarations can be trusted is a table of
  declared by true language, summed over all rows with the text model's posterior.
* suffix: the last label of the address, as the share of each language among rows that have it,
  against the share among all rows.
* host: a prior from the other rows of the host, smoothed towards its domain, which is smoothed
  towards all rows: ``(rows of a language + m * prior above) / (rows + m)``. The row itself does not count.

The sums are grouped aggregates of posteriors with a map-side step; hosts are joined back to rows,
which adaptive execution splits for a host with a large share of them. A source that a row lacks adds
nothing. Fitting takes at most ``MAX_ROWS`` labelled rows, those with the smallest hash of their id.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import checkpoint, slices, texts

MAX_ROWS, BUCKETS, TEXT_WEIGHT, STRENGTH = 4_000, 1 << 15, 60, 5.0
_OPENS = re.compile(r"<(?:(script|style)\b|!--)", re.I)
_CLOSES = {
    "script": re.compile(r"</script\s*+>", re.I), "style": re.compile(r"</style\s*+>", re.I), "": re.compile("-->"),
}
_HTML = re.compile(r"<html\b([^>]*)", re.I)
_DECLARED = re.compile(r"""\blang\s*=\s*["']?([A-Za-z]{2,3})""", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.I)


def declared_in(page: str) -> str | None:
    """The language of the first html tag that declares one, wherever in the page it stands.

    Tags are cut out first, so that many without an end cost one pass.
    """
    found = (_DECLARED.search(tag[1]) for tag in _HTML.finditer(page))
    return next((lang[1].lower() for lang in found if lang), None)


def plain(page: str) -> str:
    """The text of a page: scripts, styles, comments and tags are one space each.

    One without its end is a plain tag up to the next ``>``. The next end of each kind is looked for
    once and remembered, so a page of many beginnings costs one pass.
    """
    out, at = [], 0
    ends: dict[str, tuple[int, int]] = {}
    while (start := page.find("<", at)) >= 0:
        stop = -1
        opened = _OPENS.match(page, start)
        if opened:
            kind = (opened[1] or "").lower()
            if kind not in ends or ends[kind][0] < opened.end():
                closed = _CLOSES[kind].search(page, opened.end())
                ends[kind] = closed.span() if closed else (len(page), -1)
            stop = ends[kind][1]
        if stop < 0:
            stop = page.find(">", start) + 1
            if not stop:
                break
        out += page[at:start], " "
        at = stop
    return html.unescape("".join([*out, page[at:]]))


def trigrams(text: str) -> np.ndarray:
    """Hash buckets of the trigrams of letters, runs of anything else being one space."""
    line = re.sub(r"[\W\d_]+", " ", f" {text} ".lower())
    code = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64)
    if len(code) < 3:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        mixed = (code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1]) * np.uint64(0xD6E8FEB86659FD93) + code[2:]
        mixed *= np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - 15)).astype(np.int64) % BUCKETS


@dataclass
class TextModel:
    languages: list[str]
    log_p: np.ndarray  # language by bucket

    def scores(self, text: str) -> np.ndarray:
        """Log likelihood by language, at the weight of ``TEXT_WEIGHT`` trigrams at most."""
        at = trigrams(text)
        if not len(at):
            return np.zeros(len(self.languages))
        total = self.log_p[:, at].sum(1)
        return (total - total.max()) * min(1.0, TEXT_WEIGHT / len(at))


def train(docs: DataFrame, max_rows: int = MAX_ROWS) -> TextModel:
    """The text model of documents (``doc_id, text, lang``); rows without text or language don't count.
    Without any row there are no languages."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("lang").cast("string")).alias("lang"), F.col("text").cast("string").alias("text"))
    ids = rows.filter("lang is not null and doc_id is not null").select("doc_id").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    chosen = rows.join(F.broadcast(ids), "doc_id", "left_semi").filter("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch)):
                own = np.bincount(trigrams(text), minlength=BUCKETS)
                sums[lang] = sums[lang] + own if lang in sums else own
        packed = [v.astype("<i8").tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(packed, pa.binary())], ["lang", "counts"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<i8") for x in part["counts"])
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "counts": [total.astype("<i8").tobytes()]})

    # At most max_rows texts stand behind these rows, one for each language.
    schema = "lang string, counts binary"
    found = sorted(map(tuple, chosen.select("lang", "text").mapInArrow(count, schema).groupBy("lang").applyInPandas(add, schema).collect()))
    counts = np.array([np.frombuffer(c, "<i8") for _, c in found]).reshape(len(found), BUCKETS) + 0.05
    return TextModel([lang for lang, _ in found], np.log(counts / counts.sum(1, keepdims=True)) if found else counts)


def from_pages(pages: DataFrame) -> DataFrame:
    """Evidence rows of web pages (``page_id, url, html``)."""

    @F.pandas_udf("text string, declared string, host string")
    def parts(url: pd.Series, page: pd.Series) -> pd.DataFrame:
        def one(u, p):
            p = p or ""
            host = _HOST.match(u or "")
            return plain(p), declared_in(p), host[1].lower().rstrip(".") if host else None

        return pd.DataFrame([one(u, p) for u, p in zip(url, page)], columns=["text", "declared", "host"], dtype=object)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), parts(F.col("url").cast("string"), F.col("html").cast("string")).alias("e"))
    label = F.element_at(F.split("e.host", r"\."), -1)
    domain = F.regexp_extract("e.host", r"([^.]+\.[^.]+)$", 1)
    return rows.select(
        F.lit(None).cast("long").alias("doc_id"), "page_id", F.col("e.text").alias("text"), F.col("e.declared").alias("declared"),
        F.col("e.host").alias("host"), F.when(domain != "", domain).otherwise(F.col("e.host")).alias("domain"),
        F.when(F.col("e.host").contains("."), label).alias("suffix"),
    )


def from_documents(docs: DataFrame) -> DataFrame:
    """Evidence rows of documents (``doc_id, text, source``): the source stands for the host."""
    nothing = F.lit(None).cast("string")
    source = F.concat(F.lit("source:"), F.col("source").cast("string"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("text").cast("string").alias("text"),
        nothing.alias("declared"), source.alias("host"), source.alias("domain"), nothing.alias("suffix"),
    )


def _sums(p: str, n: int) -> Column:
    return F.array(*(F.sum(F.col(p)[i]) for i in range(n)))


def _smoothed(own: Column, above: Column, strength: float) -> Column:
    """``(own + m * above) / (sum of own + m)`` for arrays."""
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x) + F.lit(strength)
    return F.zip_with(own, above, lambda x, y: (F.greatest(x, F.lit(0.0)) + F.lit(strength) * y) / total)


def identify(evidence: DataFrame, model: TextModel, strength: float = STRENGTH) -> DataFrame:
    """``doc_id, page_id, lang, p, p_text, declared, host``, one row for each row of ``evidence``.

    ``lang`` is the most probable language, ``p`` its probability and ``p_text`` that by text alone;
    equal ones go to the first in alphabet. Null and empty texts rest on the other sources. If the
    model has no language, ``lang`` is null.
    """
    languages = model.languages
    n = len(languages)
    if not n:
        none = F.lit(None)
        return evidence.select("doc_id", "page_id", none.cast("string").alias("lang"), none.cast("double").alias("p"), none.cast("double").alias("p_text"), "declared", "host")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            log = np.array([model.scores(t) for t in texts(batch)]).reshape(-1, n)
            p = np.exp(log - log.max(1, keepdims=True)) if len(log) else log
            p /= p.sum(1, keepdims=True)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), n).cast(pa.list_(pa.float64())) for x in (log, p)]
            keep = [batch.column(c) for c in ("doc_id", "page_id", "declared", "host", "domain", "suffix")]
            yield pa.RecordBatch.from_arrays([*keep, *lists], ["doc_id", "page_id", "declared", "host", "domain", "suffix", "log_text", "text_p"])

    scored = checkpoint(
        evidence.select("doc_id", "page_id", "text", "declared", "host", "domain", "suffix").mapInArrow(
            score,
            "doc_id long, page_id long, declared string, host string, domain string, suffix string, log_text array<double>, text_p array<double>",
        )
    )
    # One row for each language, and one for declarations of none of them.
    known = F.when(F.col("declared").isin(languages), F.col("declared")).otherwise(F.lit("other"))
    said = {r["d"]: np.array(r["s"]) for r in scored.filter("declared is not null").groupBy(known.alias("d")).agg(_sums("text_p", n).alias("s")).collect()}
    table = np.array([said.get(d, np.zeros(n)) for d in [*languages, "other"]]) + 0.5
    table = np.log(table / table.sum(0))
    declared = {d: F.array(*map(F.lit, map(float, table[i]))) for i, d in enumerate([*languages, "other"])}
    log_declared = F.array(*[F.lit(0.0)] * n)
    for d, row in declared.items():
        log_declared = F.when(F.col("declared").isNotNull() & (known == d), row).otherwise(log_declared)

    whole = scored.agg(_sums("text_p", n).alias("s")).first()["s"]
    whole = np.array([x or 0.0 for x in whole]) + 0.5
    overall = F.array(*map(F.lit, map(float, whole / whole.sum())))
    hosts = scored.groupBy("host", "domain", "suffix").agg(_sums("text_p", n).alias("host_sum"))
    domains = hosts.filter("domain is not null").groupBy("domain").agg(_sums("host_sum", n).alias("domain_sum"))
    suffixes = hosts.filter("suffix is not null").groupBy("suffix").agg(_sums("host_sum", n).alias("suffix_sum"))
    names = (
        hosts.filter("host is not null").join(domains, "domain", "left").join(suffixes, "suffix", "left")
        .select("host", "host_sum", "domain_sum", "suffix_sum")
    )

    def less(total: Column) -> Column:
        return F.zip_with(total, "text_p", lambda a, b: a - b)

    domain_prior = _smoothed(less(F.col("domain_sum")), overall, strength)
    host_prior = F.coalesce(_smoothed(less(F.col("host_sum")), domain_prior, strength), overall)
    suffix_share = F.coalesce(_smoothed(less(F.col("suffix_sum")), overall, strength), overall)
    log = [
        F.col("log_text")[i] + log_declared[i] + F.log(host_prior[i]) + F.log(suffix_share[i]) - F.log(overall[i]) for i in range(n)
    ]
    joined = scored.join(names, "host", "left").withColumn("log", F.array(*log))
    top = F.array_max("log")
    weight = F.aggregate(F.transform("log", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    best = F.array_position("log", top).cast("int")
    return joined.select(
        "doc_id", "page_id", F.element_at(F.array(*map(F.lit, languages)), best).alias("lang"), (1 / weight).alias("p"),
        F.element_at("text_p", best).alias("p_text"), "declared", "host",
    )
