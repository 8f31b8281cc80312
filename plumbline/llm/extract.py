"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

1. ``dom`` cuts a page into block elements in page order and measures each: density of text and links
   in its subtree, words of its name and attributes and of those above it, depth, place and share among
   its siblings.
2. Boosted trees give each element log odds that its subtree holds main text.
3. Decoding takes the likeliest choice for the whole tree in which an element is kept only if its
   parent is, and an element without text of its own only if one of its children is. One pass from
   the last element to the first finds it: no removed menu keeps an entry, no kept article is empty.

The trees are trained on at most ``TRAIN_PAGES`` pages, those of the smallest hash of their id among
pages of at most ``TRAIN_CHARS`` characters that mark their article as such. The mark is a weak label: so
that the trees learn more than that mark, each page is also drawn anew ``REDRAWN`` times, its own text
in other layouts, with menus, side columns, notices, adverts, forms and comments around and between,
filled with text of other pages. If no page marks its article, there are layouts only, with the
longest blocks of the pages as text.
"""

from __future__ import annotations

import html as entities
import pickle
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom
from .frames import slices

TRAIN_PAGES, TRAIN_CHARS, REDRAWN = 120, 100_000, 6
TREES, DEPTH, BINS, RATE, LEAST_ROWS = 80, 5, 32, 0.2, 8
#: Source bytes whose elements are held at once.
_BATCH = 2 << 20
_REMEMBERED = 20_000

# Words that layouts name their parts with.
_ARTICLE = "article content main post entry story body text news blog page single detail document read prose".split()
_WRAP = "wrapper container page row col inner site outer grid layout main content box wrap".split()
_PARTS = {
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs links tabs toc".split(),
    "header": "header masthead branding top banner logo head tagline title".split(),
    "footer": "footer colophon bottom copyright foot legal credits".split(),
    "side": "sidebar aside widget side rail right left secondary panel related recommended popular trending".split(),
    "notice": "notice cookie cookies consent alert message gdpr newsletter subscribe paywall popup modal warning info".split(),
    "advert": "ad ads advert advertisement sponsored sponsor promo promotion banner adsense teaser".split(),
    "form": "form search login signup newsletter contact subscribe feedback".split(),
    "comments": "comments comment reply replies discussion responses disqus thread reader readers respond".split(),
    "share": "share social sharing tags meta follow buttons byline author".split(),
}


def _digest(main: dom.Page, inside: set[str]) -> np.ndarray:
    """Label of each element: whether it or one below it has text of ``inside``."""
    label = np.array([t in inside if t else False for t in main.text])
    total = np.concatenate(([0], np.cumsum(label)))
    return total[np.array(main.end)] > total[: len(label)]


def marked(page: dom.Page) -> tuple[list[str], list[str]] | None:
    """Texts that the page itself marks as its article, and its other texts; none without such a mark."""
    n = len(page.name)
    main, other = [False] * n, [False] * n
    for i in range(n):
        p = page.parent[i]
        tokens = dom.attribute_tokens(page.name[i], page.attributes[i])
        main[i] = (p >= 0 and main[p]) or page.name[i] == "article" or "articlebody" in "".join(tokens)
        apart = page.name[i] in ("nav", "aside", "footer", "form") or any(
            t in _PARTS[kind] for kind in ("advert", "comments", "notice") for t in tokens[1:]
        )
        other[i] = (p >= 0 and other[p]) or apart
    inside = [t for i, t in enumerate(page.text) if t and main[i] and not other[i]]
    outside = [t for i, t in enumerate(page.text) if t and not (main[i] and not other[i])]
    return (inside, outside) if inside else None


class Layouts:
    """Draws pages of known main text."""

    def __init__(self, rng: random.Random, prose: list[str], scraps: list[str]):
        self.rng, self.prose, self.scraps = rng, prose or [_filler(rng) for _ in range(50)], scraps
        self.scraps = self.scraps or [_filler(rng)[:30] for _ in range(50)]
        self.inside: set[str] = set()  # main texts of the page drawn last

    def named(self, words: list[str], tags: list[str]) -> tuple[str, str]:
        """A start and an end tag, with some words of its kind as class or id."""
        rng = self.rng
        tag = rng.choice(tags)
        plain = tag in ("div", "p", "ul", "ol", "li", "section", "td")  # says nothing by itself
        some = rng.sample(words, rng.choice([1, 1, 2])) if plain or rng.random() < 0.6 else []
        if some and rng.random() < 0.4:
            some[0] += rng.choice(["-wrap", "-box", "-area", "_1", "-list", "Block", "-inner", "-section"])
        joint = rng.choice(["-", " ", "_"]).join(some)
        attribute = f' {rng.choice(["class", "id", "class"])}="{joint}"' if some else ""
        return f"<{tag}{attribute}>", f"</{tag}>"

    def some_prose(self, least: int, most: int) -> list[str]:
        return [self.rng.choice(self.prose) for _ in range(self.rng.randint(least, most))]

    def shown(self, text: str) -> str:
        return entities.escape(text)

    def listing(self, n: int) -> str:
        rng = self.rng
        link = rng.random() < 0.9
        items = [self.shown(rng.choice(self.scraps)[:60]) for _ in range(n)]
        items = [f'<a href="/{i}">{t}</a>' if link else t for i, t in enumerate(items)]
        kind = rng.choice(["ul", "ul", "div", "a"])
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{t}</li>" for t in items) + "</ul>"
        return "".join(f"<div>{t}</div>" for t in items) if kind == "div" else " | ".join(items)

    def part(self, kind: str) -> str:
        rng = self.rng
        if kind == "menu":
            a, b = self.named(_PARTS[kind], ["nav", "div", "ul", "nav"])
            return a + self.listing(rng.randint(2, 12)) + b
        if kind == "header":
            a, b = self.named(_PARTS[kind], ["header", "div"])
            line = f"<h1>{self.shown(rng.choice(self.scraps)[:40])}</h1>" if rng.random() < 0.4 else ""
            line += f"<p>{self.shown(rng.choice(self.scraps))}</p>" if rng.random() < 0.5 else self.shown(rng.choice(self.scraps))
            return a + line + (self.part("menu") if rng.random() < 0.5 else "") + b
        if kind == "footer":
            a, b = self.named(_PARTS[kind], ["footer", "div", "footer"])
            line = "&copy; " + self.shown(rng.choice(self.scraps))
            more = [f"<p>{self.shown(t)}</p>" for t in self.some_prose(0, 2)]
            return a + (line if rng.random() < 0.7 else f"<p>{line}</p>") + "".join(more) + (self.listing(3) if rng.random() < 0.4 else "") + b
        if kind == "side":
            a, b = self.named(_PARTS[kind], ["aside", "div", "section"])
            head = f"<h3>{self.shown(rng.choice(self.scraps)[:30])}</h3>"
            inner = [self.listing(rng.randint(2, 6)), "".join(f"<p>{self.shown(t)}</p>" for t in self.some_prose(1, 3))]
            return a + head + rng.choice(inner) + (rng.choice(inner) if rng.random() < 0.3 else "") + b
        if kind in ("notice", "advert"):
            a, b = self.named(_PARTS[kind], ["div", "div", "aside", "section", "p"])
            body = self.shown(rng.choice([*self.some_prose(1, 1), rng.choice(self.scraps)]))
            if not a.startswith("<p") and rng.random() < 0.5:
                body = f"<p>{body}</p>" * rng.choice([1, 1, 2])
            return a + body + (f'<a href="#">{self.shown(rng.choice(self.scraps)[:20])}</a>' if rng.random() < 0.4 else "") + b
        if kind == "form":
            a, b = self.named(_PARTS[kind], ["form", "form", "div"])
            line = f"<p>{self.shown(rng.choice(self.scraps))}</p>" if rng.random() < 0.6 else self.shown(rng.choice(self.scraps))
            return a + line + '<label>e</label><input type="text"><button>ok</button>' * rng.randint(1, 3) + b
        if kind == "share":
            a, b = self.named(_PARTS[kind], ["div", "ul", "p"])
            return a + (self.listing(rng.randint(2, 5)) if not a.startswith("<p") else self.shown(rng.choice(self.scraps))) + b
        a, b = self.named(_PARTS["comments"], ["div", "section", "ol", "div"])
        each = []
        for text in self.some_prose(1, 6):
            c, d = self.named(_PARTS["comments"], ["div", "li", "article", "div"])
            by = rng.choice(["", f"<b>{self.shown(rng.choice(self.scraps)[:12])}</b> ", f"<div>{self.shown(rng.choice(self.scraps)[:12])}</div>"])
            each.append(c + by + (f"<p>{self.shown(text)}</p>" if rng.random() < 0.7 else self.shown(text)) + d)
        head = f"<h3>{self.shown(rng.choice(self.scraps)[:20])}</h3>" if rng.random() < 0.6 else ""
        return a + head + "".join(each) + (self.part("form") if rng.random() < 0.4 else "") + b

    def main(self, texts: list[str]) -> str:
        rng = self.rng
        a, b = self.named(_ARTICLE, ["article", "article", "main", "div", "div", "section", "td"])
        block = rng.choice(["p", "p", "p", "p", "div"])
        self.inside = set(texts)
        out = []
        for i, text in enumerate(texts):
            shown = self.shown(text)
            if i == 0 and rng.random() < 0.8:
                line = f"<h1>{shown}</h1>"
                out.append(f"<header>{line}</header>" if rng.random() < 0.15 else line)
                continue
            words = shown.split(" ")
            if len(words) > 8 and rng.random() < 0.15 and "&" not in shown:
                spot = rng.randrange(len(words) - 2)
                words[spot : spot + 2] = [f'<a href="/x">{" ".join(words[spot : spot + 2])}</a>']
                shown = " ".join(words)
            kind = rng.random()
            if kind < 0.05:
                out.append(f"<blockquote>{shown}</blockquote>")
            elif kind < 0.10:
                words, size = text.split(" "), rng.choice([2, 5, 12])
                points = [" ".join(words[k : k + size]) for k in range(0, len(words), size)][: 12]
                points.append(" ".join(words[12 * size :]))
                points = [t for t in points if t]
                self.inside.update(points)
                out.append("<ul>" + "".join(f"<li>{self.shown(t)}</li>" for t in points) + "</ul>")
            elif kind < 0.15:
                out.append(f"<h2>{shown}</h2>")
            else:
                out.append(f"<{block}>{shown}</{block}>")
            if rng.random() < 0.06:
                out.append(self.part(rng.choice(["advert", "share", "side", "notice"])))
        body = "".join(out)
        if rng.random() < 0.3:
            c, d = self.named(_ARTICLE, ["div", "section"])
            body = c + body + d
        if rng.random() < 0.25:
            body = self.part("share") + body
        if rng.random() < 0.2:
            body += self.part(rng.choice(["comments", "side", "share", "form"]))
        return f"<table><tr>{a}{body}{b}</tr></table>" if a.startswith("<td") else a + body + b

    def page(self, texts: list[str]) -> str:
        rng = self.rng
        before = [k for k, share in (("notice", 0.3), ("header", 0.6), ("menu", 0.7), ("advert", 0.4), ("form", 0.2)) if rng.random() < share]
        after = [k for k, share in (("comments", 0.45), ("side", 0.5), ("advert", 0.3), ("form", 0.3), ("footer", 0.8)) if rng.random() < share]
        if rng.random() < 0.3:
            rng.shuffle(before)
        if rng.random() < 0.3 and "side" in after:
            after.remove("side")
            before.append("side")
        inner = self.main(texts)
        body = [*map(self.part, before), inner, *map(self.part, after)]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            a, b = self.named(_WRAP, ["div", "div", "section", "main"])
            start, stop = rng.randint(0, len(before)), rng.randint(len(before) + 1, len(body))
            body = [*body[:start], a + "".join(body[start:stop]) + b, *body[stop:]]
            before, after = before[:start], []
            if len(body) <= len(before):
                break
        return "<html><body>" + "".join(body) + "</body></html>"


def _filler(rng: random.Random) -> str:
    return " ".join("".join(rng.choices("aeinorst", k=rng.randint(2, 9))) for _ in range(rng.randint(4, 60))).capitalize() + "."


@dataclass
class Model:
    """Trees of equal depth: inner node ``k`` has the children ``2k + 1`` and ``2k + 2``."""

    tokens: dict[str, float]
    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def token_score(self, name: str, attributes: str) -> float:
        return sum(self.tokens.get(t, 0.0) for t in dom.attribute_tokens(name, attributes))

    def remembering(self):
        """``token_score`` that looks equal attributes up once."""
        memory: dict[tuple[str, str], float] = {}

        def score(name: str, attributes: str) -> float:
            value = memory.get((name, attributes))
            if value is None:
                if len(memory) > _REMEMBERED:
                    memory.clear()
                value = memory[name, attributes] = self.token_score(name, attributes)
            return value

        return score

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        every, inner = np.arange(len(rows)), self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(rows), np.int64)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + (rows[every, feature[at]] > cut[at])
            out += leaf[at - inner]
        return out


def boosted(rows: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Base, features, cuts and leaves of trees that fit the log odds of ``label``: Newton steps on
    histograms of ``BINS`` quantiles of each feature."""
    n, width = rows.shape
    edges = [np.unique(np.quantile(rows[:, f], np.arange(1, BINS) / BINS).astype(np.float32)) for f in range(width)]
    binned = np.column_stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(edges)])
    cells = binned + np.arange(width) * BINS
    base = float(np.log((label.sum() + 1) / (n - label.sum() + 1)))
    margin = np.full(n, base)
    features, cuts, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = label - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf, np.float32)
        for level in range(DEPTH):
            begin, count = 2**level - 1, 2**level
            slot = ((at - begin)[:, None] * (width * BINS) + cells).ravel()
            g, h, rows_in = (
                np.bincount(slot, np.repeat(v, width), count * width * BINS).reshape(count, width, BINS).cumsum(2)
                for v in (gradient, hessian, np.ones(n))
            )
            whole_g, whole_h, whole_n = g[:, :1, -1:], h[:, :1, -1:], rows_in[:, :1, -1:]
            gain = g**2 / (h + 1) + (whole_g - g) ** 2 / (whole_h - h + 1) - whole_g**2 / (whole_h + 1)
            gain[(rows_in < LEAST_ROWS) | (whole_n - rows_in < LEAST_ROWS)] = 0
            for k in range(count):
                f, b = divmod(int(gain[k].argmax()), BINS)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[begin + k], cut[begin + k] = f, edges[f][b]
            own = feature[at]
            at = 2 * at + 1 + (rows[np.arange(n), own] > cut[at])
        at -= 2**DEPTH - 1
        g, h = (np.bincount(at, v, 2**DEPTH) for v in (gradient, hessian))
        leaf = RATE * g / (h + 1)
        margin += leaf[at]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return base, np.array(features), np.array(cuts), np.array(leaves)


def drawn(sources: list[str], seed: int, redrawn: int = REDRAWN) -> list[tuple[dom.Page, np.ndarray]]:
    """Training pages with the label of each element."""
    rng = random.Random(seed)
    parsed = [dom.parse(s) for s in sources]
    marks = [marked(p) for p in parsed]
    prose = [t for m in marks if m for t in m[0] if len(t) > 60]
    scraps = [t for m in marks if m for t in m[1]]
    if not prose:
        texts = sorted((t for p in parsed for t in p.text if t), key=lambda t: (-len(t), t))
        prose, scraps = texts[: len(texts) // 2], texts[len(texts) // 2 :]
    layouts = Layouts(rng, prose, scraps)
    out = []
    for page, mark in zip(parsed, marks):
        texts = mark[0] if mark else layouts.some_prose(2, 9)
        if mark:
            out.append((page, _digest(page, set(texts))))
        for _ in range(redrawn):
            again = dom.parse(layouts.page(texts))
            out.append((again, _digest(again, layouts.inside)))
    return out


def fit(sources: list[str], seed: int = 5) -> Model:
    pages = drawn(sources, seed) or drawn([""] * 20, seed)
    # Element names and attributes weigh by the share of elements with main text among theirs.
    seen, main = Counter(), Counter()
    for page, label in pages:
        for name, attributes, kept in zip(page.name, page.attributes, label.tolist()):
            tokens = dom.attribute_tokens(name, attributes)
            seen.update(tokens)
            if kept:
                main.update(tokens)
    share = sum(main.values()) / max(1, sum(seen.values()))
    even = np.log((share + 0.01) / (1 - share + 0.01))
    tokens = {
        t: float(np.clip(np.log((main[t] + 2 * share) / (n - main[t] + 2 * (1 - share))) - even, -4, 4))
        for t, n in sorted(seen.items()) if n >= 3
    }
    model = Model(tokens, 0.0, *(np.zeros((0, 0)),) * 3)
    rows = dom.measure([p for p, _ in pages], model.remembering())
    label = np.concatenate([y for _, y in pages]).astype(np.float64)
    model.base, model.feature, model.cut, model.leaf = boosted(rows, label)
    return model


def train(pages: DataFrame, seed: int = 5) -> Model:
    """The model of a bounded sample, fitted in one task; it comes to the driver, some 50 kB."""
    usable = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("html").cast("string").alias("html"))
    usable = usable.filter(F.char_length("html").between(1, TRAIN_CHARS))
    likely = F.when(F.lower("html").contains("<article"), 0).otherwise(1)
    sample = usable.orderBy(likely, F.xxhash64("page_id", F.lit(seed)), F.xxhash64("html")).limit(TRAIN_PAGES)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [pickle.dumps(tuple(vars(fit(sorted(rows["html"]), seed)).values()))]})

    found = sample.withColumn("model", F.lit(0)).groupBy("model").applyInPandas(run, "model binary").collect()
    return Model(*pickle.loads(found[0][0])) if found else fit([], seed)


def decode(page: dom.Page, odds: list[float]) -> list[str]:
    """The kept texts, by the likeliest consistent choice."""
    n = len(page.name)
    gain = odds[:]
    below, least = [0.0] * n, [-np.inf] * n  # sum of children worth keeping; the best child
    worth = [False] * n
    for i in range(n - 1, -1, -1):
        own = gain[i] + below[i]
        if not page.text[i] and below[i] <= 0:
            # Without text of its own it is kept only with a child; the root may stay empty.
            own += least[i]
        gain[i] = own
        worth[i] = own > 0
        p = page.parent[i]
        if p >= 0:
            if own > 0:
                below[p] += own
            if own > least[p]:
                least[p] = own
    kept, out = [False] * n, []
    best: list[int] = [-1] * n
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        if best[p] < 0 or gain[i] >= gain[best[p]]:
            best[p] = i
    for i in range(n):
        p = page.parent[i]
        forced = p >= 0 and kept[p] and not page.text[p] and below[p] <= 0 and best[p] == i
        kept[i] = (worth[i] if p < 0 else kept[p] and (worth[i] or forced))
        if kept[i] and page.text[i]:
            out.append(page.text[i])
    return out


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of each row of ``pages``, blocks joined by an empty
    line, and its code points; empty for a null or empty page. Repeated rows come back as often;
    other columns are ignored; an empty table gives no rows."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.remembering()
        for batch in slices(batches, "html", _BATCH):
            parsed = [dom.parse(h or "") for h in batch.column("html").to_pylist()]
            odds = model.log_odds(dom.measure(parsed, score)).tolist()
            texts, at = [], 0
            for page in parsed:
                n = len(page.name)
                texts.append("\n\n".join(decode(page, odds[at : at + n])))
                at += n
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
