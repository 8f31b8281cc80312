"""Ranked search, spelling variants and main text against brute force."""

from __future__ import annotations

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import dom, extract, langid, lexical, queries, secrets, spelling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def _rows(spark, name):
    return [tuple(r)[:2] for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


def _clashing(df):
    for name in ("item", "part", "rank", "score", "key", "id", "n", "h", "word", "run", "model", "leads"):
        df = df.withColumn(name, F.lit(name))
    return df


# --- ranked lexical search


def _terms(text):
    return [t for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or ""))]


def _ranked(docs, items, k):
    cut = [(i, _terms(t)) for i, t in docs]
    cut = [(i, Counter(t), len(t)) for i, t in cut if t]
    n_docs, n_terms = len(cut), sum(n for _, _, n in cut)
    df = Counter(t for _, c, _ in cut for t in c)
    out = []
    for item_id, text in items:
        asked = _terms(text)
        scored = []
        for i, c, n in cut:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t in asked if t in c
            )
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item_id, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def test_search_equals_brute_force_over_whole_tables(spark):
    got = Counter(map(tuple, queries.op11_dense_tiles(spark, SF).collect()))
    assert got == _ranked(_rows(spark, "documents"), _rows(spark, "benchmark"), 20)


@pytest.fixture(scope="module")
def odd_documents():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["é", "É", "ÉA", "éa", "x-y", "日本"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(60)]
    docs += [(i + 100, docs[7][1]) for i in range(40)]  # equal scores
    docs += [(5, docs[5][1]), (5, docs[5][1]), (None, docs[7][1]), (None, "w1 w2"), (61, None), (62, ""), (63, " -- \x00 "),
             (64, "W1 " * 5000), (-3, docs[7][1])]
    return docs


ODD_ITEMS = [(1, "w1 w1 w2 É"), (1, "w1 w1 w2 É"), (None, "w3-w4 X"), (2, None), (3, ""), (4, "none of these"), (5, "W5 日本 éa ÉA"),
             (6, " ".join(f"w{i}" for i in range(12)))]


@pytest.mark.parametrize("block, tile", [(500_000, (256, 512, 4096)), (5, (2, 3, 2))])
def test_search_with_ties_nulls_and_small_tiles(spark, odd_documents, monkeypatch, block, tile):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    for name, value in zip(("TILE_ITEMS", "TILE_DOCS", "TILE_TERMS"), tile):
        monkeypatch.setattr(lexical, name, value)
    monkeypatch.setattr(lexical, "_PIECE", 200)
    docs = _clashing(spark.createDataFrame(odd_documents, DOCS).repartition(5))
    items = _clashing(spark.createDataFrame(ODD_ITEMS, ITEMS))
    got = Counter(map(tuple, lexical.search(docs, items, k=7).collect()))
    assert got == _ranked(odd_documents, ODD_ITEMS, 7)


def test_search_without_rows(spark, odd_documents):
    none, docs = spark.createDataFrame([], DOCS), spark.createDataFrame(odd_documents, DOCS)
    items = spark.createDataFrame(ODD_ITEMS, ITEMS)
    assert lexical.search(none, items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.filter("doc_id = 63"), items).count() == 0


def test_partial_sums_stay_below_the_exact_bound():
    rng = np.random.default_rng(1)
    largest = rng.integers(1, 2**52 // lexical.IMPACT_BOUND, 300)
    cuts = lexical.exact_cuts(largest)
    assert [a for a, _ in cuts[1:]] == [b for _, b in cuts[:-1]] and cuts[0][0] == 0 and cuts[-1][1] == 300
    assert len(cuts) > 50 and all(int(largest[a:b].sum()) * lexical.IMPACT_BOUND < 2**53 for a, b in cuts)


def test_weights_beyond_one_exact_product_are_added_in_parts():
    value = np.array([2**53 // lexical.IMPACT_BOUND * 5 + 3, 7, 11])
    tile = lexical.ItemTile(0, 2, np.array([1, 2]), np.array([0, 0, 1]), np.array([0, 1, 1]), value)
    doc, term, impact = np.array([0, 0, 1]), np.array([1, 2, 2]), np.array([999_999, 999_998, 5])
    got = lexical.multiply(tile, doc, term, impact, 2, 3)
    assert got.tolist() == [[int(value[0]) * 999_999 + 7 * 999_998, 35], [11 * 999_998, 55]]
    assert lexical.lengths_m(np.array([10**7]), 10**12, 10**15).tolist() == [75 + 25 * 10**19 // 10**15]


# --- spelling variants


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _spelled(rows, noise=31):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: set() for w in n}
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    for size, own in by_size.items():
        for w in own:
            for other in own + by_size.get(size + 1, []):
                if w != other and _near(w, other):
                    near[w].add(other)
                    near[other].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = Counter()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[(w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)] += 1
    return out


def test_variants_equal_brute_force_over_the_whole_table(spark):
    got = Counter(map(tuple, queries.op12_permuterm(spark, SF).collect()))
    assert got == _spelled(_rows(spark, "documents"))
    assert any(r[1] for r in got)


@pytest.fixture(scope="module")
def odd_words():
    rng = random.Random(8)
    base = ["aabbccdd", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "Übergröße", "übergröße", "ÿÿÿÿÿÿÿ", "words" * 4]
    for w in base[:]:
        for _ in range(25):
            i, c = rng.randrange(len(w)), rng.choice("abcdwÿé")
            base += [w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]]
    rows = [(i, " ".join(rng.choices(base, k=400)) + " × ÷ 1aaaaaaaa2") for i in range(10)]
    chain = ["rootwords", "rootword", "rootwor"]
    rows += [(50, " ".join(chain[:1] * 400)), (51, " ".join(chain[1:2] * 30)), (52, " ".join(chain[2:] * 2))]
    return rows + [(None, "aabbccdd aabbccdd"), (None, None), (11, ""), (12, "short"), (0, rows[0][1]), (0, rows[0][1])]


@pytest.mark.parametrize("text_key", [spelling.TEXT_KEY, 9, 2])
def test_variants_with_runs_of_letters_ties_and_nulls(spark, odd_words, monkeypatch, text_key):
    monkeypatch.setattr(spelling, "TEXT_KEY", text_key)
    monkeypatch.setattr(spelling, "_ROWS", 50)
    got = Counter(map(tuple, spelling.variants(_clashing(spark.createDataFrame(odd_words, DOCS))).collect()))
    assert got == _spelled(odd_words)
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(odd_words, DOCS), noise=0).collect()}
    assert got["rootwor"].form == "rootword" and got["rootwor"].root == "rootwords"


def test_variants_of_very_long_words(spark):
    rng = random.Random(4)
    long = "".join(rng.choices("abc", k=20_000))
    rows = [(1, f"{long} {long}"), (2, f"{long[:9]}z{long[10:]} {long[:9]}z{long[10:]}"), (3, f"{long[1:]} {long[1:]}"),
            (4, f"{long[:-2]} {long[:-2]}")]
    got = {len(r.word): r.n_near for r in spelling.variants(spark.createDataFrame(rows[:1] + rows[2:], DOCS), noise=0).collect()}
    assert got == {20_000: 1, 19_999: 1, 19_998: 0}
    assert sorted(r.n_near for r in spelling.variants(spark.createDataFrame(rows, DOCS), noise=0).collect()) == [0, 1, 1, 2]


def test_variants_without_words(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "few wörds")], DOCS)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], DOCS), ratio=1)


# --- main text


class _Article(HTMLParser):
    """The blocks of the marked article, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks, self.text = False, [], []

    def handle_starttag(self, tag, attrs):
        self._end() if tag in ("p", "h1", "article") else None
        self.inside |= tag == "article"
        self.text += [" "] if tag == "br" else []

    def handle_endtag(self, tag):
        self._end() if tag in ("p", "h1", "article") else None
        self.inside &= tag != "article"

    def handle_data(self, data):
        self.text.append(data)

    def _end(self):
        text = " ".join("".join(self.text).split())
        if text and self.inside:
            self.blocks.append(text)
        self.text = []


def _article(source):
    parser = _Article()
    parser.feed(source or "")
    return "\n\n".join(parser.blocks)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_extracts_the_marked_article_of_every_page(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.op13_main_text(spark, sf).collect()}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        assert (got[i].url, got[i].text, got[i].n_chars) == (page.url, _article(page.html), len(_article(page.html)))


@pytest.fixture(scope="module")
def model(spark):
    return extract.train(spark.read.parquet(f"{SF}/pages.parquet"))


def test_held_out_layouts(spark, model):
    sources = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    held_out = extract.drawn(sources[150:250], seed=77, redrawn=2)
    odds = model.log_odds(dom.measure([p for p, _ in held_out], model.token_score))
    at = right = found = wanted = 0
    for page, label in held_out:
        n = len(page.name)
        got = extract.decode(page, odds[at : at + n].tolist())
        want = [t for t, y in zip(page.text, label) if t and y]
        common = sum((Counter(got) & Counter(want)).values())
        right, found, wanted, at = right + common, found + len(got), wanted + len(want), at + n
    assert right / found > 0.97 and right / wanted > 0.97


LAYOUT = """<html><head><title>x</title><body><div id="wrap"><div class="top-bar"><a href=/>Home</a> <a href=/a>About</a></div>
<div class="cookie-consent"><p>We use cookies to improve your experience here. By continuing you agree to it.</p></div>
<div class="main-content"><h1>The title of it</h1><p>First paragraph of the story, long enough to be prose &amp; more.
<p>Second one,<br>which goes  on&nbsp;and on about the matter.<div class="ad-slot">Buy the best thing ever made, for sale today only.</div></div>
<div class="sidebar"><h3>Popular</h3><ul><li><a href=1>One link</a><li><a href=2>Two links</a></ul></div>
<div id="comments"><h3>3 comments</h3><div class="comment"><p>I do not agree with this at all, since it says nothing new.</p></div></div>
<form><p>Leave a reply</p><input><button>Send</button></form><div class="footer">Copyright 2020 by someone.</div></div>"""


def test_another_layout_and_odd_pages(spark, model):
    rows = [(1, "u", LAYOUT), (2, None, None), (3, "u", ""), (None, "u", "<p>"), (1, "u", LAYOUT), (4, "u", "no markup at all"),
            (5, "u", "<" * 1000), (6, "u", "<!-- never ends <p>text")]
    pages = _clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in extract.extract(pages, model).select("page_id", "url", "text", "n_chars").collect())
    text = ("The title of it\n\nFirst paragraph of the story, long enough to be prose & more.\n\n"
            "Second one, which goes on and on about the matter.")
    assert got[1, "u", text, len(text)] == 2
    assert got[2, None, "", 0] == got[3, "u", "", 0] == got[None, "u", "", 0] == got[6, "u", "", 0] == 1
    assert sum(got.values()) == len(rows)
    none = pages.limit(0)
    assert extract.extract(none, extract.train(none)).count() == 0


def test_decoding_finds_the_likeliest_consistent_choice():
    rng = random.Random(2)
    for _ in range(200):
        page = dom.Page()
        page.add("#root", "", -1, 0)
        for i in range(1, rng.randint(2, 8)):
            p = rng.randrange(i)
            while page.text[p]:
                p = page.parent[p]
            page.add("div", "", p, page.depth[p] + 1)
            page.text[i] = f"t{i}" if rng.random() < 0.5 else ""
        n = len(page.name)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        best, choice = 0.0, []
        for kept in itertools.product([False, True], repeat=n):
            children = [any(kept[c] for c in range(n) if page.parent[c] == i) for i in range(n)]
            fits = all(not kept[i] or ((i == 0 or kept[page.parent[i]]) and (page.text[i] or children[i])) for i in range(n))
            total = sum(o for o, k in zip(odds, kept) if k)
            if fits and total > best:
                best, choice = total, [t for t, k in zip(page.text, kept) if k and t]
        assert extract.decode(page, odds) == choice


@pytest.mark.parametrize("source", [
    "<" * 300_000, '<a b="' * 60_000, "<script>" * 60_000, "<!--" * 100_000, "<div>" * 60_000 + "</section>" * 60_000,
    "<li><div>" * 40_000, "</" * 200_000, "&amp;" * 100_000, "<select><option>" * 40_000, "<p title='" * 50_000,
])
def test_pages_are_read_in_linear_time(source):
    began = time.time()
    dom.measure([dom.parse(source)], lambda a, b: 0.0)
    assert time.time() - began < 8


@pytest.mark.parametrize("source, texts", [
    ("a<b>b</b>c", ["abc"]),
    ("<p>one<p>two<div>three</p>four</div>", ["one", "two", "three", "four"]),
    ("<script>var t='<p>no</p>'</script><p>yes", ["yes"]),
    ("<p class=a'b>it's</p><p>so</p>", ["it's", "so"]),
    ("1 < 2 <3 x", ["1 < 2 <3 x"]),
    ("<head><p>no head end</p>", ["no head end"]),
    ("<div><label>name<div>x</div></div><p>after</p>", ["after"]),
    ("<select><option>a<option>b</select><p>after", ["after"]),
    ("<div>x<ul><li>1<li>2</ul>y</div>", ["x", "1", "2", "y"]),
    ("a<!-->b<!-- c --!>d-->e", ["abe"]),
])
def test_blocks_of_markup(source, texts):
    assert [t for t in dom.parse(source).text if t] == texts


# --- hostile texts of earlier operators


def test_plain_text_of_pages_equals_the_expression():
    hidden = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
    rng = random.Random(12)
    parts = ["<script>", "</script>", "</SCRIPT  >", "<style a>", "</style>", "<!--", "-->", "<", ">", "x", " y ", "<p>", "<scripts>", "\n"]
    for _ in range(5_000):
        page = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert langid.plain(page) == hidden.sub(" ", page), page


@pytest.mark.parametrize("part", ["<script>", "<!--", "<style ", "<", "<script></script", "</script   "])
def test_plain_text_takes_linear_time(part):
    page = part * (1_000_000 // len(part))
    began = time.time()
    langid.plain(page)
    assert time.time() - began < 1


def test_logins_in_addresses_are_those_of_the_plain_expression():
    rule = next(r for r in secrets.RULES if r.kind == "url_login")
    rng = random.Random(13)
    for _ in range(5_000):
        text = "".join(rng.choices(["ab", "c", "://", ":", "@", "/", " ", "A", "user", "9"], k=rng.randint(0, 16)))
        wanted = [m.span() for m in re.finditer(r"[a-z]+://[^/\s:@]+:[^/\s:@]+@", text)]
        assert [m.span() for m in re.finditer(rule.pattern, text)] == wanted, text


@pytest.mark.parametrize("part", ["a", "eyJ", "eyJa.", "ab://", "a:b@", "://a:", "xox", "ghp_", "token = ", "-----BEGIN ", "0", "AKIA"])
def test_secrets_take_linear_time(part):
    text = part * (1_000_000 // len(part)) + " http://u:p@host AKIA password"
    began = time.time()
    for rule in secrets.RULES:
        for _ in re.finditer(rule.pattern, text):
            pass
    assert time.time() - began < 1
