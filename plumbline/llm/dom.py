"""HTML pages as arrays of block elements, in one linear scan, and what is measured on them.

Inline markup dissolves into the text of its block. Elements whose contents are never shown as text,
or are controls of a form, are left out. Unclosed and crossing tags are closed as browsers do in the
common cases: a block ends an open paragraph, an item ends the item before it, an end tag without a
start is ignored, a tag or comment without an end takes the rest.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import numpy as np

# Element names by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe textarea title xmp noframes".split())
HIDDEN = frozenset("head svg math canvas audio video object select button label datalist legend".split())
BLOCKS = frozenset(
    "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption "
    "thead tbody tfoot tr td th form fieldset blockquote pre figure figcaption address hgroup details summary center "
    "menu dialog search".split()
)
#: Elements that need no end tag.
LOOSE = frozenset("p li dt dd td th tr".split())
#: An element that is open when one of its values begins, and has no end of its own, ends there.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
CONTROLS = frozenset("input button label select textarea option".split())

# Quotes count only behind "="; all parts are possessive, so a failing match gives nothing back.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SENTENCE = re.compile(r"[.!?,;:]")


def attribute_tokens(name: str, attributes: str) -> tuple[str, ...]:
    """The element's name and the words of its class, id, role and itemprop."""
    found = [f"<{name}"]
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            found += [p.lower() for p in _PART.findall(m[1])]
    return tuple(dict.fromkeys(found))


@dataclass
class Page:
    """Elements in page order, a root first. Element ``i`` spans ``i`` to ``end[i]``.

    Text that has elements beside it is a child of its own, named ``#text``; other text belongs to its
    element. ``text`` is empty where there is none.
    """

    name: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    controls: list[int] = field(default_factory=list)

    def add(self, name: str, attributes: str, parent: int, depth: int) -> int:
        self.name.append(name)
        self.attributes.append(attributes)
        self.parent.append(parent)
        self.depth.append(depth)
        self.end.append(0)
        self.text.append("")
        self.linked.append(0)
        self.controls.append(0)
        return len(self.name) - 1


def parse(source: str) -> Page:
    page = Page()
    stack = [page.add("#root", "", -1, 0)]
    opened: dict[str, int] = {}
    pieces: list[str] = []
    links = 0  # characters of ``pieces`` inside links
    in_link = False
    hidden = inside = 0  # open elements that are not shown, and blocks opened inside them
    at, size = 0, len(source)

    def flush() -> None:
        """The text so far becomes a leaf below the open element."""
        nonlocal links
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                leaf = page.add("#text", "", stack[-1], len(stack))
                page.text[leaf] = text
                page.linked[leaf] = min(links, len(text))
                page.end[leaf] = leaf + 1
            pieces.clear()
            links = 0

    def close() -> None:
        flush()
        node = stack.pop()
        opened[page.name[node]] -= 1
        page.end[node] = len(page.name)

    while at < size:
        start = source.find("<", at)
        if start < 0:
            start = size
        if start > at and not hidden:
            pieces.append(source[at:start])
            if in_link:
                links += start - at
        if start == size:
            break
        following = source[start + 1 : start + 2]
        if following == "!" or following == "?":
            mark = "-->" if source.startswith("!--", start + 1) else ">"
            # A comment may end where it begins: <!--> and <!--->.
            stop = source.find(mark, start + 2 if mark == "-->" else start + 1)
            if stop < 0:
                break
            at = stop + len(mark)
            continue
        if not following.isalpha() and following != "/":
            if not hidden:
                pieces.append("<")
            at = start + 1
            continue
        tag = _TAG.match(source, start)
        if tag is None:
            if following == "/" and not source[start + 2 : start + 3].isalpha():
                stop = source.find(">", start)  # an end tag without a name is a comment
            else:
                stop = -1
            if stop < 0:
                break
            at = stop + 1
            continue
        at = tag.end()
        ends, name, attributes = tag[1], tag[2].lower(), tag[3]
        if name in RAW:
            if not ends:
                stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                if stop is None:
                    break
                if name == "textarea":
                    page.controls[stack[-1]] += 1
                at = stop.start()
            continue
        if name in HIDDEN:
            if name in CONTROLS and not ends:
                page.controls[stack[-1]] += 1
            if not ends and not attributes.endswith("/"):
                opened[name] = opened.get(name, 0) + 1
                hidden += 1
            elif ends and opened.get(name):
                opened[name] -= 1
                hidden -= 1
                inside = inside if hidden else 0
            continue
        if hidden and name in BLOCKS:
            if not ends and hidden == opened.get("head", 0):  # a head without an end
                hidden = opened["head"] = 0
            elif name not in LOOSE:
                inside += -1 if ends else 1
                if inside < 0:  # the end of an element around it
                    for other in HIDDEN:
                        opened.pop(other, None)
                    hidden = inside = 0
        if hidden:
            continue
        if name in BLOCKS:
            if ends:
                if opened.get(name):
                    while page.name[stack[-1]] != name:
                        close()
                    close()
                elif name == "p":
                    flush()
            else:
                flush()
                if page.name[stack[-1]] == "p":
                    close()
                while name in ENDED_BY.get(page.name[stack[-1]], ()):
                    close()
                node = page.add(name, attributes, stack[-1], len(stack))
                stack.append(node)
                opened[name] = opened.get(name, 0) + 1
            in_link = False
        elif name == "a":
            in_link = not ends
        elif name == "br" or name == "hr" or name == "img":
            pieces.append(" ")
            if name == "hr":
                flush()
        elif name == "input":
            page.controls[stack[-1]] += 1
    opened["#root"] = 1
    while stack:
        close()
    return _folded(page)


def _folded(page: Page) -> Page:
    """Text without elements beside it goes to its element."""
    n = len(page.name)
    children = [0] * n
    for p in page.parent[1:]:
        children[p] += 1
    alone = [page.name[i] == "#text" and page.parent[i] > 0 and children[page.parent[i]] == 1 for i in range(n)]
    if not any(alone):
        return page
    number, out = [0] * (n + 1), Page()
    for i in range(n):
        number[i] = len(out.name)
        if alone[i]:
            p = number[page.parent[i]]
            out.text[p], out.linked[p] = page.text[i], page.linked[i]
            continue
        parent = number[page.parent[i]] if i else -1
        out.add(page.name[i], page.attributes[i], parent, page.depth[i])
        out.text[-1], out.linked[-1], out.controls[-1] = page.text[i], page.linked[i], page.controls[i]
    number[n] = len(out.name)
    kept = [i for i in range(n) if not alone[i]]
    out.end = [number[page.end[i]] for i in kept]
    return out


#: What ``measure`` returns of an element, in order.
FEATURES = (
    "log_chars", "link_share", "chars_per_element", "marks_per_char", "depth", "position", "page_share", "sibling_place",
    "log_siblings", "parent_share", "own_tokens", "best_above", "worst_above", "chars_per_text", "same_name_siblings",
    "mean_sibling", "controls_per_element", "paragraph_share", "is_text", "digit_share", "largest_sibling", "is_heading",
    "parent_log_chars", "parent_link_share", "parent_marks_per_char", "parent_chars_per_text", "parent_page_share", "parent_tokens",
)


def measure(pages: list[Page], token_score) -> np.ndarray:
    """Features of all elements of ``pages``, page after page; ``token_score(name, attributes)`` is a number."""
    sizes = np.array([len(p.name) for p in pages], np.int64)
    first = np.cumsum(sizes) - sizes
    base = np.repeat(first, sizes)
    n = int(sizes.sum())

    def joined(of, kind=np.float64) -> np.ndarray:
        return np.fromiter((v for p in pages for v in of(p)), kind, n)

    index = np.arange(n)
    parent = joined(lambda p: p.parent, np.int64) + base
    root = index == base
    parent[root] = index[root]
    end = joined(lambda p: p.end, np.int64) + base
    depth = joined(lambda p: p.depth)
    own_chars = joined(lambda p: map(len, p.text))

    def below(x: np.ndarray) -> np.ndarray:
        """Sum over each element and all below it."""
        total = np.concatenate(([0.0], np.cumsum(x)))
        return total[end] - total[index]

    chars = below(own_chars)
    linked = below(joined(lambda p: p.linked))
    marks = below(joined(lambda p: [len(_SENTENCE.findall(t)) if t else 0 for t in p.text]))
    digits = below(joined(lambda p: [sum(map(t.count, "0123456789")) if t else 0 for t in p.text]))
    controls = below(joined(lambda p: p.controls))
    texts = below(own_chars > 0)
    paragraphs = below(own_chars * joined(lambda p: [name == "p" for name in p.name]))
    elements = (end - index).astype(np.float64)
    whole = np.maximum(chars[base], 1)
    before = np.concatenate(([0.0], np.cumsum(own_chars)))
    position = (before[index] - before[base]) / whole
    siblings = np.bincount(parent[~root], minlength=n)[parent].astype(np.float64)
    siblings[root] = 1
    # Children of one parent in page order: their rank among those with the same parent.
    order = np.lexsort((index, parent))
    order = order[~root[order]]
    place = np.zeros(n)
    if len(order):
        heads = np.flatnonzero(np.concatenate(([True], parent[order][1:] != parent[order][:-1])))
        place[order] = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
    names = np.array([name for p in pages for name in p.name])
    _, name = np.unique(names, return_inverse=True) if n else (None, np.zeros(0, np.int64))
    kind = parent * (int(name.max()) + 1 if n else 1) + name
    _, kind = np.unique(kind, return_inverse=True) if n else (None, np.zeros(0, np.int64))
    alike = np.bincount(kind)[kind] / np.maximum(siblings, 1) if n else np.zeros(0)
    largest = np.zeros(n)
    np.maximum.at(largest, parent[~root], chars[~root])
    largest = largest[parent]
    token = np.fromiter((token_score(a, b) for p in pages for a, b in zip(p.name, p.attributes)), np.float64, n)
    best, worst = token.copy(), token.copy()
    for level in range(1, int(depth.max()) + 1 if n else 0):
        at = np.flatnonzero(depth == level) if level < 64 else None
        if at is None:
            break
        best[at] = np.maximum(best[at], best[parent[at]])
        worst[at] = np.minimum(worst[at], worst[parent[at]])
    deep = np.flatnonzero(depth >= 64)
    for i in deep.tolist():  # parents come before their children
        best[i], worst[i] = max(best[i], best[parent[i]]), min(worst[i], worst[parent[i]])
    least = np.maximum(chars, 1)
    of_parent = np.maximum(chars[parent], 1)
    return np.column_stack([
        np.log1p(chars), linked / least, np.log1p(chars / elements), marks / least, np.minimum(depth, 40), position,
        chars / whole, place / np.maximum(siblings - 1, 1), np.log1p(siblings), chars / of_parent, token, best, worst,
        np.log1p(chars / np.maximum(texts, 1)), alike, np.log1p(of_parent / np.maximum(siblings, 1)), controls / elements,
        paragraphs / least, names == "#text", digits / least, largest / of_parent,
        np.isin(names, ["h1", "h2", "h3", "h4", "h5", "h6"]),
        *(x[parent] for x in (np.log1p(chars), linked / least, marks / least, np.log1p(chars / np.maximum(texts, 1)), chars / whole, token)),
    ]).astype(np.float32)
