"""Main text of web pages by composite text density.

Each element has its characters per tag, adjusted for the share of them in links; where its tag, class or role names it as
menu, advert, comment and the like, a tenth of that. The sum of its children's densities picks the subtree that holds the
article, and the outermost article or main around it is taken whole. Beside it an area is kept that is not links for the
most part and whose characters stand in blocks about half as long, at least, as those of every element on the way up to the
body: that length does not grow with an area's size. Headings before it, lists and other articles need no such length. What is named as something else is then left out of what was picked,
unless it holds a main, the longest article that is not named itself, or more than half of the unlinked text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Fixed values of the markup: elements by behaviour.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "title", "textarea", "iframe", "svg", "math", "object", "audio", "video", "canvas", "xmp"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
          "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav",
          "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
PROSE = {"p", "blockquote", "pre"}
HEADINGS = {"h1", "h2", "h3"}
#: Areas beside the best one that need no long blocks: other articles, and lists unless of links.
OWN = {"article", "main", "ul", "ol", "dl"}
#: Elements that end where one of the same group starts, up to the element that holds the group.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
            "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
APART = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "fieldset", "label"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: A mark is a class or id, or starts it, or follows the name of what it belongs to; a state after it (share-enabled) names no such element.
MARKS = re.compile(
    r"(?:^|\s)(?:(?:site|page|main|post|entry|article|blog|cookie|global)[_-])?(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promo(?:s|tion|tions)?|banners?|cookies?|consent|gdpr|notices?|alerts?|"
    r"comments?|commentlist|disqus|respond|replies|sidebars?|side-bar|menus?|nav|navbar|navigation|breadcrumbs?|share|sharing|social|related|recommend(?:ed|ations)?|"
    r"newsletter|subscribe|subscription|signup|popup|modal|overlay|footer|foot|site-header|page-header|masthead|topbar|toolbar|pagination|pager|skip-link|widgets?|"
    r"tags?|tagcloud|print-only|hidden|sr-only)(?=$|[\s_-])"
    r"(?![_-](?:enabled|disabled|active|inactive|on|off|open|opened|closed|allowed|ready|visible|none|free|xs|sm|md|lg|xl|print|mobile|desktop)(?=$|[\s_-]))")

#: Density of elements named as something else, and the share of the body path's block length that an area beside it needs.
PRIOR, NEAR = 0.1, 0.5
_OPEN, _NAME, _STOP = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])"), re.compile(r"[^\s/>]+"), re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")


def _apart(tag: str, attributes: str, in_article: bool) -> int:
    """2 if an element is something other than main text, 1 if it is marked as such but may turn out to hold the article."""
    marked = int(tag in ("form", "fieldset"))
    if tag in APART and not marked or tag == "header" and not in_article:
        return 2
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            marked = 2
        elif name == "role" and value in ROLES or name in ("class", "id") and MARKS.search(value):
            marked = max(marked, 1)
    return marked


class _Markup:
    """Tags of a page in order. Each character is looked at a bounded number of times, whatever never closes."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}

    def tag_end(self, at: int) -> int:
        """Place of the > that ends the tag; quotes count after = only, and only if they close before another tag."""
        while at <= self.last[">"]:
            stop = _STOP.search(self.page, at)
            if stop is None:
                return -1
            at = stop.end()
            if stop[0] == ">":
                return at - 1
            if at <= self.last[stop[0]] and self.page[: at - 1][-8:].rstrip().endswith("="):
                close = self.page.find(stop[0], at)
                inside = self.page[at:close]
                if ">" not in inside or "<" not in inside[inside.index(">") :]:
                    at = close + 1
        return -1

    def tags(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, tag, closing, attributes); comments, declarations and all of raw elements have no tag."""
        page, at = self.page, 0
        while (found := _OPEN.search(page, at)) is not None:
            start = found.start()
            if found[0] == "<!--":
                end = page.find("-->", found.end())
                at = len(page) if end < 0 else end + 3
                yield start, at, "", False, ""
                continue
            end = self.tag_end(found.end())
            if end < 0:
                yield start, len(page), "", False, ""
                return
            at = end + 1
            if found[0] in ("<!", "<?"):
                yield start, at, "", False, ""
                continue
            name = _NAME.match(page, found.end() - 1)
            tag, attributes, closing = name[0].lower(), page[name.end() : end], found[0] == "</" or page[start + 1] == "/"
            if not closing and tag in RAW and not attributes.rstrip().endswith("/"):
                raw = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(page, at)
                at = len(page) if raw is None else raw.end()
            yield start, at, tag, closing, attributes


class Tree:
    """Elements of a page in document order; node 0 is the root. texts: (node, start of a new block, text)."""

    def __init__(self, page: str):
        self.tag, self.parent, self.marked, self.link = ["html"], [-1], [0], [False]
        self.texts: list[tuple[int, int, str]] = []
        self.open_nodes, self.places, self.open_blocks = [0], {}, [0]
        at, block = 0, 0
        for start, end, tag, closing, attributes in _Markup(page).tags():
            if start > at:
                self.texts.append((self.open_nodes[-1], block, page[at:start]))
            at = end
            if not tag:
                continue
            block += tag in BLOCKS
            if closing:
                self._close(tag)
                continue
            self._imply(tag)
            if tag == "html" or tag == "body" and self.places.get("body"):
                continue
            if tag == "br":
                self.texts.append((self.open_nodes[-1], block, " "))
            if tag not in RAW:
                self._add(tag, attributes)
        if at < len(page):
            self.texts.append((self.open_nodes[-1], block, page[at:]))
        self.apart = self._set_apart()

    def _set_apart(self) -> list[bool]:
        """Marked elements and what they hold, but for those that hold a main, the longest unmarked article or most of the unlinked text."""
        n = len(self.tag)
        never = [tag in ("html", "body", "article", "main") for tag in self.tag]
        gone, plain = [False] * n, [0] * n
        for node in range(1, n):
            gone[node] = gone[self.parent[node]] or self.marked[node] == 2 and not never[node]
        for node, _, text in self.texts:
            if not (gone[node] or self.link[node]):
                plain[node] += len("".join(text.split()))
        for node in range(n - 1, 0, -1):
            plain[self.parent[node]] += plain[node]
        articles = [node for node in range(n) if self.tag[node] == "article" and not self.marked[node] and plain[node]]
        longest = max(articles, key=lambda node: plain[node], default=0)
        held = [False] * n
        for node in range(n - 1, 0, -1):
            held[node] = held[node] or node == longest or self.tag[node] == "main" and plain[node] > 0
            held[self.parent[node]] = held[self.parent[node]] or held[node]
        apart = [False] * n
        for node in range(1, n):
            kept = never[node] or self.marked[node] == 1 and (held[node] or 2 * plain[node] > plain[0])
            apart[node] = apart[self.parent[node]] or self.marked[node] > 0 and not kept
        return apart

    def _add(self, tag: str, attributes: str) -> None:
        above = self.open_nodes[-1]
        self.tag.append(tag)
        self.parent.append(above)
        self.marked.append(_apart(tag, attributes, bool(self.places.get("article") or self.places.get("main"))))
        self.link.append(self.link[above] or tag == "a")
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open_nodes))
            if tag in BLOCKS:
                self.open_blocks.append(len(self.open_nodes))
            self.open_nodes.append(len(self.tag) - 1)

    def _innermost(self, tags: Iterable[str]) -> int:
        """Place of the last open element of some tags, 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _cut(self, place: int) -> None:
        """Ends the open elements from a place on."""
        while len(self.open_nodes) > place:
            self.places[self.tag[self.open_nodes.pop()]].pop()
        while self.open_blocks[-1] >= place:
            self.open_blocks.pop()

    def _close(self, tag: str) -> None:
        place = self._innermost((tag,))
        # A stray end of an inline element does not end blocks.
        if place and (tag in BLOCKS or place > self.open_blocks[-1]):
            self._cut(place)

    def _imply(self, tag: str) -> None:
        """Ends the elements that the start of this one ends."""
        if tag in BLOCKS and self.places.get("p"):
            self._cut(self.places["p"][-1])
        group, holders = SIBLINGS.get(tag, ((), ()))
        place = self._innermost(group)
        if place > self._innermost(holders):
            self._cut(place)


def densities(tree: Tree, chars: np.ndarray) -> np.ndarray:
    """Composite density of each element from the characters that stand directly in it."""
    n = len(tree.tag)
    total, linked = chars.astype(float), np.where(tree.link, chars, 0).astype(float)
    tags, link_tags = np.ones(n), np.array([float(x) for x in tree.link])
    own = tags.copy(), link_tags.copy()
    for node in range(n - 1, 0, -1):
        up = tree.parent[node]
        for values in (total, linked, tags, link_tags):
            values[up] += values[node]
    tags, link_tags = tags - own[0], link_tags - own[1]
    every, in_links = max(total[0], 1.0), linked[0]
    tags, link_tags, some = np.maximum(tags, 1), np.maximum(link_tags, 1), np.maximum(linked, 1)
    plain = np.maximum(total - linked, 1)
    base = np.log(total / plain * linked + in_links / every * total + np.e)
    weight = np.log(np.maximum(total / some * tags / link_tags, 1.0)) / np.log(np.maximum(base, 1 + 1e-9))
    return np.where(total > 0, total / tags * np.maximum(weight, 1e-6), 0.0)


def _below(tree: Tree, values: np.ndarray) -> np.ndarray:
    """Sum over each element and all that stands in it."""
    total = values.astype(float)
    for node in range(len(tree.tag) - 1, 0, -1):
        total[tree.parent[node]] += total[node]
    return total


def chosen(tree: Tree, density: np.ndarray, chars: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Which elements belong to the main text: the subtree of the best density sum, the outermost article or main around it,
    and on the way from there to the root the areas with blocks about as long, and headings. No density: nothing.

    blocks: for each element, the squares of the lengths of the blocks that stand in it, taken at each block's first element.
    """
    n = len(tree.tag)
    sums = np.zeros(n)
    block = np.array([tag in BLOCKS for tag in tree.tag])
    areas = np.where(block, density, 0.0) * np.where(tree.apart, PRIOR, 1.0)  # inline elements are no areas of their own
    np.add.at(sums, np.array(tree.parent[1:], int), areas[1:])
    if not sums.max() > 0:
        return np.zeros(n, bool) if density.max() <= 0 else ~np.array(tree.apart)
    best = list(range(n))
    for node in range(n - 1, 0, -1):
        up = tree.parent[node]
        if sums[best[node]] >= sums[best[up]]:
            best[up] = best[node]
    way = [best[0]]
    while tree.parent[way[-1]] >= 0:
        way.append(tree.parent[way[-1]])
    top = next((node for node in reversed(way) if tree.tag[node] in ("article", "main")), way[0])
    above = set(way[way.index(top) + 1 :])
    named = np.array(tree.apart)
    links = np.where(tree.link, chars, 0)
    held = _below(tree, chars)
    heavy = 2 * _below(tree, links) > held
    length = _below(tree, blocks) / np.maximum(held, 1)  # of the block that a character stands in, on average
    threshold = NEAR * min(length[node] for node in way[way.index(top) :])
    # Text that stands in an element of the way, or there in inline elements, is an area of its own.
    around = {node: [0, 0, 0.0] for node in above}
    run = [-1] * n
    for node in range(n):
        run[node] = node if node in above else -1 if block[node] or node == top else run[tree.parent[node]]
        if run[node] >= 0:
            for i, value in enumerate((chars[node], links[node], blocks[node])):
                around[run[node]][i] += value
    picked, dropped = np.zeros(n, bool), np.zeros(n, bool)
    for node in range(n):
        up = tree.parent[node]
        if node == top or up >= 0 and picked[up] and up not in above:
            picked[node] = True
        elif run[node] >= 0:
            text, linked, squares = around[run[node]]
            picked[node] = 2 * linked <= text and squares >= threshold * text
        elif up in above and not heavy[node] and (length[node] >= threshold or tree.tag[node] in OWN or tree.tag[node] in HEADINGS and node < top):
            picked[node] = True
        else:  # parts of an area of links or of short blocks
            dropped[node] = up in above or dropped[up]
            picked[node] = dropped[node] and not heavy[node] and tree.tag[node] in PROSE and length[node] >= threshold
    return picked & ~named


def main_text(page: str | None) -> str:
    """Blocks of the main text, one a line; empty if there is none."""
    if not page:
        return ""
    tree = Tree(page)
    texts = [(node, block, html.unescape(text)) for node, block, text in tree.texts]
    chars, lengths, first = np.zeros(len(tree.tag), int), Counter(), {}
    for node, block, text in texts:
        size = len("".join(text.split()))
        chars[node] += size
        lengths[block] += size
        first.setdefault(block, node)
    squares = np.zeros(len(tree.tag))
    for block, size in lengths.items():
        squares[first[block]] += size * size
    picked = chosen(tree, densities(tree, chars), chars, squares)
    blocks: dict[int, list[str]] = {}
    for node, block, text in texts:
        if picked[node]:
            blocks.setdefault(block, []).append(text)
    lines = (_SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame) -> DataFrame:
    """pages' columns but html, with text and n_chars (code points): the main text of each whole page.

    Null and empty pages have an empty text; markup that never closes ends with the page. Each row is read for itself:
    repeated rows repeat their text, no rows give none. Columns named text or n_chars are replaced.
    """
    pages = pages.drop("text", "n_chars").withColumn("html", F.col("html").cast("string"))
    kept = [c for c in pages.columns if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(page) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"])

    kinds = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in kept)
    return pages.select(*kept, "html").mapInArrow(run, f"{kinds}text string, n_chars long")
