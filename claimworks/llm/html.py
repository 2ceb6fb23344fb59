"""Main text of web pages by tree scoring.

A page becomes a tree of its block elements; inline markup only adds text. Blocks of text
give points for length and commas, less their share of link text, to the element that holds
them, and each element passes half of its points on to the one above (an article all of
them, a main element nine tenths). Some tags and class words add points. An element's score
is its points less its share of link text; the best one is kept whole, and with it the
siblings that score well beside it. No tag decides by itself.

Left out: elements that are menus, headers outside the article, footers, sidebars, notices,
adverts, forms, hidden parts and reader comments, by tag, role or the words of class and
id; scripts, styles and the head. Class words only speak of containers: a paragraph, heading,
list item or cell is never left out for its own class, nor a container with a first heading or an
article in it. Character references are decoded, white space in a block becomes one space,
blocks are joined by a line end in page order; nothing else is dropped.

Work is linear in the page: tags are scanned once, open elements are found by tag, points go
up and decisions go down the tree in one pass each.

Null and empty pages give the empty text. Unclosed and misnested tags are allowed: a block
tag ends an open paragraph, an end tag without a start is ignored, a tag that never ends is
text. Repeated rows are extracted each. Columns of the input named `text` or `n_chars` are
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import read, ship, without

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
#: The rest of a tag: a quoted value may hold the sign that ends one.
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements whose content is not text of the page.
RAW = set("script style template iframe title".split())
BLOCKS = set(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption head "
    "button textarea select".split()
)
BREAKS = {"br", "hr"}
#: Elements that end an open one of these when they start, and the elements that shield it.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
OUT_TAGS = set("nav footer aside form dialog menu button textarea select head".split())
OUT_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
OUT_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "newsletter subscribe subscription signup sidebar comment comments disqus reply replies respond share sharing social related recommended breadcrumb breadcrumbs "
    "menu navbar nav navigation footer masthead pagination pager popup modal overlay widget widgets login search skip toolbar hidden copyright disclaimer header topbar".split()
)
#: Elements that class words can leave out.
CONTAINERS = set("div section span ul ol dl table header figure details center fieldset".split())
GOOD_WORDS = set("article body content entry main page post text blog story".split())
START_POINTS = {"article": 60.0, "main": 40.0, "section": 3.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "address": -3.0, "li": -3.0}
GOOD_POINTS = 25.0
#: The share of its kids' points that an element gets.
PASSED = {"article": 1.0, "main": 0.9}
#: Blocks whose points go to the element around them.
LEAVES = set("p pre span h1 h2 h3 h4 h5 h6 li td blockquote".split())


class _Node:
    __slots__ = ("tag", "up", "out", "by_word", "good", "holds", "within", "kids", "points", "chars", "links", "keep")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.up, self.kids = tag, None, []
        self.points = self.chars = self.links = 0.0
        self.out, self.by_word, self.good, self.keep = tag in OUT_TAGS, False, False, False
        self.holds = self.within = False
        if attrs:
            self._marks(attrs)

    def _marks(self, attrs: str) -> None:
        words: set[str] = set()
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                words |= {w.lower() for w in _WORD.findall(value)}
            elif name == "role":
                self.out |= value.lower() in OUT_ROLES
                self.good |= value.lower() in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                self.out = True
        self.good |= bool(words & GOOD_WORDS)
        self.by_word = bool(words & OUT_WORDS) and self.tag in CONTAINERS


def _tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """('text', text, ''), ('start', tag, attributes) and ('end', tag, '') in page order; comments and raw elements are skipped."""
    at, begin, quotes = 0, 0, True  # `begin`: where text not yet given starts
    while True:
        at = html.find("<", at)
        if at < 0 or at + 1 >= len(html):
            break
        after = html[at + 1]
        kind = attrs = ""
        tag = ""
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = len(html) if end < 0 else end + 3
        elif after in "!?" or (after == "/" and not html[at + 2 : at + 3].isalpha()):
            end = html.find(">", at) + 1
        elif m := _TAG.match(html, at):
            rest = _REST.match(html, m.end()) if quotes else None
            quotes = rest is not None  # no quote closes from here on, if one search ran to the end
            end = rest.end() if rest else html.find(">", m.end()) + 1
            kind, tag, attrs = ("end" if after == "/" else "start"), m[1].lower(), html[m.end() : max(end - 1, 0)]
        else:
            at += 1
            continue
        if end <= 0:  # no tag ends from here on
            break
        if at > begin:
            yield "text", html[begin:at], ""
        at = begin = end
        if kind == "start" and tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, end)
            at = begin = close.end() if close else len(html)
        elif kind:
            yield kind, tag, attrs
    if begin < len(html):
        yield "text", html[begin:], ""


class _Open:
    """The open elements: the innermost one, and the depth of the innermost of each tag."""

    def __init__(self, root: _Node):
        self.stack, self.depths, self.solid = [root], {}, [0]

    def push(self, node: _Node) -> None:
        node.up = self.stack[-1]
        node.up.kids.append(node)
        self.depths.setdefault(node.tag, []).append(len(self.stack))
        if node.tag not in ("span", "button"):
            self.solid.append(len(self.stack))
        self.stack.append(node)

    def depth(self, tags: set[str]) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def cut(self, depth: int) -> None:
        """Close the element at `depth` and all within it."""
        while len(self.stack) > depth:
            self.depths[self.stack.pop().tag].pop()
            if self.solid[-1] == len(self.stack):
                self.solid.pop()

    def make_room(self, tag: str) -> None:
        """Close what a block of this tag ends."""
        if self.stack[self.solid[-1]].tag == "p":
            self.cut(self.solid[-1])
        if tag in CLOSES:
            found = self.depth(CLOSES[tag])
            if found > self.depth(FENCES[tag]):
                self.cut(found)


def _parse(html: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """The elements, each after the one around it, and the blocks of text in page order: element, text, characters in links."""
    root = _Node("#page")
    open_, nodes = _Open(root), [root]
    blocks: list[tuple[_Node, str, int]] = []
    pieces: list[str] = []
    linked: list[str] = []
    in_link = False

    def flush() -> None:
        if pieces:
            text = " ".join(_decoded("".join(pieces)).split())
            if text:
                blocks.append((open_.stack[-1], text, min(len(text), len(" ".join(_decoded(" ".join(linked)).split())))))
            pieces.clear()
            linked.clear()

    for kind, tag, attrs in _tokens(html):
        if kind == "text":
            pieces.append(tag)
            if in_link:
                linked.append(tag)
        elif tag in BREAKS:
            flush()
        elif tag == "a":
            in_link = kind == "start"
        elif kind == "end":
            if open_.depths.get(tag):
                flush()
                open_.cut(open_.depths[tag][-1])
                in_link = False
            elif tag == "p":
                flush()
        elif tag in BLOCKS:
            flush()
            in_link = False
            open_.make_room(tag)
            nodes.append(_Node(tag, attrs))
            open_.push(nodes[-1])
        elif tag == "span" and attrs and attrs[-1] != "/":
            node = _Node(tag, attrs)
            if node.out or node.by_word:
                flush()
                nodes.append(node)
                open_.push(node)
    flush()
    return nodes, blocks


def _decoded(text: str) -> str:
    return unescape(text) if "&" in text else text


def _settle(nodes: list[_Node]) -> None:
    """Decide what is out, with all that is in it."""
    for n in reversed(nodes):
        n.holds |= n.tag in ("article", "main", "h1")
        if n.up is not None:
            n.up.holds |= n.holds
    for n in nodes:
        if n.up is not None:
            n.within = n.up.within or n.up.tag in ("article", "main")
            n.out |= n.up.out
        n.out |= (n.tag == "header" and not n.within) or (n.by_word and not n.holds)


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    nodes, blocks = _parse(html)
    _settle(nodes)
    live = [b for b in blocks if not b[0].out]
    if not live:
        return ""
    for node, text, links in live:
        # Inner punctuation is what prose has and menus lack.
        holder = node.up if node.tag in LEAVES and node.up is not None else node
        holder.points += (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)) * (1 - links / len(text))
        holder.chars += len(text)
        holder.links += links
    for n in reversed(nodes):
        if n.up is not None:
            n.up.points += n.points * PASSED.get(n.up.tag, 0.5)
            n.up.chars += n.chars
            n.up.links += n.links
    best = None
    for n in nodes:
        n.points = (n.points + START_POINTS.get(n.tag, 0.0) + GOOD_POINTS * n.good) * (1 - n.links / n.chars) if n.chars else 0.0
        if n.chars and n.tag not in ("html", "#page") and (best is None or n.points > best.points):
            best = n
    best = best or nodes[0]
    best.keep = True
    if best.up is not None and best.tag != "body":
        for k in best.up.kids:
            quiet = k.links < 0.3 * max(k.chars, 1)
            k.keep |= not k.out and (k.tag == "h1" or (k.chars > 0 and quiet and k.tag == best.tag and k.points >= max(10.0, 0.2 * best.points)))
        for node, text, links in live:
            node.keep |= node.up is best.up and node.tag == "p" and len(text) > 80 and links < 0.25 * len(text)
    for n in nodes:
        n.keep |= n.up is not None and n.up.keep
    return "\n".join(text for node, text, _ in live if node.keep)


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """All columns of `df`, `text` and `n_chars`."""
    df = without(df, *[c for c in ("text", "n_chars") if c != html])
    ship(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name.lower() not in ("text", "n_chars")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(html).to_pylist()]
            out = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *out], names=[*names, "text", "n_chars"])

    return df.mapInArrow(run, schema)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("page"))
    return extract(pages, "page").select("page_id", "url", "text", "n_chars")
