"""Main text of web pages by composite text density."""
from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import pick, pieces, texts
from docquarry.llm.registry import query
from docquarry.session import spread

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
                    "strike strong sub sup time tt u var wbr").split())
#: Never main text.
DROPPED = frozenset(("head script style noscript template title iframe object embed svg math canvas audio video map nav aside footer form "
                     "button select textarea input datalist dialog menu").split())
#: Words of class, id or role that name what is not main text.
NAMED = frozenset(("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies "
                   "disqus footer gdpr masthead menu modal nav navbar navigation navigational newsletter notice notices notification overlay "
                   "pager pagination popup promo promotion recommended related replies respond share sharing sidebar signup skip social "
                   "sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets complementary contentinfo search").split())
#: Of these, words that also stand in the names of parts of a text; such a node goes only if it is mostly links.
AMBIGUOUS = frozenset("promo recommended related replies respond search share sharing skip social teaser menu pager".split())
#: Parts of a class or id that say where or in what form something stands.
PLACES = frozenset(("site page main global top bottom left right center header head foot primary secondary inner outer container wrapper wrap box block "
                    "bar area list item items link links form section region row col column content text body post posts article entry single "
                    "mobile desktop sticky fixed large small big mini wide full panel banner zone slot unit new wp js id").split())
#: Parts of a class or id that make it tell what a page has, or the state of it, and not what the element is.
STATES = frozenset(("has have no not with without is show hide enable enabled disable disabled open opened close closed fixed sticky on off active "
                    "inactive visible allowed").split())
MENU_LINK = 24  # characters of a menu's link at most, on average
ROOTS = frozenset("html body main article".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: A list item closes the item before, but none outside its own list.
SCOPE = frozenset("ul ol dl table select body html article section div".split())

# nothing in it is tried twice: a quoted value follows a sign, all else is one character; a tag, comment or
# declaration that the page's end cuts off is markup too
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)", re.S)
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


class Page:
    """Nodes of a page in order of their start tags, as columns; texts and block ends in page order."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.dropped = ["#root"], [0], [False]
        self.doubtful: dict[int, bool] = {}  # forms and nodes named like what is not main text
        self.linked: set[int] = set()  # of these, those whose name is ambiguous: only boxes of links go
        self.chars, self.links, self.tags, self.link_tags = [0], [0], [0], [0]
        self.runs: list[tuple[int, str | None]] = []  # (node, text), text None: a block ends
        self.stack, self.open_links, self.in_head = [0], 0, True
        self.open = Counter()  # open nodes by tag, so that no end tag looks through the stack in vain
        self.outer = [0]  # open nodes that are not inline
        self._read(html)
        if self.doubtful:
            self._settle()
        self._sum()

    def _open(self, tag: str, attributes: str) -> int:
        stack = self.stack
        if self.in_head and tag not in IN_HEAD and tag != "head":
            self._close("head")
            self.in_head = False
        if tag not in INLINE:
            if tag not in VOID or tag == "hr":
                self._close_scoped({"p"}, SCOPE | {"td", "th", "li"})
            self.runs.append((stack[-1], None))
        if tag in CLOSES:
            self._close_scoped(CLOSES[tag], SCOPE)
        up = stack[-1]
        node = len(self.tag)
        bad = (tag in DROPPED and tag != "form") or (tag == "header" and not self.open["article"] and not self.open["main"])
        doubtful = tag == "form"
        if attributes and not bad and tag not in ("html", "body"):
            names = " ".join(a or b or c for a, b, c in _NAME.findall(attributes)).lower()
            kind = named(names) if names else None
            if kind and not doubtful and kind <= AMBIGUOUS:
                self.linked.add(node)
            doubtful = doubtful or bool(kind)
            bad = tag not in ROOTS and bool(_HIDDEN.search(attributes))
        if doubtful and not bad:
            self.doubtful[node] = tag in ROOTS  # an article or main stays, but is no sign of main text
        for column, value in ((self.tag, tag), (self.parent, up), (self.dropped, bad or self.dropped[up]), (self.chars, 0), (self.links, 0),
                              (self.tags, 0), (self.link_tags, 0)):
            column.append(value)
        return node

    def _pop(self) -> None:
        node = self.stack.pop()
        self.open[self.tag[node]] -= 1
        if self.tag[node] == "a":
            self.open_links -= 1
        if self.tag[node] not in INLINE:
            self.outer.pop()
            self.runs.append((self.stack[-1], None))

    def _close(self, tag: str) -> None:
        """Close the innermost open ``tag`` and all in it, if there is one."""
        if self.open[tag]:
            while self.tag[self.stack[-1]] != tag:
                self._pop()
            self._pop()

    def _close_scoped(self, tags: set[str], scope: frozenset[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        for node in reversed(self.outer):  # what is closed here and what ends the search is never inline
            if self.tag[node] in tags:
                while self.stack[-1] != node:
                    self._pop()
                self._pop()
                return
            if self.tag[node] in scope:
                return

    def _text(self, raw: str) -> None:
        node = self.stack[-1]
        if not raw or self.dropped[node]:
            return
        text = unescape(raw)
        self.runs.append((node, text))
        n = len(text) - text.count(" ")
        self.chars[node] += n
        if self.open_links:
            self.links[node] += n

    def _read(self, html: str) -> None:
        at = 0
        while found := _MARKUP.search(html, at):
            self._text(html[at:found.start()])
            at = found.end()
            slash, tag, attributes = found.groups()
            if tag is None:
                continue
            tag = tag.lower()
            if slash:
                if tag == "p" and not self.open["p"]:
                    self.runs.append((self.stack[-1], None))
                self._close(tag)
            elif tag in ("html", "body") and tag in self.tag:
                continue
            else:
                node = self._open(tag, attributes)
                if tag in RAW:
                    end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                    at = end.end() if end else len(html)
                elif tag == "br":
                    self.runs.append((self.stack[-1], " "))
                elif tag not in VOID and not attributes.endswith("/"):
                    self.stack.append(node)
                    self.open[tag] += 1
                    if tag not in INLINE:
                        self.outer.append(node)
                    self.open_links += tag == "a"
        self._text(html[at:])

    def _settle(self) -> None:
        """Drop the doubtful nodes, but for those that hold the page's text.

        A doubtful node stays if no article or main is beside it, and it
        contains one or over half of the page's characters out of links, and
        nearly all of those of an article or main around it.
        Outer nodes come first; an article in another doubtful node is none."""
        n = len(self.tag)
        end, plain, near = list(range(n)), [c - x for c, x in zip(self.chars, self.links)], [-1] * n
        whole = list(self.chars)
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            end[p] = max(end[p], end[i])
            plain[p] += plain[i]
            whole[p] += whole[i]
        asked = [i for i, root in self.doubtful.items() if not root]
        for i in asked:
            near[i] = i
        for i in range(1, n):
            near[i] = max(near[i], near[self.parent[i]])  # the innermost doubtful node around
        marks = [i for i in range(n) if self.tag[i] in ("article", "main") and not self.dropped[i] and i not in self.doubtful and plain[i]]
        inner, set_marks = {near[m] for m in marks}, set(marks)
        main = list(range(n))  # the article or main around a node, else the page
        for i in range(n):
            main[i] = i if i in set_marks else main[self.parent[i]]
        later = [n] * (len(marks) + 1)
        for k in range(len(marks) - 1, -1, -1):
            later[k] = min(later[k + 1], near[marks[k]])
        gone, k, closed = -1, 0, n
        for i in asked:
            if i <= gone:
                continue
            while k < len(marks) and marks[k] < i:
                if not self.dropped[marks[k]]:
                    closed = min(closed, end[marks[k]])
                k += 1
            beside = closed < i or later[bisect_right(marks, end[i])] < i
            most = 2 * plain[i] > plain[0] and 10 * plain[i] > 9 * plain[main[i]]
            if not beside and (i in inner or most):
                continue
            if i in self.linked and 2 * plain[i] > whole[i]:
                continue
            gone = end[i]
            for j in range(i, end[i] + 1):
                self.dropped[j], self.chars[j], self.links[j] = True, 0, 0
        self.runs = [(j, text) for j, text in self.runs if text is None or not self.dropped[j]]

    def _sum(self) -> None:
        """Characters and tags below every node, links apart; dropped nodes count nowhere."""
        n = len(self.tag)
        self.end = list(range(n))
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            self.end[p] = max(self.end[p], self.end[i])
            if not self.dropped[i]:
                link = self.tag[i] == "a"
                self.chars[p] += self.chars[i]
                self.links[p] += self.links[i]
                self.tags[p] += self.tags[i] + 1
                self.link_tags[p] += self.link_tags[i] + link
        body = next((i for i, t in enumerate(self.tag) if t == "body"), 0)
        self.body = body
        part = self.links[body] / max(1, self.chars[body])
        self.density, self.total = [0.0] * n, [0.0] * n
        for i in range(n):
            if not self.dropped[i] and self.chars[i]:
                self.density[i] = composite(self.chars[i], self.tags[i], self.links[i], self.link_tags[i], part)
        for i in range(n - 1, 0, -1):
            self.total[self.parent[i]] += self.density[i]

    def content(self) -> int:
        """The node that holds the main text.

        The node with the largest sum of its children's densities comes first;
        the least density on its path to the body is the threshold. Other
        branches that reach it give their own nodes of the largest sum, and the
        lowest node above all of these is the result."""
        first = max(range(self.body, self.end[self.body] + 1), key=lambda i: (self.total[i] or self.density[i] / 2, -i))
        threshold, i = self.density[first], first
        while i != self.body:
            i = self.parent[i]
            threshold = min(threshold, self.density[i])
        marked = {first}
        low, high = first, first
        for i in range(self.body + 1, self.end[self.body] + 1):
            if self.density[i] >= threshold and not self.dropped[i] and self.tag[i] not in INLINE and self.chars[i] > 2 * self.links[i]:
                marked.add(i)
                low, high = min(low, i), max(high, i)
        top = first
        while not (top <= low and high <= self.end[top]):
            top = self.parent[top]
        return top

    def _above(self, node: int) -> Iterator[int]:
        while node:
            yield node
            node = self.parent[node]

    def text(self) -> str:
        """Blocks of the chosen node, without menus, joined by newlines. A menu is a box of links that are short and
        are most of its text, outside of an article or main: lists of references and tables of links belong to the text."""
        top = self.content()
        boxes, inside = [False] * len(self.tag), [False] * len(self.tag)
        inside[top] = any(self.tag[i] in ("article", "main") for i in self._above(top))
        for i in range(top + 1, self.end[top] + 1):
            inside[i] = inside[self.parent[i]] or self.tag[i] in ("article", "main")
            box = self.tag[i] not in INLINE and self.tag[i] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and self.link_tags[i] > 1 \
                and 2 * self.links[i] > self.chars[i] and self.links[i] < MENU_LINK * self.link_tags[i] and not inside[i]
            boxes[i] = box or boxes[self.parent[i]]
        blocks, block = [], []
        for node, text in self.runs:
            if text is None:
                if block:
                    blocks.append("".join(block))
                    block = []
            elif top <= node <= self.end[top] and not boxes[node]:
                block.append(text)
        blocks.append("".join(block))
        return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def named(names: str) -> frozenset[str] | None:
    """The words by which a class, id or role names what is not main text, if it does. 'site-footer' and
    'sidebar-left' do; 'has-sidebar' and 'comment-open' tell a state, 'search-methods' and 'advert-study' a topic."""
    found: set[str] = set()
    for name in names.split():
        parts = set(re.split(r"[^a-z]+", name)) - {""}
        if parts & NAMED and not parts & STATES and parts <= NAMED | PLACES:
            found |= parts & NAMED
    return frozenset(found) or None


def composite(chars: int, tags: int, links: int, link_tags: int, body_part: float) -> float:
    """Characters per tag, lowered by the share of links: C/T times the logarithm
    of (C/LC)(T/LT) to the base ln(C/(C - LC) LC + body_part C + e); counts of 0 count as 1."""
    t, lc, lt = max(1, tags), max(1, links), max(1, link_tags)
    plain = max(1, chars - links)
    base = max(math.log(chars / plain * links + body_part * chars + math.e), 1.0 + 1e-9)
    return chars / t * math.log(max(chars / lc * (t / lt), 1.0 + 1e-9)) / math.log(base)


def main_text(html: str) -> str:
    """Main text of one page; empty if it has none."""
    return Page(html).text() if html else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars (code points).

    Null and empty pages have the empty text; a page without markup is its own
    text; a tag that the page's end cuts off is markup; end tags of nothing are passed over; depth and number of
    nodes cost no more than their number; null ids and urls and repeated rows are kept; no rows give no rows.
    Pages are read one after the other, so memory is that of the longest page."""
    plain = pick(pages, id=id_col, url=url_col, html=html_col)
    schema = T.StructType([plain.schema["id"], plain.schema["url"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 128):
                found = pa.array(list(map(main_text, texts(batch["html"]))), pa.string())
                yield pa.record_batch([batch["id"], batch["url"], found], names=schema.names)

    return plain.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))


@query("op7_html_text")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return extract_text(spread(spark.read.parquet(f"{sf}/pages.parquet"))).withColumnRenamed("id", "page_id")
