"""Main-text extraction by composite text density.

Each page becomes a light DOM in one pass that never reads a character twice (implied ends of p, li and the like are honoured; quotes count only
after "=", and one that is never closed ends with its tag). Elements that are furniture by tag or role are left out. Every other node gets a composite density,
its characters per tag with a logarithm that falls with the share of link characters and tags, and a density sum over its children. The node of the largest sum is
the core; the smallest density on its path up to the body is the threshold. The core widens to the article or main element around it (with the articles beside it that are
dense as well), or else to ancestors of whose other children none but headings is below the threshold.

Names are evidence, never a verdict. An element one of whose classes or whose id has a word for menus, adverts, notices or reader comments is furniture if it is mostly links, or
if there is a core without it that holds more text (for comments, and where the core is an article or main element, a fifth is enough); else it takes part like any other, so that an article in a box with such a name is found.
Elements inside the core with names that may be furniture or not (notice, share, header) go only if measures agree: many link characters, or a density below the core's own without a
heading in them. Reader comments are also told by structure: like siblings that each have an author or time and a link to reply.

Defined results: null or empty html, and pages without text outside furniture, give ''; truncated pages are read as far
as they go (an unfinished tag at the end is dropped, an unfinished character reference is text); plain text without tags is its own
article; repeated pages are judged row by row; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

# Fixed values of HTML: void elements, elements whose start closes an open one, block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"}
FURNITURE_TAGS = frozenset(
    "script style noscript template iframe object svg math canvas audio video head title nav footer aside form button select textarea input dialog menu datalist".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of names that speak for furniture, those of reader comments, words that do only as a whole name, and words that say nothing beside them (fixed values).
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored cookie cookies consent gdpr privacy popup modal "
    "nav navbar navigation menu menus breadcrumb breadcrumbs masthead topbar footer sidebar sidebars pagination pager subscribe newsletter".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies responses reactions".split())
MAYBE_WORDS = frozenset(
    "banner promo promotion notice notices alert overlay header aside widget widgets toolbar related recommended share sharing social signup login reply respond discussion".split()
)
PLAIN_WORDS = frozenset(
    "area bar block body bottom box button buttons container content form group holder inner item items left link links list main outer page panel post posts "
    "right row section site slot thread top wrap wrapper".split()
)
BYLINE_WORDS = frozenset("author byline date time timestamp user username avatar posted".split())
REPLY_WORDS = frozenset("reply respond antworten antwort répondre responder".split())
LINK_SHARE = 1 / 3
#: A named element takes part if no core without it has as much text; one of comments, or beside an article or main element, if that has less than this share of its text.
#: It must have some text to be an article.
OTHER_SHARE = 1 / 5
LEAST_ARTICLE = 60
#: Articles beside the core's that are at least this dense, against it, belong to the page's text.
ARTICLE_SHARE = 1 / 4
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header caption figcaption".split())
_WORD = re.compile("[a-z]+")
_CAMEL = re.compile("(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "parts", "chars", "own", "tags", "link_chars", "link_tags", "density", "total", "furniture", "maybe", "named", "heading", "byline", "reply")

    def __init__(self, tag: str, parent: Node | None, furniture: bool = False, maybe: bool = False, named: str = "", byline: bool = False) -> None:
        self.tag, self.parent, self.furniture, self.maybe, self.named, self.byline, self.reply = tag, parent, furniture, maybe, named, byline or tag == "time", False
        self.parts: list[Node | str] = []
        self.chars = self.own = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.heading = False


# Possessive, so that a tag is read once: name, then attributes in which a quote opens a value only after "=".
_TAG = re.compile(r"""(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
_PLAIN_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_TELLING = re.compile("class|id|role|hidden", re.I)
RAW = frozenset("script style textarea title noscript iframe".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


class Builder:
    """Builds the tree; ``open`` has the depths of the open elements by tag."""

    def __init__(self) -> None:
        self.root = Node("html", None)
        self.stack = [self.root]
        self.open: dict[str, list[int]] = {}

    def feed(self, html: str) -> None:
        at, end, tag_at = 0, len(html), _TAG
        while at < end:
            start = html.find("<", at)
            if start < 0 or start + 1 == end:
                start = end
            head = html[start + 1 : start + 3]
            if start < end and not (head[0].isascii() and head[0].isalpha() or head[0] in "/!?"):
                self._text(html[at : start + 1])  # a sign, no tag
                at = start + 1
                continue
            self._text(html[at:start])
            if start == end:
                return
            if head[0] in "!?" or head[0] == "/" and not (head[1:].isascii() and head[1:].isalpha()):
                if html.startswith("<!--", start):
                    close = start + 1 if html.startswith(("<!-->", "<!--->"), start) else html.find("-->", start + 4)
                    at = end if close < 0 else html.find(">", close) + 1
                else:
                    close = html.find(">", start)
                    at = end if close < 0 else close + 1
                continue
            m = tag_at.match(html, start + 1)
            if m is None and tag_at is _TAG:  # the rest is one tag that does not end: from here on quotes count no more
                tag_at = _PLAIN_TAG
                m = tag_at.match(html, start + 1)
            if m is None:
                return
            at, tag = m.end(), m[2].lower()
            if m[1]:
                self._end(tag)
            else:
                self._start(tag, m[3])
                if tag in RAW:  # the content is no markup
                    close = _RAW_END[tag].search(html, at)
                    at = close.start() if close else end

    def _text(self, text: str) -> None:
        if text:
            self.stack[-1].parts.append(unescape(text) if "&" in text else text)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            if tag == "html" or self.open.get("body"):
                return
            self._pop_to(1)
        if tag in CLOSES_P:
            self._close({"p"}, ("table", "td", "th", "button", "object"))
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPE.get(tag, ("table",)))
        if tag in VOID:
            if tag in ("br", "hr"):
                self.stack[-1].parts.append(Node(tag, self.stack[-1]))
            return
        node = Node(tag, self.stack[-1], *self._furniture(tag, attributes))
        node.parent.parts.append(node)
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(node)

    def _end(self, tag: str) -> None:
        if tag == "br":
            self.stack[-1].parts.append(Node("br", self.stack[-1]))
        elif tag not in ("html", "body") and self.open.get(tag):
            self._pop_to(self.open[tag][-1])

    def _pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.open[self.stack.pop().tag].pop()

    def _close(self, tags: set[str], scope) -> None:
        """Ends the innermost open element of ``tags`` within the scope, and those of ``tags`` right around it."""
        depth = max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)
        if depth > max((self.open[t][-1] for t in scope if self.open.get(t)), default=0):
            while self.stack[depth - 1].tag in tags:
                depth -= 1
            self._pop_to(depth)

    def _furniture(self, tag: str, attributes: str) -> tuple[bool, bool, str, bool]:
        """Whether the element is furniture, whether it may be, what its names speak for, and whether they name an author or a time."""
        if tag in FURNITURE_TAGS or tag == "header" and not (self.open.get("article") or self.open.get("main")):
            return True, False, "", False
        if not attributes or not _TELLING.search(attributes):
            return False, False, "", False
        given = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
        if given.get("role", "").lower() in FURNITURE_ROLES or "hidden" in given or given.get("aria-hidden") == "true":
            return True, False, "", False
        if tag in ("body", "main"):
            return False, False, "", False
        maybe, named, byline = False, "", False
        for name in [*given.get("class", "").split(), given.get("id", "")]:
            words = set(_WORD.findall(_CAMEL.sub(" ", name).lower()))
            named = "comments" if words & COMMENT_WORDS else named or ("furniture" if words & FURNITURE_WORDS else "")
            maybe |= bool(words - PLAIN_WORDS) and words - PLAIN_WORDS <= MAYBE_WORDS
            byline |= bool(words & BYLINE_WORDS)
        return False, maybe and not named, named, byline


def parse(html: str) -> Node:
    builder = Builder()
    builder.feed(html)
    return builder.root


def _ordered(root: Node) -> list[Node]:
    """Nodes outside furniture, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [x for x in node.parts if isinstance(x, Node) and not x.furniture]
    return out


def _is_reply(node: Node) -> bool:
    text = "".join(x for x in node.parts if isinstance(x, str)).strip() if node.tag in ("a", "button") else ""
    return 0 < len(text) <= 24 and not REPLY_WORDS.isdisjoint(text.lower().split())


def _measure(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        node.chars = node.own = node.tags = node.link_chars = node.link_tags = 0
        node.density = node.total = 0.0
        node.heading = node.reply = False
        for x in node.parts:
            if isinstance(x, str):
                node.own += len("".join(x.split()))
            elif x.furniture:
                node.reply |= _is_reply(x)
            else:
                node.chars += x.chars
                node.byline |= x.byline
                node.reply |= x.reply or _is_reply(x)
                node.heading |= x.heading or x.tag in HEADINGS and x.chars > 0
                node.tags += x.tags + 1
                node.link_chars += x.chars if x.tag == "a" else x.link_chars
                node.link_tags += 1 if x.tag == "a" else x.link_tags
        node.chars += node.own
    top = nodes[0]
    share = top.link_chars / max(1, top.chars)
    for node in nodes:
        chars, link = node.chars, node.link_chars if node.tag != "a" else node.chars
        if chars:
            base = math.log(chars / max(1, chars - link) * link + share * chars + math.e)
            ratio = chars / max(1, link) * (max(1, node.tags) / max(1, node.link_tags))
            node.density = chars / max(1, node.tags) * max(0.0, math.log(max(ratio, 1.0))) / math.log(max(base, math.e / 2 + 0.2))
    for node in nodes:
        node.total = sum(x.density for x in node.parts if isinstance(x, Node) and not x.furniture)
        # text of the node's own is a child without tags
        if node.chars > node.link_chars:
            node.total += node.own


def densest(root: Node) -> Node | None:
    """The node of the largest density sum; all nodes are measured."""
    nodes = _ordered(root)
    _measure(nodes)
    return max((n for n in nodes if n.chars), key=lambda n: n.total, default=None)


def _path(node: Node) -> list[Node]:
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out


def _comment_lists(nodes: list[Node]) -> list[Node]:
    """Nodes whose like children each have an author or time and a link to reply."""
    out = []
    for node in nodes:
        if node.reply and node.byline:
            kids = [x for x in node.parts if isinstance(x, Node) and not x.furniture and x.chars]
            marked = [x for x in kids if x.byline and x.reply]
            if len(marked) >= 2 and len({x.tag for x in marked}) == 1:
                out.append(node)
    return out


def _judge_names(root: Node) -> Node | None:
    """Decides about named elements by measures, and returns the densest node."""
    nodes = _ordered(root)
    _measure(nodes)
    for node in _comment_lists(nodes):  # the comments only: what else stands beside them may be the article
        for x in node.parts:
            if isinstance(x, Node) and x.byline and x.reply:
                x.furniture = True
    named = [x for x in nodes if x.named and not x.furniture]
    held = [(x, x.chars, x.link_chars if x.tag != "a" else x.chars) for x in named]
    for x in named:
        x.furniture = True
    best = densest(root)
    found = [] if best is None else widened(best)
    without, told = max((x.chars for x in found), default=0), any(x.tag in ("article", "main") for x in found)
    freed = [x for x, chars, links in held if links < LINK_SHARE * chars and chars >= LEAST_ARTICLE and without < chars * (OTHER_SHARE if told or x.named == "comments" else 1)]
    if not freed:
        return best
    for x in freed:
        x.furniture = False
    return densest(root)


def widened(best: Node) -> list[Node]:
    """The elements whose text is the article, in page order."""
    path = _path(best)
    for tag in ("article", "main"):
        around = [n for n in path if n.tag == tag]
        if around:
            own = around[-1]
            beside = [x for x in own.parent.parts if isinstance(x, Node) and x.tag == tag and not x.furniture] if own.parent is not None else [own]
            return [x for x in beside if x is own or x.density >= ARTICLE_SHARE * own.density and x.link_chars < LINK_SHARE * x.chars]
    threshold = min(n.density for n in path)
    for above in path[1:]:
        others = [x for x in above.parts if isinstance(x, Node) and not x.furniture and x.chars and x is not best]
        if any(x.density < threshold and x.tag not in HEADINGS or x.maybe for x in others):
            break
        best = above
    return [best]


def _settle(node: Node) -> None:
    """Elements that may be furniture become it where measures agree."""
    for x in _ordered(node):
        if x.maybe and x is not node and x.chars:
            links = x.link_chars if x.tag != "a" else x.chars
            x.furniture = links >= LINK_SHARE * x.chars or x.density < node.density and not x.heading


def core(root: Node) -> list[Node]:
    """The elements that are the page's text."""
    best = _judge_names(root)
    if best is None:
        return []
    found = widened(best)
    for node in found:
        _settle(node)
    return found


def text_of(node: Node) -> str:
    """Blocks in page order; white space inside a block is one space."""
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run:
            block = " ".join("".join(run).split())
            run.clear()
            if block:
                blocks.append(block)

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        elif not x.furniture:
            if x.tag in BLOCK:
                end()
                stack.append(None)
            stack += reversed(x.parts)
    end()
    return "\n".join(blocks)


def main_text(html: str) -> str:
    return "\n".join(filter(None, map(text_of, core(parse(html)))))


SCHEMA = "page_id bigint, url string, text string"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [main_text(x) if x else "" for x in pc.fill_null(batch.column("html"), "").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html")).mapInArrow(_extract, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
