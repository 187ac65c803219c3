"""Main text of web pages by composite text density.

Every DOM node gets its characters per tag, adjusted for links: link text lowers the
density, the more so where the page as a whole has few links. The densities of a node's
children are summed. The node with the greatest sum sets the threshold, the least density
on its path to the body. From the body down, every node that reaches the threshold marks
the subtree with the greatest sum below it; what is marked is the main text. Page
furniture that elements declare is then taken out of it, and a marked part of an
``article`` stands for the whole of that article. All steps are linear in the page.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)>",
    re.S,
)
#: For what follows a tag whose quotes never close.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Fixed values of HTML: elements without content, with raw text, blocks, and what closes an open paragraph or item.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes noembed xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol menu dl table tbody thead tfoot select".split())
_RAW_END = {t: re.compile(f"</{t}", re.I) for t in RAW}
#: What is never main text: elements, roles, and words in a class or id (chosen by us, not taken from a standard).
FURNITURE = frozenset("head nav footer aside form button select input dialog menu".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
COMMENTS = frozenset("comment comments commentlist disqus respond".split())
MARKS = COMMENTS | frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies "
    "copyright disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "outbrain overlay pager pagination popup promo promoted promotion recommended related search share sharing sidebar signup skip "
    "social sponsor sponsored subscribe subscription taboola toolbar widget widgets".split()
)
_WORDS = re.compile(r"[^a-z]+")
#: Names that tell of a layout, as ``has-sidebar``, say nothing of the element itself.
_MODIFIER = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without|is|show|hide)[-_]\S*", re.I)
_WHOLE = frozenset("html body main".split())
#: With one of these words a header is the article's own.
_OWN = frozenset("post entry article story content".split())
_STORY = frozenset(("article", "main"))
#: Elements that stay furniture even when they hold an article.
_NEVER = frozenset("head nav footer aside dialog menu button select input".split()) | RAW


def _furniture(tag: str, attrs: str, in_article: bool) -> int:
    """0: none, 1: declared in a way that layouts use as well, 2: surely furniture."""
    if tag in FURNITURE:
        return 2 if tag in _NEVER else 1
    if tag == "header" and not in_article:
        return 1
    if not attrs or tag in _WHOLE or tag == "article" and "comment" not in attrs.lower():
        return 0
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            words = set(_WORDS.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", _MODIFIER.sub("", value)).lower()))
            if words & COMMENTS:
                return 2
            if (words & MARKS) - {"header"} or "header" in words and not (in_article or words & _OWN):
                return 1
        elif name == "role" and value.lower() in ROLES:
            return 1
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            return 2
    return 0


class _Page:
    """Tags, parents and own furniture of the nodes, and (node, text) in page order; a text of "\\0" ends a block."""

    def __init__(self, page: str):
        self.tags, self.parents, self.declared = ["#root"], [-1], [0]
        self.items: list[tuple[int, str]] = []
        self._stack = [0]
        # depths of the open elements: of each tag, of blocks, and of what list items and cells end at
        self._open: dict[str, list[int]] = defaultdict(list)
        self._blocks: list[int] = []
        self._scopes: list[int] = []
        self._read(page)

    def _text(self, piece: str) -> None:
        if piece:
            self.items.append((self._stack[-1], html.unescape(piece) if "&" in piece else piece))

    def _break(self) -> None:
        self.items.append((self._stack[-1], "\0"))

    def _leave(self, depth: int) -> None:
        while len(self._stack) > depth:
            k = self._stack.pop()
            tag = self.tags[k]
            self._open[tag].pop()
            if tag in BLOCK:
                self._blocks.pop()
                self.items.append((k, "\0"))
            if tag in _SCOPE:
                self._scopes.pop()

    def _read(self, page: str) -> None:
        at = begin = 0
        size, last, pattern = len(page), page.rfind(">"), _TAG
        while 0 <= (here := page.find("<", begin)):
            sign, m = page[here + 1 : here + 2], None
            if sign in ("!", "?"):
                m = _TAG.match(page, here)
            elif here < last and (sign == "/" or sign.isalpha()):
                m = pattern.match(page, here)
                if m is None and pattern is _TAG and page[here + 1 : here + 3].lstrip("/")[:1].isalpha():
                    pattern = _PLAIN_TAG
                    m = pattern.match(page, here)
            if m is None:
                begin = here + 1
                continue
            self._text(page[at:here])
            at = begin = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            elif self._start(tag, m[3]) and tag in RAW:
                end = _RAW_END[tag].search(page, at)
                close = page.find(">", end.start()) if end else -1
                at = begin = size if close < 0 else close + 1
        self._text(page[at:])

    def _end(self, tag: str) -> None:
        held = self._open[tag]
        if held:
            # an inline end tag does not close a block
            if tag in BLOCK or not self._blocks or self._blocks[-1] < held[-1]:
                self._leave(held[-1])
        elif tag in ("br", "p"):
            self._break()

    def _start(self, tag: str, attrs: str) -> bool:
        """Opens an element; whether it may have content."""
        held = self._open
        if tag in ("html", "head", "body") and held[tag]:
            return False
        if held["head"] and (tag == "body" or tag in BLOCK and tag not in ("html", "title") and self.tags[self._stack[-1]] == "head"):
            self._leave(held["head"][-1])
        if tag in BLOCK:
            if tag != "br" and self._blocks and self.tags[self._stack[self._blocks[-1]]] == "p":
                self._leave(self._blocks[-1])
            if closes := _ITEMS.get(tag):
                scope = self._scopes[-1] if self._scopes else 0
                found = [d for t in closes if held[t] and (d := held[t][-1]) > scope]
                if found:
                    self._leave(min(found) if tag == "tr" else max(found))
            self._break()
        if tag in VOID:
            return False
        node, depth = len(self.tags), len(self._stack)
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        self.declared.append(_furniture(tag, attrs, bool(held["article"] or held["main"])))
        if tag not in RAW:
            self._stack.append(node)
            held[tag].append(depth)
            if tag in BLOCK:
                self._blocks.append(depth)
            if tag in _SCOPE:
                self._scopes.append(depth)
        return True


def _density(c: int, linked: int, count: int, links: int, ratio: float) -> float:
    """Of ``c`` characters, ``linked`` of them in links, over ``count`` tags, ``links`` of them links; ``ratio`` is the body's share of link text."""
    if not c:
        return 0.0
    base = math.log(c / max(c - linked, 1) * linked + ratio * c + math.e)
    adjusted = c / max(linked, 1) * max(count, 1) / max(links, 1)
    return c / max(count, 1) * math.log(max(adjusted, 1.0)) / math.log(max(base, math.e))


class _Measures:
    """Characters, link characters, densities and sums of the children's densities of all nodes."""

    def __init__(self, page: _Page, density=_density):
        tags, parents = page.tags, page.parents
        n = len(tags)
        link = [False] * n
        for k in range(1, n):
            link[k] = link[parents[k]] or tags[k] == "a"
        self.link, self.own = link, [0] * n
        self.chars, self.linked, count, links = [0] * n, [0] * n, [0] * n, [0] * n
        for k, t in page.items:
            if t != "\0":
                c = len(" ".join(t.split()))
                self.own[k] += c
                self.chars[k] += c
                self.linked[k] += c if link[k] else 0
        for k in range(n - 1, 0, -1):
            p = parents[k]
            count[p] += count[k] + 1
            links[p] += links[k] + (tags[k] == "a")
            self.chars[p] += self.chars[k]
            self.linked[p] += self.linked[k]
        self.body = next((k for k in range(n) if tags[k] == "body" and self.chars[k]), 0)
        ratio = self.linked[self.body] / max(self.chars[self.body], 1)
        self.density = [density(self.chars[k], self.linked[k], count[k], links[k], ratio) for k in range(n)]
        self.sums = [0.0] * n
        for k in range(n - 1, 0, -1):
            self.sums[parents[k]] += self.density[k]

    def marked(self, parents: list[int]) -> tuple[list[bool], float]:
        """Heads of the subtrees that are content, and the threshold."""
        n, body = len(parents), self.body
        top = list(range(n))  # the node of the greatest sum below each, itself included; the outer one of equals
        for k in range(n - 1, 0, -1):
            p = parents[k]
            if self.sums[top[k]] > self.sums[top[p]] or self.sums[top[k]] == self.sums[top[p]] and top[p] != p and top[k] < top[p]:
                top[p] = top[k]
        threshold, k = self.density[top[body]], top[body]
        while k > body:
            k = parents[k]
            threshold = min(threshold, self.density[k])
        reached, heads = [False] * n, [False] * n
        for k in range(body, n):
            reached[k] = (k == body or reached[parents[k]]) and self.density[k] >= threshold and (k == body or self.chars[k] > 0)
            if reached[k]:
                heads[top[k]] = True
        return heads, threshold


def _below(heads: list[bool], parents: list[int]) -> list[bool]:
    """Nodes that are heads or below one."""
    got = list(heads)
    for k in range(1, len(parents)):
        got[k] = got[k] or got[parents[k]]
    return got


def main_text(page: str | None, density=_density) -> str:
    """Of one page: blocks in page order, white space folded, joined by single spaces."""
    dom = _Page(page or "")
    tags, parents = dom.tags, dom.parents
    n = len(tags)
    of = _Measures(dom, density)
    heads, threshold = of.marked(parents)
    content = _below(heads, parents)
    declared = _kept_declarations(dom, of)
    gone = _below([d > 0 for d in declared], parents)
    # the article that each node is in: the innermost one, or else the innermost main
    story = [-1] * n
    for k in range(1, n):
        up = story[parents[k]]
        story[k] = k if tags[k] == "article" or tags[k] == "main" and (up < 0 or tags[up] == "main") else up
    inside: dict[int, int] = defaultdict(int)
    outside = 0
    for k in range(n):
        if content[k] and not gone[k] and not of.link[k] and of.own[k]:
            if story[k] >= 0:
                inside[story[k]] += of.own[k]
            else:
                outside += of.own[k]
    if sum(inside.values()) >= outside and inside:
        heads = [k in inside for k in range(n)]
    else:
        heads = [heads[k] or k in inside for k in range(n)]
    taken = list(heads)
    for k in range(1, n):
        if taken[parents[k]] and not gone[k]:
            menu = tags[k] in ("ul", "ol", "div", "section", "table") and of.linked[k] > 0.5 * of.chars[k] and of.density[k] < threshold
            taken[k] = taken[k] or not menu
    blocks, part = [], []
    for k, t in dom.items:
        if t == "\0":
            if part:
                blocks.append("".join(part))
                part = []
        elif taken[k] and not gone[k]:
            part.append(t)
    blocks.append("".join(part))
    return " ".join(" ".join(blocks).split())


def _kept_declarations(dom: _Page, of: _Measures) -> list[int]:
    """Declared furniture, less layout elements that turn out to hold the page's own text.

    Where furniture holds every article, the largest one's layout elements are not furniture.
    Without an article, neither are those that hold more than half of the text outside links and comments.
    """
    tags, parents, declared = dom.tags, dom.parents, list(dom.declared)
    n = len(tags)
    sure, any_ = [d == 2 for d in declared], [d > 0 for d in declared]
    in_sure, in_any = _below(sure, parents), _below(any_, parents)
    plain = [of.chars[k] - of.linked[k] for k in range(n)]
    stories = [k for k in range(n) if tags[k] in _STORY and not in_sure[k] and plain[k]]
    if stories:
        if all(in_any[k] for k in stories):
            k = max(stories, key=lambda k: (plain[k], -k))
            while k > 0:
                declared[k] = 0
                k = parents[k]
        return declared
    own = [0 if of.link[k] or in_sure[k] else of.own[k] for k in range(n)]
    for k in range(n - 1, 0, -1):
        own[parents[k]] += own[k]
    for k in range(n):
        if declared[k] == 1 and 2 * own[k] > own[0]:
            declared[k] = 0
    return declared


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple = ("url",)) -> DataFrame:
    """(id, *keep, text, n_chars long) per row of ``pages``; null or textless pages have an empty text.

    Rows are taken one by one: repeated and null ids yield a row each, an empty table none.
    Pages of any length are read whole, in time and memory in proportion to it. Columns
    other than these are not read, so their names don't matter.
    """
    cols = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t.as_py()) for t in b.column(len(cols))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*cols, "text", "n_chars"])

    rows = pages.select(*cols, F.col(html_col).cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(cols)])
    return rows.mapInArrow(run, f"{schema}, text string, n_chars long")
