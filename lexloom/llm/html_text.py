"""HTML extraction by composite text density: the densest subtrees of the DOM, link-adjusted, down to the body-path threshold."""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
_RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "textarea", "title", "iframe", "template", "svg")}
_HIDDEN = frozenset(("script", "style", "noscript", "template", "iframe", "svg", "head", "title", "textarea"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_INLINE = frozenset(("b", "i", "em", "strong", "span", "u", "font", "a", "small"))
_CLOSES_P = _BLOCK - frozenset(("br", "td", "th", "tr", "body", "html"))
#: Open elements that a tag ends when it starts again, and what that may not reach across.
_SIBLINGS = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_SPACES = re.compile(r"[ \t\r\f\v\n\xa0]+")


class Node:
    __slots__ = ("tag", "parent", "children", "parts", "chars", "tags", "link_chars", "link_tags", "density", "sum", "near", "p")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.children, self.parts = tag, parent, [], []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        # The open elements that a sibling would end, by the sibling's tag, and the paragraph that a block would.
        self.near = parent.near if parent is not None else {}
        for ends, (tags, walls) in _SIBLINGS.items():
            if tag in tags or tag in walls:
                self.near = self.near | {ends: self if tag in tags else None}
        self.p = self if tag == "p" else parent.p if parent is not None and tag in _INLINE else None


class _Tags:
    """Where the tags of a page end, in one pass: what has been looked for in vain isn't looked for again."""

    def __init__(self, page: str) -> None:
        self.page, self.gone, self.quotes = page, set(), True

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def end(self, at: int) -> int:
        """The place of the > that ends the tag whose attributes begin at `at`, -1 if none does. One within quotes doesn't,
        unless quotes of the page are so broken that a tag reaches the page's end: from there on they aren't heeded."""
        first = at
        while self.quotes:
            at = _PLAIN.match(self.page, at).end()
            if at == len(self.page):
                self.quotes = False
                break
            if self.page[at] == ">":
                return at
            close = self.find(self.page[at], at + 1)
            at = close + 1 if close > 0 else at + 1
        return self.find(">", first)


def parse(page: str) -> Node:
    """A tree of the page; unclosed and stray tags are mended as far as the densities need it. It never fails, and the time it
    takes follows the page's length."""
    root = Node("html", None)
    node, at, n = root, 0, len(page)
    tags, raw_gone, opened = _Tags(page), set(), {}

    def add(raw: str) -> None:
        if raw and not raw.isspace():
            node.parts.append(html.unescape(raw) if "&" in raw else raw)
        elif raw:
            node.parts.append(" ")

    def close(up: Node) -> Node:
        """Ends the open elements from the current one up to `up`."""
        x = node
        while x is not up.parent:
            opened[x.tag] -= 1
            x = x.parent
        return up.parent

    text = 0
    while at < n:
        start = tags.find("<", at)
        if start < 0:
            break
        if page.startswith(("<!--", "<![CDATA["), start):
            mark, ends = ("<!--", "-->") if page[start + 2] == "-" else ("<![CDATA[", "]]>")
            add(page[text:start])
            stop = tags.find(ends, start + len(mark))
            if mark != "<!--":
                add(page[start + len(mark) : stop if stop >= 0 else n])
            at = text = stop + 3 if stop >= 0 else n
            continue
        if page.startswith(("<!", "<?"), start):
            add(page[text:start])
            stop = tags.find(">", start)
            at = text = stop + 1 if stop >= 0 else n
            continue
        closing = page.startswith("</", start)
        m = _NAME.match(page, start + 1 + closing)
        stop = tags.end(m.end()) if m else -1
        if stop < 0:
            at = start + 1
            continue
        add(page[text:start])
        at = text = stop + 1
        name, empty = m[0].lower(), page[m.end() : stop].rstrip().endswith("/")
        if closing:
            if opened.get(name):
                up = node
                while up.tag != name:
                    up = up.parent
                node = close(up)
            continue
        if name == "html":
            continue
        if name in _CLOSES_P and node.p is not None:
            node = close(node.p)
        if name in _SIBLINGS and node.near.get(name) is not None:
            node = close(node.near[name])
        new = Node(name, node)
        node.children.append(new)
        node.parts.append(new)
        if name in _RAW and not empty:
            end = None if name in raw_gone else _RAW[name].search(page, at)
            if end is None:
                raw_gone.add(name)
            if name == "title":
                new.parts.append(html.unescape(page[at : end.start() if end else n]))
            at = text = end.end() if end else n
        elif name not in _VOID and not empty:
            node = new
            opened[name] = opened.get(name, 0) + 1
    add(page[text:])
    return root


def _ordered(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(reversed(x.children))
    return out


def measure(root: Node) -> Node | None:
    """Composite text density of every node and the sum over its children; the body (or the root), None without text."""
    nodes = _ordered(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    inside = {id(body)}
    for x in nodes:
        if x.parent is not None and id(x.parent) in inside and x.tag not in _HIDDEN:
            inside.add(id(x))
    for x in reversed(nodes):
        if id(x) not in inside:
            continue
        x.chars = sum(len(_SPACES.sub(" ", p).strip()) for p in x.parts if isinstance(p, str))
        for c in x.children:
            if id(c) in inside:
                x.chars += c.chars
                x.tags += c.tags + 1
                x.link_chars += c.link_chars
                x.link_tags += c.link_tags + (c.tag == "a")
        if x.tag in ("a", "button", "select"):
            x.link_chars, x.link_tags = x.chars, x.link_tags if x.tag != "a" else x.tags
    if not body.chars:
        return None
    share = body.link_chars / body.chars
    for x in nodes:
        if id(x) not in inside or not x.chars:
            continue
        tags, link_tags, link_chars, plain = max(x.tags, 1), max(x.link_tags, 1), max(x.link_chars, 1), max(x.chars - x.link_chars, 1)
        base = math.log(x.chars * x.link_chars / plain + share * x.chars + math.e)
        odds = x.chars * tags / (link_chars * link_tags)
        x.density = x.chars / tags * max(0.0, math.log(max(odds, 1.0)) / math.log(base) if base > 1 else 0.0) if base > 1 else x.chars / tags
    for x in nodes:
        if id(x) in inside:
            x.sum = sum(c.density for c in x.children if id(c) in inside)
    return body


def _text(x: Node) -> str:
    out: list[str] = []
    stack: list = [x]
    while stack:
        p = stack.pop()
        if isinstance(p, str):
            out.append(p)
        elif p is None:
            out.append("\0")
        elif p.tag not in _HIDDEN or p is x:
            if p.tag in _BLOCK:
                stack.append(None)
                out.append("\0")
            stack.extend(reversed(p.parts))
    lines = (_SPACES.sub(" ", line).strip() for line in "".join(out).split("\0"))
    return "\n".join(line for line in lines if line)


def _chosen(body: Node, nodes: list[Node], threshold: float) -> set[int]:
    """The ids of the maximum-sum nodes under the body and, from it down, under every node that reaches the threshold.

    A node of running text only stands for the block that it is part of, so no paragraph is cut within.
    """
    top: dict[int, Node] = {}
    blocks: dict[int, bool] = {}
    for x in reversed(nodes):
        best = x
        for c in x.children:
            if top[id(c)].sum > best.sum:
                best = top[id(c)]
        top[id(x)] = best
        blocks[id(x)] = x.tag in _BLOCK or any(blocks[id(c)] for c in x.children)
    depth: dict[int, int] = {}
    lift: dict[int, Node] = {}
    for x in nodes:
        inner = x is not body
        depth[id(x)] = depth[id(x.parent)] + 1 if inner else 0
        lift[id(x)] = lift[id(x.parent)] if inner and not blocks[id(x)] and x.parent is not body else x
    chosen: set[int] = set()
    stack = [body]
    while stack:
        x = stack.pop()
        best = top[id(x)]
        whole = lift[id(best)]
        chosen.add(id(whole if depth[id(whole)] >= depth[id(x)] else x))
        if best is not x:
            stack.extend(c for c in x.children if c.density >= threshold)
    return chosen


def extract(page: str) -> tuple[str, str, float]:
    """(title, text, density sum of the chosen node) of a page."""
    root = parse(page)
    title = next((_SPACES.sub(" ", "".join(p for p in x.parts if isinstance(p, str))).strip() for x in _ordered(root) if x.tag == "title"), "")
    body = measure(root)
    if body is None:
        return title, "", 0.0
    best = max((x for x in _ordered(body)), key=lambda x: x.sum)
    if best.sum <= 0:
        return title, _text(body), 0.0
    threshold, up = math.inf, best
    while up is not None:
        if up.density > 0:
            threshold = min(threshold, up.density)
        if up is body:
            break
        up = up.parent
    nodes = _ordered(body)
    chosen = _chosen(body, nodes, threshold)
    # Of a chosen subtree, blocks below the threshold go, unless a part of them reaches it.
    reaches: dict[int, bool] = {}
    for x in reversed(nodes):
        reaches[id(x)] = x.density >= threshold or any(reaches[id(c)] for c in x.children)
    kept = Node("div", None)
    stack = [(body, kept, id(body) in chosen)]
    while stack:
        x, copy, whole = stack.pop()
        for p in x.parts:
            if isinstance(p, str):
                if whole:
                    copy.parts.append(p)
            elif not whole or p.tag == "br" or p.tag not in _HIDDEN and (p.tag not in _BLOCK or reaches[id(p)]):
                new = Node(p.tag, copy)
                copy.parts.append(new)
                stack.append((p, new, whole or id(p) in chosen))
    return title, _text(kept), best.sum


def _extract(pages: pa.Array) -> pa.Array:
    rows = []
    for p in pages:
        page = p.as_py()
        title, text, total = ("", "", 0.0) if page is None else extract(page)
        rows.append({"title": title, "text": text, "density": round(total, 6)})
    return pa.array(rows, pa.struct([("title", pa.string()), ("text", pa.string()), ("density", pa.float64())]))


def extracted(pages: DataFrame, page: str = "html", out: str = "main") -> DataFrame:
    """pages with the struct column `out`: title, text of the densest subtrees, and the density sum of the first among them.

    The node with the greatest sum gives the threshold, the least density on its path to the body. From the body down, every node
    that reaches it keeps its maximum-sum subtree; nodes below it are not entered, and text beside a kept subtree goes. Within a
    kept subtree, blocks go that don't reach the threshold and hold none that does, so very short lines may go with the ads.

    Null and empty pages, and pages without text in their body, give empty texts and 0; a page without tags gives its text. Of
    nodes with equal sums the first in the document counts. Rows that repeat are extracted each, pages are parsed
    whole, in time that follows their length, a column named `out` is replaced and others stay. An empty table stays empty.
    """
    return pages.withColumn(out, F.arrow_udf(_extract, "struct<title:string,text:string,density:double>")(F.col(page)))
