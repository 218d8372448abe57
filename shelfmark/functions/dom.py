"""The two page operations that need nesting: dropping noise elements, and text by place in the tree.

A small tree over the standard library's parser, applied to Arrow batches. Everything else about pages is done with
column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd

from shelfmark.functions import fixed

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
NOISE_TAGS = set(fixed.NOISE_TAGS)
NOISE_CLASS = re.compile(fixed.NOISE_CLASSES, re.I)
HEADINGS = ("h1", "h2", "h3", "h4")
ENOUGH_TEXT = 200
CLIMB_LIMIT = 12

# What to read on which page layout: heading class, specification blocks, description block, price element.
SITE_RULES = {
    "generic": {
        "title": r"product.*title|title|entry-title",
        "specs": (("table", "dl", "div", "section"),
                  r"woocommerce-product-attributes|product-attributes|specification|tech-spec|spec|attribute|detail"),
        "description": (("div", "section"),
                        r"woocommerce-product-details__short-description|product-description|description|entry-content"),
        "price": (("span", "div", "p"), r"woocommerce-Price-amount|regular-price|mrp|price"),
        "noise": True, "climb": True,
    },
    "shopify": {
        "title": r"product.*title|title",
        "specs": (("details", "table", "div", "section"), r"accordion|spec|tab|tech|detail|overview|feature"),
        "description": (("div",), r"product.*description|description|rte"),
        "price": (("s", "del", "span", "div", "price-list"), r"price-item--regular|compare|mrp|regular-price|price-list"),
        "noise": True, "climb": True,
    },
    "croma": {"title": r"pd-title|product-title", "specs": (("tr", "li", "div"), r"spec|feature"),
              "price": (None, r"pdp__mrp|mrpPrice|old-price|was-price")},
    "reliance": {"title": r"pdp__title|product-title", "specs": (("tr", "li", "div"), r"spec|details|pdp__feature"),
                 "price": (("span",), r"product-marked-price|pdp__mrpPrice")},
    "tatacliq": {"specs": (("tr", "li", "div"), r"spec|feature|description")},
    "amazon": {},
}
_COMPILED = {
    site: {k: (v[0], re.compile(v[1], re.I)) if isinstance(v, tuple) else re.compile(v, re.I) if isinstance(v, str) else v
           for k, v in rules.items()}
    for site, rules in SITE_RULES.items()
}


class Node:
    __slots__ = ("name", "css", "parent", "children", "start", "end")

    def __init__(self, name: str, css: str, parent: "Node | None", start: int):
        self.name, self.css, self.parent, self.start, self.end = name, css, parent, start, None
        self.children: list[Node | str] = []

    def walk(self) -> Iterator["Node"]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            else:
                stack.extend(reversed(item.children))

    def spaced_text(self) -> str:
        return " ".join(s for s in (t.strip() for t in self.strings()) if s)


class _Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self._html = html
        self._lines = [0]
        for line in html.split("\n"):
            self._lines.append(self._lines[-1] + len(line) + 1)
        self.root = self._open = Node("[document]", "", None, 0)
        self.feed(html)
        self.close()
        for node in self.root.walk():
            if node.end is None:
                node.end = len(html)

    def _at(self) -> int:
        line, column = self.getpos()
        return self._lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        css = next((v or "" for k, v in attrs if k == "class"), "")
        node = Node(tag, css, self._open, self._at())
        self._open.children.append(node)
        if tag in VOID:
            node.end = node.start + len(self.get_starttag_text() or "")
        else:
            self._open = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self._open
        while node is not None and node.name != tag:
            node = node.parent
        if node is None:
            return
        at = self._at()
        while self._open is not node:
            self._open.end = at
            self._open = self._open.parent
        # the closing tag itself belongs to the element
        close = self._html.find(">", at)
        node.end = close + 1 if close >= 0 else len(self._html)
        self._open = node.parent

    def handle_data(self, data):
        if self._open.name not in ("script", "style", "template"):
            self._open.children.append(data)


def _strip_noise(root: Node) -> list[tuple[int, int]]:
    """Remove noise elements from the tree; returns the source ranges they covered."""
    gone = []
    stack = [root]
    while stack:
        node = stack.pop()
        kept = []
        for child in node.children:
            if isinstance(child, Node) and (child.name in NOISE_TAGS or (child.css and NOISE_CLASS.search(child.css))):
                gone.append((child.start, child.end))
            else:
                kept.append(child)
                if isinstance(child, Node):
                    stack.append(child)
        node.children = kept
    return gone


def _matching(root: Node, rule) -> Iterator[Node]:
    names, css = rule
    return (n for n in root.walk() if (names is None or n.name in names) and n.css and css.search(n.css))


def _measures(top: Node) -> dict[int, tuple[int, int, int]]:
    """For every node below top, and top: characters and number of its strings, and headings below it."""
    sums: dict[int, tuple[int, int, int]] = {}
    for node in reversed(list(top.walk())):  # a node's children come after it, so they are summed before
        inner = [sums[id(c)] for c in node.children if isinstance(c, Node)]
        own = [t for t in (c.strip() for c in node.children if isinstance(c, str)) if t]
        headings = sum(m[2] for m in inner) + sum(isinstance(c, Node) and c.name in HEADINGS for c in node.children)
        sums[id(node)] = (sum(map(len, own)) + sum(m[0] for m in inner), len(own) + sum(m[1] for m in inner), headings)
    return sums


def _scope_of(anchor: Node | None, root: Node) -> Node | None:
    """Where to read: the nearest element around the heading with enough text and no second heading, else the one of
    those with most; without a heading the page's main part."""
    if anchor is None:
        named = {n.name: n for n in reversed(list(root.walk())) if n.name in ("main", "body")}
        return named.get("main") or named.get("body") or root
    around, node = [], anchor.parent
    while node is not None and node.name != "[document]" and len(around) < CLIMB_LIMIT:
        around.append(node)
        node = node.parent
    sums = _measures(root)
    for node in around:  # a heading inside dropped noise
        if id(node) not in sums:
            sums |= _measures(node)
    lengths = []
    for node in around:
        characters, strings, headings = sums[id(node)]
        if headings > 1:
            break
        lengths.append(characters + max(strings - 1, 0))
    enough = next((n for n, size in zip(around, lengths) if size >= ENOUGH_TEXT), None)
    return enough or (around[lengths.index(max(lengths))] if lengths else None)


def _surroundings(anchor: Node | None, root: Node, have: int) -> str:
    """The text around the heading, where the page's own blocks say less than that and not enough."""
    scope = _scope_of(anchor, root) if have < ENOUGH_TEXT else None
    text = scope.spaced_text() if scope is not None else ""
    return text if len(text) > have else ""


def read_page(html: str, site: str) -> dict:
    rules = _COMPILED.get(site, _COMPILED["generic"])
    root = _Tree(html).root

    def first_heading() -> Node | None:
        headings = [n for n in root.walk() if n.name == "h1"]
        wanted = rules.get("title")
        return next((h for h in headings if wanted and h.css and wanted.search(h.css)), headings[0] if headings else None)

    anchor = first_heading() if site != "shopify" else None
    gone = _strip_noise(root) if rules.get("noise") else []
    if site == "shopify":
        anchor = first_heading()
    clean, at = [], 0
    for start, end in sorted(gone):
        if start >= at:
            clean.append(html[at:start])
        at = max(at, end)
    clean.append(html[at:])
    blocks = [n.spaced_text() for n in _matching(root, rules["specs"])] if "specs" in rules else []
    described = next(_matching(root, rules["description"]), None) if "description" in rules else None
    description = described.spaced_text() if described is not None else ""
    prices = ["".join(n.strings()).strip() for n in _matching(root, rules["price"])] if "price" in rules else []
    have = len(description) + sum(map(len, blocks))
    return {
        "clean_html": "".join(clean),
        "heading": "".join(anchor.strings()).strip() if anchor is not None else None,
        "description": description,
        "blocks": blocks,
        "surroundings": _surroundings(anchor, root, have) if rules.get("climb") else "",
        "price_texts": prices,
    }


COLUMNS = ("clean_html string, heading string, description string, blocks array<string>, surroundings string, "
           "price_texts array<string>")


def read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas: batches with html and site columns; the page columns are appended."""
    for batch in batches:
        read = [read_page(h or "", s or "generic") for h, s in zip(batch["html"], batch["site"])]
        extra = pd.DataFrame(read, index=batch.index, columns=[c.split()[0] for c in COLUMNS.split(", ")])
        yield pd.concat([batch.drop(columns=["html"]), extra], axis=1)
