"""A small HTML tree on html.parser, and the section parser for rendered pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from .parse import Section, resolve_href

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that end an open paragraph.
BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Tags that end an open tag of the same group, within the nearest container.
SIBLINGS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str]) -> None:
        self.name, self.attrs = name, attrs
        self.children: list[Node | str] = []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """Descendants in document order."""
        stack = self.elements()[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack += node.elements()[::-1]

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = self.children[::-1]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            else:
                stack += item.children[::-1]

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def _close(self, names: set[str] | frozenset[str], within: set[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name in within:
                return
            if self.open[k].name in names:
                del self.open[k:]
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and any(n.name == tag for n in self.open):
            return
        if tag in BLOCKS:
            self._close({"p"}, {"button", "td", "th", "table", "section", "div"})
        if tag in SIBLINGS:
            self._close(*SIBLINGS[tag])
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.open[-1].name == tag and tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse_html(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    _prune(builder.root)
    return builder.root


def _prune(root: Node) -> None:
    """Take out scripts, styles and permalink anchors."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not (c.name in ("script", "style") or c.name == "a" and c.has_class("headerlink"))]
        stack += node.elements()


def squeeze(text: str) -> str:
    """Runs of blanks to one, none after a line break, two line breaks at most."""
    for pattern, by in ((r"[ \t]+", " "), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n")):
        text = re.sub(pattern, by, text)
    return text.strip()


def is_section(node: Node) -> bool:
    return node.name == "section" or node.name == "div" and node.has_class("section")


def label(node: Node | None) -> str:
    return " ".join(s for t in node.strings() if (s := t.strip())) if node else ""


def split_html(html: str, docset: str, docname: str) -> list[Section]:
    """Sections of a page; a page without section nodes is one section of all its text, without links."""
    tree = parse_html(html)
    nodes = list(tree.walk())
    root = next((n for n in nodes if n.attrs.get("role") == "main"), None) or next((n for n in nodes if n.name == "body"), tree)
    path = f"{docname}.html"
    out: list[Section] = []
    todo = [(n, []) for n in root.elements() if is_section(n)][::-1]
    if not todo:
        header = label(next((n for n in nodes if n.name in HEADINGS[:3]), None))
        text = squeeze("\n".join(root.strings()))
        return [Section(docset, path, "", header, header, 0, 0, text, docname=docname)] if text else []
    while todo:
        node, above = todo.pop()
        anchor = node.attrs.get("id", "")
        header = label(next((c for c in node.elements() if c.name in HEADINGS), None))
        trail = [*above, header] if header else above
        own = [c for c in node.elements() if not is_section(c)]
        inner = [d for c in own for d in c.walk()]
        text = squeeze("\n".join("\n".join(c.strings()) for c in own))
        symbols = [d.attrs["id"] for d in inner if d.name == "dt" and "id" in d.attrs]
        targets = [resolve_href(d.attrs["href"], docname) for d in inner if d.name == "a" and d.has_class("reference") and d.attrs.get("href")]
        anchors = list(dict.fromkeys([*([anchor] if anchor else []), *symbols]))
        if text or anchors:
            out.append(Section(docset, path, anchor, " > ".join(trail), header, 0, 0, text, anchors, [t for t in dict.fromkeys(targets) if t], docname))
        todo += [(c, trail) for c in node.elements() if is_section(c)][::-1]
    return out
