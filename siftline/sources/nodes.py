"""A small node tree over the standard library's HTML parser, for the selector jobs inside Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# an open element of the key is closed by the start of one of the values
IMPLIED_END = {"p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "section", "article"},
               "li": {"li"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th", "tr"}}
NOT_TEXT = {"script", "style", "template"}


class Node:
    _below: "list[Node] | None" = None

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None"):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator["Node"]:
        """All elements below this one in document order."""
        stack = self.children[::-1]
        while stack:
            node = stack.pop()
            if isinstance(node, Node):
                yield node
                stack += node.children[::-1]

    def texts(self) -> Iterator[str]:
        if len(self.children) == 1 and isinstance(text := self.children[0], str):
            if text := text.strip():
                yield text
            return
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                if item.strip():
                    yield item.strip()
            elif item.tag not in NOT_TEXT:
                stack.extend(reversed(item.children))

    def text(self, separator: str = " ") -> str:
        return separator.join(self.texts())

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            above, self.parent = self.parent, None
            while above is not None:
                above._below, above = None, above.parent

    def select(self, selector: str) -> Iterator["Node"]:
        tests = _alternatives(selector)
        for node in self.walk():
            for steps in tests:
                if _matches(node, steps, self):
                    yield node
                    break

    def first(self, selector: str) -> "Node | None":
        """An element is asked for many things: what is below it is walked once, and again when some of it was removed."""
        if self._below is None:
            self._below = list(self.walk())
        tests = _alternatives(selector)
        if len(tests) == 1 and len(tests[0]) == 1:
            only = tests[0][0]
            for node in self._below:
                if only(node):
                    return node
            return None
        for node in self._below:
            for steps in tests:
                if _matches(node, steps, self):
                    return node
        return None

    def first_text(self, selector: str, separator: str = " ") -> str:
        node = self.first(selector) if selector else None
        return node.text(separator) if node else ""


_STEP = re.compile(r"([#.]?[\w-]+)|\[([\w:-]+)(?:([*^]?=)[\"']?([^\"'\]]*)[\"']?)?\]")


@lru_cache(maxsize=256)
def _alternatives(selector: str) -> list[list[Callable[[Node], bool]]]:
    return [_compile(alternative) for alternative in selector.split(",")]


def _compile(selector: str) -> list[Callable[[Node], bool]]:
    """'div.card a[href]' -> one test of an element per step."""
    steps = []
    for part in selector.split():
        tests = []
        for name, attr, op, value in _STEP.findall(part):
            if attr:
                tests.append(_test(attr, op or "has", value))
            elif name.startswith("."):
                tests.append(_test("class", "word", name[1:]))
            elif name.startswith("#"):
                tests.append(_test("id", "=", name[1:]))
            else:
                tests.append(_test("", "tag", name))
        steps.append(tests[0] if len(tests) == 1 else lambda node, tests=tests: all(test(node) for test in tests))
    return steps


def _test(attr: str, op: str, value: str) -> Callable[[Node], bool]:
    if op == "tag":
        return lambda node: node.tag == value
    if op == "has":
        return lambda node: attr in node.attrs
    if op == "=":
        return lambda node: node.attrs.get(attr) == value

    def found(node: Node) -> bool:
        held = node.attrs.get(attr)
        if held is None:
            return False
        return held.startswith(value) if op == "^=" else value in held and (op == "*=" or value in held.split())

    return found


def _matches(node: Node, steps: list[Callable[[Node], bool]], root: Node) -> bool:
    if not steps[-1](node):
        return False
    wanted, above = len(steps) - 2, node.parent
    while wanted >= 0 and above is not None and above is not root.parent:
        if steps[wanted](above):
            wanted -= 1
        above = above.parent
    return wanted < 0


class _Tree:
    def __init__(self) -> None:
        self.root = Node("", {}, None)
        self.at = self.root

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        while tag in IMPLIED_END.get(self.at.tag, ()):
            self.at = self.at.parent or self.root
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent or self.root
        if node is not self.root:
            self.at = node.parent or self.root

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


class _Builder(_Tree, HTMLParser):
    def __init__(self) -> None:
        HTMLParser.__init__(self, convert_charrefs=True)
        _Tree.__init__(self)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.start(tag, {k: v or "" for k, v in attrs})

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))


# a text, an end, a whole script or style, or a start whose attributes are plain: what every parser reads the same way
_NAME = r"[a-z][a-z0-9]*+"
_ATTRIBUTES = r'((?: +[a-z][a-z0-9-]*+="[^"<>&]*+")*+)'
_PLAIN = re.compile(rf"([^<]++)|</({_NAME})>|<(script|style){_ATTRIBUTES}>([^<]*+)</\3>|<({_NAME}){_ATTRIBUTES}>")
# the last group of a text, an end and a start
_TEXT, _CLOSED, _OPENED = 1, 2, 7
_ATTRIBUTE = re.compile(r' +([a-z0-9-]+)="([^"]*)"')
# elements whose content isn't markup to HTMLParser
_OTHER_CONTENT = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


def _plain_tree(html: str) -> Node | None:
    """The tree of a page that is made of plain pieces only, else null: most of the time of a small page is HTMLParser's own."""
    tree, end = _Tree(), 0
    for piece in _PLAIN.finditer(html):
        if piece.start() != end:
            return None
        end = piece.end()
        kind = piece.lastindex
        if kind == _TEXT:
            text = piece[_TEXT]
            tree.handle_data(unescape(text) if "&" in text else text)
        elif kind == _CLOSED:
            tree.handle_endtag(piece[_CLOSED])
        elif kind == _OPENED:
            tag, attributes = piece.group(6, 7)
            if tag in _OTHER_CONTENT:
                return None
            tree.start(tag, dict(_ATTRIBUTE.findall(attributes)) if attributes else {})
        else:
            raw, raw_attributes, content = piece.group(3, 4, 5)
            tree.start(raw, dict(_ATTRIBUTE.findall(raw_attributes)))
            if content:
                tree.handle_data(content)
            tree.handle_endtag(raw)
    return tree.root if end == len(html) else None


def parse(html: str | None) -> Node:
    root = _plain_tree(html or "")
    if root is not None:
        return root
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
