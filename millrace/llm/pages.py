"""Blocks of an HTML page: a linear scan over its tags and texts.

A block is an element of BLOCK_TAGS that holds no other such element and has non-blank text, outside
elements that aren't shown. Omitted end tags are supplied as HTML5 does: a new paragraph, list item,
row or cell ends the open one. Blocks are numbered from 0 in document order.
"""

from __future__ import annotations

import re
from html import unescape

BLOCK_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p li pre td th figcaption blockquote div".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start tag ends an open paragraph.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre search section summary table ul li dd dt".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that divide a page, as opposed to those that format text.
CONTAINERS = frozenset("body div section article aside main header footer nav td form details dialog center fieldset".split())
#: Elements that are followed: all others are formatting inside a block.
FOLLOWED = BLOCK_TAGS | ENDS_PARAGRAPH | CONTAINERS | frozenset("table tr tbody thead tfoot html head".split())
DOCUMENT = frozenset(("html", "head", "body"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(?P<hidden>script|style|noscript|template|title|textarea)\b[^>]*>.*?(?:</(?P=hidden)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
#: Elements of text that is code.
CODE = frozenset(("code", "pre", "kbd", "samp", "tt"))


class Node:
    """An element that is followed, open or closed."""

    __slots__ = ("attrs", "block", "container", "has_block", "links", "name", "parent", "plain", "text")

    def __init__(self, name: str, attrs: str, parent: Node | None):
        self.name, self.attrs, self.parent, self.has_block = name, attrs, parent, False
        if name in BLOCK_TAGS:  # text goes to the nearest block around it
            self.block, self.text, self.plain, self.links = self, [], [], 0
        else:
            self.block = parent.block if parent else None
        #: The nearest element at or above this one that divides the page.
        self.container = self if name in CONTAINERS else parent.container


class Block:
    """A block: number, element name, text, text without code, letters inside links, and the container around it."""

    __slots__ = ("container", "links", "name", "node", "number", "plain", "text")

    def __init__(self, node: Node, number: int, text: str):
        self.node, self.number, self.name, self.text, self.links = node, number, node.name, text, node.links
        self.plain = text if len(node.plain) == len(node.text) else unescape("".join(node.plain))
        self.container = node.parent.container


def signs(node: Node) -> list[str]:
    """Values of the class and id attributes of an element, lower case."""
    if not node.attrs:
        return []
    return [w for m in ATTRIBUTE.finditer(node.attrs) for w in (m[1] or m[2] or m[3] or "").lower().split()]


def _close(stack: list[Node], ends: tuple[str, ...] | frozenset[str], stops: frozenset[str]) -> None:
    """End the innermost open element named in ``ends``, unless one of ``stops`` is nearer."""
    for i in range(len(stack) - 1, 0, -1):
        name = stack[i].name
        if name in ends:
            del stack[i:]
            return
        if name in stops:
            return


_LIST_STOPS = frozenset("ul ol menu td th table section article aside main blockquote body".split())
_TABLE_STOPS = frozenset(("table", "body"))
_PARAGRAPH_STOPS = frozenset("td th table li div section article aside main header footer nav blockquote ul ol figure figcaption body".split())


def blocks(html: str | None) -> list[Block]:
    """The blocks of a page in document order; a null, empty or tagless page has none."""
    if not html:
        return []
    root = top = Node("body", "", None)
    stack = [root]
    link = code = 0
    opened: list[Node] = []  # block elements in the order of their start tags

    for m in TOKEN.finditer(html):
        name = m["name"]
        if name is None:
            piece = m[0]
            if m["hidden"] is None and (piece[0] != "<" or piece == "<"):
                block = top.block
                if block is not None:
                    block.text.append(piece)
                    if not code:
                        block.plain.append(piece)
                    if link:
                        block.links += len(piece)
            continue
        name = name.lower()
        if m["end"]:
            if name == "a":
                link = 0
            elif name in CODE:
                code = max(0, code - 1)
            if name in FOLLOWED and name not in DOCUMENT:
                same = HEADINGS if name in HEADINGS else (name,)
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in same:
                        del stack[i:]
                        top = stack[-1]
                        link = code = 0
                        break
            continue
        if name not in FOLLOWED:
            if name == "a":
                link = 1
            elif name in CODE:
                code += 1
            elif name == "br" and top.block is not None:
                top.block.text.append("\n")
                top.block.plain.append("\n")
            continue
        if name in DOCUMENT:
            continue
        # Supply the end tags that were left out.
        if name == "li":
            _close(stack, ("li",), _LIST_STOPS)
        elif name in ("td", "th"):
            _close(stack, ("td", "th"), _TABLE_STOPS)
        elif name == "tr":
            _close(stack, ("tr",), _TABLE_STOPS)
        elif name in ("dd", "dt"):
            _close(stack, ("dd", "dt"), _LIST_STOPS)
        if name in ENDS_PARAGRAPH:
            _close(stack, ("p",), _PARAGRAPH_STOPS)
        if name in HEADINGS and stack[-1].name in HEADINGS:
            stack.pop()
        top = stack[-1]
        if name in VOID:
            continue
        node = Node(name, m["attrs"], top)
        if name in BLOCK_TAGS:
            up = top.block
            while up is not None and not up.has_block:
                up.has_block = True
                up = up.parent.block
            opened.append(node)
        code, link = int(name == "pre"), 0
        stack.append(node)
        top = node

    out: list[Block] = []
    for node in opened:
        if not node.has_block:
            text = "".join(node.text)
            if "&" in text:
                text = unescape(text)
            if text and not text.isspace():
                out.append(Block(node, len(out), text))
    return out
