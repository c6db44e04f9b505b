"""A small element tree of HTML, for the few operators that need one."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of the given name.
ENDS = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li td th tr".split()),
    "li": frozenset(("li",)),
    "td": frozenset(("td", "th", "tr")),
    "th": frozenset(("td", "th", "tr")),
    "tr": frozenset(("tr",)),
    "option": frozenset(("option",)),
}
SCOPES = frozenset("ul ol table body html section article div blockquote".split())


class Element:
    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Element | None = None):
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[Element | str] = []

    def walk(self) -> Iterator[Element]:
        """The elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            e = stack.pop()
            yield e
            stack += [c for c in reversed(e.children) if isinstance(c, Element)]

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                out.append(e)
            else:
                stack += reversed(e.children)
        return "".join(out)

    def inner(self) -> str:
        return "".join(escape(c, quote=False) if isinstance(c, str) else c.outer() for c in self.children)

    def outer(self) -> str:
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in self.attrs.items())
        return f"<{self.name}{attrs}>" + ("" if self.name in VOID else f"{self.inner()}</{self.name}>")

    def remove(self) -> None:
        if self.parent:
            self.parent.children.remove(self)

    def replace(self, *new: Element | str) -> None:
        siblings = self.parent.children
        at = siblings.index(self)
        siblings[at : at + 1] = new
        for n in new:
            if isinstance(n, Element):
                n.parent = self.parent


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.top = Element("#root", {})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        e = self.top
        while e.parent:
            if tag in ENDS.get(e.name, ()):
                self.top = e.parent
                if not (e.name in ("td", "th") and tag == "tr") and e.name != "p":
                    break
            elif e.name in SCOPES:
                break
            e = e.parent
        new = Element(tag, {k: v or "" for k, v in attrs}, self.top)
        self.top.children.append(new)
        if tag not in VOID:
            self.top = new

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        e = self.top
        while e.parent and e.name != tag:
            e = e.parent
        if e.parent:
            self.top = e.parent

    def handle_data(self, data: str) -> None:
        self.top.children.append(data)


def parse(html: str) -> Element:
    """The tree of a page or fragment; sloppy markup never raises."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


_SELECTOR = re.compile(r"^([a-z][a-z0-9]*)?((?:[.#][\w-]+)*)((?:\[[^\]]+\])*)$", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"\[([\w:-]+)(?:=\"?([^\"\]]*)\"?)?\]")


def matcher(selector: str) -> Callable[[Element], bool]:
    """Test of one simple selector: element, classes, id, attributes."""
    m = _SELECTOR.match(selector)
    name, marks, attributes = m[1], re.findall(r"([.#])([\w-]+)", m[2]), _ATTRIBUTE.findall(m[3])

    def test(e: Element) -> bool:
        if name and e.name != name:
            return False
        for kind, value in marks:
            if (value not in e.classes()) if kind == "." else (e.attrs.get("id") != value):
                return False
        return all(k in e.attrs and (not v or e.attrs[k] == v) for k, v in attributes)

    return test


class AnyOf:
    """Test of several simple selectors at once: one lookup for each element, class and id."""

    def __init__(self, selectors: tuple[str, ...] | list[str]):
        self.names = {s for s in selectors if s.isalnum()}
        self.classes = {s[1:] for s in selectors if re.fullmatch(r"\.[\w-]+", s)}
        self.ids = {s[1:] for s in selectors if re.fullmatch(r"#[\w-]+", s)}
        plain = self.names | {"." + c for c in self.classes} | {"#" + i for i in self.ids}
        self.others = [matcher(s) for s in selectors if s not in plain and " " not in s]

    def __call__(self, e: Element) -> bool:
        if e.name in self.names:
            return True
        if not e.attrs:
            return False
        return any(c in self.classes for c in e.classes()) or e.attrs.get("id") in self.ids or any(test(e) for test in self.others)


def select(root: Element, selector: str) -> Iterator[Element]:
    """Elements that a selector of simple parts (separated by blanks) finds, in document order."""
    *above, last = map(matcher, selector.split())
    for e in root.walk():
        if last(e):
            up, need = e.parent, list(above)
            while up is not None and need:
                if need[-1](up):
                    need.pop()
                up = up.parent
            if not need:
                yield e
