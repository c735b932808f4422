"""An element tree of an HTML page, with selection by tag, id and class."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

# Elements that never hold anything.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no text.
SILENT = frozenset(("script", "style", "template"))

_REFERENCE = re.compile(r"&((?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);)?")
_SIMPLE = re.compile(r"([\w-]*)(?:#([\w-]+))?((?:\.[\w-]+)*)")


class Element:
    """A tag with its attributes and what it holds, in order: texts and elements."""

    __slots__ = ("attrs", "inner", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.inner = tag, attrs or {}, []

    def walk(self, without: frozenset[str] = frozenset()) -> Iterator[Element | str]:
        """Texts and elements below this one in document order, but the elements named; a stack, as unclosed tags nest deeply."""
        rest = self.inner[::-1]
        while rest:
            own = rest.pop()
            if isinstance(own, str):
                yield own
            elif own.tag not in without:
                yield own
                rest += own.inner[::-1]

    def matches(self, simple: str) -> bool:
        """Whether ``tag#id.class.class`` holds, each part where it is given."""
        tag, own_id, classes = _SIMPLE.fullmatch(simple).groups()
        names = (self.attrs.get("class") or "").split()
        return tag in ("", self.tag) and own_id in (None, self.attrs.get("id")) and all(c in names for c in classes.split(".")[1:])

    def select(self, selector: str) -> Iterator[Element]:
        """Elements below in document order, each once; parts apart by blanks are nested."""
        first, *more = selector.split()
        if not more:
            yield from (x for x in self.walk() if isinstance(x, Element) and x.matches(first))
            return
        seen = set()
        for outer in self.select(first):
            for x in outer.select(" ".join(more)):
                if id(x) not in seen:
                    seen.add(id(x))
                    yield x

    def first(self, selector: str) -> Element | None:
        return next(self.select(selector), None)

    def text(self, without: frozenset[str] = SILENT) -> str:
        """All text below, with a line end for ``br``, but that of the elements named."""
        return "".join(x if isinstance(x, str) else "\n" if x.tag == "br" else "" for x in self.walk(without))


class _Builder(HTMLParser):
    """Elements as their tags come: nothing closes by itself, and an end tag closes what it left open within."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("")
        self.path, self.count = [self.root], {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        element = Element(tag, own)
        self.path[-1].inner.append(element)
        if tag not in VOID:
            self.path.append(element)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        while self.count.get(tag):
            closed = self.path.pop().tag
            self.count[closed] -= 1
            if closed == tag:
                break

    def handle_data(self, data: str) -> None:
        self.path[-1].inner.append(data)


def _closed(match: re.Match) -> str:
    name = match[1]
    return match[0] if name and (name[0] == "#" or name in html5) else f"&amp;{name or ''}"


def tree(html: str | None, closed: bool = False) -> Element:
    """The root of a page; broken HTML gives what could be read of it, null an empty root.

    HTML also reads old references without a semicolon, such as ``&amp``. With ``closed`` only those with one are
    references, and any other is text.
    """
    builder = _Builder()
    builder.feed(_REFERENCE.sub(_closed, html or "") if closed else html or "")
    builder.close()
    return builder.root
