"""A small element tree over the standard HTML tokenizer, and the few selector forms in use.

Plain markup (lower-case tags, quoted attributes without references) is cut by one pattern; from the
first thing that is anything else, the standard tokenizer reads on, to the same tree.  It handles void elements, raw text, and end tags that HTML lets authors leave out (list items,
paragraphs, options, table parts).  It doesn't repair misnested formatting as a browser does.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from html import unescape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key closes an open element of the value, up to the given containers.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol menu dl select table body html td th".split())
#: Elements whose content isn't markup: left to the standard tokenizer, like all that follows.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Element:
    __slots__ = ("attrs", "children", "classes", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None, classes: frozenset[str] | None = None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.classes = frozenset(attrs.get("class", "").split()) if classes is None else classes
        self.children: list[Element | str] = []

    def descendants(self) -> Iterator[Element]:
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            e = stack.pop()
            yield e
            stack += [c for c in reversed(e.children) if isinstance(c, Element)]

    def text(self) -> str:
        """All text below, in order, as it stands."""
        out: list[str] = []
        stack: list[Element | str] = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                stack += reversed(c.children)
        return "".join(out)

    def select(self, selector: str) -> Iterator[Element]:
        """Descendants that match, in document order."""
        return matching(self.descendants(), selector)

    def first(self, selector: str) -> Element | None:
        return next(self.select(selector), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#document", {}, None)
        self.now = self.root

    def handle_starttag(self, tag, attrs):
        self._make_room(tag)
        seen: dict[str, str] = {}
        for name, value in attrs:
            seen.setdefault(name, value or "")
        self._open(tag, seen)

    def _open(self, tag: str, attrs: dict[str, str], classes: frozenset[str] | None = None) -> None:
        e = Element(tag, attrs, self.now, classes)
        self.now.children.append(e)
        if tag not in VOID:
            self.now = e

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        e: Element | None = self.now
        while e is not None and e.tag != tag:
            e = e.parent
        if e is not None and e.parent is not None:
            self.now = e.parent

    def handle_data(self, data):
        self.now.children.append(data)

    def read_plain(self, html: str) -> int:
        """Read plain markup from the start, as far as it goes: the position after it."""
        at, next_token = 0, _PLAIN.scanner(html).match
        while m := next_token():
            text, end, tag, attrs = m.groups()
            if text is not None:
                self.handle_data(unescape(text) if "&" in text else text)
            elif end:
                if attrs:
                    break
                self.handle_endtag(tag)
            else:
                if tag in RAW:
                    break
                self._make_room(tag)
                # Elements of one spelling have their own copies of its attributes.
                pairs, classes = _attributes(attrs)
                self._open(tag, dict(pairs), classes)
            at = m.end()
        return at

    def _make_room(self, tag: str) -> None:
        if tag in CLOSES:
            self._close_open(CLOSES[tag])
        elif tag in BLOCKS:
            self._close_open({"p"})

    def _close_open(self, tags: set[str]) -> None:
        e: Element | None = self.now
        while e is not None and e.parent is not None and e.tag not in tags:
            if e.tag in SCOPES or (e.tag in BLOCKS and "p" not in tags and e.tag != "p" and e.tag != "div"):
                return
            e = e.parent
        if e is not None and e.parent is not None and e.tag in tags:
            self.now = e.parent


def parse_html(html: str) -> Element:
    builder = _Builder()
    at = builder.read_plain(html)
    if at < len(html):
        builder.feed(html[at:])
        builder.close()
    return builder.root


_PLAIN = re.compile(r"""([^<]+)|<(/?)([a-z][a-z0-9]*)((?: +[a-z][a-z0-9-]*="[^"<>&]*")*)>""")
_ATTRIBUTE = re.compile(r'([a-z][a-z0-9-]*)="([^"]*)"')


@functools.lru_cache(1 << 12)
def _attributes(spelled: str) -> tuple[dict[str, str], frozenset[str]]:
    """(attributes, classes) of the plain attributes of a start tag; of two alike the first counts."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(spelled):
        found.setdefault(name, value)
    return found, frozenset(found.get("class", "").split())


_COMPOUND = re.compile(r"""(?P<tag>^[a-zA-Z][\w-]*)|\.(?P<class>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)"(?P<value>[^"]*)")?\]""")


@functools.cache
def compiled(selector: str) -> tuple:
    """Descendant steps, each of (tag, classes, attribute tests)."""
    steps = []
    for part in re.findall(r'(?:[^\s\["]|\[[^\]]*\])+', selector):
        tag, classes, tests, at = None, set(), [], 0
        while at < len(part):
            m = _COMPOUND.match(part, at) if at else re.match(_COMPOUND.pattern, part)
            if not m:
                raise ValueError(f"selector not supported: {selector}")
            if m["tag"]:
                tag = m["tag"].lower()
            elif m["class"]:
                classes.add(m["class"])
            else:
                tests.append((m["attr"], m["op"], m["value"]))
            at = m.end()
        steps.append((tag, frozenset(classes), tuple(tests)))
    return tuple(steps)


def _is(e: Element, step: tuple) -> bool:
    tag, classes, tests = step
    if (tag is not None and e.tag != tag) or not classes <= e.classes:
        return False
    for name, op, value in tests:
        have = e.attrs.get(name)
        if have is None or (op == "=" and have != value) or (op == "*=" and (not value or value not in have)):
            return False
    return True


def matching(elements: Iterable[Element], selector: str) -> Iterator[Element]:
    """The elements that match, in their order."""
    steps = compiled(selector)
    tag, classes, _ = steps[-1]
    for e in elements:
        if (tag is None or e.tag == tag) and classes <= e.classes and _matches(e, steps):
            yield e


def _matches(e: Element, steps: tuple) -> bool:
    if not _is(e, steps[-1]):
        return False
    left, up = len(steps) - 2, e.parent
    while left >= 0 and up is not None:
        if _is(up, steps[left]):
            left -= 1
        up = up.parent
    return left < 0
